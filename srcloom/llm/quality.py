"""Quality classifier: naive Bayes support vectors.

A text is the set of its byte n-grams (2 to 4 bytes, hashed into a fixed number of places). Indicators are scaled by
the log ratio of their counts in the two classes, the vector is brought to length one, and a linear model with hinge
loss is fitted by dual coordinate descent. A logistic function of the margin, fitted on rows kept aside, is the score.

The fit uses at most ``per_class`` labelled ids of each class, so it has a fixed size; every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, by_name, by_place, byte_texts, labelled_ids, labelled_sample, logistic_fit, remainder

PLACES = 1 << 18
GRAMS = (2, 3, 4)
_PIECE = 1 << 20


def indicators(text: bytes | None, marks: np.ndarray) -> np.ndarray:
    """Places of the n-grams that a text has, each once, in order. ``marks``: PLACES zeros, left as they were."""
    if not text:
        return np.empty(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data), _PIECE):  # pieces overlap, so no n-gram is lost
        piece = data[start : start + _PIECE + max(GRAMS) - 1].astype(np.uint32)
        for n in GRAMS:
            if len(piece) < n:
                continue
            code = piece[: len(piece) - n + 1].copy()
            for i in range(1, n):
                code = (code << np.uint32(8)) | piece[i : len(piece) - n + 1 + i]
            marks[((code + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(14)] = True
    found = np.flatnonzero(marks)
    marks[found] = False
    return found


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.ones(PLACES), np.ones(PLACES)]
    for row, label in zip(rows, y, strict=True):
        counts[label][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """w of min 1/2 |w|^2 + cost * sum of hinge losses, over the scaled rows; the last place is the intercept."""
    w = np.zeros(PLACES + 1)
    sign = np.where(y == 1, 1.0, -1.0)
    cost_of = np.where(y == 1, cost * len(y) / max(1, 2 * (y == 1).sum()), cost * len(y) / max(1, 2 * (y == 0).sum()))
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            values = scaled(rows[i], ratios)  # anew each time: the rows are most of the memory already
            gradient = sign[i] * (w[rows[i]] @ values + w[-1]) - 1
            new = min(max(alpha[i] - gradient / (values @ values + 1), 0.0), cost_of[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def scaled(row: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[row]
    length = np.sqrt(values @ values)
    return (values / length if length else values).astype(np.float32)


def quality_model(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, per_class: int = 2500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-count ratios, weights, logistic weights). With no labels or one class only, a model that accepts all.

    Null texts, null ids and labels other than 0 and 1 are not learned from; an id labelled both ways is 1; rows of one
    id, equal or not, are learned from each, within the bound of ``per_class``."""
    arrow_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", remainder("doc_id", modulus) != held, per_class)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(PLACES, bool)
        for batch in batches:
            rows = [indicators(t, marks).astype(np.int32).tobytes() for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], ["places", "y", "turn"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fitted(list(batches))
        if model is not None:
            ratios, w, logistic, ones, zeros = model
            fields = [ratios.tobytes(), w.tobytes(), logistic.tobytes(), ones, zeros]
            yield pa.RecordBatch.from_arrays([pa.array([f]) for f in fields], ["ratios", "w", "logistic", "ones", "zeros"])

    # ids may repeat among documents: the limit holds the number of rows to the bound, and one task fits on them, so
    # that only the model comes to the driver
    bounded = sample.select("text", "y", "turn").mapInArrow(read, "places binary, y int, turn long").orderBy("turn", "places").limit(2 * per_class)
    found = bounded.coalesce(1).mapInArrow(fit, "ratios binary, w binary, logistic binary, ones long, zeros long").collect()
    if not found:
        return np.zeros(PLACES, np.float32), np.zeros(PLACES + 1, np.float32), np.array([0.0, 3.0])
    ratios, w, logistic = (np.frombuffer(found[0][c], t).copy() for c, t in (("ratios", np.float32), ("w", np.float32), ("logistic", np.float64)))
    # the sample holds the classes in other shares than the labels; the score is for the shares of the labels
    shares = labelled_ids(labels, "quality", remainder("doc_id", modulus) != held).agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    logistic[1] += np.log(max(1, shares[0]) / max(1, shares[1])) - np.log(max(1, found[0]["ones"]) / max(1, found[0]["zeros"]))
    return ratios, w, logistic


def _fitted(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int] | None:
    """(log-count ratios, weights, logistic weights, rows kept aside of label 1, of label 0); None with one class only."""
    rows = [np.frombuffer(b.as_buffer(), np.int32) for batch in batches for b in batch.column(0)]  # views, no copies
    y, turn = (np.array([v for batch in batches for v in batch.column(c).to_pylist()], np.int64) for c in (1, 2))
    fit = (turn % 4) != 0
    if len({*y[fit].tolist()}) < 2 or len({*y[~fit].tolist()}) < 2:
        return None
    chosen = np.flatnonzero(fit)
    ratios = log_count_ratios([rows[i] for i in chosen], y[chosen])
    w = dual_descent([rows[i] for i in chosen], y[chosen], ratios)
    aside = np.flatnonzero(~fit)
    logistic = logistic_fit(np.array([[margin(rows[i], ratios, w)] for i in aside]), y[aside].astype(float), ridge=1e-2)
    return ratios.astype(np.float32), w.astype(np.float32), logistic, int(y[aside].sum()), int((1 - y[aside]).sum())


def margin(row: np.ndarray, ratios: np.ndarray, w: np.ndarray) -> float:
    return float(w[row] @ scaled(row, ratios) + w[-1])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id and score (0 to 1, higher is better) of each row; ``keep`` names columns to carry along instead of the id.

    Null and empty texts have no n-gram and get the score of the intercept. Ids may be null or repeated; a kept column
    named score gives way to the score; an empty table gives an empty one. The model is some 2 MB whatever the data."""
    columns = ["doc_id"] if keep is None else keep
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) if keep is None else docs
    return by_name(_scored(docs, columns, "text" if keep is None else text_col, model), columns, ("score",))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows with a score of ``least`` or more, with all their columns as they are, whatever their names.

    Each row is judged by its text alone, so ids may be null or repeated, and equal texts stay or go together."""
    return by_name(_scored(docs, docs.columns, text_col, model).where(F.col("score") >= least), docs.columns)


def _scored(docs: DataFrame, columns: list[str], text_col: str, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """The columns by their places, and score."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    text = f"c{columns.index(text_col)}" if text_col in columns else "text"
    docs = by_place(docs, columns, **({} if text_col in columns else {"text": F.col(f"`{text_col}`")}))
    out = [f"c{i}" for i in range(len(columns))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, w, logistic = sent.value
        marks = np.zeros(PLACES, bool)
        for batch in batches:
            margins = np.array([margin(indicators(t, marks), ratios, w) for t in byte_texts(batch, text)])
            p = 1 / (1 + np.exp(-np.clip(margins * logistic[0] + logistic[1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in out), pa.array(p, pa.float64())], [*out, "score"])

    fields = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in out)
    return docs.mapInArrow(score, f"{fields}, score double")
