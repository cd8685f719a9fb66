"""Log-bilinear language model, trained in numpy with noise-contrastive estimation.

Tokens are the white-space words of a text, A-Z lower-cased, and one end. The model knows the ``words`` most frequent
ones; any other word is one of ``endings`` classes by its last two bytes, and within its class it has its share of the
counts. With r the vectors of the two words before, a token w scores (r1 C1 + r2 C2) . r_w + b_w.

The score is a sum over the two words of context, so its exponential is a product, and one matrix product gives the
normaliser of every pair of context words. Scoring a token reads three table cells and one normaliser: probabilities
are normalised over the whole vocabulary, in closed form.

Counts cover all training documents. Training reads all of them too: each task descends over its own tokens from the
same start, and the parameters are averaged by tokens, as sums per parameter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, byte_texts, settle

WORDS, ENDINGS, SIZE = 1024, 128, 24
#: So many of the most frequent words are known to every task; longer words than LONGEST are not among them.
KNOWN, LONGEST = 1 << 17, 64
NOISE, STEP, RATE, ROUNDS, CHUNK = 64, 4096, 0.15, 1, 1 << 20
END = b""


def tokens(text: bytes | None) -> list[bytes]:
    return [*text.lower().split(), END] if text else [END]


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of ``docs``; the end is the empty word. Counted within tasks first, in bounded tables."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in byte_texts(batch):
                counts.update(tokens(text))
            if len(counts) > 300_000:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


@dataclass
class Counts:
    """Totals of the training tokens, the most frequent words in order, and the totals of each class of endings."""

    total: int
    distinct: int
    known: list[tuple[bytes, int]]
    class_total: np.ndarray
    class_distinct: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def in_class(self, c: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.class_total[kind] + 0.5 * (self.class_distinct[kind] + 1)))


def summary(counts: DataFrame, known: int = KNOWN, words: int = WORDS) -> Counts:
    """Reads the bounded part of the counts: the totals, ``known`` words and one row for each class."""
    short = counts.where(F.octet_length("word") <= LONGEST)
    top = [(bytes(r["word"]), r["c"]) for r in short.orderBy(F.desc("c"), "word").limit(known).toArrow().to_pylist()]
    kind = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(ENDINGS)).cast("int")
    by_class = counts.groupBy(kind.alias("kind")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    total, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for row in by_class:
        total[row["kind"]], distinct[row["kind"]] = row["c"], row["n"]
    n, v = int(total.sum()), int(distinct.sum())
    for word, c in top[:words]:
        total[ending(word)] -= c
        distinct[ending(word)] -= 1
    return Counts(n, v, top, total, distinct)


def vocabulary(counts: Counts, words: int = WORDS) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the model's words, and the share of each number in the training tokens; classes follow the words."""
    top = counts.known[:words]
    mass = np.concatenate([[c for _, c in top], np.zeros(words - len(top)), counts.class_total]) + 0.5
    return {w: i for i, (w, _) in enumerate(top)}, mass / mass.sum()


def numbers(words: list[bytes], ids: dict[bytes, int], width: int = WORDS) -> list[int]:
    get = ids.get
    return [i if (i := get(w, -1)) >= 0 else width + zlib.crc32(w[-2:]) % ENDINGS for w in words]


class Model:
    """Vectors r (a row for each number), context matrices c1 and c2 (of the nearer and the farther word), biases b."""

    def __init__(self, share: np.ndarray, size: int = SIZE, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.share = share
        self.r = rng.normal(0, 0.1, (len(share), size)).astype(np.float32)
        self.c1, self.c2 = (np.eye(size, dtype=np.float32) * s for s in (0.5, 0.3))
        self.b = np.log(share).astype(np.float32)
        self.squares = {k: np.full_like(getattr(self, k), 1e-3) for k in ("r", "c1", "c2", "b")}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in ("r", "c1", "c2", "b")])

    def set_flat(self, values: np.ndarray) -> Model:
        at = 0
        for k in ("r", "c1", "c2", "b"):
            old = getattr(self, k)
            setattr(self, k, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def descend(self, name: str, gradient: np.ndarray, rate: float) -> None:
        self.squares[name] += gradient * gradient
        getattr(self, name)[...] -= rate * gradient / np.sqrt(self.squares[name])

    def learn(self, far: np.ndarray, near: np.ndarray, word: np.ndarray, weight: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        """One step on weighted trigrams: tell the word from NOISE words drawn by their share."""
        noise = rng.choice(len(self.share), NOISE, p=self.share)
        one, two = self.r[near], self.r[far]
        guess = one @ self.c1 + two @ self.c2
        log_noise = np.log(NOISE * self.share).astype(np.float32)
        true = np.einsum("ij,ij->i", guess, self.r[word]) + self.b[word] - log_noise[word]
        false = guess @ self.r[noise].T + (self.b - log_noise)[noise]
        scale = (weight / weight.sum()).astype(np.float32)
        up = scale * (1 / (1 + np.exp(-np.clip(true, -30, 30))) - 1)
        down = scale[:, None] / (1 + np.exp(-np.clip(false, -30, 30)))
        d_guess = up[:, None] * self.r[word] + down @ self.r[noise]
        d_r = np.zeros_like(self.r)
        add_rows(d_r, word, up[:, None] * guess)
        add_rows(d_r, near, d_guess @ self.c1.T)
        add_rows(d_r, far, d_guess @ self.c2.T)
        add_rows(d_r, noise, down.T @ guess)
        d_b = np.bincount(word, up, len(self.b)) + np.bincount(noise, down.sum(axis=0), len(self.b))
        d_c1, d_c2 = one.T @ d_guess, two.T @ d_guess
        for name, gradient in (("r", d_r), ("c1", d_c1), ("c2", d_c2), ("b", d_b.astype(np.float32))):
            self.descend(name, gradient, rate)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, norm) of log10: P(w | far, near) = 10 ** (near[n, w] + far[f, w] - norm[f, n])."""
        near = (self.r @ self.c1) @ self.r.T + self.b
        far = (self.r @ self.c2) @ self.r.T
        near -= near.max(axis=1, keepdims=True)
        far -= far.max(axis=1, keepdims=True)
        norm = np.exp(far, dtype=np.float32) @ np.exp(near, dtype=np.float32).T
        scale = np.float32(1 / math.log(10))
        return near * scale, far * scale, np.log10(np.maximum(norm, 1e-30))


def add_rows(target: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """target[rows] += values with repeated rows."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
    target[rows[starts]] += np.add.reduceat(values[order], starts, axis=0)


def trigrams(texts: list[list[int]], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(far, near, word) of each token; before a text stand two ends."""
    sizes = np.array([len(t) for t in texts])
    word = np.fromiter((i for t in texts for i in t), np.int64, sizes.sum())
    near, far = np.empty_like(word), np.empty_like(word)
    near[1:], far[2:] = word[:-1], word[:-2]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    near[starts] = end
    far[starts] = end
    second = starts[sizes > 1] + 1
    far[second] = end
    return far, near, word


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """The averaged model; every round reads all of ``docs``. Without tokens it is the model of the shares."""
    spark = docs.sparkSession
    ids, share = vocabulary(counts)
    model = Model(share)
    if not counts.total:
        return model
    end, width = ids.get(END, 0), len(share)
    for round_ in range(rounds):
        sent = spark.sparkContext.broadcast((ids, share, model.flat()))

        def descend(batches: Iterator[pa.RecordBatch], sent=sent, round_=round_) -> Iterator[pa.RecordBatch]:
            ids, share, start = sent.value
            own = Model(share).set_flat(start)
            rng = np.random.default_rng(round_)
            seen, held, size = 0, [], 0

            def learn() -> None:
                far, near, word = trigrams(held, end)
                codes, weight = np.unique((far * width + near) * width + word, return_counts=True)
                order = rng.permutation(len(codes))
                for at in range(0, len(order), STEP):
                    part = codes[order[at : at + STEP]]
                    own.learn(part // (width * width), part // width % width, part % width, weight[order[at : at + STEP]].astype(np.float32), rng)

            for batch in batches:
                for text in byte_texts(batch):
                    held.append(numbers(tokens(text), ids))
                    size += len(held[-1])
                    if size >= CHUNK:
                        learn()
                        seen, held, size = seen + size, [], 0
            if held:
                learn()
                seen += size
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([own.flat().astype(np.float64)], pa.list_(pa.float64())), pa.array([float(seen)])], ["p", "n"])

        found = docs.select("text").mapInArrow(descend, "p array<double>, n double")
        sums = found.select(F.posexplode("p").alias("i", "v"), "n").groupBy("i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
        table = sums.toArrow()
        values = np.zeros(len(model.flat()))
        values[table.column("i").to_numpy()] = table.column("v").to_numpy()
        model.set_flat(values)
    return model


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``, learned from ``training``.

    Null texts are empty: one token, the end. Ids may be null or repeated; rows are numbered, so repeated rows are
    scored each. Words that not every task knows are counted per row and find their counts by a join. Without
    training texts every token is unseen. Whole texts are read in batches; other columns are not read."""
    spark = docs.sparkSession
    arrow_batches(spark)
    training = training.select(F.col(text_col).alias("text"))
    counted = settle(token_counts(training), "counts")
    counts = summary(counted)
    model = train(training, counts, rounds)
    sent = spark.sparkContext.broadcast((counts, model.share, model.flat()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, share, flat = sent.value
        near_t, far_t, norm_t = Model(share).set_flat(flat).tables()
        ids, _ = vocabulary(counts)
        end = ids.get(END, 0)
        place = {w: i for i, (w, _) in enumerate(counts.known)}
        c = np.array([n for _, n in counts.known], float)
        kind = np.array([ending(w) for w, _ in counts.known], np.int64)
        base = counts.base(c)
        within = counts.in_class(c, kind)
        within[: len(ids)] = 0.0
        number = np.concatenate([np.arange(len(ids)), WORDS + kind[len(ids) :]]).astype(np.int64)
        get = place.get
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in byte_texts(batch):
                words = tokens(text)
                at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                seen = at >= 0
                word = np.empty(len(words), np.int64)
                word[seen] = number[at[seen]]
                rare: Counter[bytes] = Counter()
                for i in np.flatnonzero(~seen).tolist():
                    word[i] = WORDS + ending(words[i])
                    rare[words[i]] += 1
                near = np.concatenate([[end], word[:-1]])
                far = np.concatenate([[end], near[:-1]])
                fit = near_t[near, word].sum(dtype=float) + far_t[far, word].sum(dtype=float) - norm_t[far, near].sum(dtype=float)
                for column, value in zip(out, (len(words), int(seen.sum()), base[at[seen]].sum(), fit + within[at[seen]].sum(), list(rare), list(rare.values())), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["doc_id", "n_tokens", "known", "base", "fit", "words", "times"])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.mapInArrow(score, f"doc_id {doc_type}, n_tokens long, known long, base double, fit double, words array<binary>, times array<long>")
    rows = settle(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    rare = rows.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    joined = rare.join(counted, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)).cast("double"))
    kind = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(ENDINGS)).cast("int")
    base_norm = math.log10(counts.total + 0.5 * (counts.distinct + 1))
    norms = F.array(*[F.lit(float(x)) for x in np.log10(counts.class_total + 0.5 * (counts.class_distinct + 1))])
    log_count = F.log10(F.col("c") + 0.5)
    sums = joined.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * (log_count - base_norm)).alias("more_base"),
        F.sum(F.col("n") * (log_count - F.get(norms, kind))).alias("more_fit"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return rows.select("rid", "doc_id", "n_tokens", "known", "base", "fit").join(sums, "rid", "left").select(
        "doc_id", "n_tokens", plus("known", "more").cast("long").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("fit", "more_fit").alias("score"),
    )
