"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols: insult, threat, target, negation, report, or other. Small transducers read a clause and give
a factor for each word; a word's weight is the product of the factors of all of them:

* insult and threat pass their symbols' weights on (of an insult the learned one) and stop all other words;
* target raises what stands within a few words after a person or a form of address; threats without a target count nothing;
* negation lowers what follows it within a few words;
* reported speech lowers the rest of its clause.

``compose`` builds the product machine of any two of them; the grammar is two products. The target may also follow, so
one of them reads each clause from the end, and the better of the two readings is the word's. Clauses end at . ! ? ; :
and line ends. A document's features are the best clause, the sum of its clauses and the number of clauses with a match;
a logistic function of them is the score. The insult symbols and their weights are learned from labelled rows, as words
and as word beginnings, so that forms not seen before are matched too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, byte_texts, labelled_ids, labelled_sample, logistic_fit, remainder

# The closed word classes of the grammar, in English, German, French and Spanish.
THREATS = "kill hurt destroy beat burn murder töten schlagen vernichten tuer frapper détruire matar golpear destruir"
TARGETS = "you your yours yourself they them he she people du dich dir ihr euch sie tu toi vous ils elle usted ustedes tú ellos"
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás tampoco"
REPORTS = "said says quoted claimed reported wrote according sagte schrieb laut dit écrit selon dijo escribió según"

STEMS = (4, 5, 6, 7)
TARGET_REACH, NEGATION_REACH = 4, 3
TARGET_GAIN, NEGATION_LOSS, REPORT_LOSS = 1.25, 0.5, 0.7
THREAT_WEIGHT = 1.0
_CLAUSES = re.compile(rb"[.!?;:\n]+")
_WORD_TABLE = bytes(
    c if 97 <= c <= 122 or c >= 128 or c == 39 or c in b".!?;:\n" else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_PLAIN_TABLE = bytes(32 if c in b".!?;:\n" else t for c, t in enumerate(_WORD_TABLE))


# Symbols of the grammar.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6


def _letters(words: str) -> list[bytes]:
    return [w.encode() for w in words.split()]


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer that starts in state 0: ``step[state][symbol]`` is the next state and
    ``factor[state][symbol]`` what the word is multiplied with."""

    step: list[list[int]]
    factor: list[list[float]]

    def run(self, symbols: Sequence[int]) -> list[float]:
        state, out = 0, []
        for x in symbols:
            out.append(self.factor[state][x])
            state = self.step[state][x]
        return out


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The product machine, of the states that can be reached: it walks both and multiplies their factors."""
    states, step, factor = {(0, 0): 0}, [], []
    order = [(0, 0)]
    for i, j in order:
        nexts = []
        for x in range(SYMBOLS):
            pair = (a.step[i][x], b.step[j][x])
            if pair not in states:
                states[pair] = len(order)
                order.append(pair)
            nexts.append(states[pair])
        step.append(nexts)
        factor.append([a.factor[i][x] * b.factor[j][x] for x in range(SYMBOLS)])
    return Transducer(step, factor)


def within(symbol: int, reach: int, near: list[float], far: list[float]) -> Transducer:
    """Counts words since the symbol: up to ``reach`` words after it factors are ``near``, else ``far``."""
    states = range(reach + 1)  # state 0: out of reach; state i: i words of the reach are left
    return Transducer(
        [[reach if x == symbol else max(i - 1, 0) for x in range(SYMBOLS)] for i in states], [near if i else far for i in states]
    )


def weigher() -> Transducer:
    """Insults and threats: one state, which lets the two symbols pass and no other."""
    return Transducer([[0] * SYMBOLS], [[1.0 if x in (INSULT, THREAT) else 0.0 for x in range(SYMBOLS)]])


def targeted() -> Transducer:
    """What is near a target gains; a threat that is not counts nothing."""
    far = [1.0] * SYMBOLS
    far[THREAT] = 0.0
    return within(TARGET, TARGET_REACH, [TARGET_GAIN] * SYMBOLS, far)


def negated() -> Transducer:
    return within(NEGATION, NEGATION_REACH, [NEGATION_LOSS] * SYMBOLS, [1.0] * SYMBOLS)


def reported() -> Transducer:
    """Two states: before and after a verb of saying."""
    return Transducer([[int(x == REPORT) for x in range(SYMBOLS)], [1] * SYMBOLS], [[1.0] * SYMBOLS, [REPORT_LOSS] * SYMBOLS])


#: What is read from left to right without targets, the targets before a word and, read from the end, those after it.
FORWARD = compose(compose(weigher(), negated()), reported())
BEFORE = compose(FORWARD, targeted())
AFTER = targeted()


class Grammar:
    """The composed machines and the words of each symbol. ``insults`` maps words and, with a final '*', word beginnings
    to weights; a word that is an insult and of another class is an insult."""

    def __init__(self, insults: dict[bytes, float]):
        self.words = {k: v for k, v in insults.items() if not k.endswith(b"*")}
        self.stems = {k[:-1]: v for k, v in insults.items() if k.endswith(b"*")}
        classes = ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS))
        self.symbols = {w: x for x, words in classes for w in _letters(words)}
        self.threats = frozenset(_letters(THREATS))

    def insult(self, word: bytes) -> float:
        weight = self.words.get(word, 0.0)
        if not weight and len(word) >= STEMS[0]:
            for n in STEMS:
                if n <= len(word) and (w := self.stems.get(word[:n], 0.0)) > weight:
                    weight = w
        return weight

    def clause(self, words: list[bytes], weights: dict[bytes, float]) -> float:
        """The sum of the weights of a clause's words: each by the better of its two readings."""
        symbols = [INSULT if w in weights else self.symbols.get(w, OTHER) for w in words]
        if INSULT not in symbols and THREAT not in symbols:
            return 0.0
        plain, before, after = FORWARD.run(symbols), BEFORE.run(symbols), AFTER.run(symbols[::-1])[::-1]
        return sum(
            (weights[w] if x == INSULT else THREAT_WEIGHT) * max(b, p * a)
            for w, x, p, b, a in zip(words, symbols, plain, before, after, strict=True)
            if p
        )

    def features(self, text: bytes | None) -> tuple[float, float, int]:
        """(best clause, sum of clauses, clauses with a match) of a whole text; null and empty texts have none."""
        if not text:
            return 0.0, 0.0, 0
        seen = set(text.translate(_PLAIN_TABLE).split())
        found = {w: s for w in seen if (s := self.insult(w))}
        if not found and self.threats.isdisjoint(seen):
            return 0.0, 0.0, 0
        scores = []
        for clause in _CLAUSES.split(text.translate(_WORD_TABLE)):
            if score := self.clause(clause.split(), found):
                scores.append(score)
        return (max(scores), sum(scores), len(scores)) if scores else (0.0, 0.0, 0)


def inputs(best: float, total: float, n: int) -> list[float]:
    return [best, math.log1p(total), math.log1p(n)]


def learn_insults(sample: DataFrame, bound: float = 2.0) -> dict[bytes, float]:
    """Words and beginnings that toxic rows have more often: the lower bound of their log odds is the weight.

    Documents are counted, each word once. The table is bounded by the words of the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(byte_texts(batch), batch.column(1).to_pylist(), strict=True):
                words = set(text.translate(_PLAIN_TABLE).split())
                words |= {w[:n] + b"*" for w in words for n in STEMS if len(w) > n}
                counts[y].update(words)
                counts[y][b""] += 1
        keys = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["key", "clean", "toxic"]
        )

    counts = (
        sample.select("text", "y").mapInArrow(count, "key binary, clean long, toxic long")
        .groupBy("key").agg(F.sum("clean").alias("q"), F.sum("toxic").alias("p"))
    )
    size = counts.where("key = cast('' as binary)").first()
    if size is None:
        return {}
    odds = F.log((F.col("p") + 0.5) / (size["p"] + 1.0)) - F.log((F.col("q") + 0.5) / (size["q"] + 1.0))
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    table = counts.where("key <> cast('' as binary)").select("key", (odds - 1.5 * error).alias("weight")).where(F.col("weight") >= bound)
    return {bytes(r["key"]): r["weight"] for r in table.collect()}


def toxicity_model(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, per_class: int = 6000) -> tuple[dict[bytes, float], list[float]]:
    """Insult weights from three quarters of the sample, the score's weights from the rest.

    The intercept is that of the label shares of all training ids, so a score of 0.5 means the same whether
    ``per_class`` binds or not."""
    arrow_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", remainder("doc_id", modulus) != held, per_class)
    rest = F.pmod("turn", F.lit(4)) == 0
    insults = learn_insults(sample.where(~rest))
    grammar = Grammar(insults)

    def measure(batches):
        for batch in batches:
            rows = [grammar.features(t) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(3)] + [batch.column(1)], ["best", "total", "n", "y"])

    seen = sample.where(rest).select("text", "y").mapInArrow(measure, "best double, total double, n double, y int").limit(2 * per_class).collect()
    x = np.array([inputs(r["best"], r["total"], r["n"]) for r in seen]).reshape(-1, 3)
    y = np.array([r["y"] for r in seen], float)
    weights = logistic_fit(x, y) if len(seen) else np.array([1.0, 0.0, 0.0, -2.0])
    # the sample holds the classes in other shares than the labels; the score is for the shares of the labels
    if 0 < y.sum() < len(y):
        shares = labelled_ids(labels, "toxic", remainder("doc_id", modulus) != held).agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
        weights[-1] += np.log(shares[0] / shares[1]) - np.log(y.sum() / (1 - y).sum())
    return insults, [float(w) for w in weights]


def score_toxicity(docs: DataFrame, model: tuple[dict[bytes, float], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), best_clause and n_clauses.

    Null and empty texts have no clause and get the score of a text without matches. Whole texts are read in Arrow
    batches; ids may be null or repeated; other columns are not read."""
    insults, weights = model
    arrow_batches(docs.sparkSession)
    w = np.array(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(insults)
        for batch in batches:
            rows = [grammar.features(t) for t in byte_texts(batch)]
            x = np.array([[*inputs(*r), 1.0] for r in rows]).reshape(-1, 4)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())],
                ["doc_id", "score", "best_clause", "n_clauses"],
            )

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, best_clause double, n_clauses long")
