"""Repeated byte strings, removed by means of suffix arrays sorted in two stages.

Every string of ``length`` bytes has one anchor: the leftmost of its ``gram``-byte pieces with the smallest hash. Equal
strings have equal anchors at equal places, so the strings of a text fall into contexts, one for each anchor: the bytes
of all strings that start in [lo, hi]. A context that stands in two places is repeated as a whole. Contexts that share
only the anchor come together, and the suffix array of their bytes shows which strings stand in two of them:

* directly sort only suffixes that are smaller than their successors;
* induce the others by a scan over the buckets of first bytes, from small to large;
* compute the common prefix of neighbours; ``length`` bytes or more in common mark both starts.

Anchors with more than ``most`` different contexts are not gathered: their strings are compared each by itself, as
grouped counts. Texts, anchors and contexts are named by 64-bit hashes; strings in suffix arrays are compared in full.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, byte_texts, meet, parts, running_sum, settle, span_hashes

LENGTH, GRAM, MOST, BLOCK = 400, 128, 4096, 1 << 18
_PIECE = 1 << 20
#: No byte of UTF-8 text; it ends each context.
END = b"\xff"


def contexts(text: bytes | None, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, lo, hi) of the contexts of a text, read in overlapping pieces of bounded size."""
    found: list[tuple[np.ndarray, ...]] = []
    n = len(text or b"") - length + 1  # starts of strings
    for at in range(0, n, _PIECE):
        data = np.frombuffer(text, np.uint8)[at : min(at + _PIECE, n) + length - 1]
        sums = running_sum(data)
        starts = np.arange(len(data) - gram + 1)
        hashes = span_hashes(sums, starts, starts + gram)
        anchor, size, width = starts, 1, length - gram + 1
        while size < width:  # the smallest of 1, 2, 4 ... neighbours, then of the whole width
            step = min(size, width - size)
            one, two = anchor[: len(anchor) - step], anchor[step:]
            anchor = np.where(hashes[two] < hashes[one], two, one)
            size += step
        cut = np.flatnonzero(np.diff(anchor)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(anchor) - 1]])
        place = anchor[lo]
        whole = span_hashes(sums, lo, hi + length) + (place - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        found.append((hashes[place].view(np.int64), whole.view(np.int64), lo + at, hi + at))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def suffix_array(data: bytes, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes in order of their first ``depth`` bytes, sorted in two stages."""
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    # A suffix is smaller than its successor if the next byte that differs is larger; the last one is larger than nothing.
    differs = np.flatnonzero(text[:-1] != text[1:])
    following = np.searchsorted(differs, np.arange(n))
    smaller = np.zeros(n, bool)
    inside = following < len(differs)
    spot = differs[np.minimum(following[inside], len(differs) - 1)] if len(differs) else np.empty(0, np.int64)
    smaller[inside] = text[spot] < text[spot + 1]
    direct = np.array(sorted(np.flatnonzero(smaller).tolist(), key=lambda i: data[i : i + depth]), np.int64)
    first = text[direct]
    low, high = np.searchsorted(first, np.arange(256), "left"), np.searchsorted(first, np.arange(256), "right")
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    order: list[np.ndarray] = []

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~smaller[before]]
        byte = text[before]
        sort = np.argsort(byte, kind="stable")
        before, byte = before[sort], byte[sort]
        for part in np.split(before, np.flatnonzero(np.diff(byte)) + 1):
            if len(part):
                waiting[text[part[0]]].append(part)

    for c in range(256):
        while waiting[c]:  # suffixes of this bucket that induce others of the same byte go on in rounds
            found, waiting[c] = np.concatenate(waiting[c]), []
            order.append(found)
            induce(found)
        if high[c] > low[c]:
            order.append(direct[low[c] : high[c]])
            induce(order[-1])
    return np.concatenate(order)


def common_with_next(data: bytes, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The common prefix of each suffix and the next in order, in steps of 8 bytes up to ``depth``."""
    padded = np.frombuffer(data + bytes(depth + 8), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = np.ascontiguousarray(words).view(np.uint64).ravel()
    one, two = order[:-1], order[1:]
    out = np.zeros(len(one), np.int64)
    alive = np.arange(len(one))
    for at in range(0, depth, 8):
        alive = alive[words[one[alive] + at] == words[two[alive] + at]]
        if not len(alive):
            break
        out[alive] = at + 8
    return out


def repeated_starts(texts: list[bytes], starts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each context the starts below ``starts`` whose string also starts elsewhere in the block."""
    data = END.join(texts) + END
    order = suffix_array(data, length)
    same = np.flatnonzero(common_with_next(data, order, length) >= length)
    marked = np.zeros(len(data), bool)
    marked[order[same]] = True
    marked[order[same + 1]] = True
    out, at = [], 0
    for text, n in zip(texts, starts, strict=True):
        out.append(np.flatnonzero(marked[at : at + n]))
        at += len(text) + 1
    return out


def as_runs(places: np.ndarray) -> list[list[int]]:
    """Runs [first, last] of increasing numbers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return np.stack([places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]], axis=1).tolist()


def sorted_blocks(rows: DataFrame, length: int, block: int) -> DataFrame:
    """(key, whole, first, last) of repeated starts; rows of a task are sorted by key, and whole keys fill a block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, start_of_key = 0, 0

        def out(upto: int) -> pa.RecordBatch:
            own = held[:upto]
            found = repeated_starts([r[2] for r in own], [len(r[2]) - length + 1 for r in own], length)
            lines = [(r[0], r[1], a, b) for r, places in zip(own, found, strict=True) for a, b in as_runs(places)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in lines], pa.int64()) for i in range(4)], ["key", "whole", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and row[0] != held[-1][0]:
                    start_of_key = len(held)
                    if size >= block:
                        yield out(len(held))
                        held, size, start_of_key = [], 0, 0
                held.append(row)
                size += len(row[2])
        if held:
            yield out(len(held))

    return rows.mapInArrow(read, "key long, whole long, first long, last long")


def single_strings(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many contexts: every string by its hash, counted in groups."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, whole, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                starts = np.arange(len(text) - length + 1)
                hashes = span_hashes(running_sum(np.frombuffer(text, np.uint8)), starts, starts + length)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key)), pa.array(np.full(n, whole)), pa.array(starts), pa.array(hashes.view(np.int64))], ["key", "whole", "first", "string"]
                )

    each = rows.mapInArrow(read, "key long, whole long, first long, string long")
    twice = each.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    return each.join(twice, "string").select("key", "whole", "first", F.col("first").alias("last"))


def _free(df: DataFrame) -> DataFrame:
    """Let Spark drop the shuffle files of what has been written as a table."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row, and with ``with_text`` the kept bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this or another row. Null
    texts are empty; texts shorter than ``length`` stay; of equal longer texts nothing is left. Ids may be null or
    repeated; rows are told apart by their texts, and equal rows have equal results."""
    spark = docs.sparkSession
    arrow_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    whole_rows = settle(docs.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "rows")
    classes = settle(whole_rows.groupBy("h").agg(F.count("*").alias("m"), F.min("doc_id").alias("one"), F.sum("n_bytes").alias("size")), "classes")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, found = [], []
            for h, t in zip(batch.column(0).to_pylist(), byte_texts(batch), strict=True):
                got = contexts(t, length, gram)
                found.append(got)
                hs.append(np.full(len(got[0]), h, np.int64))
            columns = [np.concatenate(hs), *(np.concatenate([f[i] for f in found]) for i in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["h", "key", "whole", "lo", "hi"])

    places = settle(docs.where(F.octet_length("text") >= length).select("h", "text").mapInArrow(anchors, "h long, key long, whole long, lo long, hi long"), "places")
    place = F.xxhash64("h", "lo")
    kinds = places.groupBy("key", "whole").agg(
        F.count("*").alias("held"), F.min(place).alias("one"), F.max(place).alias("other"), *(F.min_by(c, place).alias(c) for c in ("h", "lo", "hi"))
    )
    kinds = settle(kinds.select("key", "whole", "held", "h", "lo", "hi", (F.col("one") != F.col("other")).alias("twice")), "kinds")
    keys = settle(kinds.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("twice")).alias("alone")), "keys")
    wanted = meet(kinds, keys, ["key"], "n").where("n > 1 and alone > 0").select("h", "lo", "hi", "key", "whole", "n")
    wanted = wanted.join(classes.select("h", F.col("one").alias("doc_id")), "h")
    wanted = _free(settle(wanted.groupBy("h", "doc_id").agg(F.collect_list(F.struct("key", "whole", "n", "lo", "hi")).alias("wanted")), "wanted"))

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, rows in zip(byte_texts(batch), batch.column(batch.schema.get_field_index("wanted")).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[c] for r in rows], pa.int64()) for c in ("key", "whole", "n")), pa.array([t[r["lo"] : r["hi"] + length] for r in rows], pa.binary())],
                    ["key", "whole", "n", "bytes"],
                )

    same_row = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.h") == F.col("w.h"))
    fetched = docs.alias("d").join(wanted.alias("w"), same_row).select("text", "wanted").mapInArrow(bytes_of, "key long, whole long, n long, bytes binary")
    fetched = _free(settle(fetched, "contexts"))
    calm = fetched.where(F.col("n") <= most).select("key", "whole", "bytes")
    found = sorted_blocks(calm.repartition(parts(spark), "key").sortWithinPartitions("key"), length, block)
    # rows with one id and text give a context twice; the suffix array must not see it twice
    crowded = fetched.where(F.col("n") > most).select("key", "whole", "bytes").dropDuplicates(["key", "whole"])
    marks = settle(found.union(single_strings(crowded, length)), "marks")
    # of a context in two places all strings are repeated, of others those that are marked
    marks = marks.withColumn("held", F.lit(1)).union(kinds.where("twice").select("key", "whole", F.lit(0), F.col("hi") - F.col("lo"), "held"))
    marked = settle(marks.groupBy("key", "whole").agg(F.max("held").alias("held"), F.collect_list(F.struct("first", "last")).alias("runs")), "marked")
    # texts whose copies hold more than one byte in 1,000 are gone as a whole; their places need not travel
    size = classes.agg(F.sum("size")).first()[0] or 0
    copied = classes.where((F.col("m") > 1) & (F.col("size") * 1000 > size)).select("h")
    runs = meet(places.join(F.broadcast(copied), "h", "left_anti"), marked, ["key", "whole"], "held")
    runs = runs.select("h", "lo", F.explode("runs").alias("r")).select("h", (F.col("lo") + F.col("r.first")).alias("first"), (F.col("lo") + F.col("r.last")).alias("last"))
    single = classes.where("m = 1").select("h", F.col("one").alias("doc_id"))
    runs = runs.join(single, "h").groupBy("h", "doc_id").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    runs = _free(settle(runs, "runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            lines = []
            for t, found_runs in zip(byte_texts(batch), batch.column(at("runs")).to_pylist(), strict=True):
                spans = merged([(r["first"], r["last"] + length) for r in found_runs])
                kept = b"".join(t[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)], strict=True))
                lines.append((sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(at("doc_id")), batch.column(at("h")), pa.array([x[0] for x in lines], pa.int64()), pa.array([x[1] for x in lines], pa.int64()),
                 pa.array([x[2] for x in lines], pa.string()), pa.array([x[3] for x in lines], pa.binary())],
                ["doc_id", "h", "removed", "spans", "kept", "kept_bytes"],
            )

    joined = docs.alias("d").join(runs.alias("w"), same_row).select("d.doc_id", "d.h", "text", "runs")
    partly = joined.mapInArrow(cut, "doc_id long, h long, removed long, spans long, kept string, kept_bytes binary")
    partly = partly.select(F.col("doc_id").alias("id"), F.col("h").alias("text_h"), "removed", "spans", "kept", "kept_bytes")
    out = meet(whole_rows, classes.select("h", "m"), ["h"], "m")
    out = out.join(partly, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("text_h")), "left")
    gone = (F.col("m") > 1) & (F.col("n_bytes") >= length)
    columns = [
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    ]
    return out.select(*columns, *(["kept_bytes"] if with_text else []))


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs [start, end) of what the spans cover; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
