"""How filters act on each other, from sorted posting lists.

Each part (source) has a posting list per filter: the sorted ids of its rows that fail it. Ids are cut by range over
tasks and into blocks of bounded size; within a block unions and differences are galloping merges of the lists, and
only their sizes travel. Sizes of all unions and of each filter's list less each union of others tell, for every order of
the filters, what each step removes.

``audit`` takes any table of (id, part, mask). ``text_flags`` and ``with_repeats`` make the masks of five text filters.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, byte_texts, parts, settle
from srcloom.llm.galloping import common, difference, union

LETTERS = "ABCDE"
BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_REST = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point


def words_of(text: bytes, piece: int = 1 << 20) -> tuple[int, int]:
    """(words, distinct words); the text is cut at white space, so lists of words stay short."""
    n, seen, at = 0, set(), 0
    while at < len(text):
        cut = _SPACE.search(text, at + piece)
        end = cut.end() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_mask(text: bytes, least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5) -> int:
    """Bits 0 to 3: too few words, too few distinct words, too many capitals, a symbol of ``#$%&*|`` (percentages)."""
    words, distinct = words_of(text)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _REST))
    symbols = len(text.translate(None, _SYMBOLS)) < len(text)
    return (words < least_words) | (100 * distinct < least_distinct * words) << 1 | (100 * capitals > most_capitals * points) << 2 | symbols << 3


def text_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, digest) of each row; null texts and parts are empty strings. Whole texts, one pass."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text_mask(t) for t in texts], pa.int32()), pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())],
                ["id", "part", "mask", "digest"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return rows.mapInArrow(flag, f"id {kind}, part string, mask int, digest binary")


def with_repeats(flags: DataFrame, bit: int = 4, hot: int = 1000) -> DataFrame:
    """(id, part, mask): the mask has ``bit`` where a smaller id has the same digest; a null id is not smaller or larger.

    Digests with more than one row in ``hot`` are fewer than ``hot``; they are broadcast, so no task gathers a large
    group. All others meet their smallest id by a join in which no key has more than that share of rows."""
    flags = settle(flags, "flags")
    least = settle(flags.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n")), "texts")
    total = least.agg(F.sum("n")).first()[0] or 0
    least = least.where("least < most")
    large = F.broadcast(least.where(F.col("n") * hot > total).select("digest", F.col("least").alias("large")))
    others = least.where(F.col("n") * hot <= total).select(F.col("digest").alias("key"), F.col("least").alias("small"))
    # rows whose smallest id is known go on under keys of their own that meet nothing
    key = F.when(F.col("large").isNull(), F.col("digest")).otherwise(F.concat(F.lit("id").cast("binary"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    joined = flags.join(large, "digest", "left").withColumn("key", key).join(others, "key", "left")
    smaller = F.coalesce(F.col("id") > F.coalesce("large", "small"), F.lit(False))
    return joined.select("id", "part", (F.col("mask") + F.when(smaller, 1 << bit).otherwise(0)).alias("mask"))


def block_sizes(part: np.ndarray, mask: np.ndarray, rows: np.ndarray, marks: list[np.ndarray], n_parts: int, filters: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(subset, filter, sizes): for filter -1 of the union of the subset's lists (of all rows for the empty subset),
    else of the filter's list less that union. Sizes are per part and weighted by ``rows``: of all, and of each mark's.

    Entries are in order of (part, id), so a list over all parts is the parts' lists one after the other. ``marks`` are
    sorted lists of entries."""
    lists = [np.flatnonzero(mask >> f & 1) for f in range(filters)]

    def sizes(places: np.ndarray) -> np.ndarray:
        of = [places, *(places[common(places, m)[0]] for m in marks)]
        return np.stack([np.bincount(part[p], weights=rows[p], minlength=n_parts) for p in of]).astype(np.int64)

    yield 0, -1, sizes(np.arange(len(part)))
    for subset in range(1 << filters):
        inside = [f for f in range(filters) if subset >> f & 1]
        both = union([lists[f] for f in inside])
        if subset:
            yield subset, -1, sizes(both)
        for f in range(filters):
            if f not in inside:
                yield subset, f, sizes(difference(lists[f], both))


def audit(rows: DataFrame, marks: DataFrame, letters: str = LETTERS, block: int = BLOCK) -> DataFrame:
    """One row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, a column ``<mark>_lost`` for each mark, shapley.

    ``rows`` are (id, part, mask), bit f of the mask for a row that fails filter f; ``marks`` are (id, one boolean column
    for each mark). Repeated rows count each; an id may stand in several parts and with several masks. An id is marked
    if any of its rows in ``marks`` says so; null ids and null marks mark nothing. Equal rows are counted before they travel, so a hot
    id is a few entries. No part, no rows: an empty table gives an empty one. ``shapley`` is the sum over all orders of
    what the filter removes."""
    spark, n = rows.sparkSession, len(letters)
    arrow_batches(spark, 10_000)
    names = [c for c in marks.columns if c != "id"]
    kind = rows.schema["id"].dataType
    entries = rows.withColumn("part", F.coalesce("part", F.lit(""))).groupBy("id", "part", "mask").agg(F.count("*").alias("n"))
    marked = marks.where(F.col("id").isNotNull()).groupBy(F.col("id").cast(kind).alias("id")).agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in names])
    both = entries.select("*", *[F.lit(False).alias(c) for c in names]).unionByName(marked.select("id", F.lit(None).cast("string").alias("part"), F.lit(0).alias("mask"), F.lit(0).cast("bigint").alias("n"), *names))
    cut = both.repartitionByRange(parts(spark), "id").sortWithinPartitions("id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = table.column("id").combine_chunks().dictionary_encode("encode")
            ids = np.asarray(ids.indices)  # ids are sorted, so codes are in their order
            is_mark = np.asarray(table.column("part").is_null())
            text = table.column("part").combine_chunks().filter(pa.array(~is_mark))
            if not len(text):
                return
            known, part = np.unique(np.array(text.to_pylist(), object), return_inverse=True)
            mask, rows_ = (table.column(c).to_numpy()[~is_mark] for c in ("mask", "n"))
            entry_ids = ids[~is_mark]
            order = np.lexsort((mask, entry_ids, part))
            flagged = [np.unique(ids[is_mark & table.column(c).to_numpy()]) for c in names]
            # the entries of marked ids: one gallop over the ids in order, then back to the order of the parts
            by_id = np.unique(entry_ids)
            has = [np.isin(entry_ids[order], by_id[common(by_id, m)[0]]) for m in flagged]
            lists = [np.flatnonzero(h) for h in has]
            lines = [
                (known[p], subset, f, *(int(v) for v in found[:, p]))
                for subset, f, found in block_sizes(part[order], mask[order], rows_[order], lists, len(known), n)
                for p in range(len(known)) if found[0, p]
            ]
            columns = list(zip(*lines, strict=True))
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * (1 + len(names))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "subset", "filter", "size", *names])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block:  # a block ends where the id changes
                table = pa.Table.from_batches(held)
                ids = table.column("id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
                end = int(np.searchsorted(ids, ids[-1]))
                if end:
                    yield from out(table.slice(0, end))
                    held = table.slice(end).to_batches()
                    size -= end
        if held:
            yield from out(pa.Table.from_batches(held))

    counted = ", ".join(f"`{c}` long" for c in names)
    sizes = cut.mapInArrow(measure, f"part string, subset int, filter int, size long, {counted}".rstrip(", "))
    sizes = sizes.groupBy("part", "subset", "filter").agg(*[F.sum(c).alias(c) for c in ["size", *names]])
    sizes = settle(sizes, "sizes")  # at most 2^n (n / 2 + 1) rows for each part
    times = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)])  # orders in which k others come before
    shares = sizes.where("filter >= 0").groupBy("part", F.col("filter").alias("f")).agg(F.sum(F.col("size") * times[F.bit_count("subset")]).alias("share"))
    value = F.struct("size", *names)
    by_part = sizes.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct((F.col("subset") * 16 + F.col("filter")).alias("k"), value.alias("v")))).alias("sizes"))
    shares = shares.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("f", "share"))).alias("shares"))
    orders = ["".join(p) for p in itertools.permutations(letters)]
    steps = by_part.join(shares, "part", "left").select("*", F.explode(F.lit(orders)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = [F.locate(c, F.col("filter_order")) for c in letters]
    before = sum((F.when(p < F.col("step"), 1 << f).otherwise(0) for f, p in enumerate(place)), F.lit(0))
    own = sum((F.when(p == F.col("step"), f).otherwise(0) for f, p in enumerate(place)), F.lit(0))
    steps = steps.withColumns({"before": before, "own": own})
    bit = F.element_at(F.lit([1 << f for f in range(n)]), F.col("own") + 1)

    def size_of(subset: Column, of: Column, field: str = "size") -> Column:
        return F.coalesce(F.element_at("sizes", subset * 16 + of)[field], F.lit(0).cast("bigint"))

    all_but = F.lit((1 << n) - 1) - bit
    return steps.select(
        "part", "filter_order", "step", (size_of(F.lit(0), F.lit(-1)) - size_of(F.col("before") + bit, F.lit(-1))).alias("kept"),
        size_of(F.col("before"), F.col("own")).alias("removed"),
        (size_of(F.lit(0), F.col("own")) - size_of(F.col("before"), F.col("own"))).alias("redundant"),
        size_of(all_but, F.col("own")).alias("unique_fails"),
        *[size_of(F.col("before"), F.col("own"), c).alias(f"{c}_lost") for c in names],
        F.coalesce(F.element_at("shares", F.col("own")), F.lit(0).cast("bigint")).alias("shapley"),
    )


def audit_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``audit`` of the five text filters A to E, E for texts that a smaller id has too; labels give ``good`` and ``toxic``.

    Null texts are empty, null parts the empty string; other columns of the input are not read."""
    marks = labels.select(F.col(id_col).alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit(with_repeats(text_flags(docs, id_col, text_col, part_col)), marks)
