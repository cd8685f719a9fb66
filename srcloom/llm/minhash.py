"""Near-duplicates by min-max hashing.

A document is the set of its 5-word shingles. Under each permutation both the smallest and the largest value are kept,
so the signature has two values for one evaluation. Bands of five values choose candidates; sets are compared in full.

1. Documents of one word sequence are one class, named by its smallest id; only classes go on.
2. Classes that share a band are joined to the smallest of the band; components of these are candidate clusters.
3. A cluster's texts come together and every pair in it is decided by exact counts of common shingles, through lists of
   the holders of each shingle; the task returns one edge per document, not pairs. A large cluster is dealt over
   blocks, and each pair of blocks is a task. Before that, members are compared with a few leaders, and blocks that lie
   in one component already are not compared with each other.
4. Components of the edges are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, by_name, by_place, byte_texts, components, mixed, parts, running_sum, settle, span_hashes

SHINGLE = 5
#: Percent of common shingles from which two texts are linked, unless the caller names another.
SIMILARITY = 85
PERMUTATIONS, BANDS, ROWS = 70, 28, 5
#: A block holds about so many classes or shingles at most.
BLOCK, BLOCK_SHINGLES, LEADERS = 1024, 1_000_000, 8
_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_SALTS = _random.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64)
_COLUMNS = 1 << 14


def shingles(text: bytes | None, size: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """(the words joined by blanks, sorted distinct hashes of the shingles); nothing for texts without words."""
    words = text.lower().split() if text else []
    if not words:
        return b"", np.empty(0, np.uint64)
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    blanks = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(data)]])
    n = max(1, len(words) - size + 1)
    last = min(size, len(words)) - 1
    return joined, np.unique(span_hashes(running_sum(data), starts[:n], ends[last : last + n]))


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the set under each permutation, side by side."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(values), _COLUMNS):
        hashed = _FACTORS[:, None] * values[None, at : at + _COLUMNS] + _SHIFTS[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the signature; bands do not share keys."""
    return mixed((mixed(signature(values)[: BANDS * ROWS].reshape(BANDS, ROWS)) * (_SALTS | np.uint64(1))).sum(axis=1, dtype=np.uint64) + _SALTS[:, 0]).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, bands) of each row; key names the word sequence and is null without words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, rows = [], [], []
            for text in byte_texts(batch):
                joined, values = shingles(text)
                keys.append(hashlib.md5(joined).digest() if joined else None)
                sizes.append(len(values))
                rows.append(bands(values) if joined else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_shingles", "bands"],
            )

    return docs.mapInArrow(read, "doc_id long, key binary, n_shingles long, bands array<long>")


def common_counts(sets: list[np.ndarray], queries: range) -> Iterator[tuple[int, np.ndarray]]:
    """For each query set, the number of values it shares with every set, by lists of the holders of each value."""
    sizes = np.array([len(s) for s in sets])
    _, value = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(value, kind="stable")]
    ends = np.cumsum(np.bincount(value))
    starts = np.concatenate([[0], ends[:-1]])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for i in queries:
        own = value[bounds[i] : bounds[i + 1]]
        shared = own[ends[own] - starts[own] > 1]
        n = ends[shared] - starts[shared]
        if not len(n):
            yield i, np.zeros(len(sets), np.int64)
            continue
        at = np.repeat(starts[shared] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        yield i, np.bincount(holder[at], minlength=len(sets))


def group(sets: list[np.ndarray], similarity: int = SIMILARITY, queries: range | None = None) -> np.ndarray:
    """The smallest place each set is linked with, directly or through others; pairs are decided by exact counts."""
    sizes = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    for i, common in common_counts(sets, range(len(sets)) if queries is None else queries):
        linked = np.flatnonzero(100 * common >= similarity * (sizes + sizes[i] - common))
        old = np.unique(label[linked])
        old = old[old != label[i]]
        if len(old):
            old = np.append(old, label[i])
            label[np.isin(label, old)] = old.min()
    return label


def _edges(nodes: list[int], label: np.ndarray) -> pa.RecordBatch:
    pairs = [(nodes[i], nodes[j]) for i, j in enumerate(label.tolist()) if nodes[i] != nodes[j]]
    return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def compare_block(table: pa.Table, similarity: int = SIMILARITY) -> pa.Table:
    """Edges (a, b) of one task's texts. A row whose words are not those of its class is left out.

    A node that names several classes is linked by each of them."""
    seen: dict[tuple[int, bytes], np.ndarray] = {}
    for batch in table.select(["node", "key", "text"]).to_batches():
        for node, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch), strict=True):
            if (node, key) not in seen:
                joined, values = shingles(text)
                if hashlib.md5(joined).digest() == key:
                    seen[node, key] = values
    if len(seen) < 2:
        return _edges([], np.empty(0, int))
    held = sorted(seen)
    nodes = [n for n, _ in held]
    label = group([seen[h] for h in held], similarity)
    for i in range(1, len(nodes)):  # classes of one node are one
        if nodes[i] == nodes[i - 1] and label[i] != label[i - 1]:
            low, high = sorted((label[i], label[i - 1]))
            label[label == high] = low
    return _edges(nodes, label)


def compare_leaders(batches: Iterator[pa.RecordBatch], similarity: int = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """Edges between members and the leaders that came along with them."""
    for batch in batches:
        at = batch.schema.get_field_index
        rows = zip(batch.column(at("node")).to_pylist(), byte_texts(batch), batch.column(at("leaders")).to_pylist(), strict=True)
        edges, known = [], {}
        for node, text, leaders in rows:
            values = shingles(text)[1]
            for leader in leaders:
                if leader["node"] not in known:
                    known[leader["node"]] = shingles(leader["text"].encode())[1]
                other = known[leader["node"]]
                common = len(np.intersect1d(values, other, assume_unique=True))
                if node != leader["node"] and 100 * common >= similarity * (len(values) + len(other) - common):
                    edges.append((node, leader["node"]))
            if len(known) > 1000:
                known.clear()
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])


def cluster_roots(members: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, similarity: int = SIMILARITY) -> DataFrame:
    """(node, root) of the groups within the clusters of (cluster, node, key, n_shingles, text).

    A cluster of one block is settled by its task; only edges between the blocks of large ones need components."""
    compare = lambda table: compare_block(table, similarity)
    lead = lambda batches: compare_leaders(batches, similarity)
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_shingles") / block_shingles)).cast("int").alias("blocks")
    )
    sized = settle(members.join(sizes, "cluster"), "members")
    small = sized.where("blocks = 1").select("cluster", "node", "key", "text")
    roots = small.groupBy("cluster").applyInArrow(compare, "a long, b long").select(F.col("a").alias("node"), F.col("b").alias("root"))
    large = sized.where("blocks > 1")
    if not large.take(1):
        return roots
    turn = Window.partitionBy("cluster").orderBy(F.xxhash64("node"), "node")
    leaders = large.select("cluster", "node", "text", F.xxhash64("node").alias("h"))
    leaders = leaders.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= LEADERS)
    leaders = leaders.groupBy("cluster").agg(F.collect_list(F.struct("node", "text")).alias("leaders"))
    led = settle(large.join(leaders, "cluster").select("node", "text", "leaders").mapInArrow(lead, "a long, b long"), "led")
    # All that are linked with one leader are one part; parts may still meet in a group.
    part = led.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("part"))
    known = large.join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    # A part that fills blocks by itself gets blocks of its own; the rest share mixed blocks.
    filled = known.groupBy("cluster", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where((F.col("n") >= block) | (F.col("s") >= block_shingles))
    filled = filled.select("cluster", "part", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("s") / block_shingles)).cast("int").alias("own"))
    dealt = known.join(filled, ["cluster", "part"], "left").withColumn(
        "home",
        F.struct(
            F.when(F.col("own").isNotNull(), F.col("part")).alias("part"),
            F.pmod(F.xxhash64("node"), F.coalesce("own", "blocks")).cast("int").alias("i"),
        ),
    )
    dealt = settle(dealt.select("cluster", "node", "key", "text", "home"), "dealt")
    homes = dealt.groupBy("cluster", "home").count().groupBy("cluster").agg(F.collect_list("home").alias("homes"))
    # Each pair of blocks is a task, unless both lie in one part.
    apart = "filter(homes, h -> h.part is null or home.part is null or h.part <> home.part)"
    tasks = dealt.join(homes, "cluster").withColumn("other", F.explode(F.expr(apart)))
    tasks = tasks.select(
        "cluster", F.least(F.to_json("home"), F.to_json("other")).alias("one"), F.greatest(F.to_json("home"), F.to_json("other")).alias("two"), "node", "key", "text"
    )
    edges = tasks.groupBy("cluster", "one", "two").applyInArrow(compare, "a long, b long").union(led)
    return roots.union(components(edges))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    component_id is the smallest id reached by links of ``similarity`` percent or more, kept is doc_id = component_id. Null and
    empty texts and texts without words link with nothing. Rows with a null id have no name to be linked by: their
    component_id is null and they are kept. Repeated rows are copies of each other and count as one id; an id with
    several texts links the groups of all of them. Ids are whole numbers. Whole texts are read; other columns are not; an
    empty table gives an empty one."""
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = settle(signed(docs), "signed")
    named = rows.where("doc_id is not null and key is not null")
    classes = settle(named.groupBy("key").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles")), "classes")
    one = named.select(F.col("doc_id").alias("node"), "key", "bands").join(classes, ["node", "key"])
    banded = settle(one.select("node", F.explode("bands").alias("band")).distinct(), "banded")
    least = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("band", "b")
    near = banded.join(least, "band").where("node > b").select(F.col("node").alias("a"), "b")
    clusters = components(near).select("node", F.col("root").alias("cluster"))
    chosen = clusters.join(classes, "node").select(F.col("node").alias("doc_id"), "cluster", "key", "n_shingles")
    texts = docs.join(chosen, "doc_id")
    members = texts.select("cluster", F.col("doc_id").alias("node"), "key", "n_shingles", "text")
    found = settle(cluster_roots(members, similarity=similarity), "found")
    # an id with several texts links their classes; such ids are looked for before anything is joined for them
    several = settle(named.groupBy("doc_id").agg(F.min("key").alias("one"), F.max("key").alias("other")).where("one < other").select("doc_id"), "several")
    if several.take(1):
        names = classes.join(named.join(several, "doc_id").select("doc_id", "key").distinct(), "key")
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(names.select("doc_id", "node")))
    roots = classes.join(found, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    out = rows.select("doc_id", "key", "n_shingles").join(roots, "key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, with their columns, whatever their names.

    An id that is not kept goes with all its rows, of repeated rows (equal in id and text, null ids and texts included) one stays; texts
    without words link with nothing and stay. Which of repeated rows stays, where other columns differ, is not defined."""
    gone = near_duplicates(docs, id_col, text_col, similarity).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = by_place(docs, docs.columns, id_=F.col(f"`{id_col}`").cast("long"))
    kept = rows.join(gone, F.col("id_") == F.col("gone_id"), "left_anti")
    again = settle(docs.groupBy(F.col(f"`{id_col}`").cast("long").alias("again_id")).agg(F.count("*").alias("n")).where("n > 1").select("again_id"), "again")
    if again.take(1):
        same = F.col("id_").eqNullSafe(F.col("again_id"))
        once = kept.join(again, same, "left_semi").dropDuplicates(["id_", f"c{docs.columns.index(text_col)}"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return by_name(kept, docs.columns)
