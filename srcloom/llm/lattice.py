"""Embedding near-duplicates by lattice hashing.

In each table two random 8-dimensional projections of the unit vector are decoded to their nearest points of the E8
lattice. The cell of both points, and the two cells next to it (the second nearest point in either projection), are
the vector's keys; vectors that share a key are compared by cosine in double precision.

Equal vectors of one label are one class with a multiplicity. Cells with one class are dropped before vectors travel.
A pair is counted in the smallest key that it shares, so counts add up; a cell returns a sum and an edge per vector,
not pairs. A large cell is dealt over blocks, and each pair of blocks is a task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.common import arrow_batches, components, mixed, parts, settle

COSINE = 0.98
TABLES, SCALE, BLOCK = 12, 0.25, 1024


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of 1/2 and -1/2 with an even number of the latter."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            row = [0.0] * 8
            row[i], row[j] = a, b
            rows.append(row)
    rows += [list(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(rows)


ROOTS = _roots()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd round the worst entry the other way."""
    point = np.rint(x)
    rest = x - point
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    point[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of the even integer points and those shifted by 1/2, the nearer one."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


def next_point(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """The second nearest E8 points: the neighbour that lies most in the direction of the rest."""
    return point + ROOTS[((x - point) @ ROOTS.T).argmax(axis=1)]


@functools.cache
def projections(size: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthonormal projections (tables, size, 16), offsets (tables, 16) and factors that hash cells."""
    rng = np.random.default_rng(size * 1000 + tables)
    bases = np.stack([np.linalg.qr(rng.normal(size=(size, 16)))[0] for _ in range(tables)])
    return bases * np.sqrt(size / 64), rng.random((tables, 16)), rng.integers(0, 1 << 63, (tables, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cell_keys(units: np.ndarray, labels: np.ndarray, tables: int = TABLES, scale: float = SCALE) -> np.ndarray:
    """Sorted 64-bit keys of each unit vector: three cells in each table. Label and table are part of the key."""
    n, size = units.shape
    bases, offsets, factors = projections(size, tables)
    keys = np.empty((n, tables, 3), np.uint64)
    for t in range(tables):
        x = units @ bases[t] / scale + offsets[t]
        one, two = nearest_point(x[:, :8]), nearest_point(x[:, 8:])
        cells = ((one, two), (next_point(x[:, :8], one), two), (one, next_point(x[:, 8:], two)))
        for k, cell in enumerate(cells):
            code = np.rint(2 * np.hstack(cell)).astype(np.int64).view(np.uint64)
            keys[:, t, k] = mixed((code * factors[t]).sum(axis=1, dtype=np.uint64) + mixed(labels.astype(np.int64).view(np.uint64) + np.uint64(t << 40)))
    return np.sort(keys.reshape(n, -1), axis=1)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors in double precision) by length, of those that are not null or zero and have finite components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        found = flat[starts[rows][:, None] + np.arange(size)] + 0.0  # -0.0 becomes 0.0
        good = np.isfinite(found).all(axis=1)
        good[good] = np.abs(found[good]).max(axis=1) > 0
        if good.any():
            yield rows[good], found[good]


def coded(vectors: DataFrame, tables: int = TABLES, scale: float = SCALE) -> DataFrame:
    """(vec_id, class, vector, keys) of each row; class is null where a row links with nothing."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0), batch.column(2)
            named = ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            label = labels.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            out: list[list] = [[None] * len(ids) for _ in range(3)]
            for rows, found in matrices(batch.column(1)):
                rows, found = rows[named[rows]], found[named[rows]]
                if not len(rows):
                    continue
                largest = np.abs(found).max(axis=1, keepdims=True)  # so that no square over- or underflows
                units = found / largest
                units /= np.sqrt((units**2).sum(axis=1, keepdims=True))
                if units.shape[1] < 16:
                    units = np.hstack([units, np.zeros((len(units), 16 - units.shape[1]))])
                keys = cell_keys(units, label[rows], tables, scale).view(np.int64)
                for i, r in enumerate(rows.tolist()):
                    out[0][r] = hashlib.md5(label[r].tobytes() + found[i].tobytes()).digest()
                    out[1][r] = found[i].tobytes()
                    out[2][r] = keys[i]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], ["vec_id", "class", "vector", "keys"]
            )

    return vectors.mapInArrow(read, "vec_id long, class binary, vector binary, keys array<long>")


def compare(nodes: np.ndarray, vectors: np.ndarray, times: np.ndarray, keys: np.ndarray, key: int, homes: np.ndarray | None, cosine: float) -> list[tuple[int, int, int]]:
    """(node, links, smallest node linked) within a cell; ``homes`` keeps to pairs of two blocks, or within the one."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    x = vectors / largest
    norms = np.sqrt((x**2).sum(axis=1))
    linked = (x @ x.T) / (norms[:, None] * norms[None, :]) >= cosine
    np.fill_diagonal(linked, False)
    if homes is not None and homes.min() != homes.max():
        linked &= homes[:, None] != homes[None, :]
    if not linked.any():
        return []
    label = np.arange(len(nodes))
    for i in range(len(nodes)):
        old = np.unique(label[linked[i]])
        old = old[old != label[i]]
        if len(old):
            old = np.append(old, label[i])
            label[np.isin(label, old)] = old.min()
    # pairs that share a smaller key are counted there
    smaller, place = np.unique(keys[keys < key], return_inverse=True)
    if len(smaller):
        owner = np.nonzero(keys < key)[0]
        shared = np.flatnonzero(np.bincount(place) > 1)
        if len(shared):
            spot = np.searchsorted(shared, place)
            known = (spot < len(shared)) & (shared[np.minimum(spot, len(shared) - 1)] == place)
            has = np.zeros((len(nodes), len(shared)), np.float32)
            has[owner[known], spot[known]] = 1
            linked &= (has @ has.T) == 0
    counts = linked @ times
    return [(int(nodes[i]), int(counts[i]), int(nodes[label[i]])) for i in range(len(nodes)) if counts[i] or label[i] != i]


def cell_sums(cells: DataFrame, cosine: float) -> DataFrame:
    """(node, links, b) from rows sorted by (key, pair) within each task; a cell or pair of blocks is held at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def out(table: pa.Table) -> pa.RecordBatch | None:
            key, pair, node, times, home = (table.column(c).to_numpy() for c in ("key", "pair", "node", "times", "home"))
            vectors, keys = table.column("vector").to_pylist(), table.column("keys").to_pylist()
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(pair) != 0)) + 1
            found: list[tuple[int, int, int]] = []
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                sizes = [len(v) for v in vectors[low:high]]
                for size in set(sizes):  # vectors of other lengths are not comparable
                    own = np.array([low + i for i, s in enumerate(sizes) if s == size])
                    if len(own) < 2:
                        continue
                    own = own[np.argsort(node[own])]
                    found += compare(
                        node[own], np.array([np.frombuffer(vectors[i]) for i in own]), times[own], np.array([keys[i] for i in own]),
                        int(key[low]), home[own] if pair[low] >= 0 else None, cosine,
                    )
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["node", "links", "b"]) if found else None

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            key, pair = table.column("key").to_numpy(), table.column("pair").to_numpy()
            cut = int(np.flatnonzero((key == key[-1]) & (pair == pair[-1]))[0])
            rest = table.slice(cut)
            if cut and (done := out(table.slice(0, cut))):
                yield done
        if rest is not None and (done := out(rest)):
            yield done

    return cells.mapInArrow(read, "node long, links long, b long")


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, scale: float = SCALE, block: int = BLOCK,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors link when their labels are equal and not null and their cosine is ``cosine`` or more. Null, zero and
    not finite vectors, vectors with a null component and rows without id link with nothing; vectors of different
    lengths are not comparable. Repeated rows are vectors of their own and link with each other."""
    arrow_batches(vectors.sparkSession, 4096)
    data = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    rows = settle(coded(data, tables, scale), "coded")
    classes = settle(rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("node"), F.count("*").alias("times")), "classes")
    # one row of each class; an id that names equal vectors twice is one node
    one = rows.select("class", F.col("vec_id").alias("node"), "vector", "keys").join(classes, ["class", "node"]).dropDuplicates(["class"])
    one = settle(one, "one")
    held = one.select("class", F.explode(F.array_distinct("keys")).alias("key"))
    full = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    placed = settle(held.join(full, "key"), "placed")
    home = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("long")
    placed = placed.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    pair = F.when(F.col("blocks") > 1, F.least("home", "other") * F.col("blocks") + F.greatest("home", "other")).otherwise(F.lit(-1).cast("long"))
    cells = placed.select("class", "key", "home", pair.alias("pair")).join(one, "class")
    cells = cells.select("key", "pair", "home", "node", "times", "vector", "keys")
    n = max(parts(vectors.sparkSession), 1)
    sums = settle(cell_sums(cells.repartition(n, "key", "pair").sortWithinPartitions("key", "pair"), cosine), "sums")
    links = sums.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(sums.select(F.col("node").alias("a"), "b"))
    known = classes.join(links, "node", "left").join(roots, "node", "left").select("class", "times", "links", F.coalesce("root", "node").alias("root"))
    component = F.coalesce("root", "vec_id")
    return (
        rows.select("vec_id", "class").join(known, "class", "left")
        .select("vec_id", F.coalesce(F.col("times") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
        .withColumn("kept", F.expr("vec_id <=> component_id"))
    )
