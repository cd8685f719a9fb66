"""Helpers of the training-data operators: written tables, order numbers, components, hashes of byte spans."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as bytes.split() has it: blank and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tables-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as a table in the shared folder and go on from there.

    It cuts the lineage, computes each row once and outlives lost executors. The tables of an application lie
    below one folder, to be deleted with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts may be long, so Arrow batches hold few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wrapped(df: DataFrame) -> DataFrame:
    """The row as one struct, so that no column of the input clashes with the operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unwrapped(df: DataFrame, added: list[str]) -> DataFrame:
    """The input's columns and the added ones; an added column replaces one of the same name."""
    names = [c for c in df.schema["row"].dataType.names if c.lower() not in {a.lower() for a in added}]
    return df.select(*[F.col("row").getField(c).alias(c) for c in names], *added)


def by_place(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The columns under names by their place (c0, c1 ...), with further ones, so that no name of the input clashes."""
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *[c.alias(n) for n, c in more.items()])


def by_name(df: DataFrame, columns: list[str], added: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``by_place`` under their own names; an added column replaces one of the same name."""
    taken = {a.lower() for a in added}
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in taken], *added)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds ``name``: the place from 1 in the order of all rows, without gathering them in one task."""
    cut = settle(df.repartitionByRange(parts(df.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start")


def meet(rows: DataFrame, found: DataFrame, on: list[str], n: str, hot: int = 1000) -> DataFrame:
    """Joins ``rows`` with ``found``, a written table with one row for each key and in ``n`` how many of the rows have it.

    Keys with more than one row in ``hot`` are fewer than ``hot``; they are broadcast, so their rows stay where they
    are. All others meet in a shuffle in which no key has more than that share. Keys that are not found meet nothing."""
    total = found.agg(F.sum(n)).first()[0] or 0
    large = found.where(F.col(n) * hot > total)
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(large), on).unionByName(rest.join(found.where(F.col(n) * hot <= total), on))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node it can reach.

    Large-star and small-star steps in turn; each is a grouped minimum and a join, and every round is a written
    table. A node without an edge is not returned; null ends are not edges."""
    now = settle(edges.where("a != b").select("a", "b").distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()
            )
        seen = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # an edge (a, b) with a < b comes from one of its two rows only, so there are few repeats
        large = settle(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = settle(
            large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small).distinct(),
            "edges",
        )


# Hashes of byte spans: H(s..e) = sum of byte[i] * BASE^(i - s), modulo 2^64, then mixed. BASE is odd, so powers can
# be divided out and all spans of a text come from one running sum.

BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n at least; grown on demand."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def running_sum(data: np.ndarray) -> np.ndarray:
    """Prefix sums over the bytes of a text, one longer than the text."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), F.lit(modulus))


def labelled_ids(labels: DataFrame, label: str, train: Column, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, y) of the training ids; labels other than 0 and 1 and null ids are left out, an id labelled both ways is 1."""
    return (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(train)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text, y, turn): the training texts of at most ``per_class`` ids of each class, in order of a hash.

    The bound is on ids, so the broadcast is bounded. ``train`` is a condition on the id column; labels other than 0
    and 1 and null ids are left out, and an id labelled both ways is 1. ``turn`` is the hash, for splits."""
    ids = labelled_ids(labels, label, train, id_col).withColumn("turn", F.xxhash64("doc_id"))
    picked = [ids.where(F.col("y") == y).orderBy("turn", "doc_id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    return settle(texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id"), f"{label}-sample")


def byte_texts(batch, name: str = "text") -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast("large_binary" if str(column.type).startswith("large") else "binary").to_pylist()


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
