"""Ordered work on keys of any size.

A window or a fold over one key runs in one task, however large the key. Here keys with more rows than a fraction of a
partition are cut into pieces by quantiles of their order column, so a hot key is spread over as many tasks as it fills;
all other keys are one piece, and nothing is looked up for them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one task may always take for a key.
LEAST = 1 << 20
#: A piece is at most this fraction of an average partition (but for ties of the order column and LEAST).
SHARE = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A name below the shared folder that nothing else uses; it goes with the application's folder."""
    return f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and go on from there; it survives the loss of executors."""
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def default_chunks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _piece_of(cuts: Column, when: Column, step: int) -> Column:
    """How many cuts lie below ``when``: first among every ``step``-th one, then among those after it."""
    coarse = F.size(F.filter(F.col("_coarse"), lambda c: c < when))
    from_ = (F.greatest(coarse, F.lit(1)) - 1) * step
    return from_ + F.size(F.filter(F.slice(cuts, from_ + 1, step), lambda c: c < when))


def cut_hot_keys(rows: DataFrame, key: str, when: str, least: int = LEAST, chunks: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows with ``_piece``, hot keys): pieces of a key from 0 in the order of ``when``; hot keys is None without any.

    Rows are counted by key first. Fewer than SHARE times the number of partitions can be hot, which bounds what is
    broadcast. Rows of equal ``when`` stay in one piece; nulls come first."""
    spark = rows.sparkSession
    counts = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(least, (total or 0) // (SHARE * (chunks or default_chunks(spark))))
    if (largest or 0) <= limit:
        return rows.withColumn("_piece", F.lit(0)), None
    n = -(-largest // limit)
    hot = F.broadcast(counts.where(F.col("_n") > limit).select("_key"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    step = max(2, int(n**0.5))
    fractions = [i / n for i in range(1, n)]
    cuts = (
        rows.join(hot, same).groupBy("_key")
        .agg(F.array_distinct(F.percentile_approx(when, fractions, max(1000, 20 * n))).alias("_cuts"))
    )
    cuts = settle(cuts.withColumn("_coarse", F.expr(f"filter(_cuts, (c, i) -> i % {step} = 0)")))
    cut = rows.join(F.broadcast(cuts), same, "left").withColumn(
        "_piece", F.when(F.col("_cuts").isNull(), 0).otherwise(_piece_of(F.col("_cuts"), F.col(when), step))
    )
    return cut.drop("_key", "_cuts", "_coarse"), cuts.select("_key")


def previous_value(rows: DataFrame, key: str, value: str, *order: str, least: int = LEAST) -> DataFrame:
    """Adds ``previous``: the value of the row before within the key."""
    cut, hot = cut_hot_keys(rows, key, order[0], least)
    window = Window.partitionBy(key, "_piece").orderBy(*order)
    seen = cut.withColumn("previous", F.lag(value).over(window))
    if hot is None:
        return seen.drop("_piece")
    # the last value of each piece of the hot keys: as many rows as there are pieces
    ends = (
        cut.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_key"))).groupBy("_key", F.col("_piece").alias("_at"))
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
    )
    before = F.broadcast(ends.select("_key", "_at", F.lag("_last").over(Window.partitionBy("_key").orderBy("_at")).alias("_before")))
    first = F.row_number().over(window) == 1
    joined = seen.withColumn("_first", first).join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_at")) & F.col("_first"), "left")
    return joined.withColumn("previous", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("previous"))).drop(
        "_piece", "_first", "_key", "_at", "_before"
    )
