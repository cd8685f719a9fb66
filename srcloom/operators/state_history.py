"""Segment states through time: a log that only grows, with snapshots, and the state at any moment rebuilt from both.

Each append is a numbered folder of the log, cut by a hash of the project; a ledger names the last number that counts.
A snapshot holds the merged changes of all appends up to its number with times up to its moment. The state at a moment is
the nearest snapshot that is not later, merged with the rows that it does not cover, late ones included; merging does
not depend on order, so any snapshot gives the same answer.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcloom.operators import migration_state as M
from srcloom.streaming.tables import Commit, commit, newest

BUCKETS = 64
_SNAPSHOT = re.compile(r"upto=(-?\d+)-seq=(\d+)-no=\d+")


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("project"), F.lit(buckets)).cast("int")


def append_updates(updates: DataFrame, root: str, buckets: int = BUCKETS) -> int:
    """Add rows (project, segment_id, ts, event_id and any fields of a segment); returns the number of the append.

    Rows without a time belong to no moment and are in the log only. An append that fails leaves nothing that counts."""
    spark = updates.sparkSession
    before = newest(spark, f"{root}/log")
    seq = before.seq + 1
    rows = updates.withColumn("bucket", bucket(buckets))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/log/rows/seq={seq}")
    commit(spark, f"{root}/log", Commit(seq=seq), before)
    return seq


def read_log(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame:
    """All rows appended so far with the number of their append; ``buckets`` reads only those folders."""
    rows = spark.read.parquet(f"{root}/log/rows").where(F.col("seq") <= newest(spark, f"{root}/log").seq)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def _snapshots(spark: SparkSession, root: str, upto: int) -> list[tuple[int, int, str]]:
    """(moment, append, folder) of the snapshots that are not later than a moment."""
    found = [(*map(int, _SNAPSHOT.search(name).groups()), name) for name in newest(spark, f"{root}/snapshots").parts]
    return sorted(s for s in found if s[0] <= upto)


def _merged_at(spark: SparkSession, root: str, upto: int, counts: dict[str, Column], buckets: list[int] | None = None) -> DataFrame:
    """Merged changes of all rows with times up to a moment (microseconds)."""
    micros = F.unix_micros("ts")
    rows = read_log(spark, root, buckets).where(micros <= upto)
    found = _snapshots(spark, root, upto)
    if found:
        moment, seq, name = found[-1]
        known = spark.read.parquet(f"{root}/{name}")
        if buckets is not None:
            known = known.where(F.col("bucket").isin(buckets))
        rows = rows.where((F.col("seq") > seq) | (micros > moment))
        changes = M.segment_changes(rows, counts)
        return M.merge_changes(known.drop("bucket").unionByName(changes))
    return M.segment_changes(rows, counts)


def take_snapshot(spark: SparkSession, root: str, upto: int, counts: dict[str, Column], buckets: int = BUCKETS) -> None:
    """Keep the merged changes up to a moment (microseconds); it starts from the snapshot before it. ``counts`` stay the
    same for the life of a table."""
    seq = newest(spark, f"{root}/log").seq
    before = newest(spark, f"{root}/snapshots")
    name = f"snapshots/rows/upto={upto}-seq={seq}-no={before.seq + 1}"
    merged = _merged_at(spark, root, upto, counts).withColumn("bucket", bucket(buckets))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}")
    commit(spark, f"{root}/snapshots", Commit(seq=before.seq + 1, parts=[*before.parts, name]), before)


def state_at(spark: SparkSession, root: str, upto: int, counts: dict[str, Column] | None = None, projects: list | None = None, buckets: int = BUCKETS) -> DataFrame:
    """One row per segment as it was at a moment (microseconds): its fields, and counts up to then.

    ``projects`` reads the folders of these projects alone."""
    if projects is None:
        return M.settled_segments(_merged_at(spark, root, upto, counts or {}))
    kind = read_log(spark, root).schema["project"].dataType
    named = spark.createDataFrame([(p,) for p in projects], f"project {kind.simpleString()}")
    folders = [r[0] for r in named.select(bucket(buckets)).distinct().collect()]
    return M.settled_segments(_merged_at(spark, root, upto, counts or {}, folders)).where(F.col("project").isin(projects))
