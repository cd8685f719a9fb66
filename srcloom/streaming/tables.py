"""Tables that streams keep up to date, batch by batch.

A commit is one small file of a ledger. It names the parts of the table that count from now on, so readers see a whole
batch or nothing of it, and a batch that comes again after a failure is either known by its number or writes over what
it left. Parts are small changes; every few commits they are merged into one, so their number stays bounded. Folders that
a commit replaces are removed by the commit after it, when no reader of the older ledger needs them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_ENTRY = "seq long, batch_id long, closed long, parts array<string>, waiting string, garbage array<string>"


@dataclass
class Commit:
    """seq counts commits; batch_id is the last batch of the stream; closed is the time (microseconds) up to which rows
    have been applied; parts and waiting are folders that count; garbage are folders that no longer do."""

    seq: int = 0
    batch_id: int = -1
    closed: int | None = None
    parts: list[str] = field(default_factory=list)
    waiting: str | None = None
    garbage: list[str] = field(default_factory=list)


def newest(spark: SparkSession, root: str) -> Commit:
    """The last commit, or that of an empty table."""
    try:
        rows = spark.read.schema(_ENTRY).json(f"{root}/ledger/*").orderBy("seq", ascending=False).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return Commit(**rows[0].asDict()) if rows else Commit()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def commit(spark: SparkSession, root: str, entry: Commit, before: Commit) -> None:
    """Make the parts of ``entry`` the table; then remove what the commit before had replaced."""
    rows = spark.createDataFrame([(entry.seq, entry.batch_id, entry.closed, entry.parts, entry.waiting, entry.garbage)], _ENTRY)
    rows.coalesce(1).write.mode("overwrite").json(f"{root}/ledger/{entry.seq:010d}")
    for name in before.garbage:
        remove(spark, f"{root}/{name}")
    if entry.seq > 2:
        remove(spark, f"{root}/ledger/{entry.seq - 2:010d}")


def write_part(rows: DataFrame, root: str, name: str) -> DataFrame:
    """Write rows as a folder of the table, over what a failed attempt may have left, and go on from there."""
    rows.write.mode("overwrite").parquet(f"{root}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{root}/{name}")


def read_parts(spark: SparkSession, root: str, names: list[str], schema) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{n}" for n in names])


def add_part(changes: DataFrame, root: str, table: str, entry: Commit, before: Commit, merge: Callable[[DataFrame], DataFrame], most: int) -> None:
    """Write a batch's changes as a part of ``entry``; with ``most`` parts, all are merged into one."""
    name = f"{table}/{entry.seq:010d}"
    part = write_part(changes, root, name)
    entry.parts = [*before.parts, name]
    if len(entry.parts) >= most:
        merged = merge(read_parts(part.sparkSession, root, entry.parts, part.schema))
        write_part(merged, root, f"{name}-merged")
        entry.garbage += entry.parts
        entry.parts = [f"{name}-merged"]
