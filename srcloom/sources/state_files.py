"""Persisted migration state: JSON snapshots in two layouts.

Spark leaves dot-files out of every listing, so snapshots under hidden names are read by the ``file_tree`` source, whose
tasks walk the folders themselves; others by Spark's own reader.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcloom.operators.ordered import settle
from srcloom.sources.file_tree import read_tree

# File names of the two layouts.
HIDDEN_NAMES = [".migration_state.json", ".supervised_state.json"]
PLAIN_NAME, SUPERVISED_NAME = "migration_state.json", "supervised_state.json"

SEGMENT = "struct<segment_id:string,state:string,attempts:int,max_attempts:int,last_error:string,migrated_code:string,validation_passed:boolean>"
PLAIN = (
    "project_name string, source_language string, target_language string, state string, source_dir string, output_dir string, "
    "created_at string, updated_at string, total_files int, total_symbols int, total_lines int, "
    f"segments map<string,{SEGMENT}>, total_segments int, segments_completed int, segments_failed int, "
    "rules_violations array<struct<rule:string,segment_id:string,details:string,timestamp:string>>, "
    "event_log array<struct<type:string,detail:string,timestamp:string>>"
)
SUPERVISED = (
    "client struct<name:string>, project struct<name:string,source_language:string,target_language:string>, "
    "execution struct<status:string,total_duration:double>, "
    "phases array<struct<phase:string,status:string,duration_seconds:double,details:map<string,string>,timestamp:string>>"
)
_CORRUPT = "_corrupt_record"


def _files(spark: SparkSession, root: str, *names: str) -> DataFrame:
    if any(name.startswith(".") for name in names):
        return read_tree(spark, root, names=",".join(names)).select(
            F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"), F.col("mtime").alias("modificationTime"), "content"
        )
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(names) + "}" if len(names) > 1 else names[0]).load(root)
    )


def _parsed(schema: str) -> Column:
    shape = T.StructType.fromDDL(schema).add(_CORRUPT, T.StringType())
    return F.from_json(
        F.make_valid_utf8(F.col("content").cast("string")), shape,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
    )


def _read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Snapshots of one layout. Unknown keys are ignored, corrupt files dropped."""
    return (
        _files(spark, root, name).select("path", F.col("modificationTime").alias("mtime"), _parsed(schema).alias("s"))
        .select("path", "mtime", "s.*").where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)
    )


def read_plain(spark: SparkSession, root: str, name: str = PLAIN_NAME) -> DataFrame:
    return _read(spark, root, name, PLAIN)


def read_supervised(spark: SparkSession, root: str, name: str = SUPERVISED_NAME) -> DataFrame:
    return _read(spark, root, name, SUPERVISED)


def read_layouts(spark: SparkSession, root: str, plain: str = PLAIN_NAME, supervised: str = SUPERVISED_NAME) -> DataFrame:
    """Snapshots of both layouts in one walk over the tree: path, mtime, ``is_supervised`` and a struct of each layout, the other one null."""
    is_supervised = F.col("path").endswith("/" + supervised)
    rows = _files(spark, root, plain, supervised).select(
        "path", F.col("modificationTime").alias("mtime"), is_supervised.alias("is_supervised"),
        F.when(~is_supervised, _parsed(PLAIN)).alias("plain"), F.when(is_supervised, _parsed(SUPERVISED)).alias("supervised"),
    )
    sound = rows.where(F.coalesce(f"plain.{_CORRUPT}", f"supervised.{_CORRUPT}").isNull())
    return sound.withColumns({x: F.col(x).dropFields(_CORRUPT) for x in ("plain", "supervised")})


def state_segments(plain: DataFrame) -> DataFrame:
    return plain.select(
        F.col("project_name").alias("project"), F.explode_outer("segments").alias("segment_key", "s")
    ).where(F.col("segment_key").isNotNull()).select("project", "segment_key", "s.*")


def state_events(plain: DataFrame) -> DataFrame:
    return plain.select(
        F.col("project_name").alias("project"), F.posexplode_outer("event_log").alias("event_ord", "e")
    ).where(F.col("event_ord").isNotNull()).select("project", "event_ord", "e.*")


def latest_snapshot(plain: DataFrame, supervised: DataFrame) -> DataFrame:
    """Path of the newest snapshot; any supervised one goes before plain ones."""
    rows = supervised.select("path", "mtime", F.lit(1).alias("rank")).union(
        plain.select("path", "mtime", F.lit(0).alias("rank"))
    )
    return rows.agg(F.max_by("path", F.struct("rank", "mtime", "path")).alias("path"))


#: Folders of a state table; a project is in one of them.
BUCKETS = 64


def write_state(projects: DataFrame, path: str, schema: str = PLAIN, buckets: int = BUCKETS) -> None:
    """One JSON row per project, in folders by a hash of its name; ``buckets`` stays the same for the life of a table.

    Projects given replace their rows, all others stay: only the folders that a given project falls in are read and
    written, in one dynamic overwrite. Of several rows of a project the latest ``updated_at`` counts, ties by all values."""
    spark = projects.sparkSession
    home = F.pmod(F.xxhash64("project_name"), F.lit(buckets)).cast("int")
    newest = F.struct(*[c for c in ("updated_at",) if c in projects.columns], F.to_json(F.struct(*projects.columns)))
    given = projects.groupBy("project_name").agg(F.max_by(F.struct(*projects.columns), newest).alias("row")).select("row.*")
    given = settle(given.withColumn("bucket", home))
    touched = [r.bucket for r in given.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    try:
        old = spark.read.schema(schema).json(path).where(F.col("bucket").isin(touched))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
            raise
        rows = given
    else:
        named = given.select(F.col("project_name").alias("given_name"))
        others = old.join(named, F.col("project_name").eqNullSafe(F.col("given_name")), "left_anti")
        rows = given.unionByName(others, allowMissingColumns=True)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").json(path)


def read_state_table(spark: SparkSession, path: str, schema: str = PLAIN) -> DataFrame:
    return spark.read.schema(schema).json(path).drop("bucket")
