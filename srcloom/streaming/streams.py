"""Structured Streaming forms of the state machine, progress and analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from srcloom.functions import languages as L
from srcloom.functions import text as T
from srcloom.operators import migration_state as M
from srcloom.operators.segments import segment_corpus
from srcloom.operators.symbols import analyse_corpus
from srcloom.streaming.tables import Commit, add_part, commit, newest, read_parts, write_part

#: Changes that a table keeps side by side before they are merged.
PARTS = 10
_ORDER = ("ts", "event_id")


def _key(rows: DataFrame) -> str:
    return rows.schema["project"].dataType.simpleString()


def _state_schema(key: str) -> str:
    return f"project {key}, state string, seen struct<ts: timestamp, event_id: bigint>"


def _newest_states(parts: DataFrame) -> DataFrame:
    return parts.groupBy("project").agg(F.max_by("state", "seen").alias("state"), F.max("seen").alias("seen"))


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {interval}"))).first()[0]


def _apply(spark: SparkSession, root: str, rows: DataFrame, before: Commit, batch_id: int, delay: int | None, most: int) -> None:
    """One commit: rows that are in time join those that wait, and all up to the new closing time are applied in order."""
    key, shape = _key(rows), rows.schema
    entry = Commit(seq=before.seq + 1, batch_id=batch_id)
    micros = F.unix_micros("ts")
    late = F.coalesce(micros <= F.lit(before.closed), micros.isNull()) if before.closed is not None else micros.isNull()
    arrived = rows.withColumn("late", late)
    if before.waiting:
        kept = spark.read.schema(arrived.schema).parquet(f"{root}/{before.waiting}").where(~F.col("late"))
        arrived = arrived.unionByName(kept if before.closed is None else kept.where(micros > before.closed))
        entry.garbage.append(before.waiting)
    entry.waiting = f"waiting/{entry.seq:010d}"
    arrived = write_part(arrived, root, entry.waiting)
    last = arrived.where(~F.col("late")).agg(F.max(micros)).first()[0]
    entry.closed = before.closed
    if last is not None:
        entry.closed = max(last - (delay or 0), before.closed if before.closed is not None else last - (delay or 0))
    due = arrived.where(~F.col("late") & (micros <= F.lit(entry.closed))).drop("late")
    starts = _newest_states(read_parts(spark, root, before.parts, _state_schema(key)))
    folded = M.fold_transitions(due, _ORDER, starts=starts).withColumn("late", F.lit(False))
    unused = arrived.where("late").select(*shape.names, F.lit(None).cast("string").alias("from_state"), F.lit(False).alias("accepted"), F.lit(None).cast("string").alias("state"), F.lit(True).alias("late"))
    log = write_part(folded.unionByName(unused), root, f"log/seq={entry.seq}")
    changed = log.where("not late").groupBy("project").agg(F.max_by("state", F.struct(*_ORDER)).alias("state"), F.max(F.struct(*_ORDER)).alias("seen"))
    add_part(changed, root, "states", entry, before, _newest_states, most)
    commit(spark, root, entry, before)


def write_states(requests: DataFrame, target: str, checkpoint: str, delay: str = "10 minutes", most: int = PARTS) -> StreamingQuery:
    """The strict state machine on a stream, kept as a table below ``target``: nothing that arrives is lost.

    A request (project, ts, event_id, to_state) waits until a request later by ``delay`` has been seen; then it is applied
    in the order of (ts, event_id) to the state its project has, so what a project goes through does not depend on how
    requests were cut into batches. A request for a time that has been applied already is not applied; it comes out in the
    log marked ``late``, without states, and so does one without a time. ``flush_states`` applies what still waits. One project's requests may fill many
    tasks. Waiting requests and the changed states are written per batch; a batch that comes again changes nothing."""

    def one_batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = newest(spark, target)
        if batch_id > before.batch_id:
            _apply(spark, target, rows.select("project", "ts", "event_id", "to_state"), before, batch_id, _micros(spark, delay), most)

    return requests.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_states(spark: SparkSession, target: str, key: str = "bigint") -> None:
    """Apply all that still waits: the end of a bounded run. Requests of the same time that come after it are late."""
    before = newest(spark, target)
    if before.waiting:
        none = spark.createDataFrame([], f"project {key}, ts timestamp, event_id bigint, to_state string")
        _apply(spark, target, none, before, before.batch_id, None, PARTS)


def read_state_log(spark: SparkSession, target: str) -> DataFrame:
    """All requests applied so far with from_state, accepted, state, and those that came late."""
    return spark.read.parquet(f"{target}/log").where(F.col("seq") <= newest(spark, target).seq).drop("seq")


def read_states(spark: SparkSession, target: str, key: str = "bigint") -> DataFrame:
    """The state of each project."""
    return _newest_states(read_parts(spark, target, newest(spark, target).parts, _state_schema(key))).select("project", "state")


def read_requests(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_progress(updates: DataFrame, target: str, checkpoint: str, counts: dict[str, Column] | None = None, most: int = PARTS) -> StreamingQuery:
    """Live progress: every batch adds the changed segments to a table below ``target``.

    ``updates`` are (project, segment_id, ts, event_id) with any of the fields of a segment; of each field the last
    value that is not null counts, in whatever order rows arrive. ``counts`` are aggregates that add up over batches, by name. A
    batch that comes again changes nothing; parts are merged every ``most`` batches, so their files stay few."""

    def upsert(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        before = newest(spark, target)
        if batch_id > before.batch_id:
            entry = Commit(seq=before.seq + 1, batch_id=batch_id)
            add_part(M.segment_changes(rows, counts or {}), target, "segments", entry, before, M.merge_changes, most)
            commit(spark, target, entry, before)

    return updates.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, target: str) -> DataFrame:
    """One row per segment: its fields and counts as of the last commit."""
    parts = newest(spark, target).parts
    return M.settled_segments(M.merge_changes(spark.read.parquet(*[f"{target}/{p}" for p in parts])))


def read_progress(spark: SparkSession, target: str, **totals: Column) -> DataFrame:
    """Counters per project as of the last commit; ``totals`` are further aggregates over its segments, by name."""
    return M.progress(read_segments(spark, target), **totals)


def analyse_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Segments of source files as they arrive; the same stateless plan as in batch."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    path = F.col("path")
    decoded = files.select(
        "path", T.stem(path).alias("stem"), L.language_of_path(path).alias("language"),
        T.decode_text(F.col("content")).alias("content"),
    ).where("language <> 'unknown'")
    return segment_corpus(analyse_corpus(decoded))


def run_to_end(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a later run goes on from the checkpoint."""
    return (
        rows.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
