"""Migration state: transitions, segment progress, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcloom.functions import formats as FM
from srcloom.functions import text as T
from srcloom.functions.languages import TARGET_EXTENSIONS
from srcloom.operators.ordered import LEAST, cut_hot_keys, previous_value, settle
from srcloom.operators.substrings import contained

# The states in order, and where each may go.
STATES = [
    "idle", "analyzing", "analyzed", "segmenting", "segmented", "migrating", "validating",
    "assembling", "completed", "failed", "paused",
]
ALLOWED = {
    "idle": ["analyzing"],
    "analyzing": ["analyzed", "failed"],
    "analyzed": ["segmenting"],
    "segmenting": ["segmented", "failed"],
    "segmented": ["migrating"],
    "migrating": ["validating", "failed", "paused"],
    "validating": ["migrating", "assembling", "failed"],
    "assembling": ["completed", "failed"],
    "completed": ["idle"],
    "failed": ["idle", "migrating", "analyzing"],
    "paused": ["migrating", "idle"],
}
FIRST_STATE = "idle"
MAX_ATTEMPTS = 3
SECONDS_PER_SEGMENT = 5


def allowed_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, b) for a, targets in ALLOWED.items() for b in targets], "from_state string, to_state string"
    )


def is_allowed(from_state: Column, to_state: Column) -> Column:
    pairs = [f"{a}>{b}" for a, targets in ALLOWED.items() for b in targets]
    return F.concat(from_state, F.lit(">"), to_state).isin(*pairs)


def check_transitions(requests: DataFrame, project: str = "project", order: tuple[str, ...] = ("ts", "event_id"), least: int = LEAST) -> DataFrame:
    """Flags each request that may not follow the request before it."""
    seen = previous_value(requests, project, "to_state", *order, least=least)
    previous = F.coalesce("previous", F.lit(FIRST_STATE))
    return seen.withColumn("previous", previous).withColumn("allowed", is_allowed(F.col("previous"), F.col("to_state")))


# The machine as arrays: states by number, one number more for anything that is no state and is never allowed.
_UNKNOWN = len(STATES)
_ACCEPTED = np.array([[t in ALLOWED[s] for t in STATES] + [False] for s in STATES])
_NEXT = np.where(_ACCEPTED, np.arange(_UNKNOWN + 1, dtype=np.int8), np.arange(_UNKNOWN, dtype=np.int8)[:, None])


def _codes(column: pa.Array) -> np.ndarray:
    found = pc.index_in(column, value_set=pa.array(STATES, column.type))
    return pc.fill_null(found, _UNKNOWN).to_numpy(zero_copy_only=False).astype(np.int8)


def _blocks(column: np.ndarray, size: int, fill) -> np.ndarray:
    """The column in rows of ``size``, filled up at the end."""
    out = np.full(-(-len(column) // size) * size, fill, column.dtype)
    out[: len(column)] = column
    return out.reshape(-1, size)


def _composed(codes: np.ndarray, reset: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each block (row) the state it ends in for each state it may begin in; all blocks step together."""
    states = np.tile(np.arange(_UNKNOWN, dtype=np.int8), (len(codes), 1))
    for target, again, first in zip(codes.T, reset.T, start.T, strict=True):
        states[again] = first[again, None]
        states = _NEXT[states, target[:, None]]
    return states


def _scanned(maps: np.ndarray) -> np.ndarray:
    """Each map after all maps before it: a parallel prefix scan."""
    out, reach = maps.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach].astype(np.int64), axis=1)
        reach *= 2
    return out


def states_before(codes: np.ndarray, reset: np.ndarray, start: np.ndarray, state: int) -> np.ndarray:
    """The state before each request; ``reset`` marks the first of a project (or piece), which begins in ``start``."""
    n, size = len(codes), max(16, int(len(codes) ** 0.5))
    codes, reset, start = _blocks(codes, size, _UNKNOWN), _blocks(reset, size, False), _blocks(start, size, 0)
    now = np.full(len(codes), state, np.int8)
    now[1:] = _scanned(_composed(codes, reset, start))[:-1, state]
    before = np.empty_like(codes)
    for i, (target, again, first) in enumerate(zip(codes.T, reset.T, start.T, strict=True)):
        before[:, i] = np.where(again, first, now)
        now = _NEXT[before[:, i], target]
    return before.ravel()[:n]


def _first_of_group(batch: pa.RecordBatch, keys: tuple[str, ...], last: tuple | None) -> np.ndarray:
    """Which rows begin a new group of the keys; rows of a group follow each other."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last != tuple(batch.column(k)[0].as_py() for k in keys)
    for k in keys:
        codes = batch.column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _ends_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece of a hot project the state it ends in for each state it may begin in."""
    last, maps, found = None, None, []
    keys = ("project", "_piece")
    kind = pa.int64()
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.column("project").type
        begins = _first_of_group(batch, keys, last)
        codes = _codes(batch.column("to_state"))
        bounds = sorted({0, *np.flatnonzero(begins).tolist(), len(codes)})
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if begins[a]:
                if maps is not None:
                    found.append((*last, maps.tolist()))
                maps, last = np.arange(_UNKNOWN, dtype=np.int8), tuple(batch.column(k)[a].as_py() for k in keys)
            own = _blocks(codes[a:b], max(16, int((b - a) ** 0.5)), _UNKNOWN)
            maps = _scanned(_composed(own, np.zeros(own.shape, bool), np.zeros_like(own)))[-1][maps]
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if maps is not None:
        found.append((*last, maps.tolist()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.list_(pa.int32()))], ["project", "_piece", "ends"]
    )


def _begins_of_pieces(cut: DataFrame, hot: DataFrame, first: DataFrame | None, order: tuple[str, ...]) -> DataFrame:
    """(project, _piece, _begin) of the hot projects. One row per piece reaches the driver: their number is bounded."""
    spark, kind = cut.sparkSession, cut.schema["project"].dataType.simpleString()
    same = F.col("project").eqNullSafe(F.col("_key"))
    pieces = cut.join(F.broadcast(hot), same).select("project", "_piece", "to_state", *order)
    pieces = pieces.repartition("project", "_piece").sortWithinPartitions("project", "_piece", *order).select("project", "_piece", "to_state")
    ends = pieces.mapInArrow(_ends_of_pieces, f"project {kind}, _piece int, ends array<int>").collect()
    known = {} if first is None else {r[0]: r[1] for r in first.join(F.broadcast(hot), same).select("project", "state").collect()}
    rows, project, state = [], None, None
    for r in sorted(ends, key=lambda r: (str(r["project"]), r["_piece"])):
        if state is None or r["project"] != project:
            project, state = r["project"], STATES.index(known.get(r["project"], FIRST_STATE))
        rows.append((project, r["_piece"], STATES[state]))
        state = r["ends"][state]
    return spark.createDataFrame(rows, f"_project {kind}, _at int, _begin string")


def fold_transitions(
    requests: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), starts: DataFrame | None = None, least: int = LEAST, chunks: int | None = None
) -> DataFrame:
    """Strict state machine: a request that is not allowed is rejected and the
    state stays. Adds ``from_state``, ``accepted`` and ``state``.

    A project begins in the first state, or in that of ``starts`` (project, state). Applying a request is a map from
    state to state. Rows come in order of project; within a batch of rows blocks of requests are composed side by side, a
    prefix scan gives the state in which each block begins, and a second pass fills it in. Projects that are too large
    for one task are cut into pieces, whose maps are composed first, so a project of any size is replayed by many tasks.
    """
    added = ("from_state", "accepted", "state")
    requests = requests.drop(*added)
    first = None if starts is None else starts.select("project", "state")
    cut, hot = cut_hot_keys(requests, "project", order[0], least, chunks)
    begin = F.lit(FIRST_STATE)
    if first is not None:
        named = first.select(F.col("project").alias("_project_"), F.col("state").alias("_known"))
        cut = cut.join(named, F.col("project").eqNullSafe(F.col("_project_")), "left")
        begin = F.coalesce("_known", begin)
    if hot is not None:
        pieces = F.broadcast(_begins_of_pieces(cut, hot, first, order))
        cut = cut.join(pieces, F.col("project").eqNullSafe(F.col("_project")) & (F.col("_piece") == F.col("_at")), "left")
        begin = F.coalesce("_begin", begin)
    names = requests.columns
    by_piece = ["project"] if hot is None else ["project", "_piece"]
    spread = cut.select(*names, "_piece", begin.alias("_start")).repartition(*by_piece).sortWithinPartitions("project", "_piece", *order)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, keys = None, 0, ("project", "_piece")
        text = pa.array(STATES)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = _codes(batch.column("to_state"))
            before = states_before(codes, _first_of_group(batch, keys, last), _codes(batch.column("_start")), state)
            after = _NEXT[before, codes]
            state, last = int(after[-1]), tuple(batch.column(k)[n - 1].as_py() for k in keys)
            columns = [*(batch.column(c) for c in names), text.take(pa.array(before)), pa.array(_ACCEPTED[before, codes]), text.take(pa.array(after))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema), "from_state string", "accepted boolean", "state string"])
    return spread.mapInArrow(replay, shape)


def final_states(folded: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    return folded.groupBy("project").agg(
        F.max_by("state", F.struct(*order)).alias("state"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_rejected"),
    )


SEGMENT_FIELDS = ("state", "attempts", "last_error", "migrated_code", "validation_passed")


def upsert_segments(updates: DataFrame, order: tuple[str, ...] = ("ts", "event_id"), **counts: Column) -> DataFrame:
    """Latest value that is not null of each known field; other fields are ignored.

    ``counts`` are further aggregates of the same rows, by name."""
    when = F.struct(*order)
    fields = [f for f in SEGMENT_FIELDS if f in updates.columns]
    return updates.groupBy("project", "segment_id").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), when)).alias(f) for f in fields], *[c.alias(n) for n, c in counts.items()]
    )


def segment_changes(updates: DataFrame, counts: dict[str, Column], order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """One row per segment that can be merged with others of the same segment, in any order: of each known field the last
    value that is not null with its time, and the counts (aggregates that add up, by name)."""
    when = F.struct(*order)
    fields = [f for f in SEGMENT_FIELDS if f in updates.columns and f not in counts]
    return updates.groupBy("project", "segment_id").agg(
        *[F.max(F.when(F.col(f).isNotNull(), F.struct(when.alias("seen"), F.col(f).alias("value")))).alias(f) for f in fields],
        *[c.cast("bigint").alias(n) for n, c in counts.items()],
    )


def merge_changes(changes: DataFrame) -> DataFrame:
    """Later values win, counts add up."""
    others = [f for f in changes.schema if f.name not in ("project", "segment_id")]
    return changes.groupBy("project", "segment_id").agg(
        *[(F.max(f.name) if f.dataType.typeName() == "struct" else F.sum(f.name)).alias(f.name) for f in others]
    )


def settled_segments(merged: DataFrame) -> DataFrame:
    """The values without their times."""
    return merged.select(*[F.col(f"{f.name}.value").alias(f.name) if f.dataType.typeName() == "struct" else F.col(f.name) for f in merged.schema])


def retryable(segments: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return segments.where(F.col("state").isin("pending", "failed") & (F.col("attempts") < max_attempts))


def to_resume(segments: DataFrame, done: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Segments still to migrate: not validated before, attempts left."""
    out = done.where((F.col("state") == "validated") | (F.col("attempts") >= max_attempts)).select("project", "segment_id")
    return segments.join(out, ["project", "segment_id"], "left_anti")


def progress(segments: DataFrame, **totals: Column) -> DataFrame:
    """Counters per project; the percentage of nothing is 0. ``totals`` are further aggregates of the same rows, by name."""
    total, done = F.col("total_segments"), F.col("completed")
    return (
        segments.groupBy("project")
        .agg(
            F.count("segment_id").alias("total_segments"),
            F.count_if(F.col("state") == "validated").alias("completed"),
            F.count_if(F.col("state") == "failed").alias("failed"),
            *[c.alias(n) for n, c in totals.items()],
        )
        .withColumn("pending", total - done - F.col("failed"))
        .withColumn("progress_pct", F.when(total > 0, done / total * 100).otherwise(F.lit(0.0)))
    )


def event_log(folded: DataFrame, violations: DataFrame) -> DataFrame:
    """State changes and rule violations as one log."""
    changes = folded.where("accepted").select(
        "project", "ts", "event_id", F.lit("state_transition").alias("type"),
        F.concat("from_state", F.lit(" → "), "state").alias("detail"),
    )
    broken = violations.select(
        "project", "ts", "event_id", F.lit("rule_violation").alias("type"),
        F.concat("rule", F.lit(" en "), "segment_id", F.lit(": "), "details").alias("detail"),
    )
    return changes.unionByName(broken)


def latest(log: DataFrame, n: int, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Last n rows of each project. The limit is applied before the shuffle too."""
    newest = Window.partitionBy("project").orderBy(*[F.desc(c) for c in order])
    return log.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= n)


def output_file(path: Column, target: str) -> Column:
    """Name of the migrated file, in the folder of its source."""
    ext = TARGET_EXTENSIONS.get(target, f".{target}")
    folder = F.when(T.parent(path) == "", "").otherwise(F.concat(T.parent(path), F.lit("/")))
    return F.concat(folder, T.stem(path), F.lit(ext))


def compile_cascade(segments: DataFrame, compiled: DataFrame, target: str, error_chars: int = 100) -> DataFrame:
    """A file's compile result becomes the state of its segments, with ``validation_passed`` and, where it failed,
    the start of its errors as ``last_error``; segments of files not compiled keep what they have."""
    named = segments.withColumn("out_file", output_file(F.col("path"), target))
    had = lambda c, kind: F.col(c) if c in segments.columns else F.lit(None).cast(kind)
    passed, failed = F.col("compile_ok"), ~F.col("compile_ok")
    errors = F.col("errors") if "errors" in compiled.columns else F.lit("")
    results = compiled.select("out_file", F.col("success").alias("compile_ok"), F.left(F.coalesce(errors, F.lit("")), F.lit(error_chars)).alias("compile_errors"))
    return named.join(results, "out_file", "left").withColumns({
        "state": F.when(passed, "validated").when(failed, "failed").otherwise(F.col("state")),
        "validation_passed": F.when(passed, True).otherwise(had("validation_passed", "boolean")),
        "last_error": F.when(failed, F.concat(F.lit("compile: "), "compile_errors")).otherwise(had("last_error", "string")),
    }).drop("compile_ok", "compile_errors")


def compile_cascade_by_stem(segments: DataFrame, compiled: DataFrame, error_chars: int = 100) -> DataFrame:
    """The same where a compiled file counts for every source whose stem is any part of its name.

    Of several such files the last one by name counts; segments of sources without any keep what they have. The segments
    are written once: their stems are read several times, and the plan behind them must not stand in every reader."""
    had = lambda c, kind: F.col(c) if c in segments.columns else F.lit(None).cast(kind)
    errors = F.col("errors") if "errors" in compiled.columns else F.lit("")
    files = compiled.select(
        T.basename(F.col("out_file")).alias("text"), F.col("success").alias("ok"), F.left(F.coalesce(errors, F.lit("")), F.lit(error_chars)).alias("compile_errors")
    )
    results = files.groupBy("text").agg(F.max_by(F.struct("ok", "compile_errors"), F.struct("ok", "compile_errors")).alias("result"))
    named = settle(segments.withColumn("_stem", T.stem(F.col("path"))))
    # the last file of each stem is a maximum, so a stem with very many files is partial aggregates
    last = contained(named, files, "_stem").groupBy(F.col("name").alias("_stem")).agg(F.max("text").alias("text"))
    found = last.join(results.hint("merge"), "text").select("_stem", "result")
    passed, failed = F.col("result.ok"), ~F.col("result.ok")
    return named.join(found.hint("merge"), "_stem", "left").withColumns({
        "state": F.when(passed, "validated").when(failed, "failed").otherwise(F.col("state")),
        "validation_passed": F.when(passed, True).otherwise(had("validation_passed", "boolean")),
        "last_error": F.when(failed, F.concat(F.lit("compile: "), "result.compile_errors")).otherwise(had("last_error", "string")),
    }).drop("_stem", "result")


def compile_summary(compiled: DataFrame, *keys: str) -> DataFrame:
    return compiled.groupBy(*keys).agg(
        F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"), F.count("*").alias("total")
    )


ERROR_LINES = 10


def first_error_lines(errors: Column) -> Column:
    return F.array_join(F.slice(T.split_lines(errors), 1, ERROR_LINES), "\n")


def assemble(migrated: DataFrame, target: str) -> DataFrame:
    """Migrated files: the segments of a file by start line, a blank line between.
    Segments without code are left out. A file is one value, as on disk."""
    return (
        migrated.where("migrated_code <> ''")
        .withColumn("out_file", output_file(F.col("path"), target))
        .groupBy("out_file")
        .agg(F.array_sort(F.collect_list(F.struct("start_line", "seg_ord", "path", "migrated_code"))).alias("parts"))
        .select("out_file", F.array_join(F.col("parts.migrated_code"), "\n\n").alias("content"))
    )


def final_report(progressed: DataFrame, violations: DataFrame) -> DataFrame:
    counted = violations.groupBy("project").agg(F.count("*").alias("rule_violations"))
    return progressed.join(counted, "project", "left").select(
        "project", "total_segments", F.col("completed").alias("segments_ok"), F.col("failed").alias("segments_failed"),
        (F.col("failed") == 0).alias("compilation_passed"), F.coalesce("rule_violations", F.lit(0)).alias("rule_violations"),
    )


def project_list(supervised: DataFrame, plain: DataFrame) -> DataFrame:
    """Projects of both layouts, ``?`` where a field is missing."""
    known = lambda c: F.coalesce(F.col(c), F.lit("?"))
    migration = F.concat(known("source_language"), F.lit(" → "), known("target_language"))
    shape = lambda df, client: df.select(
        "path", client.alias("client"), known("project").alias("project"), known("status").alias("status"),
        migration.alias("migration"),
    )
    return shape(supervised, known("client")).unionByName(shape(plain, F.lit("Pipeline directo")))


def phase_durations(phases: DataFrame) -> DataFrame:
    return phases.groupBy("project", "phase").agg(
        F.sum("duration_seconds").alias("duration"), F.count("*").alias("runs")
    )


def run_metrics(progressed: DataFrame, phases: DataFrame) -> DataFrame:
    """Total duration and the share of segments that compile."""
    total = phases.groupBy("project").agg(F.sum("duration_seconds").alias("total_duration"))
    rate = F.when(F.col("total_segments") > 0, F.col("completed") / F.col("total_segments") * 100).otherwise(F.lit(0.0))
    return progressed.join(total, "project", "left").select(
        "project", "total_segments", F.col("completed").alias("segments_compiled"), rate.alias("compilation_rate"),
        F.coalesce("total_duration", F.lit(0.0)).alias("total_duration"),
    )


def tiles(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "project", F.concat("segments_compiled", F.lit("/"), "total_segments").alias("segments"),
        FM.rate_band(F.col("compilation_rate")).alias("band"),
        FM.tile_duration(F.col("total_segments") * SECONDS_PER_SEGMENT).alias("estimate"),
    )


def success_summary(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("success").alias("ok"), F.count_if(F.col("success") & F.col("compiled")).alias("compiled")
    )


def run_outcome(output: Column, timed_out: Column, runtime_missing: Column) -> Column:
    return (
        F.when(runtime_missing, "runtime_missing").when(timed_out, "timeout")
        .when(output.contains("[ERROR"), "compile_error").otherwise("ok")
    )


def outcome_summary(runs: DataFrame, *keys: str) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.count_if(F.col("outcome") == "ok").alias("ok"),
        (F.count_if(F.col("outcome") == "ok") / F.count("*") * 100).alias("success_rate"),
    )
