"""Streams give what the batch operators give, also when cut and resumed."""

from pyspark.sql import functions as F

from srcloom.operators import migration_state as M
from srcloom.plans import state_queries as Q
from srcloom.streaming import streams as ST
from srcloom.streaming import tables as TB

REQUESTS = "project bigint, ts timestamp, event_id bigint, to_state string"
UPDATES = "project bigint, segment_id string, ts timestamp, event_id bigint, state string, last_error string"


def run(spark, folder, start):
    """One run of a stream over what is new in a folder."""
    start(spark.readStream.schema(folder[1]).parquet(folder[0])).awaitTermination()


def logged(spark, target):
    return sorted(((r.project, r.event_id, r.from_state, r.accepted, r.state, r.late) for r in ST.read_state_log(spark, target).collect()), key=lambda r: r[:2])


def test_state_machine_stream_matches_batch(spark, sf_dir, tmp_path):
    """Files overlap in time, runs are resumed, and the end is flushed; no row is missing and none is late."""
    requests = Q.requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for part in (F.col("event_id") % 4 == 0, F.col("event_id") % 4 != 0):
        requests.where(part).repartition(2, "event_id").write.mode("append").parquet(source)
        run(spark, (source, REQUESTS), lambda rows: ST.write_states(rows, target, check, "90 days"))
    waiting = ST.read_state_log(spark, target).count()
    ST.flush_states(spark, target)
    columns = ["project", "event_id", "from_state", "accepted", "state"]
    got = ST.read_state_log(spark, target)
    want = M.fold_transitions(requests)
    assert got.where("late").isEmpty() and got.count() == want.count() > waiting
    assert got.select(columns).exceptAll(want.select(columns)).isEmpty()
    final = {r.project: r.state for r in ST.read_states(spark, target).collect()}
    assert final == {r.project: r.state for r in M.final_states(want).collect()}


def test_late_requests_are_marked_and_repeated_batches_change_nothing(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    at = lambda rows: spark.createDataFrame(rows, "project long, t long, event_id long, to_state string").selectExpr("project", "timestamp_seconds(t) as ts", "event_id", "to_state")
    runs = [
        [(1, 100, 1, "analyzing"), (1, 90, 2, "completed"), (2, 100, 3, "analyzing")],
        [(1, 200, 4, "analyzed"), (1, 95, 5, "idle")],
        [(1, 120, 6, "failed"), (1, 195, 7, "segmenting"), (2, 250, 8, "failed"), (3, None, 9, "analyzing")],
    ]
    for rows in runs:
        at(rows).coalesce(1).write.mode("append").parquet(source)
        run(spark, (source, REQUESTS), lambda rows: ST.write_states(rows, target, check, "20 seconds"))
    ST.flush_states(spark, target)
    rows = [
        (1, 2, "idle", False, "idle", False), (1, 5, "idle", False, "idle", False), (1, 1, "idle", True, "analyzing", False), (1, 6, None, False, None, True),
        (1, 7, "analyzing", False, "analyzing", False), (1, 4, "analyzing", True, "analyzed", False), (2, 3, "idle", True, "analyzing", False),
        (2, 8, "analyzing", True, "failed", False), (3, 9, None, False, None, True),
    ]
    assert logged(spark, target) == sorted(rows, key=lambda r: r[:2])
    before = logged(spark, target)
    # the same files under a new checkpoint come as batches whose numbers are known
    run(spark, (source, REQUESTS), lambda rows: ST.write_states(rows, target, str(tmp_path / "again"), "20 seconds"))
    assert logged(spark, target) == before
    # after the flush, what is older than the newest request is late
    at([(1, 249, 10, "segmenting"), (1, 300, 11, "segmenting")]).coalesce(1).write.mode("append").parquet(source)
    run(spark, (source, REQUESTS), lambda rows: ST.write_states(rows, target, check, "20 seconds"))
    ST.flush_states(spark, target)
    by_event = {r[1]: r for r in logged(spark, target)}
    assert by_event[10][5] and by_event[11] == (1, 11, "analyzed", True, "segmenting", False)


def test_stream_tables_stay_small(spark, tmp_path):
    """Many commits leave few folders, and readers see the whole of the last one."""
    target = str(tmp_path / "out")
    schema = "project long, segment_id string, ts timestamp, event_id long, state string, attempts int"
    for i in range(24):
        before = TB.newest(spark, target)
        rows = spark.createDataFrame([(1, f"s{i % 3}", None, i, "pending", i), (2, "s", None, i, None, None)], schema).withColumn("ts", F.timestamp_seconds(F.lit(i)))
        entry = TB.Commit(seq=before.seq + 1, batch_id=i)
        TB.add_part(M.segment_changes(rows.coalesce(1), {"n": F.count("*")}), target, "segments", entry, before, M.merge_changes, 4)
        TB.commit(spark, target, entry, before)
        assert len(list((tmp_path / "out" / "segments").iterdir())) <= 9 and len(list((tmp_path / "out" / "ledger").iterdir())) <= 3
    got = {(r.project, r.segment_id): (r.state, r.attempts, r.n) for r in ST.read_segments(spark, target).collect()}
    assert got == {(1, "s0"): ("pending", 21, 8), (1, "s1"): ("pending", 22, 8), (1, "s2"): ("pending", 23, 8), (2, "s"): (None, None, 24)}


def test_progress_stream_matches_batch(spark, sf_dir, tmp_path):
    updates = Q.segment_updates(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for i in range(3):
        updates.where(F.col("event_id") % 3 == i).write.mode("append").parquet(source)
        run(spark, (source, UPDATES), lambda rows: ST.write_progress(rows, target, check, {"n": F.count("*")}, most=2))
    run(spark, (source, UPDATES), lambda rows: ST.write_progress(rows, target, str(tmp_path / "again"), {"n": F.count("*")}, most=2))
    got = ST.read_segments(spark, target).select("project", "segment_id", "state", "last_error", "n")
    want = M.upsert_segments(updates, n=F.count("*")).select("project", "segment_id", "state", "last_error", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert ST.read_progress(spark, target).exceptAll(M.progress(want)).isEmpty()


def test_new_files_are_analysed_once(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "a" / "one.rs").write_text("use std::io;\n\nfn main() {\n}\n")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    ST.run_to_end(ST.analyse_stream(spark, str(src)), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (src / "two.rs").write_text("fn two() {\n}\n")
    ST.run_to_end(ST.analyse_stream(spark, str(src)), out, check).awaitTermination()
    ids = sorted(r.segment_id for r in spark.read.parquet(out).collect())
    assert ids == ["one::header", "one::main", "two::two"]
