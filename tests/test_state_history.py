"""A history of segment states, and a state table whose projects change one by one."""

import os
import random

from pyspark.sql import functions as F

from srcloom.operators import state_history as H
from srcloom.sources import state_files as SF

def counts():
    return {"attempts": F.count_if(F.col("state") == "migrating")}

SHAPE = "project string, segment_id string, ts timestamp, event_id bigint, state string, last_error string"


def test_any_moment_whatever_the_snapshots(spark, tmp_path):
    rng = random.Random(3)
    rows = [
        (f"p{rng.randint(0, 3)}", f"s{rng.randint(0, 2)}", rng.randint(0, 50), i, rng.choice(["pending", "migrating", "failed", None]), rng.choice([None, f"e{i}"]))
        for i in range(300)
    ]
    rng.shuffle(rows)
    root = str(tmp_path / "history")
    for k in range(3):
        df = spark.createDataFrame([r[:2] + (None,) + r[3:] for r in rows[k * 100 : k * 100 + 100]], SHAPE)
        times = spark.createDataFrame([(r[3], r[2]) for r in rows[k * 100 : k * 100 + 100]], "event_id bigint, t bigint")
        df = df.drop("ts").join(times, "event_id").withColumn("ts", F.timestamp_micros("t")).drop("t")
        H.append_updates(df, root, buckets=4)
        H.take_snapshot(spark, root, [30, 10, 20][k], counts(), buckets=4)
    H.append_updates(spark.createDataFrame([("p0", "s0", None, 999, "failed", "no time")], SHAPE), root, buckets=4)
    for upto in (-1, 5, 10, 25, 50):
        want = {}
        for p, s, t, i, state, error in sorted(rows, key=lambda r: (r[2], r[3])):
            if t <= upto:
                one = want.setdefault((p, s), [None, None, 0])
                one[0], one[1], one[2] = state or one[0], error or one[1], one[2] + (state == "migrating")
        got = {(r.project, r.segment_id): [r.state, r.last_error, r.attempts] for r in H.state_at(spark, root, upto, counts(), buckets=4).collect()}
        assert got == want, upto
        one = {(r.project, r.segment_id) for r in H.state_at(spark, root, upto, counts(), projects=["p1"], buckets=4).collect()}
        assert one == {k for k in want if k[0] == "p1"}


def stamps(root):
    return {d: sorted(os.listdir(f"{root}/{d}")) for d in os.listdir(root) if d.startswith("bucket=")}


def test_a_project_rewrites_its_folder_alone(spark, tmp_path):
    root = str(tmp_path / "state")
    shape = "project_name string, state string, updated_at string"
    SF.write_state(spark.createDataFrame([(f"p{i}", "idle", "1") for i in range(40)], shape), root, buckets=8)
    before = stamps(root)
    SF.write_state(spark.createDataFrame([("p7", "paused", "2"), ("p7", "failed", "3"), ("p7", "idle", "1")], shape), root, buckets=8)
    after = stamps(root)
    assert len(before) > 4 and before.keys() == after.keys() and sum(before[d] != after[d] for d in before) == 1
    got = {r.project_name: r.state for r in SF.read_state_table(spark, root).collect()}
    assert got == {f"p{i}": "failed" if i == 7 else "idle" for i in range(40)}
    SF.write_state(spark.createDataFrame([], shape), root, buckets=8)
    assert stamps(root) == after
