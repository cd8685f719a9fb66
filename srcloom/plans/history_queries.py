"""Queries over a history of segment states, appended out of order and rebuilt at a moment."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.operators import state_history as H
from srcloom.operators.ordered import new_folder
from srcloom.plans import state_queries as Q
from srcloom.plans.derived import table
from srcloom.plans.registry import query
from srcloom.sources import state_files as SF

def counts():
    return {"attempts": F.count_if(F.col("state") == "migrating")}

#: Quarters of the time of all events: two snapshots, and the moments asked for.
SNAPSHOTS, ASKED = (1, 2), (1, 3)


def history(spark, sf_dir):
    """(folder, first and last time in microseconds): three appends in the order of a hash, a snapshot after the first and the second."""
    updates = Q.segment_updates(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = updates.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    low, high = low or 0, high or 0
    root = new_folder(spark, "history")
    for part in range(3):
        H.append_updates(updates.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part), root)
        if part < len(SNAPSHOTS):
            H.take_snapshot(spark, root, low + (high - low) * SNAPSHOTS[part] // 4, counts())
    return root, low, high


@query("state_at", "with " + Q.UPDATES + """, ends as (select min(epoch_us(ts)) as low, max(epoch_us(ts)) as high from events),
  asked as (select q, low + (high - low) * q // 4 as upto from ends, (values (1), (3)) v(q))
  select q as quarter, project, segment_id, arg_max(state, row(ts, event_id)) as state, arg_max(last_error, row(ts, event_id)) filter (where last_error is not null) as last_error,
    count(*) filter (where state = 'migrating') as attempts from updates join asked on epoch_us(ts) <= upto group by q, project, segment_id""")
def state_at(spark, sf_dir):
    root, low, high = history(spark, sf_dir)
    moments = [H.state_at(spark, root, low + (high - low) * q // 4, counts()).withColumn("quarter", F.lit(q)) for q in ASKED]
    return moments[0].unionByName(moments[1])


@query("state_table", """select c_name as project_name, case when c_custkey % 10 = 0 then 'paused' else 'idle' end as state, c_mktsegment as source_language,
  (c_nationkey + case when c_custkey % 10 = 0 then 1 else 0 end)::int as total_segments from customer""")
def state_table(spark, sf_dir):
    """A project per customer is written; then a tenth of them change, and the others stay."""
    projects = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name as project_name", "'idle' as state", "c_mktsegment as source_language", "cast(c_nationkey as int) as total_segments"
    )
    root = new_folder(spark, "state")
    SF.write_state(projects.drop("c_custkey"), root)
    changed = projects.where("c_custkey % 10 = 0").withColumns({"state": F.lit("paused"), "total_segments": F.col("total_segments") + 1})
    SF.write_state(changed.drop("c_custkey"), root)
    return SF.read_state_table(spark, root).select("project_name", "state", "source_language", "total_segments")
