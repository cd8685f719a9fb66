"""Queries that run streams over the event table, cut into batches as they would arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.operators.ordered import new_folder
from srcloom.plans import state_queries as Q
from srcloom.plans.registry import query
from srcloom.streaming import streams as ST

BATCHES = 4
REQUESTS = "project bigint, ts timestamp, event_id bigint, to_state string"
UPDATES = "project bigint, segment_id string, ts timestamp, event_id bigint, state string, last_error string, rule string"


def arrivals(rows: DataFrame, n: int = BATCHES) -> tuple[list[DataFrame], int]:
    """(rows in n batches, delay in microseconds): each row arrives up to half a batch's time after its own time, so
    batches overlap and rows come out of order, but none is later than the delay."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("ts")
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    width = max(2, ((high or 0) - (low or 0)) // n + 1)
    delay = width // 2
    turn = F.floor((micros + F.pmod(F.xxhash64("event_id"), F.lit(delay)) - F.lit(low or 0)) / width)
    return [rows.where((turn >= n - 1) if i == n - 1 else (turn == i)) for i in range(n)], delay


def run_in_batches(spark, batches: list[DataFrame], schema: str, start) -> str:
    """Each batch is written and then read by a stream that goes on from its checkpoint; returns the table's folder."""
    source, target, checkpoint = (new_folder(spark, f"stream-{n}") for n in ("source", "table", "checkpoint"))
    for batch in batches:
        batch.write.mode("append").parquet(source)
        start(spark.readStream.schema(schema).parquet(source), target, checkpoint).awaitTermination()
    return target


@query("stream_state_fold", Q.FOLDED + " select project, event_id, from_state, accepted, state, false as late from folded")
def stream_state_fold(spark, sf_dir):
    batches, delay = arrivals(Q.requests(spark, sf_dir))
    target = run_in_batches(spark, batches, REQUESTS, lambda rows, to, check: ST.write_states(rows, to, check, f"{delay} microseconds"))
    ST.flush_states(spark, target)
    return ST.read_state_log(spark, target).select("project", "event_id", "from_state", "accepted", "state", "late")


@query("stream_progress", "with " + Q.STATE + """ select project, total_segments, completed, failed, total_segments - completed - failed as pending,
  case when total_segments > 0 then completed::double / total_segments * 100 else 0 end as progress_pct, e.attempts, e.violations, e.with_error
  from progress join (select user_id as project, count(*) filter (where event_type = 'click') as attempts, count(*) filter (where event_type = 'error') as violations,
    count(distinct event_id % 20) filter (where event_type = 'error') as with_error from events group by user_id) e using (project)""")
def stream_progress(spark, sf_dir):
    events = Q.segment_updates(spark, sf_dir)
    updates = events.withColumn("rule", F.when(F.col("state") == "failed", F.concat(F.lit("rule_"), F.col("event_id") % 7)))
    counts = {"attempts": F.count_if(F.col("state") == "migrating"), "violations": F.count("rule")}
    batches, _ = arrivals(updates)
    target = run_in_batches(spark, batches, UPDATES, lambda rows, to, check: ST.write_progress(rows, to, check, counts, most=3))
    return ST.read_progress(spark, target, attempts=F.sum("attempts"), violations=F.sum("violations"), with_error=F.count("last_error"))
