"""Queries over migration state, derived from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from srcloom.functions import text as T
from srcloom.operators import migration_state as M
from srcloom.plans.derived import source_files, table
from srcloom.plans.registry import query
from srcloom.plans.structure_queries import FILES, SEGMENTS, corpus_segments

_STATES = ", ".join(f"'{s}'" for s in M.STATES)
_EDGES = ", ".join(f"('{a}', '{b}')" for a, bs in M.ALLOWED.items() for b in bs)
REQUESTS = f"requests as (select user_id as project, ts, event_id, [{_STATES}][event_id % 11 + 1] as to_state from events)"
ALLOWED = f"allowed(from_state, to_state) as (values {_EDGES})"
UPDATES = """updates as (select user_id as project, concat('f', event_id % 20, '::s') as segment_id, ts, event_id,
  case event_type when 'view' then 'pending' when 'click' then 'migrating' when 'signup' then 'migrated' when 'purchase' then 'validated' else 'failed' end as state,
  case when event_type = 'click' then count(*) filter (where event_type = 'click') over (partition by user_id, event_id % 20 order by ts, event_id) end as attempts,
  case when event_type = 'error' then concat('value ', cast(round(value) as int)) end as last_error from events)"""
STATE = UPDATES + """,
  segment_state as (select project, segment_id, arg_max(state, row(ts, event_id)) as state, coalesce(max(attempts), 0) as attempts,
    arg_max(last_error, row(ts, event_id)) filter (where last_error is not null) as last_error from updates group by project, segment_id),
  progress as (select project, count(*) as total_segments, count(*) filter (where state = 'validated') as completed,
    count(*) filter (where state = 'failed') as failed from segment_state group by project)"""
FOLDED = f"""with recursive {REQUESTS}, {ALLOWED},
  ranked as (select *, row_number() over (partition by project order by ts, event_id) as n from requests),
  folded as (
    select r.project, r.ts, r.event_id, r.to_state, r.n, 'idle' as from_state, a.to_state is not null as accepted,
      case when a.to_state is not null then r.to_state else 'idle' end as state
    from ranked r left join allowed a on a.from_state = 'idle' and a.to_state = r.to_state where r.n = 1
    union all
    select r.project, r.ts, r.event_id, r.to_state, r.n, f.state, a.to_state is not null, case when a.to_state is not null then r.to_state else f.state end
    from folded f join ranked r on r.project = f.project and r.n = f.n + 1
      left join allowed a on a.from_state = f.state and a.to_state = r.to_state)"""
VIOLATIONS = "violations as (select user_id as project, ts, event_id, concat('rule_', event_id % 7) as rule, concat('f', event_id % 20, '::s') as segment_id, props as details from events where event_type = 'error')"


def requests(spark, sf_dir):
    states = ", ".join(f"'{s}'" for s in M.STATES)
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as project", "ts", "event_id", f"element_at(array({states}), cast(event_id % 11 + 1 as int)) as to_state"
    )


def segment_updates(spark, sf_dir):
    """Attempts are counted per segment by the upsert, so no window is needed here."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id as project", "concat('f', event_id % 20, '::s') as segment_id", "ts", "event_id",
        """case event_type when 'view' then 'pending' when 'click' then 'migrating' when 'signup' then 'migrated'
           when 'purchase' then 'validated' else 'failed' end as state""",
        "case when event_type = 'error' then concat('value ', cast(round(value) as int)) end as last_error",
    )


def segment_state(spark, sf_dir):
    return M.upsert_segments(segment_updates(spark, sf_dir), attempts=F.count_if(F.col("state") == "migrating"))


def violations(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(
        "user_id as project", "ts", "event_id", "concat('rule_', event_id % 7) as rule",
        "concat('f', event_id % 20, '::s') as segment_id", "props as details",
    )


def phases(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id as project", "event_type as phase", "value as duration_seconds")


@query("transition_check", f"""with {REQUESTS}, {ALLOWED}, seen as (select *, coalesce(lag(to_state) over (partition by project order by ts, event_id), 'idle') as previous from requests)
  select project, event_id, previous, s.to_state, a.to_state is not null as allowed from seen s left join allowed a on a.from_state = s.previous and a.to_state = s.to_state""")
def transition_check(spark, sf_dir):
    return M.check_transitions(requests(spark, sf_dir)).select("project", "event_id", "previous", "to_state", "allowed")


@query("state_fold", FOLDED + " select project, event_id, from_state, accepted, state from folded")
def state_fold(spark, sf_dir):
    return M.fold_transitions(requests(spark, sf_dir)).select("project", "event_id", "from_state", "accepted", "state")


@query("final_states", FOLDED + """ select project, arg_max(state, n) as state, count(*) filter (where accepted) as n_accepted,
  count(*) filter (where not accepted) as n_rejected from folded group by project""")
def final_states(spark, sf_dir):
    return M.final_states(M.fold_transitions(requests(spark, sf_dir)))


@query("segment_state", "with " + STATE + " select project, segment_id, state, attempts, last_error from segment_state")
def segment_state_query(spark, sf_dir):
    return segment_state(spark, sf_dir).select("project", "segment_id", "state", "attempts", "last_error")


@query("segment_counters", "with " + STATE + " select project, completed, failed from progress")
def segment_counters(spark, sf_dir):
    return M.progress(segment_state(spark, sf_dir)).select("project", "completed", "failed")


@query("retryable_segments", "with " + STATE + " select project, segment_id, state, attempts from segment_state where state in ('pending', 'failed') and attempts < 3")
def retryable_segments(spark, sf_dir):
    return M.retryable(segment_state(spark, sf_dir)).select("project", "segment_id", "state", "attempts")


@query("progress", "with " + STATE + """ select project, total_segments, completed, failed, total_segments - completed - failed as pending,
  case when total_segments > 0 then completed::double / total_segments * 100 else 0 end as progress_pct from progress""")
def progress(spark, sf_dir):
    return M.progress(segment_state(spark, sf_dir))


_LOG = f""", {VIOLATIONS}, log as (select project, ts, event_id, 'state_transition' as type, concat(from_state, ' → ', state) as detail from folded where accepted
  union all select project, ts, event_id, 'rule_violation', concat(rule, ' en ', segment_id, ': ', details) from violations)"""


def _log(spark, sf_dir):
    return M.event_log(M.fold_transitions(requests(spark, sf_dir)), violations(spark, sf_dir))


@query("event_log", FOLDED + _LOG + " select project, event_id, type, detail from log")
def event_log(spark, sf_dir):
    return _log(spark, sf_dir).select("project", "event_id", "type", "detail")


@query("latest_events", FOLDED + _LOG + """, newest as (select *, row_number() over (partition by project order by ts desc, event_id desc, type desc) as recency from log)
  select project, event_id, type, recency from newest where recency <= 8""")
def latest_events(spark, sf_dir):
    return M.latest(_log(spark, sf_dir), 8, ("ts", "event_id", "type")).select("project", "event_id", "type", "recency")


@query("latest_violations", f"""with {VIOLATIONS}, newest as (select *, row_number() over (partition by project order by ts desc, event_id desc) as recency from violations)
  select project, event_id, rule, recency from newest where recency <= 5""")
def latest_violations(spark, sf_dir):
    return M.latest(violations(spark, sf_dir), 5).select("project", "event_id", "rule", "recency")


@query("resume_segments", "with " + STATE + """ select distinct project, segment_id from updates u where not exists (
  select 1 from segment_state s where s.project = u.project and s.segment_id = u.segment_id and (s.state = 'validated' or s.attempts >= 3))""")
def resume_segments(spark, sf_dir):
    every = segment_updates(spark, sf_dir).select("project", "segment_id").distinct()
    return M.to_resume(every, segment_state(spark, sf_dir))


_COMPILED = "compiled as (select concat('src/d', o_orderkey % 100, '/f', o_orderkey, '.rs') as out_file, o_orderkey % 4 as kind, o_orderstatus <> 'P' as success, concat('error ', repeat('x', cast(o_orderkey % 200 as int))) as errors from orders)"


def compiled(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('src/d', o_orderkey % 100, '/f', o_orderkey, '.rs') as out_file", "o_orderkey % 4 as kind", "o_orderstatus <> 'P' as success",
        "concat('error ', repeat('x', cast(o_orderkey % 200 as int))) as errors",
    )


@query("compile_cascade", SEGMENTS + f""", {_COMPILED} select path, segment_id, case when success then 'validated' else 'failed' end as state,
  case when success then true end as validation_passed, case when not success then concat('compile: ', left(errors, 100)) end as last_error from segments join compiled on out_file = regexp_replace(path, '\\.[a-z]+$', '.rs')""")
def compile_cascade(spark, sf_dir):
    rows = corpus_segments(spark, sf_dir).select("path", "segment_id", F.lit("migrated").alias("state"))
    return M.compile_cascade(rows, compiled(spark, sf_dir), "rust").select("path", "segment_id", "state", "validation_passed", "last_error")


@query("compile_cascade_by_stem", SEGMENTS + f""", {_COMPILED}, stems as (select distinct regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[a-z]+$', '') as stem from segments),
  names as (select regexp_replace(out_file, '^.*/', '') as name, success, errors from compiled),
  last as (select stem, arg_max(success, name) as success, arg_max(errors, name) as errors from stems join names on contains(name, stem) group by stem)
  select path, segment_id, case when success then 'validated' else 'failed' end as state, case when success then true end as validation_passed,
    case when not success then concat('compile: ', left(errors, 100)) end as last_error from segments join last on stem = regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[a-z]+$', '')""")
def compile_cascade_by_stem(spark, sf_dir):
    rows = corpus_segments(spark, sf_dir).select("path", "segment_id", F.lit("migrated").alias("state"))
    return M.compile_cascade_by_stem(rows, compiled(spark, sf_dir)).select("path", "segment_id", "state", "validation_passed", "last_error")


@query("compile_summary", f"with {_COMPILED} select kind, count(*) filter (where success) as passed, count(*) filter (where not success) as failed, count(*) as total from compiled group by kind")
def compile_summary(spark, sf_dir):
    return M.compile_summary(compiled(spark, sf_dir), "kind")


@query("compile_error_lines", "select doc_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) as lines from documents")
def compile_error_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.first_error_lines(F.col("text")).alias("lines"))


@query("assembled_files", SEGMENTS + r""" select regexp_replace(path, '\.[a-z]+$', '.rs') as out_file, string_agg(code, concat(chr(10), chr(10)) order by start_line, seg_ord) as content
  from segments where kind <> 'globals' group by path""")
def assembled_files(spark, sf_dir):
    migrated = corpus_segments(spark, sf_dir).select(
        "path", "start_line", "seg_ord", F.when(F.col("kind") != "globals", F.col("code")).otherwise("").alias("migrated_code")
    )
    return M.assemble(migrated, "rust")


@query("project_report", "with " + STATE + f""", {VIOLATIONS}, counted as (select project, count(*) as n from violations group by project)
  select project, total_segments, completed as segments_ok, failed as segments_failed, failed = 0 as compilation_passed, coalesce(n, 0) as rule_violations, s_name as client, n_name as country
  from progress left join counted using (project) left join supplier on s_suppkey = project left join nation on n_nationkey = s_nationkey""")
def project_report(spark, sf_dir):
    report = M.final_report(M.progress(segment_state(spark, sf_dir)), violations(spark, sf_dir))
    clients = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).selectExpr("s_suppkey as project", "s_name as client", "n_name as country")
    return report.join(clients, "project", "left")


@query("project_list", """select concat('out/s', s_suppkey) as path, s_name as client, coalesce(n_name, '?') as project, '?' as status, concat('cobol → ', case when s_suppkey % 3 = 0 then '?' else 'rust' end) as migration
    from supplier left join nation on n_nationkey = s_nationkey and n_nationkey % 2 = 0
  union all select concat('out/c', c_custkey), 'Pipeline directo', c_name, c_mktsegment, 'cpp → rust' from customer""")
def project_list(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    supervised = table(spark, sf_dir, "supplier").join(nations, F.col("n_nationkey") == F.col("s_nationkey"), "left").selectExpr(
        "concat('out/s', s_suppkey) as path", "s_name as client", "n_name as project", "cast(null as string) as status",
        "'cobol' as source_language", "case when s_suppkey % 3 <> 0 then 'rust' end as target_language",
    )
    plain = table(spark, sf_dir, "customer").selectExpr(
        "concat('out/c', c_custkey) as path", "c_name as project", "c_mktsegment as status",
        "'cpp' as source_language", "'rust' as target_language",
    )
    return M.project_list(supervised, plain)


@query("phase_durations", "select user_id as project, event_type as phase, round(sum(value), 2) as duration, count(*) as runs from events group by all")
def phase_durations(spark, sf_dir):
    return M.phase_durations(phases(spark, sf_dir)).withColumn("duration", F.round("duration", 2))


_METRICS = "with " + STATE + """, metrics as (select project, total_segments, completed as segments_compiled,
  case when total_segments > 0 then completed::double / total_segments * 100 else 0 end as compilation_rate, total_duration
  from progress join (select user_id as project, round(sum(value), 2) as total_duration from events group by user_id) using (project))"""


def _metrics(spark, sf_dir):
    return M.run_metrics(M.progress(segment_state(spark, sf_dir)), phases(spark, sf_dir))


@query("run_metrics", _METRICS + " select * from metrics")
def run_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).withColumn("total_duration", F.round("total_duration", 2))


@query("dashboard_tiles", _METRICS + """ select project, concat(segments_compiled, '/', total_segments) as segments,
  case when compilation_rate >= 80 then 'success' when compilation_rate >= 50 then 'warning' else 'danger' end as band,
  case when total_segments * 5 < 60 then concat(total_segments * 5, 's') else concat(total_segments * 5 // 60, 'm') end as estimate from metrics""")
def dashboard_tiles(spark, sf_dir):
    return M.tiles(_metrics(spark, sf_dir))


@query("migration_success", """select o_orderpriority, count(*) as total, count(*) filter (where o_orderstatus <> 'P') as ok,
  count(*) filter (where o_orderstatus = 'F') as compiled from orders group by o_orderpriority""")
def migration_success(spark, sf_dir):
    results = table(spark, sf_dir, "orders").selectExpr("o_orderpriority", "o_orderstatus <> 'P' as success", "o_orderstatus = 'F' as compiled")
    return M.success_summary(results, "o_orderpriority")


@query("example_catalogue", FILES + r""" select regexp_replace(path, '/[^/]*$', '') as folder, language, count(*) as n_files,
  sum(len(string_split(content, chr(10))) - 1) as n_lines from files group by all""")
def example_catalogue(spark, sf_dir):
    files = source_files(spark, sf_dir).select(
        T.parent(F.col("path")).alias("folder"), "language", T.line_count_splitlines(F.col("content")).alias("n")
    )
    return files.groupBy("folder", "language").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_lines"))


@query("run_outcomes", """with runs as (select event_type, case when event_id % 17 = 0 then 'runtime_missing' when event_id % 13 = 0 then 'timeout'
    when event_type = 'error' then 'compile_error' else 'ok' end as outcome from events)
  select event_type, count(*) as runs, count(*) filter (where outcome = 'ok') as ok, count(*) filter (where outcome = 'ok')::double / count(*) * 100 as success_rate from runs group by event_type""")
def run_outcomes(spark, sf_dir):
    captured = F.when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] "), "props")).otherwise(F.col("props"))
    runs = table(spark, sf_dir, "events").select(
        "event_type", M.run_outcome(captured, F.col("event_id") % 13 == 0, F.col("event_id") % 17 == 0).alias("outcome")
    )
    return M.outcome_summary(runs, "event_type")
