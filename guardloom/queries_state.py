"""Rates, floods, budgets, conversations and windows over the traces and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardloom.operators import rulebooks as rb
from guardloom.operators import state as st
from guardloom.operators.banks import risk_sql, scan, scan_sql
from guardloom.functions import text as tx
from guardloom.operators.hits import hit_risk
from guardloom.queries import query
from guardloom.session import spread, table
from guardloom.streaming import windows as sw


def _events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", st.seconds_of(F.col("ts")).alias("t"))


def _fold_sql(out: str, first: dict[str, str], step: dict[str, str], result: str) -> str:
    """A fold as a recursive query: columns of the state before (s.x) and the event (e.now, e.v, e.d, e.ok)."""
    return f"""
    WITH RECURSIVE e AS (
      SELECT event_id, user_id, epoch(ts) AS now, CASE WHEN value >= 0 AND isfinite(value) THEN value ELSE 0.0 END AS v, event_type AS d, coalesce(event_type <> 'error', false) AS ok,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    begun AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 0::BIGINT AS event_id, {', '.join(f'{x} AS {k}' for k, x in first.items())}, {result.split('|')[1]} AS y FROM e),
    f AS (SELECT * FROM begun UNION ALL
      SELECT e.user_id, e.rn, e.event_id, {', '.join(f'{x} AS {k}' for k, x in step.items())}, {result.split('|')[0]} AS y FROM f AS s JOIN e ON s.user_id IS NOT DISTINCT FROM e.user_id AND e.rn = s.rn + 1)
    SELECT event_id, user_id, y AS {out} FROM f WHERE rn > 0"""


_LEFT = "CASE WHEN s.last IS NULL THEN 2.0 ELSE round(least(2.0, s.tokens + greatest(0.0, e.now - s.last) * 2 / 60.0), 6) END"
_WITHIN = "list_filter(s.kept, lambda x: x > e.now - 3600)"
_SEEN = "list_filter(s.kept, lambda x: e.now - x.t <= 86400)"
_FRESH = "(s.first IS NULL OR e.now - s.first > 86400)"
_NAME = "CASE WHEN s.since IS NULL THEN 'closed' WHEN e.now - s.since >= 3600 THEN 'half_open' ELSE 'open' END"
_FOLDS = {
    "state_token_bucket": _fold_sql("allowed", {"tokens": "2.0::DOUBLE", "last": "NULL::DOUBLE"}, {"tokens": f"{_LEFT} - CASE WHEN {_LEFT} >= 1 THEN 1 ELSE 0 END", "last": "e.now"}, f"{_LEFT} >= 1|true"),
    "state_sliding_limit": _fold_sql("allowed", {"kept": "[]::DOUBLE[]"}, {"kept": f"CASE WHEN len({_WITHIN}) < 3 THEN list_append({_WITHIN}, e.now) ELSE {_WITHIN} END"}, f"len({_WITHIN}) < 3|true"),
    "state_prompt_flood": _fold_sql("flood", {"kept": "[]::STRUCT(t DOUBLE, d VARCHAR)[]"}, {"kept": f"list_append({_SEEN}, {{'t': e.now, 'd': e.d}})[-10:]"}, f"len(list_filter({_SEEN}, lambda x: x.d = e.d)) >= 3|true"),
    "state_session_budget": _fold_sql("over", {"first": "NULL::DOUBLE", "total": "0.0::DOUBLE"}, {"first": f"CASE WHEN {_FRESH} THEN e.now ELSE s.first END", "total": f"CASE WHEN {_FRESH} THEN 0.0 ELSE s.total END + e.v"}, f"CASE WHEN {_FRESH} THEN 0.0 ELSE s.total END + e.v > 500|true"),
    "state_repeats": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) >= 3 AS repeated FROM events",
    "state_circuit_breaker": _fold_sql(
        "breaker", {"n": "0::BIGINT", "since": "NULL::DOUBLE"},
        {"n": f"CASE WHEN {_NAME} = 'open' THEN s.n WHEN e.ok THEN 0 ELSE s.n + 1 END", "since": f"CASE WHEN {_NAME} = 'open' THEN s.since WHEN e.ok THEN NULL WHEN {_NAME} = 'half_open' OR s.n + 1 >= 3 THEN e.now END"},
        f"{_NAME}|'closed'",
    ),
}


def _folded(name: str, made, out: str, out_type: str, amount=None):
    def run(spark, sf_dir):
        e = _events(spark, sf_dir).withColumn("digest", F.sha2("event_type", 256)).withColumn("amount", F.col("value")).withColumn("ok", F.col("event_type") != "error")
        step, start = made
        return st.fold(e, ["user_id"], ["t", "event_id"], ["digest", "amount", "ok"], step, start, out, out_type).select("event_id", "user_id", out)

    run.__name__ = name
    query(_FOLDS[name])(run)


_folded("state_token_bucket", st.token_bucket(2), "allowed", "boolean")
_folded("state_sliding_limit", st.sliding_limit(3, 3600.0), "allowed", "boolean")
_folded("state_prompt_flood", st.prompt_flood(86_400.0), "flood", "boolean")
_folded("state_session_budget", st.anchored_budget(500.0, 86_400.0), "over", "boolean")
_folded("state_repeats", st.state_repeats(), "repeated", "boolean")
_folded("state_circuit_breaker", st.circuit_breaker(3, 3600.0), "breaker", "string")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def rate_fixed_window(spark, sf_dir):
    return st.fixed_window_allowed(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 2, 3600).select("event_id", "allowed")


@query(
    """
    SELECT timing_no, CAST(CASE WHEN risk_score > 0 THEN least(100, risk_score + 15 * coalesce(sum(CASE WHEN risk_score > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id ORDER BY evaluated_at, timing_no ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)) ELSE risk_score END AS INTEGER) AS escalated
    FROM (SELECT DISTINCT timing_no, request_id, risk_score, evaluated_at FROM detector_timings WHERE request_id IS NOT NULL)
    """
)
def conversation_escalation(spark, sf_dir):
    t = table(spark, sf_dir, "detector_timings").select("timing_no", "request_id", "risk_score", "evaluated_at").distinct().filter("request_id is not null")
    return st.escalation(t, ["request_id"], ["evaluated_at", "timing_no"], "risk_score").select("timing_no", F.col("escalated").cast("int").alias("escalated"))


@query(
    """
    SELECT tenant_id, hour, CAST(n AS BIGINT) AS n, n > 3 AS burst FROM (
      SELECT coalesce(tenant_id, '') AS tenant_id, date_trunc('hour', created_at) AS hour, count(*) AS n FROM documents GROUP BY ALL)
    """
)
def ingest_bursts(spark, sf_dir):
    """Documents written per tenant and hour, by event time."""
    d = table(spark, sf_dir, "documents")
    x = d.groupBy(F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), F.date_trunc("hour", F.col("created_at").cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("burst", F.col("n") > 3)


def _chunks(spark, sf_dir):
    """Model outputs as streams: a trace's output in lines."""
    t = spread(table(spark, sf_dir, "round_trip_traces").select("trace_no", "final_output")).select("trace_no", F.posexplode(F.split("final_output", r"(?<=[.!?]) ")).alias("seq", "chunk"))
    return t


@query(
    f"""
    WITH w AS (SELECT trace_no, i, CASE WHEN i = f THEN substring(t, i * 160 + 1) ELSE substring(t, i * 160 + 1, 200) END AS w, i = f AS last FROM (
        SELECT trace_no, t, f, unnest(generate_series(0, f)) AS i FROM (
          SELECT trace_no, t, CASE WHEN length(t) >= 200 THEN floor((length(t) - 200) / 160.0)::INT + 1 ELSE 0 END AS f
          FROM (SELECT trace_no, replace(replace(replace(final_output, '. ', '.'), '! ', '!'), '? ', '?') AS t FROM round_trip_traces WHERE final_output <> '')))),
    j AS (SELECT trace_no, i, CASE WHEN last THEN length(w) ELSE 160 END AS released, len({scan_sql("p", rb.JAILBREAK + rb.EXFILTRATION)}) AS n, {risk_sql("p", rb.JAILBREAK + rb.EXFILTRATION)} AS risk FROM (SELECT *, {tx.plain_sql("w")} AS p FROM w WHERE w <> '')),
    b AS (SELECT *, min(CASE WHEN risk >= 50 THEN i END) OVER (PARTITION BY trace_no) AS stop FROM j)
    SELECT trace_no, CASE WHEN max(stop) IS NOT NULL THEN 'BLOCK' ELSE 'ALLOW' END AS final_decision, CAST(coalesce(sum(CASE WHEN stop IS NULL OR i < stop THEN released END), 0) AS BIGINT) AS released_chars, CAST(max(stop) AS INTEGER) AS blocked_at FROM b GROUP BY trace_no
    """
)
def stream_windows(spark, sf_dir):
    """Overlapping windows of each output, judged before release; what was let through."""
    w = sw.windows(_chunks(spark, sf_dir), "trace_no", "seq", "chunk")
    p = tx.plain(F.col("text"))
    risk = hit_risk(scan(p, tx.tokens(p), rb.JAILBREAK + rb.EXFILTRATION))
    return sw.released(w.withColumn("decision", F.when(risk >= 50, "BLOCK").otherwise("ALLOW")), "trace_no")


@query(
    """
    SELECT trace_no, CAST(count(*) AS INTEGER) AS n_windows, CAST(sum(length(w)) AS BIGINT) AS chars FROM (
      SELECT trace_no, CASE WHEN i = f THEN substring(t, i * 160 + 1) ELSE substring(t, i * 160 + 1, 200) END AS w FROM (
        SELECT trace_no, t, f, unnest(generate_series(0, f)) AS i FROM (
          SELECT trace_no, t, CASE WHEN length(t) >= 200 THEN floor((length(t) - 200) / 160.0)::INT + 1 ELSE 0 END AS f
          FROM (SELECT trace_no, replace(replace(replace(final_output, '. ', '.'), '! ', '!'), '? ', '?') AS t FROM round_trip_traces WHERE final_output <> '')))) WHERE w <> '' GROUP BY trace_no
    """
)
def stream_window_counts(spark, sf_dir):
    w = sw.windows(_chunks(spark, sf_dir), "trace_no", "seq", "chunk")
    return w.groupBy("trace_no").agg(F.count(F.lit(1)).cast("int").alias("n_windows"), F.sum(F.length("text")).alias("chars"))
