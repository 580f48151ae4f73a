"""Queries of the data-processing operators: nested records (p6), repeated deliveries (p7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardloom import sql_nested
from guardloom.operators import dedup, nested
from guardloom.queries import query
from guardloom.session import table

_ORDER = ["delivery_no"]


def _nodes(spark, sf_dir):
    traces = table(spark, sf_dir, "round_trip_traces")
    return nested.dewey_nodes(traces, "trace_no", "stages", nested.STAGES)


@query(sql_nested.found())
def p6_found(spark, sf_dir):
    return nested.innermost_children(_nodes(spark, sf_dir), "trace_no").select(
        "trace_no", "stage_no", "detector_name", "item_kind", "item_no"
    )


def _trace_table(name, path):
    def run(spark, sf_dir):
        return nested.node_table(_nodes(spark, sf_dir), "trace_no", path, nested.TRACE_TABLES[path])

    run.__name__ = name
    query(sql_nested.table(path, nested.TRACE_TABLES[path]))(run)


_trace_table("p6_stages", "stages")
_trace_table("p6_stage_rule_hits", "stages.rule_hits")
_trace_table("p6_detector_results", "stages.detector_results")
_trace_table("p6_detector_rule_hits", "stages.detector_results.rule_hits")
_trace_table("p6_layer_results", "stages.detector_results.layer_results")
_trace_table("p6_label_scores", "stages.detector_results.layer_results.label_scores")
_trace_table("p6_llm_errors", "stages.llm_error")


@query()
def p6_nodes(spark, sf_dir):
    """Every node with its label and its parent's, all tables in one."""
    n = _nodes(spark, sf_dir)
    return n.select("trace_no", "schema_path", nested.dewey_text("dewey").alias("node_id"), nested.dewey_text(nested.parent_of("dewey")).alias("parent_id"), F.to_json("fields").alias("fields"))


@query(
    """
    SELECT DISTINCT timing_no, CAST(i - 1 AS INTEGER) AS ordinal, rule_hits[i].rule_id AS rule_id,
           rule_hits[i].severity AS severity, rule_hits[i].message AS message
    FROM (SELECT timing_no, rule_hits, unnest(generate_series(1, len(rule_hits))) AS i FROM detector_timings)
    WHERE rule_hits[i] IS NOT NULL
    """
)
def p6_timing_rule_hits(spark, sf_dir):
    """Rule hits of the timing rows; a copied row gives its hits once."""
    t = table(spark, sf_dir, "detector_timings")
    return nested.array_table(t, "timing_no", "rule_hits").dropDuplicates()


@query(
    """
    SELECT DISTINCT timing_no, CAST(i - 1 AS INTEGER) AS ordinal, x.execution_mode AS execution_mode, x.decision AS decision,
           x.native_score AS native_score, x.normalized_score AS normalized_score, x.model_version AS model_version,
           x.latency_ms AS latency_ms, x.cost_usd AS cost_usd, x.fallback_reason AS fallback_reason, x.selected AS selected
    FROM (SELECT timing_no, i, layer_results[i] AS x
          FROM (SELECT timing_no, layer_results, unnest(generate_series(1, len(layer_results))) AS i FROM detector_timings))
    WHERE x IS NOT NULL
    """
)
def p6_timing_layers(spark, sf_dir):
    """Layer results of the timing rows; a copied row gives its layers once."""
    t = table(spark, sf_dir, "detector_timings")
    return nested.array_table(t, "timing_no", "layer_results").dropDuplicates()


_UUID_SQL = r"""
    CASE WHEN regexp_matches(u, '^[0-9a-f]{32}$') AND u <> repeat('0', 32) THEN u END AS k
    FROM (SELECT *, regexp_replace(regexp_replace(lower(event_id), '[\s{}()\[\]"''-]', '', 'g'), '^(urn:)?(uuid:)?', '') AS u FROM egress_events)
"""


@query(f"SELECT delivery_no FROM (SELECT delivery_no, k, row_number() OVER (PARTITION BY k ORDER BY delivery_no) AS r FROM (SELECT delivery_no, {_UUID_SQL})) WHERE k IS NOT NULL AND r > 1")
def p7_found(spark, sf_dir):
    e = table(spark, sf_dir, "egress_events")
    return dedup.repeated_deliveries(e, dedup.uuid_key("event_id"), _ORDER, ["delivery_no"])


@query(
    f"""
    SELECT delivery_no, k AS event_key, occurred_at, bytes_out, received_at
    FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(k, CAST(delivery_no AS VARCHAR)) ORDER BY delivery_no) AS r
          FROM (SELECT *, {_UUID_SQL})) WHERE r = 1
    """
)
def p7_events_once(spark, sf_dir):
    """Each event once; deliveries without a usable identifier all stay."""
    e = table(spark, sf_dir, "egress_events")
    once = dedup.first_deliveries(e, dedup.uuid_key("event_id"), _ORDER, "delivery_no")
    return once.select("delivery_no", F.lower(F.hex(dedup.uuid_key("event_id"))).alias("event_key"), "occurred_at", "bytes_out", "received_at")


_CUT = "2025-06-15 00:00:00"


@query(
    f"""
    SELECT delivery_no FROM (SELECT delivery_no, k, received_at, row_number() OVER (PARTITION BY coalesce(k, CAST(delivery_no AS VARCHAR)) ORDER BY delivery_no) AS r,
           count(*) FILTER (WHERE received_at < TIMESTAMP '{_CUT}') OVER (PARTITION BY k) AS old
          FROM (SELECT *, {_UUID_SQL}))
    WHERE received_at >= TIMESTAMP '{_CUT}' AND (k IS NULL OR (old = 0 AND r = 1))
    """
)
def p7_admitted(spark, sf_dir):
    """What a batch of everything received from a day on adds to what was stored before it."""
    e = table(spark, sf_dir, "egress_events")
    key = dedup.uuid_key("event_id")
    stored = e.filter(F.col("received_at") < F.lit(_CUT).cast("timestamp_ntz")).select(key.alias("key")).filter("key is not null").distinct()
    new = e.filter(F.col("received_at") >= F.lit(_CUT).cast("timestamp_ntz"))
    return dedup.admit_batch(new, stored, key, _ORDER, "delivery_no").select("delivery_no")
