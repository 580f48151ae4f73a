"""Certification metrics, votes, gates and exports over the detector timings and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardloom.operators import metrics as m
from guardloom.queries import ORACLES, query
from guardloom.session import table

# A labelled score: risk / 100 of a timing row, positive if the whole call did not end in ALLOW.
_ROWS_SQL = """
    SELECT DISTINCT t.timing_no, t.detector_name, t.decision, t.risk_score, t.execution_mode, t.latency_ms, t.confidence,
           t.risk_score / 100.0::DOUBLE AS p, r.final_decision, r.final_decision <> 'ALLOW' AS y
    FROM (SELECT DISTINCT timing_no, request_id, detector_name, decision, risk_score, execution_mode, latency_ms, confidence FROM detector_timings) t
    JOIN (SELECT request_id, min(final_decision) AS final_decision FROM round_trip_traces GROUP BY request_id) r USING (request_id)
"""


def _rows(spark, sf_dir):
    t = table(spark, sf_dir, "detector_timings").select("timing_no", "request_id", "detector_name", "decision", "risk_score", "execution_mode", "latency_ms", "confidence").distinct()
    r = table(spark, sf_dir, "round_trip_traces").groupBy("request_id").agg(F.min("final_decision").alias("final_decision"))
    return t.join(r, "request_id").withColumn("p", F.col("risk_score") / 100.0).withColumn("y", F.col("final_decision") != "ALLOW")


@query(f"SELECT final_decision AS expected, decision AS actual, CAST(count(*) AS BIGINT) AS n FROM ({_ROWS_SQL}) GROUP BY ALL")
def metric_confusion(spark, sf_dir):
    return m.confusion(_rows(spark, sf_dir), "final_decision", "decision")


_CLASS_SQL = f"""
    SELECT detector_name, n, precision, recall, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1, fp_rate FROM (
      SELECT detector_name, CAST(tp + fp + fn + tn AS BIGINT) AS n, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp)::DOUBLE, 4) END AS precision,
             CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn)::DOUBLE, 4) END AS recall, CASE WHEN fp + tn > 0 THEN round(fp / (fp + tn)::DOUBLE, 4) END AS fp_rate
      FROM (SELECT detector_name, count(*) FILTER (WHERE e AND a) AS tp, count(*) FILTER (WHERE NOT e AND a) AS fp, count(*) FILTER (WHERE e AND NOT a) AS fn, count(*) FILTER (WHERE NOT e AND NOT a) AS tn
            FROM (SELECT detector_name, coalesce(final_decision <> 'ALLOW', false) AS e, coalesce(decision NOT IN ('ALLOW', 'ERROR', 'NONE'), false) AS a FROM ({_ROWS_SQL})) GROUP BY detector_name))
"""


@query(_CLASS_SQL)
def metric_classification(spark, sf_dir):
    return m.classification(_rows(spark, sf_dir), "final_decision", "decision", ["detector_name"])


@query(
    f"""
    SELECT detector_name, CASE WHEN p > 0 AND n > 0 THEN round(w / (p * n), 4) END AS auroc FROM (
      SELECT detector_name, sum(pos * (coalesce(below, 0) + neg / 2.0::DOUBLE)) AS w, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM (
        SELECT *, sum(neg) OVER (PARTITION BY detector_name ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (
          SELECT detector_name, p, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM ({_ROWS_SQL}) WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY ALL)) GROUP BY detector_name)
    """
)
def metric_auroc(spark, sf_dir):
    return m.auroc(_rows(spark, sf_dir), "y", "p", ["detector_name"])


@query(
    f"""
    SELECT detector_name, CASE WHEN count(*) FILTER (WHERE y) > 0 THEN round(sum(CASE WHEN y THEN tp / k::DOUBLE END) / count(*) FILTER (WHERE y), 4) END AS pr_auc FROM (
      SELECT detector_name, y, sum(y::INT) OVER w AS tp, count(*) OVER w AS k FROM ({_ROWS_SQL}) WHERE p IS NOT NULL AND y IS NOT NULL
      WINDOW w AS (PARTITION BY detector_name ORDER BY p DESC, timing_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY detector_name
    """
)
def metric_pr_auc(spark, sf_dir):
    return m.average_precision(_rows(spark, sf_dir), "y", "p", "timing_no", ["detector_name"])


_BINS_SQL = f"""
    SELECT detector_name, greatest(0, ceil(conf * 10)::INT - 1)::INT AS bin, avg(conf) AS confidence, avg(((p >= 0.5) = y)::INT) AS accuracy, count(*) AS n
    FROM (SELECT *, greatest(p, 1 - p) AS conf FROM ({_ROWS_SQL}) WHERE p IS NOT NULL AND y IS NOT NULL) GROUP BY ALL
"""


@query(f"SELECT detector_name, round(sum(abs(confidence - accuracy) * n) / sum(n), 4) AS ece FROM ({_BINS_SQL}) GROUP BY detector_name")
def metric_ece(spark, sf_dir):
    return m.calibration_error(_rows(spark, sf_dir), "y", "p", ["detector_name"])


@query(
    f"""
    SELECT r.bin::INT AS bin, round(confidence, 4) AS confidence, round(accuracy, 4) AS accuracy, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(0, 9)) AS bin) r
    LEFT JOIN (SELECT greatest(0, ceil(conf * 10)::INT - 1) AS bin, avg(conf) AS confidence, avg(((p >= 0.5) = y)::INT) AS accuracy, count(*) AS n
               FROM (SELECT *, greatest(p, 1 - p) AS conf FROM ({_ROWS_SQL}) WHERE p IS NOT NULL AND y IS NOT NULL) GROUP BY ALL) b USING (bin)
    """
)
def metric_reliability(spark, sf_dir):
    return m.reliability(_rows(spark, sf_dir), "y", "p")


@query("SELECT r.bin::INT AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(0, 9)) AS bin) r LEFT JOIN (SELECT least(9, greatest(0, floor(risk_score / 10.0)::INT)) AS bin, count(*) AS n FROM detector_timings WHERE risk_score IS NOT NULL GROUP BY ALL) b USING (bin)")
def metric_score_histogram(spark, sf_dir):
    return m.histogram(table(spark, sf_dir, "detector_timings"), "risk_score")


_HALF = "2025-06-15 00:00:00"


@query(
    f"""
    WITH h AS (SELECT least(9, greatest(0, floor(risk_score / 10.0)::INT)) AS bin, count(*) FILTER (WHERE evaluated_at < TIMESTAMP '{_HALF}') AS e, count(*) FILTER (WHERE evaluated_at >= TIMESTAMP '{_HALF}') AS a
               FROM detector_timings WHERE risk_score IS NOT NULL GROUP BY 1),
    s AS (SELECT coalesce(e, 0) / (SELECT sum(e) FROM h)::DOUBLE + 1e-6 AS p, coalesce(a, 0) / (SELECT sum(a) FROM h)::DOUBLE + 1e-6 AS q FROM (SELECT unnest(generate_series(0, 9)) AS bin) r LEFT JOIN h USING (bin))
    SELECT round(sum((q - p) * ln(q / p)), 4) AS psi FROM s
    """
)
def metric_drift(spark, sf_dir):
    """Stability of risk scores between the halves of the month."""
    t = table(spark, sf_dir, "detector_timings")
    cut = F.lit(_HALF).cast("timestamp_ntz")
    return m.stability_index(t.filter(F.col("evaluated_at") < cut), t.filter(F.col("evaluated_at") >= cut), "risk_score")


@query("SELECT detector_name, coalesce(round(quantile_cont(latency_ms, 0.5), 1), 0.0) AS p50, coalesce(round(quantile_cont(latency_ms, 0.95), 1), 0.0) AS p95, coalesce(round(quantile_cont(latency_ms, 0.99), 1), 0.0) AS p99, CAST(count(latency_ms) AS BIGINT) AS n FROM detector_timings GROUP BY detector_name")
def metric_latency_percentiles(spark, sf_dir):
    return m.latency_percentiles(table(spark, sf_dir, "detector_timings"), "latency_ms", ["detector_name"])


_LIMITS = m.GATES["enforcement"]
_BAD = ", ".join(f"CASE WHEN {k} IS NULL OR NOT isfinite({k}::DOUBLE) OR {f'{k} < {v}' if k in ('f1', 'auroc', 'samples') else f'{k} > {v}' if k != 'age_days' else f'{k} < -1 OR {k} > {v}'} THEN '{k}' END" for k, v in _LIMITS.items())


@query(
    f"""
    WITH c AS ({ORACLES["metric_classification"]}), a AS ({ORACLES["metric_auroc"]}), e AS ({ORACLES["metric_ece"]}), l AS ({ORACLES["metric_latency_percentiles"].replace("FROM detector_timings", f"FROM ({_ROWS_SQL})")}),
    x AS (SELECT c.* EXCLUDE (n), c.n AS samples, a.auroc, e.ece, l.p95 AS p95_ms, 30 AS age_days FROM c LEFT JOIN a USING (detector_name) LEFT JOIN e USING (detector_name) LEFT JOIN l USING (detector_name)),
    f AS (SELECT *, list_filter([{_BAD}], lambda v: v IS NOT NULL) AS bad FROM x)
    SELECT * EXCLUDE (bad), array_to_string(bad, ',') AS failures, len(bad) = 0 AS passed FROM f
    """
)
def metric_scorecards_gated(spark, sf_dir):
    """Scorecard of every detector, and whether it may enforce."""
    rows = _rows(spark, sf_dir)
    card = m.classification(rows, "final_decision", "decision", ["detector_name"]).withColumnRenamed("n", "samples")
    for part in (m.auroc(rows, "y", "p", ["detector_name"]), m.calibration_error(rows, "y", "p", ["detector_name"]), m.latency_percentiles(rows, "latency_ms", ["detector_name"]).select("detector_name", F.col("p95").alias("p95_ms"))):
        card = card.join(part, "detector_name", "left")
    return m.gate(card.withColumn("age_days", F.lit(30)), "enforcement").withColumn("failures", F.array_join("failures", ","))


@query(
    f"""
    WITH v AS (SELECT request_id, decision AS d, count(*) AS n, sum(least(100.0, greatest(0.0, coalesce(risk_score, 0)))::DOUBLE) AS r, CASE decision WHEN 'BLOCK' THEN 5 WHEN 'REDACT' THEN 4 WHEN 'TRANSFORM' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END AS k
               FROM detector_timings WHERE decision IN ('BLOCK', 'REDACT', 'TRANSFORM', 'WARN', 'ALLOW') AND request_id IS NOT NULL GROUP BY request_id, decision)
    SELECT request_id, arg_max(d, n * 10 + k) AS decision, round(sum(r) / sum(n), 2) AS risk, round(max(n) / sum(n)::DOUBLE, 4) AS agreement FROM v GROUP BY request_id
    """
)
def consensus_votes(spark, sf_dir):
    """The detectors of a request as votes of equal weight."""
    t = table(spark, sf_dir, "detector_timings").filter("request_id is not null").withColumn("risk", F.coalesce("risk_score", F.lit(0)))
    return m.consensus(t, ["request_id"], "decision", "risk")


_BUCKET_SQL = ", ".join(f"{{'le': '{b}', 'n': count(*) FILTER (WHERE latency_ms / 1000.0::DOUBLE <= {b}::DOUBLE)}}" for b in m.BUCKETS)


@query(
    f"""
    SELECT detector_name, stage, x.le AS le, CAST(x.n AS BIGINT) AS n FROM (SELECT detector_name, stage, unnest(xs) AS x FROM (
      SELECT coalesce(detector_name, '') AS detector_name, coalesce(stage, '') AS stage, [{_BUCKET_SQL}, {{'le': '+Inf', 'n': count(*)}}] AS xs FROM detector_timings WHERE latency_ms IS NOT NULL GROUP BY 1, 2))
    """
)
def exported_latency_buckets(spark, sf_dir):
    t = table(spark, sf_dir, "detector_timings")
    return m.exported_histogram(t, ["detector_name", "stage"], F.col("latency_ms") / 1000.0)


@query(
    """
    SELECT timing_no, CASE WHEN execution_mode <> 'local_deterministic' AND decision IN ('BLOCK', 'REDACT') AND NOT coalesce(confidence >= 0.8, false) THEN 'WARN' ELSE decision END AS decision
    FROM (SELECT DISTINCT timing_no, execution_mode, decision, confidence FROM detector_timings)
    """
)
def gated_decisions(spark, sf_dir):
    """Model decisions held back until their stamp passed (here: a confidence of 0.8)."""
    t = table(spark, sf_dir, "detector_timings").select("timing_no", "execution_mode", "decision", "confidence").distinct()
    return t.select("timing_no", m.gated_decision(F.col("decision"), F.col("execution_mode") != "local_deterministic", F.col("confidence") >= 0.8).alias("decision"))


@query(
    """
    SELECT timing_no, CAST(CASE WHEN risk_score IS NULL THEN NULL WHEN risk_score >= 80 THEN 3 WHEN risk_score >= 40 THEN 2 ELSE 1 END AS INTEGER) AS severity_no,
           CASE WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.8 THEN 'medium' WHEN confidence IS NOT NULL THEN 'high' END AS band, CAST(least(100, coalesce((SELECT sum(CASE h.severity WHEN 'high' THEN 50 WHEN 'medium' THEN 30 WHEN 'low' THEN 10 ELSE 0 END) FROM unnest(rule_hits) AS u(h)), 0)) AS INTEGER) AS hit_risk
    FROM (SELECT timing_no, any_value(risk_score) AS risk_score, any_value(confidence) AS confidence, any_value(rule_hits) AS rule_hits FROM detector_timings GROUP BY timing_no)
    """
)
def risk_bands(spark, sf_dir):
    """Display severity, confidence band and the sum of the hits' weights of every timing row."""
    from guardloom.operators.hits import confidence_band, hit_risk, no_hits

    t = table(spark, sf_dir, "detector_timings").select("timing_no", "risk_score", "confidence", "rule_hits").dropDuplicates(["timing_no"])
    sev = F.when(F.col("risk_score") >= 80, 3).when(F.col("risk_score") >= 40, 2).when(F.col("risk_score").isNotNull(), 1)
    return t.select("timing_no", sev.alias("severity_no"), confidence_band(F.col("confidence")).alias("band"), hit_risk(F.coalesce("rule_hits", no_hits())).alias("hit_risk"))
