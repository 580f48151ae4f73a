"""Queries of the text operators and, where SQL can say the same, their DuckDB texts."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardloom.llm import abuse, bpe, langid, lookalike, mixture, pii, reading, sketch
from guardloom.llm.common import spread
from guardloom.session import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- 1 look-alike texts -------------------------------------------------------------


_FORMS_SQL = f"SELECT rec_no, text, {lookalike.form_sql('text')} AS form FROM infer_requests"


@query(f"WITH f AS ({_FORMS_SQL}) SELECT a.rec_no AS rec_no_a, b.rec_no AS rec_no_b FROM f AS a JOIN f AS b ON a.form = b.form AND a.rec_no < b.rec_no AND a.text <> b.text")
def p1_found(spark, sf_dir):
    return lookalike.same_look_pairs(table(spark, sf_dir, "infer_requests"), "rec_no", "text")


@query(f"SELECT rec_no, form AS canonical FROM ({_FORMS_SQL})")
def p1_canonical(spark, sf_dir):
    return lookalike.canonical_forms(table(spark, sf_dir, "infer_requests"), "rec_no", "text")


# --- 2 languages --------------------------------------------------------------------


def _language_model(spark, sf_dir):
    """Centroids from the labelled documents; the sample is bounded per language."""
    return langid.fit(langid.labelled_sample(table(spark, sf_dir, "documents"), "text", "lang", "doc_id"))


def _segments(spark, sf_dir):
    return langid.segments(table(spark, sf_dir, "infer_requests"), _language_model(spark, sf_dir), "rec_no", "text")


@query()
def p2_found(spark, sf_dir):
    labels = langid.label_of("params")
    rows = table(spark, sf_dir, "infer_requests").select("rec_no", "text", F.coalesce(labels, F.lit("")).alias("label"))
    both = rows.select(F.struct("rec_no", "label").alias("k"), "text")
    segs = langid.segments(both, _language_model(spark, sf_dir), "k", "text")
    out = segs.filter(F.col("lang") != F.col("k.label")).select("k.rec_no", "lang")
    return out.dropDuplicates(["rec_no", "lang"])


@query()
def p2_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query()
def p2_languages(spark, sf_dir):
    return langid.document_language(_segments(spark, sf_dir), "rec_no")


# --- 3 abusive content --------------------------------------------------------------


def _texts(spark, sf_dir):
    """The texts of problems 3 and 5 with where they come from."""
    a = table(spark, sf_dir, "infer_requests").select(F.lit("infer_requests").alias("origin"), "rec_no", "source", "text")
    b = table(spark, sf_dir, "round_trip_traces").select(F.lit("round_trip_traces").alias("origin"), F.col("trace_no").alias("rec_no"), "source", F.col("final_output").alias("text"))
    return a.unionByName(b)


def _abuse_scores(spark, sf_dir):
    return abuse.scored(_texts(spark, sf_dir), ["origin", "rec_no", "source"], "text")


@query()
def p3_found(spark, sf_dir):
    return _abuse_scores(spark, sf_dir).filter("abusive").select("origin", "rec_no")


@query()
def p3_scores(spark, sf_dir):
    return _abuse_scores(spark, sf_dir).select("origin", "rec_no", "probability", "score", "abusive")


@query()
def p3_rates(spark, sf_dir):
    """Texts, cases and rate of every source; a null source is a source."""
    x = _abuse_scores(spark, sf_dir).groupBy("origin", "source")
    return x.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("abusive").alias("n_abusive"), F.round(F.avg(F.col("abusive").cast("int")), 6).alias("rate"))


@query()
def p3_passages(spark, sf_dir):
    t = _texts(spark, sf_dir)
    return abuse.flagged_passages(t, ["origin", "rec_no"], "text", abuse.fit(t, "text"))


# --- 4 percentiles ------------------------------------------------------------------

_SHARES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _latencies(spark, sf_dir):
    t = table(spark, sf_dir, "detector_timings")
    return sketch.once(t, "timing_no", ["detector_name", "latency_ms", "evaluated_at"]).withColumn("day", F.to_date("evaluated_at"))


def _day_sketches(spark, sf_dir):
    return sketch.sketch(_latencies(spark, sf_dir), "latency_ms", ["detector_name", "day"])


_GAMMA = (1 + sketch.ALPHA) / (1 - sketch.ALPHA)
_SKETCH_SQL = f"""
    SELECT detector_name, day, CAST(sign(x) AS INTEGER) AS sgn,
           CAST(CASE WHEN x = 0 THEN 0 ELSE ceil(ln(abs(x)) / ln(CAST({_GAMMA!r} AS DOUBLE))) END AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT DISTINCT timing_no, detector_name, CAST(latency_ms AS DOUBLE) AS x, CAST(evaluated_at AS DATE) AS day FROM detector_timings)
    WHERE x IS NOT NULL GROUP BY ALL
"""


def _percentile_sql(groups: str) -> str:
    picks = ", ".join(
        f"arg_min(mid, place) FILTER (WHERE upto > floor({p!r}::DOUBLE * (total - 1))) AS {name}" for name, p in _SHARES.items()
    )
    return f"""
    SELECT {groups}, CAST(max(total) AS BIGINT) AS n, {picks} FROM (
      SELECT *, sum(n) OVER (PARTITION BY {groups} ORDER BY place) AS upto, sum(n) OVER (PARTITION BY {groups}) AS total FROM (
        SELECT {groups}, sgn * (bucket + 10000000) AS place, sgn * 2.0::DOUBLE / ({_GAMMA!r}::DOUBLE + 1) * pow({_GAMMA!r}::DOUBLE, bucket) AS mid, sum(n) AS n
        FROM ({_SKETCH_SQL}) GROUP BY {groups}, sgn, bucket)) GROUP BY {groups}
    """


@query(_SKETCH_SQL)
def p4_sketches(spark, sf_dir):
    """What is stored per day: bucket counts that merge by addition."""
    return _day_sketches(spark, sf_dir)


@query(_percentile_sql("detector_name"))
def p4_percentiles(spark, sf_dir):
    """Per detector, merged from the sketches of its days."""
    merged = sketch.merge(_day_sketches(spark, sf_dir), ["detector_name"])
    return sketch.percentiles(merged, ["detector_name"], _SHARES)


@query(_percentile_sql("detector_name, day"))
def p4_percentiles_by_day(spark, sf_dir):
    return sketch.percentiles(_day_sketches(spark, sf_dir), ["detector_name", "day"], _SHARES)


# --- 8 token ids --------------------------------------------------------------------


@query()
def p8_ids(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


# --- 5 personal information ---------------------------------------------------------


def _pii_key(spark) -> str:
    """The secret of the pseudonyms; a random one for this run where none is set, so nobody can undo them."""
    return spark.conf.get("spark.guardloom.pii.key", "") or secrets.token_hex(32)


@query()
def p5_found(spark, sf_dir):
    return pii.found_kinds(_texts(spark, sf_dir), ["origin", "rec_no"], "text", _pii_key(spark))


@query()
def p5_redacted(spark, sf_dir):
    return pii.redacted(_texts(spark, sf_dir), ["origin", "rec_no"], "text", _pii_key(spark)).drop("kinds")


# --- 9 mixtures ---------------------------------------------------------------------


def _counted(spark, sf_dir):
    """doc_id, source and tokens of all documents, counted once and written to the shared folder."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return materialize(bpe.token_counts(d, "text").drop("text"))


@query()
def p9_mixture(spark, sf_dir):
    return mixture.mix(_counted(spark, sf_dir), "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"))


@query()
def p9_shares(spark, sf_dir):
    counted, targets = _counted(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    mixed = mixture.mix(counted, "doc_id", "source", "n_tokens", targets)
    return mixture.shares(mixed, targets, counted, "source", "n_tokens")


# --- 10 reading level ---------------------------------------------------------------


def _reading_model(spark, sf_dir):
    return reading.fit(table(spark, sf_dir, "documents"), "text", "source", "lang")


def _graded(spark, sf_dir):
    return reading.graded(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", "lang", _reading_model(spark, sf_dir))


@query()
def p10_found(spark, sf_dir):
    return _graded(spark, sf_dir).filter("english_prose and level in ('easy', 'hard')").select("doc_id", "level")


@query()
def p10_grades(spark, sf_dir):
    return reading.all_graded(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text", "lang", _reading_model(spark, sf_dir))


@query()
def p10_profile(spark, sf_dir):
    """How demanding each source is: English prose by level."""
    g = _graded(spark, sf_dir).filter("english_prose").groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("mean_grade"), *[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in ("easy", "middle", "hard")])


@query()
def p10_validation(spark, sf_dir):
    """Error of the grades of each source by trees that never saw it."""
    rows = [(s, n, e, m) for s, n, e, m in _reading_model(spark, sf_dir).validation]
    return spark.createDataFrame(rows, "source string, n int, rmse double, mean_grade double")
