"""Readers and sinks: labelled datasets, spools of JSON lines, audit records."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ALIASES = {"text": ("text", "input_text", "prompt"), "output_text": ("output_text", "output"), "expected_decision": ("expected_decision", "expected", "label"), "language": ("language", "lang")}


def labelled(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """text, output_text, expected_decision, language from JSON lines, a JSON array or CSV.

    Column names have aliases; rows without a text or with an unknown decision
    are left out (see ``rejected``); the language is 'en' where absent.
    """
    return _labelled(spark, path, kind).filter("ok").drop("ok")


def rejected(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    return _labelled(spark, path, kind).filter("not ok").drop("ok")


def _labelled(spark: SparkSession, path: str, kind: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"') if kind == "csv" else spark.read.json(path, multiLine=kind == "json")
    lower = {c.lower(): c for c in raw.columns}

    def pick(name: str):
        own = [F.col(f"`{lower[a]}`").cast("string") for a in _ALIASES[name] if a in lower]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    d = F.upper(F.trim(pick("expected_decision")))
    ok = (F.coalesce(F.trim(pick("text")), F.lit("")) != "") & F.coalesce(d.isin("ALLOW", "WARN", "TRANSFORM", "REDACT", "BLOCK"), F.lit(False))
    return raw.select(pick("text").alias("text"), pick("output_text").alias("output_text"), d.alias("expected_decision"), F.coalesce(pick("language"), F.lit("en")).alias("language"), ok.alias("ok"))


def spool(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; lines that are none are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_audit(df: DataFrame, path: str, fail_closed: bool = True) -> bool:
    """Append records as JSON lines; the commit protocol publishes whole tasks only.

    Whether they are stored: a failure is raised, so that nothing goes out
    unrecorded, unless ``fail_closed`` is unset; then it is logged.
    """
    try:
        df.write.mode("append").json(path)
    except Exception:
        if fail_closed:
            raise
        logging.getLogger(__name__).exception("records were not stored at %s", path)
        return False
    return True


def append_judge_calls(df: DataFrame, path: str, price_in: float, price_out: float) -> bool:
    """Append calls of a judge (tokens_in, tokens_out) with their cost; prices are per thousand tokens."""
    cost = (F.coalesce("tokens_in", F.lit(0)) * price_in + F.coalesce("tokens_out", F.lit(0)) * price_out) / 1000
    return append_audit(df.withColumn("cost_usd", cost), path)


def append_reviews(df: DataFrame, path: str) -> bool:
    """Append what a person is asked to decide (request_id, detector, text): one row per question, pending."""
    asked = F.sha2(F.concat_ws("|", F.coalesce("request_id", F.lit("")), F.coalesce("detector", F.lit(""))), 256)
    return append_audit(df.withColumn("review_id", F.substring(asked, 1, 32)).withColumn("status", F.lit("pending")), path)


def telemetry_query(stream: DataFrame, path: str, checkpoint: str, seconds: int = 10):
    """Start a stream that appends telemetry every so many seconds."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
