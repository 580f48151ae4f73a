"""Guarded model calls: the prompt is judged, then the answer that was given for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardloom.operators.hits import rank
from guardloom.plans.pipeline import guard


def round_trip(df: DataFrame, prompt: str, answer: str, policy: dict, metadata: str | None = None) -> DataFrame:
    """``df`` with input_verdict, output_verdict, final_decision and final_output.

    A blocked prompt has no answer: the output is not judged and nothing is
    shown. Otherwise the more severe decision holds and the answer is shown as
    the output guard left it. Null answers stay null.
    """
    own = df.columns
    x = guard(df.withColumn("__stage", F.lit("input")), prompt, policy, "__stage", metadata)
    x = x.select(*own, F.col("verdict").alias("input_verdict"))
    blocked = F.col("input_verdict.decision") == "BLOCK"
    x = x.withColumn("__stage", F.when(~blocked, "output"))
    x = guard(x, answer, policy, "__stage", metadata).withColumnRenamed("verdict", "output_verdict")
    i, o = F.col("input_verdict.decision"), F.col("output_verdict.decision")
    final = F.when(rank(o) > rank(i), o).otherwise(i)
    shown = F.when(~blocked & (o != "BLOCK") & F.col(answer).isNotNull(), F.coalesce("output_verdict.sanitized", F.col(answer)))
    return x.select(*own, "input_verdict", "output_verdict", final.alias("final_decision"), shown.alias("final_output_shown"))
