"""Typed requests as the plain rows that the pipeline reads: text, stage and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.operators import agentic
from guardloom.operators.detectors import Text
from guardloom.operators.hits import rank
from guardloom.functions import text as tx
from guardloom.plans.pipeline import guard


def _plain(df: DataFrame, key: list[str], text: Column, stage: str, **blocks: Column) -> DataFrame:
    meta = F.to_json(F.struct(*[v.alias(k) for k, v in blocks.items()])) if blocks else F.lit("{}")
    return df.select(*key, F.coalesce(text, F.lit("")).alias("text"), F.lit(stage).alias("stage"), meta.alias("metadata"))


def retrievals(df: DataFrame, key: list[str]) -> DataFrame:
    """chunks ARRAY<STRUCT<content, tenant_id, score, score_kind>>, tenant_id, scope_enforced_in_query: the chunks' texts, apart by blank lines."""
    text = F.array_join(F.transform("chunks", lambda c: F.coalesce(c["content"], F.lit(""))), "\n\n")
    return _plain(df, key, text, "retrieval", tenant_id=F.col("tenant_id"), scope_enforced_in_query=F.col("scope_enforced_in_query"), retrieval=F.struct("chunks"))


def agent_plans(df: DataFrame, key: list[str]) -> DataFrame:
    """plan (JSON text) as it is."""
    return _plain(df, key, F.col("plan"), "agent_plan")


def agent_steps(df: DataFrame, key: list[str]) -> DataFrame:
    """action, iteration, max_iterations."""
    return _plain(df, key, F.col("action"), "agent_loop", usage=F.struct(F.struct("iteration", "max_iterations").alias("agent_step")))


def memory_writes(df: DataFrame, key: list[str]) -> DataFrame:
    """memory_key, memory_value."""
    return _plain(df, key, F.col("memory_value"), "memory_write", memory_key=F.col("memory_key"))


def tool_calls(df: DataFrame, key: list[str], policy: dict) -> DataFrame:
    """key, decision, risk of tool calls: tool_name and tool_args (MAP) against the tools policy, tool_result as text of a tool.

    The more severe decision holds; a call without a result is judged by its name and arguments alone.
    """
    call = F.from_json(F.to_json(F.struct("tool_name", "tool_args")), agentic.SCHEMA)
    none = Text(F.lit(""), F.lit(""), tx.words())
    judged = agentic.tools(none, policy.get("tools", {}), F.col("__call"))
    x = df.select(*key, call.alias("__call"), F.coalesce("tool_result", F.lit("")).alias("__text"), F.when(F.col("tool_result").isNotNull(), "tool").alias("__stage"))
    x = guard(x.withColumn("__tools", judged), "__text", {k: v for k, v in policy.items() if k != "tools"}, "__stage")
    a, b = F.col("__tools.decision"), F.col("verdict.decision")
    return x.select(*key, F.when(rank(b) > rank(a), b).otherwise(a).alias("decision"), F.greatest("__tools.risk", "verdict.risk").alias("risk"))


def guard_distinct(df: DataFrame, text_col: str, policy: dict, stage_col: str = "stage") -> DataFrame:
    """``guard`` where each (text, stage) is judged once, however many rows repeat it; ``df`` with ``verdict``.

    Rows meet their verdict by a 128-bit digest; the side of the verdicts has one
    row per digest, so adaptive execution can split a digest that fills a partition.
    """
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(stage_col), F.lit("")), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("string"), F.coalesce(F.col(text_col), F.lit(""))))
    rows = df.withColumn("__d", digest)
    once = rows.groupBy("__d").agg(F.first(text_col).alias("__text"), F.first(stage_col).alias("__stage"))
    judged = guard(once, "__text", policy, "__stage").select("__d", "verdict")
    return rows.join(judged, "__d").drop("__d")
