"""Queries of the guardrail detectors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardloom import sql_guard
from guardloom.functions import text as tx
from guardloom.operators import agentic
from guardloom.plans import pipeline as pl
from guardloom.queries import query
from guardloom.samples import SAMPLES
from guardloom.session import spread, table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "stage", "source", "lang", "tenant_id", "n_chars")


def _metadata():
    """A metadata block from the columns of a document: what a caller would send along."""
    n = F.coalesce("n_chars", F.lit(0))
    named = F.concat(F.lit("Source of "), "source")
    return F.to_json(
        F.struct(
            "tenant_id",
            named.alias("source_context"),
            F.array(F.struct(F.concat(F.lit("https://kb.example/"), "source").alias("url"), named.alias("text"))).alias("grounding_sources"),
            (F.col("source") != "kb_chunks").alias("scope_enforced_in_query"),
            F.struct(F.array(F.struct(F.when(n % 10 < 9, F.col("tenant_id")).otherwise("another").alias("tenant_id"), (n / 1000.0).alias("score"), F.lit("similarity").alias("score_kind"), F.col("source").alias("content"))).alias("chunks")).alias("retrieval"),
            F.struct((F.col("stage") == "input").alias("hit"), (n / 1000.0).alias("similarity"), F.col("source").alias("cached_query"), F.col("tenant_id"), F.lit(True).alias("partitioned"), (n * 60.0).alias("entry_age_seconds")).alias("semantic_cache"),
            F.struct((n % 2 == 0).alias("approved"), F.when(n % 4 == 0, F.col("tenant_id")).alias("approved_by")).alias("approval"),
            F.struct((n * 100.0).alias("tokens"), (n / 100.0).alias("cost_usd"), (n * 1.0).alias("thinking_tokens"), F.struct((n / 10).cast("int").alias("iteration"), F.lit(40).alias("max_iterations"), F.lit(3).alias("tool_depth")).alias("agent_step")).alias("usage"),
            F.struct(F.lit("external").alias("source_trust"), F.when(F.col("source") == "kb_chunks", "curated").otherwise("open").alias("corpus_trust")).alias("corpus"),
            F.struct(F.col("text").alias("reasoning_trace"), (F.col("lang") == "en").alias("trace_scanned"), F.lit("prod").alias("env"), (F.col("source") == "chat_logs").alias("logprobs")).alias("trace"),
            F.array(F.struct(F.lit("image").alias("type"), F.when(F.col("source") != "release_notes", F.col("text")).alias("extracted_text"))).alias("attachments"),
        )
    )


@query()
def guard_documents(spark, sf_dir):
    """The flagship: every enabled detector, chained rewrites, one verdict per document."""
    d = _documents(spark, sf_dir).withColumn("metadata", _metadata())
    g = pl.guard(d, "text", pl.DEFAULT_POLICY, metadata="metadata")
    return g.select("doc_id", "stage", "verdict.decision", "verdict.risk", "verdict.decided_by", F.size("verdict.hits").alias("n_hits"), F.sha2(F.coalesce("verdict.sanitized", F.lit("")), 256).alias("sanitized_sha256"))


def _facts(spark, sf_dir, policy):
    d = _documents(spark, sf_dir).withColumn("metadata", _metadata())
    f = pl.fact_table(pl.guard(d, "text", policy, metadata="metadata"), ["doc_id", "stage"])
    return f.groupBy("detector", "stage", "decision").agg(F.count(F.lit(1)).alias("n"), F.max("risk").alias("max_risk"), F.sum("n_hits").alias("n_hits"))


@query()
def guard_fact_table(spark, sf_dir):
    """Decisions by detector and stage, from the exploded request x detector table of the default policy."""
    return _facts(spark, sf_dir, pl.DEFAULT_POLICY)


@query(sql_guard.facts())
def guard_fact_exact(spark, sf_dir):
    """The same under a policy of detectors that SQL can state together."""
    return _facts(spark, sf_dir, {n: {"enabled": True, **sql_guard.SETTINGS.get(n, {})} for n in sql_guard.FACTS})


def _sampled(spark, name: str):
    rows = [(-1 - i, t, m or "{}") for i, (t, m) in enumerate(SAMPLES[name])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, metadata string")


def _tenant_prompts(spark, sf_dir):
    """One registered prompt per tenant: its first policy note."""
    notes = table(spark, sf_dir, "documents").filter("source = 'policy_notes' and text is not null")
    return notes.groupBy("tenant_id").agg(F.min_by("text", "doc_id").alias("__prompt"))


def _detector(name: str, settings: dict):
    def run(spark, sf_dir):
        d = _documents(spark, sf_dir)
        meta = _metadata()
        if name == "system_prompt_leakage":
            d = spread(d).join(_tenant_prompts(spark, sf_dir), "tenant_id", "left")
            known = agentic.shingle_digests(F.coalesce("__prompt", F.lit("")), settings["key"])
            meta = F.to_json(F.struct(known.alias("system_prompt_fingerprints")))
        d = (d if name == "system_prompt_leakage" else spread(d)).select("doc_id", "text", meta.alias("metadata")).unionByName(_sampled(spark, name).coalesce(1)).withColumn("stage", F.lit("output"))
        policy = {name: {"enabled": True, "stages": list(pl.STAGES), **settings}}
        g = pl.guard(d, "text", policy, metadata="metadata")
        return g.select("doc_id", "verdict.decision", "verdict.risk", F.transform("verdict.hits", lambda h: h["rule_id"]).alias("rules")).select("doc_id", "decision", "risk", F.array_join("rules", ",").alias("rules"))

    run.__name__ = f"detect_{name}"
    run.__doc__ = f"The {name} detector alone over every document and its labelled samples (negative ids)."
    query(sql_guard.detector(name))(run)


for _name in pl.PIPELINE:
    _detector(_name, sql_guard.SETTINGS.get(_name, {}))


@query(
    """
    SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(e)) AS BIGINT) AS emails, CAST(count(*) FILTER (WHERE len(e) > 0) AS BIGINT) AS docs_with
    FROM (SELECT lang, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS e FROM documents) GROUP BY lang
    """.replace("\\\\", "\\")
)
def emails_by_language(spark, sf_dir):
    e = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0)
    d = _documents(spark, sf_dir).select("lang", F.size(e).alias("e"))
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("e").cast("bigint").alias("emails"), F.count_if(F.col("e") > 0).alias("docs_with"))


@query(
    f"""
    SELECT doc_id, CAST(len({tx.tokens_sql("text")}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({tx.tokens_sql("text")})) AS INTEGER) AS n_distinct,
           CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars FROM documents
    """
)
def text_statistics(spark, sf_dir):
    k = tx.tokens(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(k).alias("n_tokens"), F.size(F.array_distinct(k)).alias("n_distinct"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


_COUNTS = "map_values(list_aggregate(regexp_extract_all(text, '(?s).'), 'histogram'))"


@query(
    f"""
    SELECT doc_id, round(CASE WHEN text = '' THEN 0.0 ELSE log2(length(text)) - list_sum(list_transform({_COUNTS}, lambda c: c * log2(c))) / length(text) END, 4) AS entropy
    FROM documents WHERE text IS NOT NULL
    """
)
def text_entropy(spark, sf_dir):
    """Entropy of every text, whatever its length."""
    d = spread(_documents(spark, sf_dir)).filter("text is not null")
    return d.select("doc_id", F.round(tx.entropy(F.col("text")), 4).alias("entropy"))
