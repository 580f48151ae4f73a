"""From a policy to a plan: which detectors run, in which order, on which text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.functions import text as tx
from guardloom.operators import agentic, detectors as d, models
from guardloom.operators.detectors import Text
from guardloom.operators.hits import aggregate
from guardloom.plans.plugins import Plugins, until_block
from guardloom.session import spread

#: name -> (stages or None for all, whether its rewrite is what later detectors read, detector). In this order.
PIPELINE: dict[str, tuple[tuple[str, ...] | None, bool, Callable[..., Column]]] = {
    "abuse": (("input", "output"), False, d.abuse),
    "secrets": (None, False, d.secrets),
    "exfiltration": (None, False, d.exfiltration),
    "gibberish": (None, False, d.gibberish),
    "language": (None, False, d.language),
    "topic_restriction": (None, False, d.topic_restriction),
    "toxicity": (None, False, d.toxicity),
    "bias": (None, False, d.bias),
    "sentiment": (None, False, d.sentiment),
    "compliance": (None, True, d.compliance),
    "competitor": (None, True, d.competitor),
    "jailbreak": (None, False, d.jailbreak),
    "pii": (None, True, d.pii),
    "malicious_url": (None, True, d.malicious_url),
    "copyright": (("output",), False, d.copyright_),
    "code_safety": (None, False, d.code_safety),
    "hallucination": (("output",), False, agentic.hallucination),
    "sensitive_business_data": (None, True, d.sensitive_business_data),
    "citation_integrity": (("output",), False, agentic.citation_integrity),
    "system_prompt_leakage": (("output",), False, agentic.system_prompt_leakage),
    "numerical_consistency": (("output",), False, d.numerical_consistency),
    "document_metadata_leakage": (None, False, d.document_metadata_leakage),
    "retrieval_chunk_injection": (("retrieval",), False, d.retrieval_chunk_injection),
    "embedding_integrity": (("retrieval",), False, d.embedding_integrity),
    "tenant_scope_assertion": (("retrieval",), False, agentic.tenant_scope_assertion),
    "retrieval_jamming": (("retrieval",), False, agentic.retrieval_jamming),
    "tool_output_injection": (("tool",), False, d.tool_output_injection),
    "excessive_agency": (("agent_plan", "agent_loop"), False, agentic.excessive_agency),
    "human_approval_gate": (("agent_plan", "agent_loop"), False, agentic.human_approval_gate),
    "unbounded_consumption": (("agent_loop", "input", "output"), False, agentic.unbounded_consumption),
    "memory_write_poisoning": (("memory_write",), False, d.memory_write_poisoning),
    "corpus_poisoning_monitor": (("memory_write", "retrieval"), False, agentic.corpus_poisoning_monitor),
    "reasoning_trace_disclosure": (("output",), False, agentic.reasoning_trace_disclosure),
    "output_control_char_sanitizer": (("output",), False, d.output_control_char_sanitizer),
    "multimodal_injection": (("input",), False, agentic.multimodal_injection),
    "semantic_cache_integrity": (("input", "output", "retrieval"), False, agentic.semantic_cache_integrity),
    "structure": (("output",), False, d.structure),
    "tools": (("input", "output"), False, agentic.tools),
}
STAGES = ("input", "output", "retrieval", "tool", "agent_plan", "agent_loop", "memory_write")
ALIASES = {"tool_governance": "tools", "schema_enforcement": "structure"}


def effective(policy: dict) -> dict[str, dict]:
    """The enabled detectors' settings in pipeline order; aliases count where the proper key is absent."""
    own = {**policy}
    for alias, name in ALIASES.items():
        if alias in own and name not in own:
            own[name] = own[alias]
    return {k: own[k] for k in PIPELINE if isinstance(own.get(k), dict) and own[k].get("enabled")}


def _stages(name: str, cfg: dict) -> tuple[str, ...]:
    out = tuple(cfg.get("stages") or PIPELINE[name][0] or STAGES)
    unknown = set(out) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages of {name}: {sorted(unknown)}")
    return out


def guard(df: DataFrame, text_col: str, policy: dict, stage_col: str = "stage", metadata: str | None = None, custom: dict[str, Callable] | Plugins | None = None) -> DataFrame:
    """``df`` with ``verdict`` (decision, risk, decided_by, hits, sanitized) and ``results``.

    All detectors run, also after one blocks. A detector whose stages leave out
    the row's stage gives no result there; a null or unknown stage is in none. Rewrites of the detectors that may
    transform are what later ones read, in the stages input and output. One
    projection without a shuffle; prepared texts are computed once per rewrite.
    Null texts count as empty. ``custom`` detectors (functions by name, or
    Plugins that the policy enables) run last; the first that blocks ends their
    list, and what says nothing is not recorded. Enabled keys with a model's
    strategy read the model's reply from the column of their name, if there is one.
    """
    plan = effective(policy)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = spread(df).withColumn("__t0", text).withColumn("__p0", tx.plain(F.col("__t0"))).withColumn("__k0", tx.tokens(F.col("__p0")))
    version, names, pending = 0, [], {}
    if metadata:  # parsed once for all detectors
        out = out.withColumn("__m", agentic.meta(F.col(metadata)))
    m = F.col("__m") if metadata else agentic.meta(F.lit("{}"))

    def now() -> Text:
        return Text(F.col(f"__t{version}"), F.col(f"__p{version}"), F.col(f"__k{version}"))

    for name, cfg in plan.items():
        t, run = now(), PIPELINE[name][2]
        r = run(t, cfg) if run.__module__ == d.__name__ else run(t, cfg, m)
        pending[f"__r_{name}"] = F.when(F.col(stage_col).isin(*_stages(name, cfg)), r)
        names.append(name)
        if PIPELINE[name][1]:
            out, pending = out.withColumns(pending), {}
            got = F.col(f"__r_{name}")
            put = F.col(stage_col).isin("input", "output") & got["decision"].isin("REDACT", "TRANSFORM") & (F.length(got["sanitized"]) > 0)
            version += 1
            new = f"__t{version}"
            out = out.withColumn(new, F.when(put, got["sanitized"]).otherwise(t.raw))
            out = out.withColumn(f"__p{version}", F.when(F.col(new) != t.raw, tx.plain(F.col(new))).otherwise(t.plain))
            out = out.withColumn(f"__k{version}", F.when(F.col(new) != t.raw, tx.tokens(F.col(f"__p{version}"))).otherwise(t.tokens))
    own = custom if isinstance(custom, Plugins) else None
    for name, run in (custom.items() if custom and own is None else []):
        pending[f"__c_{name}"] = run(now(), policy.get(name, {}))
    for name in own.names() if own else []:
        if isinstance(policy.get(name), dict) and policy[name].get("enabled"):
            pending[f"__c_{name}"] = own.result(name, now(), policy[name])
    for name, cfg in models.standalone(policy, {*PIPELINE, *ALIASES}).items():
        if name in df.columns:  # the model's reply, which came with the row
            pending[f"__r_{name}"] = F.when(F.col(stage_col).isin(*cfg["stages"]), models.model_result(name, F.col(name), cfg.get("threshold", 0.5)))
            names.append(name)
    extra = [k for k in pending if k.startswith("__c_")]
    if pending:
        out = out.withColumns(pending)
    if not names and not extra:
        return out.select(*df.columns, aggregate([], text, text).alias("verdict"))
    results = F.filter(F.array(*[F.col(f"__r_{n}") for n in names]), lambda r: r.isNotNull()) if names else None
    if extra:
        added = until_block([F.col(k) for k in extra])
        results = added if results is None else F.concat(results, added)
    out = out.withColumn("results", results)
    verdict = _verdict(F.col("results"), F.col("__t0"), F.col(f"__t{version}"))
    return out.select(*df.columns, "results", verdict.alias("verdict"))


def _verdict(results: Column, original: Column, current: Column) -> Column:
    from guardloom.operators.hits import no_hits, rank

    keyed = F.transform(results, lambda r, i: F.struct(rank(r["decision"]).alias("k"), (-i).alias("i"), r["decision"].alias("d"), r["detector"].alias("n")))
    top = F.array_max(keyed)
    rewrites = F.filter(results, lambda r: r["decision"].isin("REDACT", "TRANSFORM") & r["sanitized"].isNotNull())
    last = F.when(F.size(rewrites) > 0, F.element_at(rewrites, -1)["sanitized"])
    return F.struct(
        F.coalesce(top["d"], F.lit("ALLOW")).alias("decision"),
        F.coalesce(F.array_max(F.transform(results, lambda r: r["risk"])), F.lit(0)).alias("risk"),
        F.when(top["d"] != "ALLOW", top["n"]).alias("decided_by"),
        F.coalesce(F.flatten(F.transform(results, lambda r: r["hits"])), no_hits()).alias("hits"),
        F.when(current != original, current).otherwise(last).alias("sanitized"),
    )


def fact_table(guarded: DataFrame, key: list[str]) -> DataFrame:
    """One row per request and detector: key, position, detector, decision, risk, n_hits.

    The outer form of the generator is meant: for the inner one the optimizer
    infers a filter on ``results`` and pushes it below every projection of the
    guard plan, which writes all detectors out once more for each rewrite.
    """
    x = guarded.select(*key, F.posexplode_outer("results").alias("position", "__r")).filter("__r is not null")
    return x.select(*key, "position", "__r.detector", "__r.decision", "__r.risk", F.size("__r.hits").alias("n_hits"))


#: What runs unless a policy says otherwise.
DEFAULT_POLICY = {n: {"enabled": True} for n in PIPELINE if n not in ("structure", "tools", "human_approval_gate", "language")}
