"""Layers of detection, egress, remediation: decisions over results that were computed before."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.operators.hits import rank


def escalates(mode: str, risk: Column, confidence: Column, band: tuple[int, int] = (35, 70), least: float = 0.7) -> Column:
    """Whether the next layer is asked: rules within the band, a model below its confidence or without one."""
    if mode == "deterministic":
        return risk.between(*band)
    return confidence.isNull() | (confidence < least)


def escalation_fold(layers: DataFrame, key: list[str], fallback: str = "deterministic", band: tuple[int, int] = (35, 70), least: float = 0.7) -> DataFrame:
    """decision, risk, selected_mode per key from rows (mode, decision, risk, confidence, available).

    deterministic, then ml, then llm, each only while the one before leaves it
    open. A layer that is asked but not there falls back: fail_open ALLOW 0,
    fail_closed BLOCK 100, deterministic the rules' result.
    """
    def one(mode: str) -> Column:
        return F.max_by(F.struct("decision", F.col("risk").cast("int").alias("risk"), "confidence"), F.when((F.col("mode") == mode) & F.col("available"), F.lit(1)))

    x = layers.groupBy(*key).agg(*[one(m).alias(m) for m in ("deterministic", "ml", "llm")])
    fb = {"fail_open": F.struct(F.lit("ALLOW").alias("decision"), F.lit(0).alias("risk")), "fail_closed": F.struct(F.lit("BLOCK").alias("decision"), F.lit(100).alias("risk"))}.get(
        fallback, F.struct(F.col("deterministic.decision").alias("decision"), F.col("deterministic.risk").alias("risk"))
    )
    pick = lambda m: F.struct(F.col(f"{m}.decision").alias("decision"), F.col(f"{m}.risk").alias("risk"))
    more = F.col("deterministic").isNull() | escalates("deterministic", F.col("deterministic.risk"), F.lit(None), band)
    more_llm = escalates("ml", F.col("ml.risk"), F.col("ml.confidence"), least=least)
    mode = F.when(~more, "deterministic").when(F.col("ml").isNull(), "fallback").when(~more_llm, "ml").when(F.col("llm").isNull(), "ml").otherwise("llm")
    x = x.withColumn("selected_mode", mode)
    out = F.when(F.col("selected_mode") == "deterministic", pick("deterministic")).when(F.col("selected_mode") == "ml", pick("ml")).when(F.col("selected_mode") == "llm", pick("llm")).otherwise(fb)
    return x.withColumn("o", out).select(*key, "o.decision", "o.risk", "selected_mode")


def layer_divergence(layers: DataFrame, key: list[str]) -> DataFrame:
    """n_layers, n_decisions and spread of scores of each key's attempts."""
    return layers.groupBy(*key).agg(F.count(F.lit(1)).alias("n_layers"), F.count_distinct("decision").alias("n_decisions"), F.round(F.max("normalized_score") - F.min("normalized_score"), 4).alias("spread"))


def egress_reason(host: Column, region: Column, crossing: Column, no_external: Column, allow_hosts: Column, allow_regions: Column) -> Column:
    """allowed, or the first reason against a call that leaves: no_external_calls, not_allowlisted, residency."""
    return (
        F.when(~crossing, "in_boundary")
        .when(F.coalesce(no_external, F.lit(False)), "no_external_calls")
        .when(~F.coalesce(F.array_contains(allow_hosts, host), F.lit(False)), "not_allowlisted")
        .when((F.size(allow_regions) > 0) & ~F.coalesce(F.array_contains(allow_regions, region), F.lit(False)), "residency")
        .otherwise("allowed")
    )


#: What a failed check does by action: decision and whether the text goes.
REMEDIES = {"noop": (None, False), "reask": ("BLOCK", True), "fix": ("TRANSFORM", False), "filter_field": ("TRANSFORM", False), "refrain": ("BLOCK", True), "exception": ("BLOCK", True), "custom": (None, False), "ask_human": ("BLOCK", True)}


def remediation(hits: Column, decision: Column, on_fail: dict[str, str], fallback: str = "noop") -> Column:
    """The action: that of the first policy key with a hit whose rule id begins with it, else the global one."""
    prefix = F.transform(hits, lambda h: F.regexp_extract(h["rule_id"], r"^([^:.]*)", 1))
    chosen = F.coalesce(*[F.when(F.array_contains(prefix, k), F.lit(v)) for k, v in on_fail.items()], F.lit(fallback)) if on_fail else F.lit(fallback)
    return F.when(decision == "ALLOW", "noop").otherwise(chosen)


def remedied(action: Column, decision: Column, text: Column, fields: list[str] | None = None) -> Column:
    """decision and text after an action; filter_field takes ``fields`` out of a JSON text."""
    d, t = decision, text
    if fields:
        t = F.when(action == "filter_field", without_fields(text, fields)).otherwise(t)
    for name, (to, gone) in REMEDIES.items():
        if to:
            d = F.when(action == name, to).otherwise(d)
        if gone:
            t = F.when(action == name, F.lit(None).cast("string")).otherwise(t)
    return F.struct(d.alias("decision"), t.alias("text"))


def without_fields(text: Column, fields: list[str]) -> Column:
    """A JSON object without the named fields; any other text as it is."""
    parsed = F.from_json(text, "map<string,variant>")
    kept = F.to_json(F.map_filter(parsed, lambda k, _: ~k.isin(fields)))
    return F.when(text.rlike(r"^\s*\{") & F.try_parse_json(text).isNotNull(), kept).otherwise(text)


def additive_merge(a: Column, b: Column) -> Column:
    """Worst decision, largest risk, hits one after the other."""
    worst = F.when(rank(b["decision"]) > rank(a["decision"]), b["decision"]).otherwise(a["decision"])
    return F.struct(worst.alias("decision"), F.greatest(a["risk"], b["risk"]).alias("risk"), F.concat(a["hits"], b["hits"]).alias("hits"))


def merge_spans(spans: Column) -> Column:
    """Greedy cover of array<struct<start,end,label>>: by start, longer first, later overlaps dropped."""
    keyed = F.array_sort(F.transform(F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"])), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["label"].alias("label"))))
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        ok = s["start"] >= acc["at"]
        one = F.array(F.struct(s["start"].cast("int").alias("start"), (-s["back"]).cast("int").alias("end"), F.upper(s["label"]).alias("label")))
        return F.struct(F.when(ok, (-s["back"]).cast("int")).otherwise(acc["at"]).alias("at"), F.when(ok, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(keyed, start, step, lambda acc: acc["kept"])


def redact_spans(text: Column, spans: Column) -> Column:
    """The text with merged spans replaced by [LABEL]; spans beyond its end are left out."""
    kept = F.filter(merge_spans(spans), lambda s: s["end"] <= F.length(text))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["label"], F.lit("]")).alias("out"))
    return F.aggregate(kept, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


#: Terms of the stub model, which stands in where no weights are: task -> (term, weight).
STUB = {"toxicity": {"idiot": 0.6, "stupid": 0.4, "hate": 0.3}, "jailbreak": {"ignore": 0.4, "instructions": 0.3, "unrestricted": 0.6}, "pii": {"ssn": 0.5, "passport": 0.4}}


def stub_score(tokens: Column, task: str) -> Column:
    """Sum of the weights of a task's terms, 1 at most; BLOCK from 0.5, WARN above 0."""
    s = F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.when(F.array_contains(tokens, w), v).otherwise(0.0) for w, v in STUB[task].items()]))
    return F.struct(s.alias("score"), F.when(s >= 0.5, "BLOCK").when(s > 0, "WARN").otherwise("ALLOW").alias("decision"))


def vendor_moderation(vendor: str, response: Column) -> Column:
    """decision and risk of moderation replies (JSON): severities 0-7, scores 0-1 or a flag."""
    if vendor == "severity":
        sev = F.array_max(F.transform(F.regexp_extract_all(response, F.lit(r'"severity"\s*:\s*(\d+)'), 1), lambda x: x.cast("int")))
        r = F.coalesce(sev, F.lit(0))
        return F.struct(F.when(r >= 4, "BLOCK").when(r > 0, "WARN").otherwise("ALLOW").alias("decision"), F.round(r / 7.0 * 100).cast("int").alias("risk"))
    if vendor == "scores":
        top = F.array_max(F.transform(F.regexp_extract_all(response, F.lit(r'"[a-z/_-]+"\s*:\s*(0?\.\d+|1(?:\.0+)?)'), 1), lambda x: x.cast("double")))
        flagged = F.get_json_object(response, "$.flagged") == "true"
        return F.struct(F.when(F.coalesce(flagged, F.lit(False)), "BLOCK").otherwise("ALLOW").alias("decision"), F.round(F.coalesce(top, F.lit(0.0)) * 100).cast("int").alias("risk"))
    hit = F.coalesce(F.get_json_object(response, "$.action") == "GUARDRAIL_INTERVENED", F.lit(False))
    return F.struct(F.when(hit, "BLOCK").otherwise("ALLOW").alias("decision"), F.when(hit, 90).otherwise(0).alias("risk"))


def judge_reply(reply: Column) -> Column:
    """decision, risk and reason from the last balanced JSON object of a judge's reply; null if there is none."""
    last = F.regexp_extract(reply, r"(?s).*(\{[^{}]*\})", 1)
    d = F.upper(F.get_json_object(last, "$.decision"))
    ok = d.isin("ALLOW", "WARN", "TRANSFORM", "REDACT", "BLOCK")
    return F.when(ok, F.struct(d.alias("decision"), F.get_json_object(last, "$.risk_score").try_cast("double").alias("risk"), F.get_json_object(last, "$.reason").alias("reason")))


_IP = re.compile(r"^(0x[0-9a-f]+|0[0-7]*|[1-9]\d*)$", re.I)


def legacy_ipv4(host: str) -> str | None:
    """The dotted address that one to four decimal, hexadecimal or octal parts stand for."""
    parts = host.split(".")
    if not 1 <= len(parts) <= 4 or not all(_IP.match(p) for p in parts):
        return None
    nums = [int(p, 16) if p.lower().startswith("0x") else int(p, 8) if p.startswith("0") and len(p) > 1 else int(p) for p in parts]
    if any(n > 255 for n in nums[:-1]) or nums[-1] >= 256 ** (5 - len(nums)):
        return None
    value = sum(n << (8 * (3 - i)) for i, n in enumerate(nums[:-1])) + nums[-1]
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))
