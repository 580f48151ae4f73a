"""Findings, risks and decisions: the shared vocabulary of all detectors.

A detector's result is one struct column; a hit is (rule_id, severity, message).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.functions.text import let

HIT = "struct<rule_id:string,severity:string,message:string>"
NO_HITS = f"array<{HIT}>"
#: Weights that add up to a risk, and the order of decisions.
WEIGHTS = {"low": 10, "medium": 30, "high": 50}
PRECEDENCE = {"BLOCK": 5, "REDACT": 4, "TRANSFORM": 3, "WARN": 2, "ALLOW": 1}
#: Severity and risk for display, which are other numbers than the weights.
DISPLAY_RISK = {"low": 25, "medium": 60, "high": 90}


def most_repeats(items: Column) -> Column:
    """How often the most frequent item of an array occurs; 0 if it is empty. Sorts, so n log n."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step, lambda acc: acc["best"])


def no_hits() -> Column:
    return F.array().cast(NO_HITS)


def hit(rule_id: str | Column, severity: str | Column, message: str | Column) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(rule_id).alias("rule_id"), col(severity).alias("severity"), col(message).alias("message"))


def hits_of(*conditional: Column) -> Column:
    """The hits that are not null, in order."""
    return F.filter(F.array(*conditional), lambda h: h.isNotNull()) if conditional else no_hits()


def rank(decision: Column) -> Column:
    """Precedence of a decision; null counts as 0."""
    out = F.lit(0)
    for d, r in PRECEDENCE.items():
        out = F.when(decision == d, r).otherwise(out)
    return out


def rank_sql(d: str) -> str:
    return "CASE " + " ".join(f"WHEN {d} = '{k}' THEN {v}" for k, v in PRECEDENCE.items()) + " ELSE 0 END"


def hit_risk(hits: Column) -> Column:
    """Sum of the weights, capped at 100."""
    weight = lambda h: F.when(h["severity"] == "high", 50).when(h["severity"] == "medium", 30).when(h["severity"] == "low", 10).otherwise(0)
    return F.least(F.lit(100), F.aggregate(hits, F.lit(0), lambda acc, h: acc + weight(h)))


def severity_of_risk(risk: Column) -> Column:
    return F.when(risk >= 80, "high").when(risk >= 40, "medium").otherwise("low")


def confidence_band(c: Column) -> Column:
    c = F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return F.when(c < 0.5, "low").when(c < 0.8, "medium").when(c.isNotNull(), "high")


def normalize_risk(value: Column, mode: Column | None = None) -> Column:
    """0..100, whole; scores of model modes are shares and come times 100."""
    v = value if mode is None else F.when(mode.isin("local_ml", "local_embedding", "probability"), value * 100).otherwise(value)
    return F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), v.cast("double"))), 0).cast("int")


def result(name: str, decision: Column, risk: Column, hits: Column, sanitized: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("detector"),
        decision.alias("decision"),
        risk.cast("int").alias("risk"),
        hits.cast(NO_HITS).alias("hits"),
        (sanitized if sanitized is not None else F.lit(None)).cast("string").alias("sanitized"),
    )


def by_threshold(name: str, hits: Column, threshold: int, block: str = "BLOCK", below: str = "WARN", risk: Column | None = None, sanitized: Column | None = None) -> Column:
    """No hit allows; a risk from the threshold on blocks; below it warns."""

    def of(h: Column) -> Column:
        def with_risk(r: Column) -> Column:
            return result(name, F.when(F.size(h) == 0, "ALLOW").when(r >= threshold, block).otherwise(below), r, h, sanitized)

        return let(hit_risk(h) if risk is None else risk, with_risk)

    return let(hits.cast(NO_HITS), of)


def by_action(name: str, hits: Column, action: str, risk=None, sanitized=None) -> Column:
    """Any hit gives the configured action; risk and sanitized may be functions of the hits."""

    def of(h: Column) -> Column:
        r = hit_risk(h) if risk is None else risk(h) if callable(risk) else risk
        clean = sanitized(h) if callable(sanitized) else sanitized
        return result(name, F.when(F.size(h) == 0, "ALLOW").otherwise(action), r, h, clean)

    return let(hits.cast(NO_HITS), of)


def aggregate(results: list[Column], original: Column, current: Column) -> Column:
    """One decision from the detectors' results, in pipeline order.

    The highest precedence wins, and of equal ones the first supplies the
    message; the risk is the largest; hits are concatenated; the sanitized text
    is the last REDACT or TRANSFORM one, unless the chained text has changed.
    Without results: ALLOW and 0.
    """
    if not results:
        return F.struct(F.lit("ALLOW").alias("decision"), F.lit(0).alias("risk"), F.lit(None).cast("string").alias("decided_by"), no_hits().alias("hits"), F.lit(None).cast("string").alias("sanitized"))
    all_ = F.array(*results)
    keyed = F.transform(all_, lambda r, i: F.struct(rank(r["decision"]).alias("k"), (-i).alias("i"), r["decision"].alias("d"), r["detector"].alias("n")))
    top = F.array_max(keyed)
    rewrites = F.filter(all_, lambda r: r["decision"].isin("REDACT", "TRANSFORM") & r["sanitized"].isNotNull())
    last = F.when(F.size(rewrites) > 0, F.element_at(rewrites, -1)["sanitized"])
    return F.struct(
        top["d"].alias("decision"),
        F.array_max(F.transform(all_, lambda r: r["risk"])).alias("risk"),
        F.when(top["d"] != "ALLOW", top["n"]).alias("decided_by"),
        F.flatten(F.transform(all_, lambda r: r["hits"])).alias("hits"),
        F.when(~current.eqNullSafe(original), current).otherwise(last).alias("sanitized"),
    )
