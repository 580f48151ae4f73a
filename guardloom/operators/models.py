"""Replies of models as columns: language masses, entity spans, contracts, strategies, provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.operators.hits import PRECEDENCE, hit, hits_of, let, result

MODES = ("local_deterministic", "local_ml", "local_embedding", "local_llm", "remote_llm", "remote_api")


def language_mass(scores: Column, allowed: list[str] | None = None, blocked: list[str] | None = None) -> Column:
    """Share of probability (label -> probability) on blocked languages, else outside the allowed ones.

    A blocklist comes first. Masses are added up, so a text of a language that
    the model does not know, which it spreads over others, still counts as not
    allowed. Null and empty scores give 0, as does no list.
    """
    within = lambda langs: F.aggregate(F.map_entries(scores), F.lit(0.0), lambda a, e: a + F.when(F.lower(e["key"]).isin([x.lower() for x in langs]), e["value"].cast("double")).otherwise(0.0))
    if blocked:
        mass = within(blocked)
    elif allowed:
        mass = F.greatest(F.lit(0.0), 1.0 - within(allowed))
    else:
        mass = F.lit(0.0)
    return F.when(F.size(F.coalesce(F.map_keys(scores), F.array().cast("array<string>"))) > 0, mass).otherwise(0.0)


def entity_spans(tokens: Column) -> Column:
    """Spans (start, end, label) from a tagger's tokens: array of (label, start, end) in order.

    A run of one type is a span; B- and U- begin a new one, O and tokens without
    width end it. Neighbours may lie one character apart. Labels come out in
    capitals and without their prefix.
    """
    spans = "array<struct<start:int,end:int,label:string>>"
    start = F.struct(F.array().cast(spans).alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, t: Column) -> Column:
        name = F.upper(F.regexp_replace(F.trim(F.coalesce(t["label"], F.lit(""))), r"^[A-Za-z][-_](?=.)", ""))
        kind = F.when(~name.isin("", "O", "OUT", "OUTSIDE", "NONE") & (t["end"] > t["start"]), name)
        last = F.element_at(acc["done"], -1)
        goes_on = kind.isNotNull() & (F.size(acc["done"]) > 0) & kind.eqNullSafe(acc["open"]) & ~t["label"].rlike("^[bBuU][-_]") & (t["start"] <= last["end"] + 1)
        wider = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1), F.array(F.struct(last["start"].alias("start"), t["end"].cast("int").alias("end"), last["label"].alias("label"))))
        new = F.concat(acc["done"], F.array(F.struct(t["start"].cast("int").alias("start"), t["end"].cast("int").alias("end"), kind.alias("label"))))
        return F.struct(F.when(F.coalesce(goes_on, F.lit(False)), wider).when(kind.isNotNull(), new).otherwise(acc["done"]).cast(spans).alias("done"), kind.alias("open"))

    return F.aggregate(tokens, start, step, lambda acc: acc["done"])


def breaches(mode: Column, decision: Column, scores: Column) -> Column:
    """What a reply breaks of the contract: unknown mode or decision, scores outside [0, 1]; empty if it is kept."""
    return F.filter(
        F.array(
            F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), "execution_mode"),
            F.when(decision.isNotNull() & ~decision.isin(*PRECEDENCE), "decision"),
            F.when(F.exists(F.coalesce(F.map_values(scores), F.array().cast("array<double>")), lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1)), "label_scores"),
        ),
        lambda x: x.isNotNull(),
    )


def strategy(cfg: dict, org: dict | None = None) -> dict | None:
    """The order of modes that a detector's settings ask for, with their backends; None without a model.

    The organisation's default fills in a missing strategy and its backends,
    and missing keys of backends whose mode is in the order.
    """
    org = org or {}
    own = cfg.get("strategy") if isinstance(cfg.get("strategy"), dict) else None
    plan = own or org.get("strategy")
    if not isinstance(plan, dict):
        return None
    order = [m for m in plan.get("order", []) if m in MODES]
    if not any(m != "local_deterministic" for m in order):
        return None
    backends, given = dict(cfg.get("backends") or {}), org.get("backends") or {}
    for mode, b in given.items():
        if mode not in backends and (mode in order or own is None):
            backends[mode] = b
        elif mode in backends and b.get("auth_value") and not backends[mode].get("auth_value"):
            backends[mode] = {**backends[mode], "auth_value": b["auth_value"]}
    return {"order": order, "backends": {m: backends[m] for m in order if m in backends}, "fallback": plan.get("fallback", "deterministic")}


def standalone(policy: dict, known: set[str]) -> dict[str, dict]:
    """Enabled keys of a policy that are no detector of the pipeline but have a model: their settings with the stages."""
    out = {}
    for k, cfg in policy.items():
        if k in known or not isinstance(cfg, dict) or not cfg.get("enabled"):
            continue
        plan = strategy(cfg, policy.get("runtime_policy", {}).get(k))
        if plan:
            out[k] = {**cfg, "plan": plan, "stages": tuple(cfg.get("stages") or ("input", "output"))}
    return out


def model_result(name: str, reply: Column, threshold: float = 0.5) -> Column:
    """A detector's result from a reply struct (score in 0..1, decision or null); no reply allows."""

    def of(r: Column) -> Column:
        risk = F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(r["score"], F.lit(0.0)) * 100)), 0).cast("int")
        decision = F.coalesce(r["decision"], F.when(r["score"] >= threshold, "BLOCK"), F.lit("ALLOW"))
        found = hits_of(F.when(decision != "ALLOW", hit(f"{name}.model", "high", "The model objects")))
        return result(name, decision, risk, found)

    return let(reply, of)


def provenance(digest: Column, signed: Column, verified: Column, bill: Column, key: bool = True, need_signature: bool = True, need_bill: bool = True) -> Column:
    """(ok, findings) of an artifact: pinned by a digest, its signature verified, its bill of materials whole.

    ``signed`` and ``verified`` say whether there is a signature and whether it
    verifies; ``bill`` holds what is wrong with the bill of materials (null if
    there is none at all, an empty array if nothing is).
    """
    bad = F.coalesce(F.size(bill) > 0, F.lit(True))
    find = lambda c, rule, sev, text: F.when(c, hit(f"model_provenance.{rule}", sev, text))
    ok = F.coalesce(verified, F.lit(False)) & F.coalesce(digest != "", F.lit(False))
    lacking = F.lit(need_signature) & ~ok
    findings = hits_of(
        find(F.coalesce(digest, F.lit("")) == "", "unpinned_artifact", "high", "No digest"),
        find(lacking & F.lit(not key), "no_verification_key", "high", "Nothing to verify with"),
        find(lacking & F.lit(key) & ~F.coalesce(signed, F.lit(False)), "unsigned_artifact", "high", "No signature"),
        find(lacking & F.lit(key) & F.coalesce(signed, F.lit(False)), "invalid_signature", "high", "The signature does not verify"),
        find(F.lit(need_bill) & bad, "missing_aibom", "high", "No whole bill of materials"),
        find(F.lit(not need_bill) & F.coalesce(F.size(bill) > 0, F.lit(False)), "malformed_aibom", "medium", "The bill of materials is not whole"),
    )
    return let(findings, lambda f: F.struct((~F.exists(f, lambda x: x["severity"] == "high")).alias("ok"), f.alias("findings")))
