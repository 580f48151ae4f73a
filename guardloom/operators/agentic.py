"""Detectors that also read the request's metadata.

``m`` is the metadata column parsed once by ``meta``: the blocks that detectors
know have fixed schemas; what is absent or of another type reads as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.functions import text as tx
from guardloom.operators import rulebooks as rb
from guardloom.operators.banks import scan
from guardloom.operators.detectors import Text
from guardloom.operators.hits import by_action, by_threshold, hit, hit_risk, hits_of, let, most_repeats, no_hits, result

SCHEMA = """
source_context string,
grounding_sources array<struct<url string, source_id string, id string, text string, content string, snippet string>>,
tenant_id string, scope_enforced_in_query boolean,
retrieval struct<chunks array<struct<tenant_id string, score double, score_kind string, content string>>>,
semantic_cache struct<hit boolean, similarity double, cached_query string, tenant_id string, partitioned boolean, entry_age_seconds double>,
approval struct<approved boolean, approved_by string, approval_id string, token string, issued_at double>,
usage struct<tokens double, cost_usd double, thinking_tokens double, agent_step struct<iteration int, max_iterations int, tool_depth int, state string>>,
trace struct<reasoning_trace string, trace_scanned boolean, answer_redacted boolean, logprobs boolean, top_logprobs boolean, env string, raw_tool_args boolean>,
attachments array<struct<type string, extracted_text string, transcript string>>,
corpus struct<source_trust string, corpus_trust string, source_id string>,
system_prompt_fingerprints array<string>,
tool_name string, tool_args map<string,string>
"""


def meta(c: Column) -> Column:
    return F.from_json(c, SCHEMA)


_STOP = "the a an and or of to in is are was it that this for with on as at by be from has have had will can not".split()


def content_words(c: Column) -> Column:
    """Distinct tokens that are no stop words and longer than one letter."""
    return F.array_distinct(F.filter(tx.tokens(c), lambda w: (F.length(w) > 1) & ~w.isin(_STOP)))


def hallucination(t: Text, cfg: dict, m: Column) -> Column:
    """Sentences against the sources: token overlap below the threshold is weak, below 0.6 of it ungrounded."""
    limit, least = cfg.get("threshold", 0.5), cfg.get("min_claim_words", 3)
    x = m
    sources = F.concat(
        F.when(x["source_context"].isNotNull(), F.array(x["source_context"])).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform(x["grounding_sources"], lambda s: F.coalesce(s["text"], s["content"], s["snippet"], F.lit(""))), F.array().cast("array<string>")),
    )
    bags = F.transform(sources, content_words)
    union = F.flatten(bags)
    claims = F.filter(F.transform(tx.sentences(t.raw), content_words), lambda c: F.size(c) >= least)
    best = F.transform(claims, lambda c: F.greatest(tx.overlap(c, union), F.coalesce(F.array_max(F.transform(bags, lambda b: tx.overlap(c, b))), F.lit(0.0))))

    def decide(scores: Column) -> Column:
        bad, weak = F.filter(scores, lambda v: v < limit * 0.6), F.filter(scores, lambda v: (v >= limit * 0.6) & (v < limit))
        hits = F.concat(
            F.transform(bad, lambda v: hit("hallucination.ungrounded", "high", "A claim without support")),
            F.transform(weak, lambda v: hit("hallucination.weak", "medium", "A claim with weak support")),
        )
        n = F.greatest(F.size(scores), F.lit(1))
        risk = F.least(F.lit(100), (80.0 * F.size(bad) / n + 30.0 * F.size(weak) / n).cast("int"))
        return by_action("hallucination", hits, "BLOCK" if cfg.get("action") == "BLOCK" else "WARN", risk)

    none = result("hallucination", F.lit("ALLOW"), F.lit(0), no_hits())
    return F.when(F.size(sources) == 0, none).otherwise(let(best, decide))


def citation_integrity(t: Text, cfg: dict, m: Column) -> Column:
    """Cited numbers, URLs and quotes against the grounding sources (an anti-join within the row)."""
    x = m
    given = F.coalesce(x["grounding_sources"], F.array().cast("array<struct<url:string,source_id:string,id:string,text:string,content:string,snippet:string>>"))
    n = F.size(given)
    numbers = F.array_distinct(F.regexp_extract_all(t.raw, F.lit(r"\[(\d{1,3})\]"), 1))
    bad_numbers = F.filter(numbers, lambda v: ~v.cast("int").between(F.lit(1), n))
    urls = F.array_distinct(F.regexp_extract_all(t.raw, F.lit(r"(https?://[^\s\"'<>)\]]+)"), 1))
    bad_urls = F.array_except(urls, F.transform(given, lambda s: s["url"]))
    texts = F.array_join(F.transform(given, lambda s: F.lower(F.coalesce(s["text"], s["content"], s["snippet"], F.lit("")))), " ")
    quotes = F.regexp_extract_all(t.raw, F.lit(r"[\"“]([^\"”]{20,})[\"”]"), 1)
    unproven = F.filter(quotes, lambda q: tx.overlap(tx.tokens(q), tx.tokens(texts)) < cfg.get("min_quote_overlap", 0.6))
    hits = F.concat(
        F.transform(F.concat(bad_numbers, bad_urls), lambda v: hit("citation.unsupported", "high", F.concat(F.lit("Cites what was not given: "), v))),
        F.transform(unproven, lambda q: hit("citation.unverified_quote", "medium", "A quote that no source holds")),
    )
    lacking = F.lit(not cfg.get("require_sources", False)) & (n == 0)
    return by_action("citation_integrity", F.when(lacking, no_hits()).otherwise(hits), cfg.get("action", "WARN"))


def shingle_digests(c: Column, key: str = "", n: int = 8) -> Column:
    """Keyed digests of n-token shingles: HMAC-SHA256, 32 hex digits, distinct."""
    return F.transform(F.array_distinct(tx.ngrams(tx.tokens(c), n)), lambda g: F.substring(tx.hmac_sha256(g, key), 1, 32))


def system_prompt_leakage(t: Text, cfg: dict, m: Column) -> Column:
    """Output that shares shingles with a registered prompt."""
    known = F.coalesce(m["system_prompt_fingerprints"], F.array().cast("array<string>"))
    fixed = tx.words(*cfg.get("fingerprints", []))
    shared = F.size(F.array_intersect(shingle_digests(t.raw, cfg.get("key", "")), F.concat(known, fixed)))
    hits = hits_of(F.when(shared >= cfg.get("match_threshold", 2), hit("system_prompt.leak", "high", "Repeats a registered prompt")))
    return by_action("system_prompt_leakage", hits, cfg.get("action", "BLOCK"))


def tenant_scope_assertion(t: Text, cfg: dict, m: Column) -> Column:
    """Chunks of other tenants, chunks without an owner, filters applied after the query."""
    x = m
    chunks = F.coalesce(x["retrieval"]["chunks"], F.array().cast("array<struct<tenant_id:string,score:double,score_kind:string,content:string>>"))
    foreign = F.filter(chunks, lambda c: c["tenant_id"].isNotNull() & (c["tenant_id"] != x["tenant_id"]))
    hits = F.concat(
        F.transform(foreign, lambda c: hit("tenant_scope.cross_tenant", "high", F.concat(F.lit("A chunk of "), c["tenant_id"]))),
        hits_of(
            F.when(F.exists(chunks, lambda c: c["tenant_id"].isNull()), hit("tenant_scope.untagged", "high", "A chunk without an owner")),
            F.when(x["scope_enforced_in_query"] == F.lit(False), hit("tenant_scope.post_filter", "medium", "Filtered after the query")),
        ),
    )
    block = F.lit(cfg.get("action") == "BLOCK") | ((F.size(foreign) > 0) & F.lit(cfg.get("block_cross_tenant", True)))
    return result("tenant_scope_assertion", F.when(F.size(hits) == 0, "ALLOW").when(block, "BLOCK").otherwise("WARN"), hit_risk(hits), hits)


def retrieval_jamming(t: Text, cfg: dict, m: Column) -> Column:
    """Chunks that make the answer fail: refusals, suppression, no content, one chunk that outranks the rest."""
    refusals = ["i cannot answer", "i can't answer", "i am unable to", "no information is available", "i cannot help", "this question cannot be answered", "i must decline", "not allowed to answer"]
    n = reduce(lambda a, b: a + b, [F.when(t.plain.contains(r), 1).otherwise(0) for r in refusals])
    chunks = F.coalesce(m["retrieval"]["chunks"], F.array().cast("array<struct<tenant_id:string,score:double,score_kind:string,content:string>>"))
    far = F.exists(chunks, lambda c: c["score_kind"] == "distance")
    scores = F.array_sort(F.filter(F.transform(chunks, lambda c: c["score"]), lambda s: s.isNotNull() & ~F.isnan(s)))
    k = F.size(scores)
    # the best is the largest similarity or the least distance; the median of the rest is the upper one
    best = F.when(far, F.get(scores, F.lit(0))).otherwise(F.get(scores, k - 1))
    rest = F.when(far, F.slice(scores, F.lit(2), F.greatest(k - 1, F.lit(0)))).otherwise(F.slice(scores, F.lit(1), F.greatest(k - 1, F.lit(0))))
    median = F.get(rest, F.floor(F.size(rest) / 2).cast("int"))
    ratio = F.when(far, median / best).otherwise(best / median)
    hits = hits_of(
        F.when(n >= cfg.get("refusals", 2), hit("retrieval_jamming.refusal", "high", "Chunks that refuse")),
        F.when(t.plain.rlike(r"(do not|don't|never) (use|cite|read|trust) (the )?other (documents|chunks|sources|results)"), hit("retrieval_jamming.suppression", "high", "Suppresses other chunks")),
        F.when((F.size(chunks) > 0) & (F.size(t.tokens) < cfg.get("min_words", 25)), hit("retrieval_jamming.contentless", "medium", "Hardly any content")),
        F.when((k >= 3) & (ratio >= cfg.get("dominance", 3.0)), hit("retrieval_jamming.dominance", "medium", "One chunk outranks the rest")),
    )
    return by_action("retrieval_jamming", hits, "BLOCK" if cfg.get("action") == "BLOCK" else "WARN")


def excessive_agency(t: Text, cfg: dict, m: Column) -> Column:
    """Risky actions in plans, also where names are joined by signs; low risks allow and keep their hits."""
    spaced = F.regexp_replace(t.plain, r"[_\-\"{}\[\]:,]+", " ")
    spaced = F.regexp_replace(spaced, " +", " ")
    hits = F.array_distinct(F.concat(scan(t.plain, t.tokens, rb.AGENCY), scan(spaced, tx.tokens(spaced), rb.AGENCY)))
    for a in cfg.get("high_risk_actions", []):
        hits = F.concat(hits, hits_of(F.when(spaced.contains(a.lower().replace("_", " ")), hit("agency.configured", "high", f"Configured action {a}"))))

    def decide(h: Column) -> Column:
        risk = hit_risk(h)
        decision = F.when(risk >= cfg.get("block_threshold", 50), "BLOCK").when(risk >= cfg.get("warn_threshold", 30), "WARN").otherwise("ALLOW")
        return result("excessive_agency", decision, risk, h)

    return let(hits, decide)


def approval_token(action: Column, by: Column, at: Column, key: str) -> Column:
    """What a signed approval carries: HMAC over the action's digest, approver and time."""
    return tx.hmac_sha256(F.concat_ws("|", F.sha2(action, 256), by, at.cast("bigint").cast("string")), key)


def human_approval_gate(t: Text, cfg: dict, m: Column) -> Column:
    """Gated categories need an approval by a named person, signed where a key is configured."""
    x = m["approval"]
    spaced = F.regexp_replace(t.plain, r"[_\-\"{}\[\]:,]+", " ")
    names = cfg.get("gated_categories")
    gated = [r for r in rb.AGENCY if (r.rule_id.rpartition(".")[2] in names if names is not None else r.severity == "high")]
    wanted = scan(spaced, tx.tokens(spaced), gated)
    named = F.coalesce(x["approved_by"], F.lit("")) != ""
    ok = F.coalesce(x["approved"], F.lit(False))
    key = cfg.get("key")
    if key:
        ok = ok & F.coalesce(x["token"] == approval_token(t.raw, x["approved_by"], x["issued_at"], key), F.lit(False))
    hits = F.when(ok, hits_of(F.when(~named & F.lit(cfg.get("identity_required", True)), hit("approval.anonymous", "medium", "Nobody is named")))).otherwise(
        F.transform(wanted, lambda h: hit("approval.missing", "high", F.concat(F.lit("Not approved: "), h["message"])))
    )
    return by_action("human_approval_gate", F.when(F.size(wanted) == 0, no_hits()).otherwise(hits), cfg.get("action", "BLOCK"))


def non_negative(c: Column) -> Column:
    """Numbers as they are, everything else and negative ones 0."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")), 0.0).otherwise(v)


def unbounded_consumption(t: Text, cfg: dict, m: Column) -> Column:
    """Limits of one request; sums over sessions come by the keyed state. 50 a hit."""
    u = m["usage"]
    step = u["agent_step"]
    tokens, thinking = non_negative(u["tokens"]), non_negative(u["thinking_tokens"])
    cap = F.least(F.lit(cfg.get("max_iterations", 50)), F.coalesce(F.when(step["max_iterations"] > 0, step["max_iterations"]), F.lit(cfg.get("max_iterations", 50))))
    hits = hits_of(
        F.when(tokens > cfg.get("max_tokens", 200_000), hit("consumption.tokens", "high", "Too many tokens")),
        F.when(non_negative(u["cost_usd"]) > cfg.get("max_cost_usd", 10.0), hit("consumption.cost", "high", "Too costly")),
        F.when(step["iteration"] >= cap, hit("consumption.iterations", "high", "Too many iterations")),
        F.when(step["tool_depth"] > cfg.get("max_depth", 25), hit("consumption.depth", "high", "Tools call too deep")),
        F.when(thinking > cfg.get("max_thinking", 32_000), hit("consumption.thinking", "high", "Too much reasoning")),
        F.when((thinking >= 4_000) & (thinking / F.greatest(tokens, F.lit(1.0)) > cfg.get("max_thinking_ratio", 50)), hit("consumption.thinking_ratio", "high", "Reasoning outweighs the answer")),
    )
    return by_action("unbounded_consumption", hits, cfg.get("action", "BLOCK"), lambda h: F.least(F.lit(100), F.size(h) * 50))


def corpus_poisoning_monitor(t: Text, cfg: dict, m: Column) -> Column:
    """Written documents that claim authority, repeat a question or carry more trust than their source."""
    c = m["corpus"]
    claims = reduce(lambda a, b: a + b, [F.when(t.plain.contains(p), 1).otherwise(0) for p in ("official answer", "the only correct answer", "authoritative source", "this document supersedes", "verified by the vendor")])
    questions = F.filter(F.transform(F.split(F.replace(t.plain, F.lit("?"), F.lit("?\n")), r"[.!\n]+"), lambda x: F.trim(x)), lambda s: s.endswith("?"))
    most = most_repeats(questions)
    low = F.arrays_overlap(tx.tokens(c["source_trust"]), tx.words("untrusted", "public", "external", "user", "unknown", "low"))
    high = F.arrays_overlap(tx.tokens(c["corpus_trust"]), tx.words("trusted", "curated", "internal", "verified", "high"))
    hits = hits_of(
        F.when(claims >= cfg.get("authority", 1), hit("corpus.authority", "high", "Claims authority")),
        F.when(most >= cfg.get("question_repeats", 3), hit("corpus.question_stuffing", "high", "Repeats a question")),
        F.when(low & high, hit("corpus.trust_boundary", "high", "An untrusted source for a trusted corpus")),
    )
    return by_action("corpus_poisoning_monitor", hits, "BLOCK" if cfg.get("action") == "BLOCK" else "WARN")


def reasoning_trace_disclosure(t: Text, cfg: dict, m: Column) -> Column:
    x = m["trace"]
    long_ = F.length(x["reasoning_trace"]) >= cfg.get("min_trace", 40)
    env = F.lower(F.coalesce(x["env"], F.lit("")))
    gated = env.isin("prod", "production", "live", "")
    hits = hits_of(
        F.when(long_ & ~F.coalesce(x["trace_scanned"], F.lit(False)), hit("trace.unscanned", "high", "The reasoning was not checked")),
        F.when(long_ & F.coalesce(x["answer_redacted"], F.lit(False)), hit("trace.unredacted", "high", "The answer was redacted, the reasoning not")),
        F.when(gated & F.coalesce(x["top_logprobs"], F.lit(False)), hit("trace.logprobs", "high", "Top log-probabilities are shown")).when(gated & F.coalesce(x["logprobs"], F.lit(False)), hit("trace.logprobs", "medium", "Log-probabilities are shown")),
        F.when(F.coalesce(x["raw_tool_args"], F.lit(False)), hit("trace.tool_args", "medium", "Raw tool arguments are shown")),
    )
    return by_action("reasoning_trace_disclosure", hits, "BLOCK" if cfg.get("action") == "BLOCK" else "WARN")


def multimodal_injection(t: Text, cfg: dict, m: Column) -> Column:
    """Instructions in what was extracted from attachments, of all of them; media that nothing was extracted from."""
    given = F.coalesce(m["attachments"], F.array().cast("array<struct<type:string,extracted_text:string,transcript:string>>"))
    text = lambda a: F.concat_ws(" ", a["extracted_text"], a["transcript"])
    joined = F.array_join(F.transform(given, text), "\n")
    plain = tx.plain(joined)
    found = F.size(scan(plain, tx.tokens(plain), rb.INJECTION)) >= cfg.get("match", 1)
    dark = F.exists(given, lambda a: (F.lower(a["type"]) != "text") & (F.trim(text(a)) == ""))
    hits = hits_of(
        F.when(found, hit("multimodal.injection", "high", "Instructions in an attachment")),
        F.when(dark & F.lit(cfg.get("flag_media", True)), hit("multimodal.unextracted", "medium", "Media without extracted text")),
    )
    block = found & F.lit(cfg.get("action", "BLOCK") == "BLOCK")
    return result("multimodal_injection", F.when(F.size(hits) == 0, "ALLOW").when(block, "BLOCK").otherwise("WARN"), hit_risk(hits), hits)


def semantic_cache_integrity(t: Text, cfg: dict, m: Column) -> Column:
    x = m
    c = x["semantic_cache"]
    on = F.coalesce(c["hit"], F.lit(False))
    foreign = on & c["tenant_id"].isNotNull() & (c["tenant_id"] != x["tenant_id"])
    hits = hits_of(
        F.when(foreign, hit("semantic_cache.cross_tenant", "high", "An entry of another tenant")),
        F.when(on & ~F.coalesce(c["partitioned"], F.lit(False)), hit("semantic_cache.unpartitioned", "high", "The cache is shared")),
        F.when(on & (c["similarity"] < cfg.get("similarity", 0.9)), hit("semantic_cache.similarity", "medium", "Low similarity")),
        F.when(on & (tx.jaccard(F.array_distinct(t.tokens), F.array_distinct(tx.tokens(c["cached_query"]))) < cfg.get("overlap", 0.3)), hit("semantic_cache.divergence", "high", "Another question")),
        F.when(on & (c["entry_age_seconds"] > cfg.get("max_age", 86_400)), hit("semantic_cache.stale", "medium", "An old entry")),
    )
    block = F.lit(cfg.get("action") == "BLOCK") | foreign
    return result("semantic_cache_integrity", F.when(F.size(hits) == 0, "ALLOW").when(block, "BLOCK").otherwise("WARN"), hit_risk(hits), hits)


def tools(t: Text, cfg: dict, m: Column) -> Column:
    """One tool call against the rules, which stop at the first failure. Blocks, risk 40."""
    x = m
    name, args = x["tool_name"], x["tool_args"]
    allowed, denied, domains = cfg.get("allowed"), cfg.get("denied", []), cfg.get("domain_allowlist")
    values = F.coalesce(F.map_values(args), F.array().cast("array<string>"))
    checks = []
    if denied:
        checks.append((name.isin(denied), hit("tools.denied", "high", F.concat(F.lit("Denied tool "), name))))
    if allowed is not None:
        checks.append((~name.isin(allowed), hit("tools.not_allowed", "high", F.concat(F.lit("Not an allowed tool "), name))))
    checks.append((F.exists(values, lambda v: F.length(v) > cfg.get("max_arg", 10_000)), hit("tools.argument_length", "high", "An argument is too long")))
    for tool, schema in cfg.get("schemas", {}).items():
        mine, known = name == tool, schema.get("properties", {})
        keys = F.coalesce(F.map_keys(args), tx.words())
        lacking = F.array_except(tx.words(*schema.get("required", [])), keys)
        checks.append((mine & (F.size(lacking) > 0), hit("tools.argument_missing", "high", F.concat(F.lit("Missing argument "), F.get(lacking, F.lit(0))))))
        if schema.get("additionalProperties") is False:
            checks.append((mine & (F.size(F.array_except(keys, tx.words(*known))) > 0), hit("tools.argument_unknown", "high", "An argument that the tool does not have")))
        for arg, rule in known.items():
            v = args[arg]
            form = {"integer": v.rlike(r"^-?\d+$"), "number": v.try_cast("double").isNotNull(), "boolean": v.isin("true", "false")}.get(rule.get("type"))
            if form is not None:
                checks.append((mine & v.isNotNull() & ~form, hit("tools.argument_type", "high", f"{arg} is no {rule['type']}")))
            if "maxLength" in rule:
                checks.append((mine & (F.length(v) > rule["maxLength"]), hit("tools.argument_length", "high", f"{arg} is too long")))
            if "enum" in rule:
                checks.append((mine & v.isNotNull() & ~v.isin(rule["enum"]), hit("tools.argument_value", "high", f"{arg} has another value")))
    if domains is not None:
        host = lambda v: F.lower(F.regexp_extract(v, r"(?i)^https?://([^/:?#]+)", 1))
        checks.append((F.exists(values, lambda v: (host(v) != "") & ~host(v).isin(domains)), hit("tools.domain", "high", "A host that is not allowed")))
    first = F.coalesce(*[F.when(c, h) for c, h in checks])
    spoken = F.coalesce(*[F.when(name.isNull() & t.plain.contains(d.lower()), hit("tools.denied", "high", f"Names {d}")) for d in denied]) if denied else None
    hits = hits_of(F.coalesce(first, spoken) if spoken is not None else first)
    return by_action("tools", hits, "BLOCK", lambda h: F.size(h) * 40)
