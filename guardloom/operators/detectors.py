"""Detectors that need the text alone: column in, result struct out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from guardloom.functions import text as tx
from guardloom.operators import rulebooks as rb
from guardloom.operators.banks import scan
from guardloom.operators.hits import by_action, by_threshold, hit, hit_risk, hits_of, let, most_repeats, no_hits, result


@dataclass(frozen=True)
class Text:
    """A text with its plain form and tokens, which are columns that were computed once."""

    raw: Column
    plain: Column
    tokens: Column


def _bank(name: str, bank, threshold: int, needs_block_action: bool):
    def run(t: Text, cfg: dict) -> Column:
        hits = scan(t.plain, t.tokens, bank)
        limit = cfg.get("block_threshold", threshold)
        if needs_block_action and cfg.get("action", "WARN") != "BLOCK":
            limit = 1_000
        return by_threshold(name, hits, limit)

    return run


exfiltration = _bank("exfiltration", rb.EXFILTRATION, 40, False)
document_metadata_leakage = _bank("document_metadata_leakage", rb.METADATA, 60, False)
retrieval_chunk_injection = _bank("retrieval_chunk_injection", rb.INJECTION + rb.ACTION_LURES, 50, True)
tool_output_injection = _bank("tool_output_injection", rb.INJECTION + rb.ACTION_LURES + rb.EXFILTRATION, 50, True)


def memory_write_poisoning(t: Text, cfg: dict) -> Column:
    return _bank("memory_write_poisoning", rb.INJECTION + rb.FUTURE, 50, True)(t, {"action": "BLOCK", **cfg})


_ENCODED = r"[A-Za-z0-9+/]{16,}|(\\x[0-9a-fA-F]{2}){5,}"


def _decoded(raw: Column) -> Column:
    """What the base64 and hexadecimal runs of a text say, apart by blanks; what is no text is left out."""
    valid = lambda b: F.coalesce(F.make_valid_utf8(b.cast("string")), F.lit(""))
    base64 = F.transform(F.regexp_extract_all(raw, F.lit(r"([A-Za-z0-9+/]{16,}={0,2})"), 1), lambda r: valid(F.try_to_binary(r, F.lit("base64"))))
    hexes = F.transform(F.regexp_extract_all(raw, F.lit(r"((?:\\x[0-9a-fA-F]{2}){5,})"), 1), lambda r: valid(F.unhex(F.replace(r, F.lit("\\x"), F.lit("")))))
    return F.array_join(F.concat(base64, hexes), " ")


def jailbreak(t: Text, cfg: dict) -> Column:
    """Rules over the text and over what base64 runs in it decode to; games and definitions are excused."""
    bank = rb.JAILBREAK + [rb.rules("jailbreak", f"custom_{i} | high | Configured word | - | {w}")[0] for i, w in enumerate(cfg.get("keywords", []))]
    hits = scan(t.plain, t.tokens, bank)
    if cfg.get("detect_encoding", True):
        inside = _decoded(t.raw)
        hidden = F.when(t.raw.rlike(_ENCODED), F.size(scan(tx.plain(inside), tx.tokens(inside), rb.JAILBREAK)) > 0).otherwise(False)
        hits = F.concat(hits, hits_of(F.when(hidden, hit("jailbreak.encoded_payload", "high", "An encoded part holds a jailbreak"))))
    definition = t.plain.rlike(r"^(what is|what does|define|explain the term|who invented) ")
    game = t.plain.rlike(r"(chess|board game|video game|role-?playing game)")

    def excuse(h: Column) -> Column:
        return F.when((F.size(h) > 0) & ((definition & (F.size(h) == 1)) | (game & ~F.exists(h, lambda x: x["severity"] == "high"))), no_hits()).otherwise(h)

    return by_threshold("jailbreak", let(hits, excuse), cfg.get("threshold", 60))


def secrets(t: Text, cfg: dict) -> Column:
    """Credentials by their formats; risk 100. BLOCK, or REDACT with [REDACTED]."""
    action, spared = cfg.get("action", "BLOCK"), cfg.get("exceptions", [])
    found = [F.when(t.raw.rlike(p), hit(f"secrets.{n}", sev, msg)) for n, sev, msg, p in rb.SECRETS]
    hits = hits_of(*found)
    if cfg.get("detect_base64", True):
        inside = _decoded(t.raw)
        hidden = reduce(lambda a, b: a | b, [inside.rlike(p) for _, _, _, p in rb.SECRETS])
        hits = F.concat(hits, hits_of(F.when(t.raw.rlike(r"[A-Za-z0-9+/]{24,}") & hidden, hit("secrets.encoded", "high", "An encoded part holds a secret"))))
    for s in spared:
        hits = F.when(t.raw.contains(s), no_hits()).otherwise(hits)
    clean = reduce(lambda c, r: F.regexp_replace(c, r[3], "[REDACTED]"), rb.SECRETS, t.raw)
    return by_action("secrets", hits, action, lambda h: F.when(F.size(h) > 0, 100).otherwise(0), lambda h: F.when((F.size(h) > 0) & F.lit(action == "REDACT"), clean))


def gibberish(t: Text, cfg: dict) -> Column:
    """Unnatural text: invisible characters, entropy, symbols, repeats, letters, unknown words.

    Words count as known by the frequent words of the languages in
    ``rb.FREQUENT``; the rule leaves out texts of other scripts and JSON. Where a
    repeated word is all there is, prose is warned about, not blocked, unless
    ``repetition_blocks``.
    """
    least = cfg.get("min_length", 10)
    dense = F.regexp_replace(t.raw, r"\s+", "")
    letters = F.regexp_replace(t.plain, "[^a-z]", "")
    vowels = F.length(F.regexp_replace(letters, "[^aeiou]", ""))
    ratio = (F.length(letters) - vowels) / F.greatest(vowels, F.lit(1))
    special = tx.share_of(t.raw, r"[\p{L}\p{N}\s]")
    most = most_repeats(F.filter(F.split(F.lower(t.raw), r"\s+"), lambda w: F.length(w) > 2))
    words = F.filter(F.split(t.plain, r"[^\p{L}]+"), lambda w: w != "")
    known = let(words, lambda ws: F.size(F.filter(ws, lambda w: w.isin(rb.FREQUENT_WORDS))) / F.greatest(F.size(ws), F.lit(1)))
    latin = F.length(F.regexp_replace(t.raw, r"[^\p{IsLatin}]", ""))
    prose = (latin > 30) & (latin * 2 > F.length(dense)) & ~t.raw.rlike(r"^\s*[{\[]")
    hits = hits_of(
        F.when(t.raw.rlike(tx.INVISIBLE), hit("gibberish.invisible", "high", "Characters that draw nothing")),
        F.when((F.length(dense) > 20) & (tx.entropy(dense) > cfg.get("entropy", 5.5)), hit("gibberish.entropy", "medium", "Entropy above the limit")),
        F.when(1 - special > cfg.get("special_ratio", 0.4), hit("gibberish.excessive_special_chars", "medium", "Mostly signs")),
        F.when(most >= cfg.get("repetition", 5), hit("gibberish.token_stuffing", "medium", "A word repeats")),
        F.when((F.length(letters) > 20) & ((ratio > 6) | ((ratio > 0) & (ratio < 0.3))), hit("gibberish.incoherent", "medium", "Unusual mix of vowels and consonants")),
        F.when(prose & (known < cfg.get("known_ratio", 0.08)), hit("gibberish.no_recognizable_words", "high", "Hardly any known word")),
    )
    action = cfg.get("action", "BLOCK")

    def decide(h: Column) -> Column:
        only = (F.size(h) == 1) & (F.get(h, F.lit(0))["rule_id"] == "gibberish.token_stuffing") & F.lit(not cfg.get("repetition_blocks", False))
        return result("gibberish", F.when(F.size(h) == 0, "ALLOW").when(only & F.lit(action == "BLOCK"), "WARN").otherwise(action), hit_risk(h), h)

    return let(F.when(F.length(t.raw) >= least, hits).otherwise(no_hits()), decide)


#: Frequent trigrams of some Latin-script languages.
TRIGRAMS = {
    "en": "the and ing ion ent her for tha nth int ere tio ver all his",
    "de": "der die und ein ich sch den che nde ung gen das hen ver ist",
    "fr": "les ent que des est ion ais our ait ous men tio ne  re  de ",
    "es": "que del los ado ent est con las par res aci com nte  la  de",
    "it": "che ell ion con del per ent ita are ato zio gli  la  di  un",
    "pt": "que ent ado com est par dos nao cao  de  do  da res men ara",
    "nl": "een het van den ver aar gen  de cht sch eer ijk  he ing ter",
    "sv": "och att det som för den med var inte har ska ett till ing ade",
    "da": "det der til for ikk med den har kan ret hed nde lig jeg ved",
    "fi": "sta ssa ien ist lla kan tta ien aan ise tee on  ja  hän min",
    "tr": "lar ler bir ara eri ını dan için ile nda yor ver ası aya ek ",
    "ro": "are rea sau est ul  ulu lor pri ent cu  și  pen din con ate",
    "pl": "nie prz rze owa sta  po  na  si ych ego cie dzi wie  za ani",
}


def language(t: Text, cfg: dict) -> Column:
    """The language by script or by frequent trigrams; blocked or not allowed ones are hits."""
    n = F.greatest(F.length(F.regexp_replace(t.raw, r"[^\p{L}]", "")), F.lit(1))
    scripts = {"ru": r"\p{IsCyrillic}", "ar": r"\p{IsArabic}", "zh": r"\p{IsHan}", "ja": r"\p{IsHiragana}\p{IsKatakana}", "el": r"\p{IsGreek}", "he": r"\p{IsHebrew}", "hi": r"\p{IsDevanagari}", "ko": r"\p{IsHangul}"}
    share = {k: F.length(F.regexp_replace(t.raw, f"[^{v}]", "")) / n for k, v in scripts.items()}
    by_script = F.coalesce(*[F.when(share[k] > 0.3, F.lit(k)) for k in ("ja", "zh", "ru", "ar", "el", "he", "hi", "ko")])
    tri = F.array_distinct(tx.trigrams(F.regexp_replace(t.plain, "[^a-zà-ÿ]+", " ")))
    scored = F.array(*[F.struct(F.size(F.array_intersect(tri, tx.words(*_cut(v)))).alias("s"), F.lit(k).alias("l")) for k, v in TRIGRAMS.items()])
    best = F.array_max(scored)
    confidence = F.when(by_script.isNotNull(), F.least(F.lit(1.0), F.greatest(*share.values()) + 0.2)).otherwise(F.least(F.lit(1.0), best["s"] / 6.0))
    lang = F.when(confidence >= cfg.get("min_confidence", 0.5), F.coalesce(by_script, best["l"])).otherwise("unknown")
    mixed = reduce(lambda a, b: a + b, [F.when(s > 0.2, 1).otherwise(0) for s in share.values()]) + F.when(F.length(F.regexp_replace(t.raw, r"[^\p{IsLatin}]", "")) / n > 0.2, 1).otherwise(0)
    allowed, blocked = cfg.get("allowed"), cfg.get("blocked", [])
    hits = hits_of(
        F.when(lang.isin(blocked), hit("language.blocked", "high", F.concat(F.lit("Language "), lang))) if blocked else F.lit(None).cast("struct<rule_id:string,severity:string,message:string>"),
        F.when(~lang.isin([*allowed, "unknown"]), hit("language.not_allowed", "high", F.concat(F.lit("Language "), lang))) if allowed else F.lit(None).cast("struct<rule_id:string,severity:string,message:string>"),
        F.when(F.lit(cfg.get("detect_mixed", False)) & (mixed > 1), hit("language.mixed", "medium", "Several scripts")),
    )
    hits = F.when(F.length(t.raw) >= cfg.get("min_length", 20), hits).otherwise(no_hits())
    risk = lambda h: F.least(F.lit(100), F.aggregate(h, F.lit(0), lambda a, x: a + F.when(x["severity"] == "high", 60).otherwise(20)))
    return by_action("language", hits, cfg.get("action", "WARN"), risk)


def _cut(v: str) -> list[str]:
    return [v[i : i + 3] for i in range(0, len(v), 4)]


def topic_restriction(t: Text, cfg: dict) -> Column:
    """Blocked topics by their words; sentences that inform, warn or offer help are excused."""
    wanted = cfg.get("allowed_topics")
    excused = t.plain.rlike(rb.RESOURCE) | t.plain.rlike(rb.INFORMATIONAL) | t.plain.rlike(rb.WARNING) if cfg.get("context_aware", True) else F.lit(False)

    def mentions(name: str) -> Column:
        strong, broad = rb.TOPICS.get(name, ("", ""))
        strong = [*strong.split(), *cfg.get("custom_synonyms", {}).get(name, [])]
        return F.arrays_overlap(t.tokens, tx.words(*strong)) | (F.size(F.array_intersect(t.tokens, tx.words(*broad.split()))) >= 2)

    if wanted:
        none = ~reduce(lambda a, b: a | b, [mentions(x) for x in wanted])
        hits = hits_of(F.when(none, hit("topic.off_topic", "high", "None of the allowed topics")))
        return by_threshold("topic_restriction", hits, cfg.get("block_threshold", 40), risk=F.when(none, 80).otherwise(0))
    hits = hits_of(*[F.when(mentions(x) & ~excused, hit(f"topic.{x}", "high", f"Blocked topic {x}")) for x in cfg.get("blocked_topics", list(rb.TOPICS))])
    return by_threshold("topic_restriction", hits, cfg.get("block_threshold", 40))


def toxicity(t: Text, cfg: dict) -> Column:
    """Terms of eight categories, also spelled with digits, stretched or spaced; harmless questions are excused first."""
    forms = [t.tokens]
    if cfg.get("detect_evasion", True):
        bent = tx.squeezed(tx.leet(tx.despaced(t.plain)))
        forms.append(tx.tokens(bent))
    found = []
    for cat, (sev, force, terms) in rb.TOXIC.items():
        words = [*terms.split(), *(cfg.get("custom_terms", []) if cat == "insult" else [])]
        ok = reduce(lambda a, b: a | b, [F.arrays_overlap(f, tx.words(*words)) for f in forms]) if words else F.lit(False)
        if cat in rb.TOXIC_PHRASES:
            ok = ok | t.plain.rlike(rb.TOXIC_PHRASES[cat])
        found.append(F.when(ok, hit(f"toxicity.{cat}", sev, f"Toxic language: {cat}")))
    hits = hits_of(*found)
    forced = [f"toxicity.{c}" for c, (_, f, _) in rb.TOXIC.items() if f]
    aware = cfg.get("context_aware", True)

    def decide(h: Column) -> Column:
        def with_force(force: Column) -> Column:
            risk = F.when(force, F.greatest(F.lit(90), hit_risk(h))).otherwise(hit_risk(h))
            block = F.lit(cfg.get("action", "WARN") == "BLOCK") | (risk >= 40)
            return result("toxicity", F.when(F.size(h) == 0, "ALLOW").when(block, "BLOCK").otherwise("WARN"), risk, h)

        return let(F.exists(h, lambda x: x["rule_id"].isin(forced)), with_force)

    def excuse(h: Column) -> Column:
        return F.when((F.size(h) > 0) & ~F.exists(h, lambda x: x["rule_id"].isin(forced)) & t.plain.rlike(rb.SAFE_QUERY), no_hits()).otherwise(h)

    return let(let(hits, excuse) if aware else hits, decide)


def bias(t: Text, cfg: dict) -> Column:
    """Stereotypes by attribute; a negation shortly before lowers a high hit and drops a medium one."""
    keep = {"low": ["high"], "medium": ["medium", "high"], "high": ["low", "medium", "high"]}[cfg.get("sensitivity", "medium")]
    found = []
    for attribute in cfg.get("attributes", list(rb.BIAS)):
        for r in rb.BIAS[attribute]:
            at = F.regexp_instr(t.plain, F.lit(r.pattern))
            before = F.substring(t.plain, F.greatest(at - 80, F.lit(1)), F.least(at - 1, F.lit(80)))
            denied = before.rlike(rb.NEGATION)
            sev = F.when(denied, "low").otherwise(r.severity)
            ok = F.arrays_overlap(t.tokens, tx.words(*r.words)) & (at > 0) & ~(denied & F.lit(r.severity == "medium")) & sev.isin(keep)
            found.append(F.when(ok, hit(r.rule_id, sev, r.message)))
    hits = hits_of(*found)
    return by_action("bias", hits, "BLOCK" if cfg.get("action") == "BLOCK" else "WARN")


def valence(tokens: Column) -> Column:
    """Mean valence of known words in [-1, 1]: negated ones turn half round, boosted ones weigh more; 0 without any."""
    table = F.create_map(*[F.lit(x) for kv in rb.VALENCE.items() for x in kv])
    scored = F.transform(
        tokens,
        lambda w, i: table[w]
        * F.when(F.arrays_overlap(F.slice(tokens, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), tx.words(*rb.NEGATORS)) & (i > 0), -0.5).otherwise(1.0)
        * F.when((i > 0) & F.get(tokens, i - 1).isin(rb.BOOSTERS), 1.5).otherwise(1.0),
    )
    def mean(known: Column) -> Column:
        m = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
        return F.when(F.size(known) > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), m))).otherwise(0.0)

    return let(F.filter(scored, lambda v: v.isNotNull()), mean)


def sentiment(t: Text, cfg: dict) -> Column:
    tones = [F.when(F.arrays_overlap(t.tokens, tx.words(*rb.TONES[x].split())), hit(f"sentiment.{x}", "medium", f"Tone: {x}")) for x in cfg.get("blocked_tones", list(rb.TONES))]
    low = F.when(valence(t.tokens) < cfg.get("min_sentiment", -0.3), hit("sentiment.excessively_negative", "medium", "Mostly negative words"))
    hits = F.when(F.length(t.raw) >= cfg.get("min_length", 15), hits_of(*tones, low)).otherwise(no_hits())
    return by_action("sentiment", hits, cfg.get("action", "WARN"))


def compliance(t: Text, cfg: dict) -> Column:
    """Prohibited claims and missing disclaimers of industries; APPEND adds the disclaimer."""
    hits, notes = [], []
    for industry in cfg.get("industries", list(rb.COMPLIANCE)):
        words, bank, note = rb.COMPLIANCE[industry]
        topic = F.arrays_overlap(t.tokens, tx.words(*words.split()))
        lacking = topic & ~t.plain.contains(note.lower())
        hits.append(F.when(topic, scan(t.plain, t.tokens, bank)).otherwise(no_hits()))
        hits.append(hits_of(F.when(lacking, hit(f"compliance.{industry}.disclaimer", "medium", "The disclaimer is missing"))))
        notes.append(F.when(lacking, F.lit(f"\n\n---\n**Disclaimer:** {note}")).otherwise(""))
    hits.append(scan(t.plain, t.tokens, rb.COMPLIANCE_GENERAL))
    for r in cfg.get("custom_rules", []):
        hits.append(hits_of(F.when(t.plain.rlike(f"(?i){r['pattern']}"), hit(f"compliance.{r['id']}", r.get("severity", "medium"), r.get("message", "A configured rule")))))
    if cfg.get("ai_disclosure"):
        hits.append(hits_of(F.when(~t.plain.rlike(r"\b(ai|artificial intelligence|language model|chatbot|assistant)\b"), hit("compliance.ai_disclosure", "low", "Does not say that a machine wrote it"))))
    all_ = F.concat(*hits)
    action = cfg.get("action", "WARN")
    if action == "APPEND":
        text = F.concat(t.raw, *notes)
        return by_action("compliance", all_, "TRANSFORM", sanitized=lambda h: F.when(F.size(h) > 0, text))
    return by_action("compliance", all_, action)


def _nearly(name: str) -> Callable[[Column], Column]:
    """Words of three letters or more that one edit in some seven letters, or all after five, tell from a name."""

    def of(word: Column) -> Column:
        close = F.levenshtein(word, F.lit(name)) * 2 <= (F.length(word) + len(name)) * 0.15
        begins = (F.substring(word, 1, 5) == name[:5]) & (F.length(word) >= 5) if len(name) >= 5 else F.lit(False)
        return (F.length(word) >= 3) & (close | begins)

    return of


def competitor(t: Text, cfg: dict) -> Column:
    """Mentions of competitors and aliases, or words much like a name; the words around them set the severity."""
    names = {**{c: [c] for c in cfg.get("competitors", [])}}
    for c, others in cfg.get("aliases", {}).items():
        names.setdefault(c, [c]).extend(others)
    if not names:
        return result("competitor", F.lit("ALLOW"), F.lit(0), no_hits())
    found, clean = [], t.raw
    for c, forms in names.items():
        p = "|".join(f.lower().replace(".", r"\.") for f in forms)
        at = f"(^|[^a-z0-9])({p})($|[^a-z0-9])"
        around = F.regexp_extract(t.plain, f"([^.!?]{{0,40}})(^|[^a-z0-9])({p})($|[^a-z0-9])([^.!?]{{0,40}})", 0)
        sev = (
            F.when(around.rlike("(api|sdk|integrat|export|import|plugin)"), "low")
            .when(around.rlike("(worse|bad|terrible|hate|avoid|scam)"), "high")
            .when(around.rlike("(compare|comparison|versus|vs|better than|alternative)"), "medium")
            .when(around.rlike("(partner|partnership|together with)"), "low")
            .otherwise("medium")
        )
        like = F.exists(t.tokens, _nearly(c.lower())) if cfg.get("fuzzy", True) else F.lit(False)
        rule = f"competitor.{c.lower().replace(' ', '_')}"
        found.append(F.when(t.plain.rlike(at), hit(rule, sev, f"Mentions {c}")).when(like, hit(rule, "medium", f"Mentions what is nearly {c}")))
        clean = F.regexp_replace(clean, f"(?i)\\b({p})\\b", "[COMPETITOR]")
    hits = hits_of(*found)
    action = cfg.get("action", "WARN")
    if action == "RESTRICT":
        return by_action("competitor", hits, "TRANSFORM", sanitized=lambda h: F.when(F.size(h) > 0, clean))
    return by_action("competitor", hits, action)


_URL = r"(?i)(https?://[^\s\"'<>)\]]+)"


def malicious_url(t: Text, cfg: dict) -> Column:
    """Each URL against the checks in order; allowlisted hosts are free, blocklisted ones one hit."""
    allow, block = cfg.get("allowlist", []), cfg.get("blocklist", [])
    urls = F.regexp_extract_all(t.raw, F.lit(_URL), 1)

    def check(u: Column) -> Column:
        host = F.lower(F.regexp_extract(u, r"(?i)^https?://(?:[^/@]*@)?\[?([^/:?#\]]+)", 1))
        base = F.substring_index(host, ".", -2)
        near = reduce(F.least, [F.levenshtein(base, F.lit(p)) for p in rb.POPULAR])
        ip = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
        checks = hits_of(
            F.when(ip, hit("url.ip_address", "high", "A bare address")),
            F.when(base.isin(rb.SHORTENERS) | host.isin(rb.SHORTENERS), hit("url.shortener", "medium", "A shortened link")),
            F.when(F.substring_index(host, ".", -1).isin(rb.RISKY_TLDS), hit("url.tld", "medium", "A risky top-level domain")),
            F.when(~ip & (F.size(F.split(host, r"\.")) - 2 > cfg.get("max_subdomains", 3)), hit("url.subdomains", "medium", "Many subdomains")),
            F.when(host.rlike(r"(^|\.)xn--"), hit("url.punycode", "medium", "Punycode")),
            F.when(~ip & (near == 1), hit("url.typosquat", "high", "One letter from a popular name")),
        )
        listed = F.array(hit("url.blocklisted", "high", "A blocklisted host"))
        out = F.when(host.isin(block), listed).otherwise(checks) if block else checks
        return F.when(host.isin(allow), no_hits()).otherwise(out) if allow else out

    hits = F.concat(F.flatten(F.transform(urls, check)), hits_of(F.when(t.plain.contains("data:text/html"), hit("url.data_uri", "high", "A data URI"))))
    hits = F.array_distinct(hits)
    action = cfg.get("action", "REDACT")
    clean = F.regexp_replace(t.raw, _URL, "[URL REDACTED]")
    return by_action("malicious_url", hits, action, sanitized=lambda h: F.when((F.size(h) > 0) & F.lit(action == "REDACT"), clean))


def copyright_(t: Text, cfg: dict) -> Column:
    """Licence texts, lyrics, configured passages and long repeats; many works are compared by the fingerprint join."""
    lic = [F.when(t.plain.contains(x), hit("copyright.licence", "medium", f"Licence text: {x}")) for x in cfg.get("licences", rb.LICENCES)]
    grams = tx.ngrams(t.tokens, 8)
    repeats = let(grams, lambda g: F.size(g) - F.size(F.array_distinct(g)))
    six = tx.ngrams(t.tokens, 6)
    again = let(six, lambda g: F.size(g) > F.size(F.array_distinct(g)))
    lyrics = t.plain.rlike(rb.LYRICS) & again
    bare = F.array_join(t.tokens, " ")
    known = [F.when(bare.contains(" ".join(re.findall("[a-z0-9]+", x.lower()))), hit("copyright.passage", "high", "A protected passage")) for x in cfg.get("passages", [])]
    hits = F.concat(F.array_distinct(hits_of(*lic)), F.array_distinct(hits_of(*known)), hits_of(F.when(lyrics, hit("copyright.lyrics", "medium", "Lyrics that repeat")), F.when(repeats >= 3, hit("copyright.repetition", "low", "Long passages repeat"))))
    return by_action("copyright", hits, cfg.get("action", "WARN"))


def code_safety(t: Text, cfg: dict) -> Column:
    """Dangerous calls in fenced code, or in the whole text where none is fenced."""
    fenced = F.array_join(F.regexp_extract_all(t.plain, F.lit(r"(?s)```[a-z]*\n(.*?)```"), 1), "\n")
    code = F.when(F.length(fenced) > 0, fenced).otherwise(t.plain)
    banks = [r for lang in cfg.get("languages", list(rb.CODE)) for r in rb.CODE[lang]]
    custom = [rb.rules("code", f"banned_{i} | high | Banned call | - | {w}")[0] for i, w in enumerate(cfg.get("custom_banned", []))]
    return by_action("code_safety", F.array_distinct(scan(code, tx.tokens(code), banks + custom)), cfg.get("action", "BLOCK"))


def sensitive_business_data(t: Text, cfg: dict) -> Column:
    """One hit per category; an allowlisted phrase excuses the text. REDACT replaces the phrases."""
    hits = scan(t.plain, t.tokens, rb.SENSITIVE)
    for phrase in cfg.get("allowlist", []):
        hits = F.when(t.plain.contains(phrase.lower()), no_hits()).otherwise(hits)
    action = cfg.get("action", "REDACT")
    clean = reduce(lambda c, r: F.regexp_replace(c, "(?i)" + r.pattern[len("(^|[^a-z0-9])"): -len("($|[^a-z0-9])")], "[REDACTED]"), rb.SENSITIVE, t.raw)
    def decide(h: Column) -> Column:
        enough = hit_risk(h) >= cfg.get("block_threshold", 60)
        decision = F.when(F.size(h) == 0, "ALLOW").when(enough, action).otherwise("WARN")
        return result("sensitive_business_data", decision, hit_risk(h), h, F.when(enough & F.lit(action == "REDACT"), clean))

    return let(hits, decide)


def equations(text: Column) -> Column:
    """Whether each ``a op b = c`` of the text holds: array of (text, right), tolerance 0.01 or a thousandth."""
    num = r"(-?\d+(?:\.\d+)?)"
    p = F.lit(rf"{num} ?([-+*/x]) ?{num} ?= ?{num}")
    get = lambda g: F.regexp_extract_all(text, p, g)
    rows = F.arrays_zip(get(0).alias("e"), get(1).alias("a"), get(2).alias("op"), get(3).alias("b"), get(4).alias("c"))
    return F.transform(
        rows,
        lambda r: F.struct(
            r["e"].alias("equation"),
            _holds(r["a"].cast("double"), r["op"], r["b"].cast("double"), r["c"].cast("double")).alias("right"),
        ),
    )


def _holds(a: Column, op: Column, b: Column, c: Column) -> Column:
    want = F.when(op == "+", a + b).when(op == "-", a - b).when(op.isin("*", "x"), a * b).when(b != 0, a / b)
    return F.coalesce(F.abs(want - c) <= F.greatest(F.lit(0.01), F.abs(want) * 0.001), F.lit(True))


def numerical_consistency(t: Text, cfg: dict) -> Column:
    wrong = F.filter(equations(t.raw), lambda r: ~r["right"])
    hits = F.transform(wrong, lambda r: hit("numerical.inconsistent", "high", F.concat(F.lit("Does not hold: "), r["equation"])))
    return by_threshold("numerical_consistency", hits, cfg.get("block_threshold", 60))


def embedding_integrity(t: Text, cfg: dict) -> Column:
    """Texts made for the retriever: stuffed keywords, hidden characters, raw vectors, long base64."""
    n = F.size(t.tokens)
    most = most_repeats(t.tokens)
    hidden = F.length(t.raw) - tx.length_without(t.raw, tx.INVISIBLE)
    hits = hits_of(
        F.when((n >= 20) & (most / n >= cfg.get("repetition", 0.3)), hit("embedding.keyword_stuffing", "medium", "One word fills the text")),
        F.when((hidden >= 20) | (hidden / F.greatest(F.length(t.raw), F.lit(1)) >= 0.05), hit("embedding.hidden_text", "high", "Hidden characters")),
        F.when(t.raw.rlike(r"\[\s*(-?\d+\.\d+\s*,\s*){15,}-?\d+\.\d+"), hit("embedding.raw_vector", "high", "A raw vector")),
        F.when(t.raw.rlike(r"[A-Za-z0-9+/]{512,}"), hit("embedding.base64", "medium", "A long encoded run")),
    )
    return by_threshold("embedding_integrity", hits, 50 if cfg.get("action") == "BLOCK" else 1_000)


def output_control_char_sanitizer(t: Text, cfg: dict) -> Column:
    """Terminal control sequences; what is kept of the text has none (colours may stay)."""
    esc, colour = "\x1b", "\x1b\\[[0-9;]*m"
    ansi = f"{esc}\\[[0-9;?]*[A-Za-z]"
    osc = f"{esc}\\][^\x07{esc}]*(\x07|{esc}\\\\)"
    keep = cfg.get("allow_colour", True)
    rest = F.regexp_replace(t.raw, colour, "") if keep else t.raw
    hits = hits_of(
        F.when(t.raw.rlike(f"{esc}\\]52;"), hit("output_control_char.osc52", "high", "Writes to the clipboard")),
        F.when(t.raw.rlike(f"{esc}\\](?!52;)"), hit("output_control_char.osc", "high", "An operating system command")),
        F.when(t.raw.rlike(f"{esc}\\[[0-9;]*[HJKABCDsu]|\r(?!\n)"), hit("output_control_char.screen", "high", "Moves the cursor")),
        F.when(rest.rlike(ansi), hit("output_control_char.ansi", "medium", "A terminal sequence")),
        F.when(F.regexp_replace(rest, f"{ansi}|{osc}", "").rlike("[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]"), hit("output_control_char.control", "medium", "Control characters")),
    )
    free = f"{esc}(?!\\[[0-9;]*m)" if keep else esc
    csi = f"{esc}\\[(?![0-9;]*m)[0-9;?]*[A-Za-z]" if keep else ansi
    clean = F.regexp_replace(F.regexp_replace(t.raw, osc, "[OSC]"), csi, "[CSI]")
    clean = F.regexp_replace(clean, f"[\x00-\x08\x0b\x0c\x0e-\x1a\x1c-\x1f\x7f]|\r(?!\n)|{free}", "?")
    action = cfg.get("action", "REDACT")
    return by_action("output_control_char_sanitizer", hits, action, sanitized=lambda h: F.when((F.size(h) > 0) & F.lit(action == "REDACT"), clean))


def structure(t: Text, cfg: dict) -> Column:
    """Whether the text parses as the expected JSON or XML; one hit, risk 30."""
    body = F.trim(F.regexp_replace(t.raw, r"(?s)^\s*```(?:json|xml)?\s*|\s*```\s*$", ""))
    kind = cfg.get("expected_format", "json")
    ok = F.try_parse_json(body).isNotNull() if kind == "json" else body.rlike(r"(?s)^(<\?xml[^>]*\?>)?\s*<([A-Za-z_][\w.-]*)[^>]*>.*</\2>\s*$")
    required = cfg.get("required", [])
    lacking = reduce(lambda a, b: a | b, [F.get_json_object(body, f"$.{k}").isNull() for k in required]) if required and kind == "json" else F.lit(False)
    hits = hits_of(F.when(~F.coalesce(ok, F.lit(False)), hit("structure.invalid", "medium", f"No valid {kind}")).when(lacking, hit("structure.missing", "medium", "A required field is missing")))
    return by_action("structure", hits, cfg.get("action", "BLOCK"))


_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DAY, _MON, _YEAR = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:19|20)\d\d"
_STREET = r"(?:street|st|avenue|ave|road|rd|highway|hwy|drive|dr|court|ct|boulevard|blvd|lane|ln|way|place|pl|circle|cir|parkway|pkwy|square|sq|trail|trl)"
_NAME = r"[A-Z][a-z]{1,20}"
#: type -> (severity, pattern, guard on what was matched); with a guard ("any" takes all) only group 1 is redacted.
PII_TYPES = {
    "email": ("medium", rf"({_EMAIL})", None),
    "ssn": ("high", r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])", None),
    "credit_card": ("high", r"(?<!\d)(\d(?:[ -]?\d){12,18})(?!\d)", "luhn"),
    "ipv4": ("low", r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?![\d.])", "ipv4"),
    "phone": ("medium", r"(?<![\w.])(\+?\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]\d{3,4}[ .-]\d{3,4})(?![\w-])", None),
    "iban": ("high", r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7})\b", None),
    "nino": ("high", r"\b([A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])\b", None),
    "nif_es": ("high", r"\b(\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z])\b", "nif"),
    "mac": ("low", r"\b((?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}|(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4})\b", None),
    # general
    "api_key": ("high", r"\b((?:sk|pk)_(?:live|test)_[A-Za-z0-9]{24,}|gh[po]_[A-Za-z0-9]{36,}|AKIA[0-9A-Z]{16}|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]+|(?i:api[_-]?(?:key|token))[=:\s]+[\"']?[\w-]{32,})", None),
    "user_agent": ("low", r"(?i)(Mozilla/\d\.\d\s*\([^)]{10,}\))", None),
    "ipv6": ("low", r"(?<![\w:.])((?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[0-9a-fA-F:]*::)(?:[0-9a-fA-F]{1,4}:){1,7}(?::[0-9a-fA-F]{1,4}){0,6}:?|::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})(?![\w:])", None),
    "gps_coordinates": ("medium", r"(\[-?\d{1,3}\.\d{1,8},\s*-?\d{1,3}\.\d{1,8}\])", None),
    "ethereum_address": ("medium", r"\b(0x[0-9A-Fa-f]{40})\b", None),
    "bitcoin_address": ("medium", r"\b([13][a-km-zA-HJ-NP-Z1-9]{25,34}|bc1[a-z0-9]{39,59})\b", None),
    "masked_number": ("medium", r"(?i)(?<![\w*])((?:X{4}[\s-]){2,3}X{4}[\s-]\d{4}|(?:\*{4}[\s-]?){3}\d{4}|\d{4}[\s-]\*{4}[\s-]\*{4}[\s-]\d{4})\b", None),
    "password": ("high", r"(?i)(?:password|passcode|passphrase|pin|secret\s+key|api\s+secret|token|credential)s?[\s:=-]{1,5}(?=[^\s]*\d)([\w!@#$%^&*()\[\]\-+=<>?]{8,80})", "any"),
    "medical_record": ("high", r"(?i)\b(?:MRN|Medical Record|Patient ID)[:\s#]*((?=[a-z]*\d)[A-Z0-9]{6,12})\b", "any"),
    "health_insurance_id": ("high", r"(?i)\b(?:Member ID|Policy|Insurance ID|Subscriber)[:\s#]*((?=[a-z]*\d)[A-Z0-9]{8,15})\b", "any"),
    "date_of_birth": ("medium", rf"(?i)\b({_MON}[/-]{_DAY}[/-]{_YEAR}|{_YEAR}[/-]{_MON}[/-]{_DAY}|{_DAY}[/-]{_MON}[/-]{_YEAR}|{_MONTH}\s+{_DAY}(?:st|nd|rd|th)?,?\s+{_YEAR}|{_DAY}(?:st|nd|rd|th)?\s+{_MONTH}\s+{_YEAR})\b", None),
    "person_name": ("medium", rf"\b(?:Dear|Hi|Hello|Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Prof\.?|[Mm]y\s+name\s+is|I'?m(?=\s+{_NAME}\s+{_NAME})|patient|client|student|user|member|subscriber|employee|recipient|caller|sender|buyer|seller|applicant|owner|holder|resident|tenant)\s+({_NAME}(?:\s+{_NAME}){{0,2}})\b", "any"),
    "username": ("low", r"(?i)(?:(?<![\w.+%-])(?=@)|(?:username|user\s*name|login|handle)[\s:=]+[\"']?(?=[\w.-]*[\d_]))(@?[A-Za-z0-9_.-]{3,30})\b", "any"),
    # regional, by country
    "in_pan": ("high", r"\b([A-Z]{5}\d{4}[A-Z])\b", None),
    "in_aadhaar": ("high", r"\b([2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4})\b", "verhoeff"),
    "in_gstin": ("high", r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9])\b", None),
    "in_din": ("medium", r"\b(?:DIN|din)[:\s#]*(\d{8})\b", "any"),
    "in_ifsc": ("medium", r"\b([A-Z]{4}0[A-Z0-9]{6})\b", None),
    "in_upi": ("medium", r"\b([A-Za-z0-9._-]{3,}@[A-Za-z]{2,20})\b(?!\.)", None),
    "uk_utr": ("medium", r"\b(?:UTR|utr)[:\s#]*(\d{10})\b", "any"),
    "uk_nhs": ("high", r"\b(\d{3}[\s-]?\d{3}[\s-]?\d{4})\b", "nhs"),
    "uk_vat": ("medium", r"\b(GB\s?\d{9}(?:\s?\d{3})?)\b", None),
    "de_vat": ("medium", r"\b(DE\s?\d{9})\b", None),
    "fr_vat": ("medium", r"\b(FR\s?[A-HJ-NP-Z0-9]{2}\s?\d{9})\b", None),
    "it_vat": ("medium", r"\b(IT\s?\d{11})\b", None),
    "nl_vat": ("medium", r"\b(NL\s?\d{9}B\d{2})\b", None),
    "es_vat": ("medium", r"\b(ES\s?[A-Z0-9]\d{7}[A-Z0-9])\b", None),
    "be_vat": ("medium", r"\b(BE\s?0?\d{9})\b", None),
    "nl_bsn": ("high", r"\b([1-9]\d{8})\b", "bsn"),
    "it_cf": ("high", r"\b([A-Z]{6}\d{2}[A-EHLMPRST]\d{2}[A-Z]\d{3}[A-Z])\b", None),
    "dk_cpr": ("high", r"\b((?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}[-\s]?\d{4})\b", None),
    "ro_cnp": ("high", r"\b([1-8]\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{6})\b", None),
    "pl_pesel": ("high", r"\b(\d{2}(?:[02][1-9]|[13][0-2])(?:0[1-9]|[12]\d|3[01])\d{5})\b", None),
    "gr_amka": ("high", r"\b((?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{7})\b", None),
    "sg_nric": ("high", r"\b([STFG]\d{7}[A-Z])\b", None),
    "my_ic": ("high", r"\b(\d{6}[-\s]\d{2}[-\s]?\d{4})\b", None),
    "th_id": ("high", r"\b(\d[-\s]\d{4}[-\s]?\d{5}[-\s]?\d{2}[-\s]?\d)\b", None),
    "ph_tin": ("high", r"\b(\d{3}[-\s]\d{3}[-\s]?\d{3}[-\s]?\d{3})\b", None),
    "id_ktp": ("high", r"\b(\d{16})\b", "ktp"),
    "tw_id": ("high", r"\b([A-Z][12]\d{8})\b", None),
    "jp_mynumber": ("high", r"(?:\bMyNumber|マイナンバー|個人番号)[:\s#]*(\d{4}[\s-]?\d{4}[\s-]?\d{4})\b", "any"),
    "au_tfn": ("high", r"(?i)\bTFN[:\s#]*(\d{3}[\s-]?\d{3}[\s-]?\d{2,3})\b", "tfn"),
    "au_abn": ("medium", r"(?i)\bABN[:\s#]*(\d{2}[\s-]?\d{3}[\s-]?\d{3}[\s-]?\d{3})\b", "abn"),
    "au_acn": ("medium", r"(?i)\bACN[:\s#]*(\d{3}[\s-]?\d{3}[\s-]?\d{3})\b", "acn"),
    "hk_id": ("high", r"\b([A-Z]{1,2}\d{6}[(\[][A0-9][)\]])", None),
    "ca_sin": ("high", r"(?i)\b(?:SIN|NAS)[:\s#]*(\d{3}[-\s]?\d{3}[-\s]?\d{3})\b", "sin"),
    "br_cpf": ("high", r"\b(\d{3}\.?\d{3}\.?\d{3}-?\d{2})\b", "cpf"),
    "br_cnpj": ("high", r"\b(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})\b", "cnpj"),
    "mx_curp": ("high", r"\b([A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z0-9]\d)\b", None),
    "mx_rfc": ("high", r"(?<![\w&])([A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3})\b", None),
    # wide shapes, after all that are narrower
    "imei": ("medium", r"\b(\d{2}-\d{6}-\d{6}-\d|\d{15})\b", None),
    "bank_account": ("high", r"\b(\d{8,17})\b", None),
    "address": ("medium", rf"(?i)\b(\d{{1,5}}\s+[A-Za-z][\w\s]{{1,30}}{_STREET}\b(?:[,.\s]+[\w\s]{{1,30}}[,.\s]+[A-Z]{{2}}\s+\d{{5}}(?:-\d{{4}})?\b)?)", None),
    "url": ("low", r"(?i)(https?://[^\s<>\"']{8,}|\bwww\.[a-z0-9.-]+\.[a-z]{2,}[^\s<>\"']*)", None),
    "tax_id": ("high", r"\b(9\d{2}-\d{2}-\d{4}|\d{2}-\d{7})\b", None),
    "vin": ("medium", r"\b((?=[A-Z]*\d)[A-HJ-NPR-Z0-9]{17})\b", None),
    "national_id": ("high", r"\b([A-Z]{2}\d{7,10}[A-Z]?)\b", None),
    "passport": ("high", r"\b([A-Z]{1,2}\d{6,9})\b", None),
    "drivers_license": ("high", r"\b([A-Z]{1,2}\d{5,8}|[A-Z]\d{3}-\d{3}-\d{2}-\d{3}-\d)\b", None),
    "license_plate": ("low", r"\b((?=[A-Z]{0,4}[\s-]?[A-Z]{0,4}\d)[A-Z0-9]{1,4}[\s-]?[A-Z0-9]{2,4}(?:[\s-]?[A-Z0-9]{1,4})?)\b", None),
}
#: Shapes that ordinary words, codes and links have too: only where ``types`` names them.
PII_ON_REQUEST = ("address", "url", "tax_id", "vin", "national_id", "passport", "drivers_license", "license_plate")
#: Other names of types in policies.
PII_ALIASES = {"ip_address": ("ipv4", "ipv6"), "mac_address": ("mac",), "uk_nino": ("nino",), "es_nif": ("nif_es",)}


def _pii_types(cfg: dict) -> list[str]:
    """The types to look for, in the order of PII_TYPES: all that need no request, or those named."""
    named = cfg.get("types")
    if named is None:
        return [k for k in PII_TYPES if k not in PII_ON_REQUEST]
    wanted = {k for n in named for k in PII_ALIASES.get(n, (n,))}
    if unknown := wanted - PII_TYPES.keys():
        raise ValueError(f"unknown types of personal data: {sorted(unknown)}")
    return [k for k in PII_TYPES if k in wanted]


def _partly(kind: str, m: Column) -> Column:
    """What partial redaction leaves of a match; types without a form of their own give their tag."""
    tail = lambda n: F.right(F.regexp_replace(m, "[^0-9A-Za-z]", ""), F.lit(n))
    forms = {
        "email": lambda: F.concat(F.left(m, F.lit(1)), F.lit("***@"), F.substring_index(m, "@", -1)),
        "phone": lambda: F.concat(F.lit("(***) ***-"), tail(4)),
        "ssn": lambda: F.concat(F.lit("***-**-"), tail(4)),
        "tax_id": lambda: F.concat(F.lit("***-**-"), tail(4)),
        "credit_card": lambda: F.concat(F.lit("****-****-****-"), tail(4)),
        "ipv4": lambda: F.concat(F.substring_index(m, ".", 2), F.lit(".x.x")),
        "iban": lambda: F.concat(F.left(m, F.lit(2)), F.lit("****"), tail(4)),
        "mac": lambda: F.concat(F.lit("**:**:**:**:**:"), tail(2)),
        "api_key": lambda: F.concat(F.left(m, F.lit(4)), F.lit("..."), F.right(m, F.lit(4))),
        "bank_account": lambda: F.concat(F.lit("****"), tail(4)),
        "passport": lambda: F.concat(F.lit("***"), tail(3)),
        "drivers_license": lambda: F.concat(F.lit("***"), tail(4)),
        "vin": lambda: F.concat(F.lit("*" * 13), tail(4)),
        "license_plate": lambda: F.concat(F.lit("***"), tail(2)),
        "date_of_birth": lambda: F.lit("**/**/****"),
    }
    return forms[kind]() if kind in forms else F.lit(f"[{kind.upper()}]")


def _kept(found: Column, guard) -> Column:
    return F.filter(found, lambda x: guard(x))


def _each(found: Column, h: Column) -> Column:
    return F.transform(found, lambda m: h)


def _replaced(text: Column, items: Column, put) -> Column:
    return F.aggregate(items, text, lambda acc, m: F.replace(acc, m, put(m)))


def pii(t: Text, cfg: dict) -> Column:
    """Personal data by type: every match is a hit, also where types overlap.

    Redaction takes the types in their order, in full or (redaction_strategy
    ``partial``) leaving the ends that _partly gives; the action words follow
    their aliases, an unknown one redacts.
    """
    from guardloom.functions import checksums as ck

    guards = {
        "luhn": ck.luhn, "ipv4": ck.ipv4, "nif": ck.nif_es, "verhoeff": ck.verhoeff, "nhs": ck.nhs_uk, "bsn": ck.bsn_nl, "ktp": ck.ktp_id, "tfn": ck.tfn_au,
        "abn": ck.abn_au, "acn": ck.acn_au, "sin": lambda c: ck.luhn(c, 9), "cpf": ck.cpf_br, "cnpj": ck.cnpj_br,
    }
    word = str(cfg.get("action", "REDACT")).upper()
    action = {"TRANSFORM": "REDACT", "MASK": "REDACT", "ANONYMIZE": "REDACT", "DENY": "BLOCK", "WARN": "ALLOW", "LOG": "ALLOW", "NONE": "ALLOW"}.get(word, word if word in ("REDACT", "BLOCK", "ALLOW") else "REDACT")
    partial = cfg.get("redaction_strategy", "full") == "partial"
    hits, clean = [], t.raw
    for kind in _pii_types(cfg):
        sev, p, guard = PII_TYPES[kind]
        found = F.regexp_extract_all(t.raw, F.lit(p), 1)
        if guard and guard != "any":
            found = _kept(found, guards[guard])
        hits.append(_each(found, hit(f"pii.{kind}", sev, f"Personal data: {kind}")))
        put = f"[{kind.upper()}]"
        if guard or partial:
            clean = _replaced(clean, F.array_distinct(found), (lambda m, k=kind: _partly(k, m)) if partial else (lambda m, put=put: F.lit(put)))
        else:
            clean = F.regexp_replace(clean, p, put)
    all_ = F.concat(*hits)
    return by_action("pii", all_, action, sanitized=lambda h: F.when((F.size(h) > 0) & F.lit(action == "REDACT"), clean))


def abuse(t: Text, cfg: dict) -> Column:
    """Payload length and repeated phrases; rates and floods come by the keyed state. 30 a hit."""
    parts = F.filter(F.transform(F.split(t.plain, r"[.!?\n]+"), lambda x: F.trim(x)), lambda s: s != "")
    most = most_repeats(parts)
    hits = hits_of(
        F.when(F.length(t.raw) > cfg.get("max_chars", 100_000), hit("abuse.payload", "high", "The text is too long")),
        F.when(most >= cfg.get("repetitive", 10), hit("abuse.repetitive", "medium", "A phrase repeats")),
    )
    return by_action("abuse", hits, "BLOCK", lambda h: F.least(F.lit(100), F.size(h) * 30))
