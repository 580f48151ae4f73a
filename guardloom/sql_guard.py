"""What the detector queries compute, as DuckDB SQL; detectors that SQL cannot say have none."""

from __future__ import annotations

from collections.abc import Iterable

from guardloom.functions import text as tx
from guardloom.operators import rulebooks as rb
from guardloom.operators.detectors import TRIGRAMS
from guardloom.samples import PROMPT, SAMPLES

_KEY = "prompt key"
SETTINGS = {
    "competitor": {"competitors": ["Lumadock", "Norvik Pad", "Quelbit"], "aliases": {"Quelbit": ["Quelbit Cloud"]}, "action": "RESTRICT"},
    "compliance": {"action": "APPEND"},
    "language": {"allowed": ["en"], "detect_mixed": True},
    "secrets": {"action": "REDACT"},
    "structure": {"expected_format": "json"},
    "tools": {"denied": ["run_sql", "send_mail"]},
    "pii": {"action": "REDACT"},
    "jailbreak": {"detect_encoding": False},
    "system_prompt_leakage": {"key": _KEY, "match_threshold": 1},
}
_W = {"low": 10, "medium": 30, "high": 50}


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _words(w: Iterable[str]) -> str:
    return "[" + ", ".join(map(q, w)) + "]"


def _rows(name: str) -> str:
    """doc_id, t (text), p (plain), k (tokens), m (metadata) of all documents and the samples."""
    n, named = "coalesce(n_chars, 0)", "'Source of ' || source"
    meta = f"""json_object('tenant_id', tenant_id, 'source_context', {named}, 'grounding_sources', json_array(json_object('url', 'https://kb.example/' || source, 'text', {named})),
        'scope_enforced_in_query', source <> 'kb_chunks', 'retrieval', json_object('chunks', json_array(json_object('tenant_id', CASE WHEN {n} % 10 < 9 THEN tenant_id ELSE 'another' END, 'score', {n} / 1000.0, 'score_kind', 'similarity', 'content', source))),
        'semantic_cache', json_object('hit', stage = 'input', 'similarity', {n} / 1000.0, 'cached_query', source, 'tenant_id', tenant_id, 'partitioned', true, 'entry_age_seconds', {n} * 60.0),
        'approval', json_object('approved', {n} % 2 = 0, 'approved_by', CASE WHEN {n} % 4 = 0 THEN tenant_id END), 'usage', json_object('tokens', {n} * 100.0, 'cost_usd', {n} / 100.0, 'thinking_tokens', {n} * 1.0, 'agent_step', json_object('iteration', {n} // 10, 'max_iterations', 40, 'tool_depth', 3)),
        'corpus', json_object('source_trust', 'external', 'corpus_trust', CASE WHEN source = 'kb_chunks' THEN 'curated' ELSE 'open' END), 'trace', json_object('reasoning_trace', text, 'trace_scanned', lang = 'en', 'env', 'prod', 'logprobs', source = 'chat_logs'),
        'attachments', json_array(json_object('type', 'image', 'extracted_text', CASE WHEN source <> 'release_notes' THEN text END)))"""
    samples = ", ".join(f"({-1 - i}, {q(t)}, {q(m or '{}')})" for i, (t, m) in enumerate(SAMPLES[name]))
    return f"""(SELECT doc_id, t, {tx.plain_sql('t')} AS p, {tx.tokens_sql(tx.plain_sql('t'))} AS k, m FROM (
        SELECT doc_id, coalesce(text, '') AS t, {meta} AS m FROM documents UNION ALL SELECT CAST(column0 AS BIGINT), column1, CAST(column2 AS JSON) FROM (VALUES {samples}) AS s(column0, column1, column2)))"""


def _hits(*found: tuple[str, str, str]) -> str:
    """A list of {r, w} of the (condition, rule id, severity) that hold, in order."""
    cases = ", ".join(f"CASE WHEN {c} THEN {{'r': {i if i.startswith('(') else q(i)}, 'w': {_W[s]}}} END" for c, i, s in found)
    return f"list_filter([{cases}], lambda h: h IS NOT NULL)"


def _bank(bank, p: str = "p", k: str = "k") -> list[tuple[str, str, str]]:
    out = []
    for r in bank:
        cond = f"regexp_matches({p}, {q(r.pattern)})"
        if r.words:
            cond = f"(list_has_any({k}, {_words(r.words)}) AND {cond})"
        out.append((cond, r.rule_id, r.severity))
    return out


def _verdict(name: str, hits: str, decision: str, risk: str = "least(100, coalesce(list_sum(list_transform(h, lambda x: x.w)), 0))", rows: str | None = None) -> str:
    """decision and risk may use h (the hits) and risk."""
    return f"""
    SELECT doc_id, {decision} AS decision, CAST(risk AS INTEGER) AS risk, array_to_string(list_transform(h, lambda x: x.r), ',') AS rules
    FROM (SELECT *, {risk} AS risk FROM (SELECT *, {hits} AS h FROM {rows or _rows(name)}))"""


def _threshold(limit: int, block: str = "BLOCK") -> str:
    return f"CASE WHEN len(h) = 0 THEN 'ALLOW' WHEN risk >= {limit} THEN '{block}' ELSE 'WARN' END"


def _action(action: str) -> str:
    return f"CASE WHEN len(h) = 0 THEN 'ALLOW' ELSE '{action}' END"


def _most(items: str) -> str:
    """How often the most frequent item of a list occurs."""
    return f"coalesce(list_max(map_values(list_aggregate({items}, 'histogram'))), 0)"


def _sentences(t: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(regexp_replace({t}, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: trim(s, ' ')), lambda s: s <> '')"


def _content(t: str) -> str:
    from guardloom.operators.agentic import _STOP

    return f"list_distinct(list_filter({tx.tokens_sql(t)}, lambda w: length(w) > 1 AND NOT list_contains({_words(_STOP)}, w)))"


def _overlap(a: str, b: str) -> str:
    """Of distinct lists."""
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0.0 END"


def _jsons(path: str) -> str:
    """The JSON array at a path as a list, empty if there is none."""
    return f"coalesce(CAST(json_extract(m, '{path}') AS JSON[]), [])"


def _num(path: str) -> str:
    v = f"TRY_CAST(m->>'{path}' AS DOUBLE)"
    return f"(CASE WHEN json_type(m, '{path}') IN ('VARCHAR', 'OBJECT', 'ARRAY', 'BOOLEAN') OR {v} IS NULL OR {v} < 0 THEN 0.0 ELSE {v} END)"


def _bool(path: str, default: str = "false") -> str:
    return f"coalesce(TRY_CAST(m->>'{path}' AS BOOLEAN), {default})"


def _abuse(name):
    parts = "list_filter(list_transform(regexp_split_to_array(p, '[.!?\\n]+'), lambda s: trim(s, ' ')), lambda s: s <> '')"
    return _verdict(name, _hits(("length(t) > 100000", "abuse.payload", "high"), (f"{_most(parts)} >= 10", "abuse.repetitive", "medium")), _action("BLOCK"), "least(100, 30 * len(h))")


def _secrets(name):
    found = [(f"regexp_matches(t, {q(p)})", f"secrets.{n}", s) for n, s, _, p in rb.SECRETS]
    return _verdict(name, _hits(*found), _action("REDACT"), "CASE WHEN len(h) > 0 THEN 100 ELSE 0 END")


def _gibberish(name):
    dense, letters = "regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')", "regexp_replace(p, '[^a-z]', '', 'g')"
    chars = f"list_aggregate(list_filter(regexp_extract_all({dense}, '(?s).'), lambda c: c <> ''), 'histogram')"
    entropy = f"(log2(length({dense})) - list_sum(list_transform(map_values({chars}), lambda c: c * log2(c))) / length({dense}))"
    vowels = f"length(regexp_replace({letters}, '[^aeiou]', '', 'g'))"
    ratio = f"((length({letters}) - {vowels}) / greatest({vowels}, 1))"
    special = "CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]', '', 'g')) / length(t) ELSE 1.0 END"
    words = "list_filter(regexp_split_to_array(p, '[^\\p{L}]+'), lambda w: w <> '')"
    known = f"len(list_filter({words}, lambda w: list_contains({_words(rb.FREQUENT_WORDS)}, w))) / greatest(len({words}), 1)"
    latin = "length(regexp_replace(t, '[^\\p{Latin}]', '', 'g'))"
    long_ = "list_filter(regexp_split_to_array(lower(t), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 2)"
    hits = _hits(
        (f"regexp_matches(t, {q(tx.INVISIBLE)})", "gibberish.invisible", "high"), (f"length({dense}) > 20 AND {entropy} > 5.5", "gibberish.entropy", "medium"),
        (f"{special} > 0.4", "gibberish.excessive_special_chars", "medium"), (f"{_most(long_)} >= 5", "gibberish.token_stuffing", "medium"),
        (f"length({letters}) > 20 AND ({ratio} > 6 OR ({ratio} > 0 AND {ratio} < 0.3))", "gibberish.incoherent", "medium"),
        (f"{latin} > 30 AND {latin} * 2 > length({dense}) AND NOT regexp_matches(t, '^\\s*[{{\\[]') AND {known} < 0.08", "gibberish.no_recognizable_words", "high"),
    )
    hits = f"CASE WHEN length(t) >= 10 THEN {hits} ELSE [] END"
    return _verdict(name, hits, "CASE WHEN len(h) = 0 THEN 'ALLOW' WHEN len(h) = 1 AND h[1].r = 'gibberish.token_stuffing' THEN 'WARN' ELSE 'BLOCK' END")


def _topics(name):
    excused = " OR ".join(f"regexp_matches(p, {q(x)})" for x in (rb.RESOURCE, rb.INFORMATIONAL, rb.WARNING))
    found = [(f"NOT ({excused}) AND (list_has_any(k, {_words(s.split())}) OR len(list_intersect(list_distinct(k), {_words(b.split())})) >= 2)", f"topic.{t}", "high") for t, (s, b) in rb.TOPICS.items()]
    return _verdict(name, _hits(*found), _threshold(40))


def _bias(name):
    found = []
    for bank in rb.BIAS.values():
        for r in bank:
            got = f"regexp_extract(p, {q(r.pattern)})"
            at = f"(CASE WHEN regexp_matches(p, {q(r.pattern)}) THEN strpos(p, {got}) ELSE 0 END)"
            denied = f"regexp_matches(substring(p, CAST(greatest({at} - 80, 1) AS BIGINT), CAST(least({at} - 1, 80) AS BIGINT)), {q(rb.NEGATION)})"
            # medium ones that are denied drop out; high ones become low, which medium sensitivity leaves out
            found.append((f"list_has_any(k, {_words(r.words)}) AND {at} > 0 AND NOT {denied}", r.rule_id, r.severity))
    return _verdict(name, _hits(*found), _action("WARN"))


def valence_sql(k: str) -> str:
    """Mean valence of a token list, as ``detectors.valence``."""
    good, bad = ([w for w, v in rb.VALENCE.items() if (v > 0) == want] for want in (True, False))
    score = f"(CASE WHEN list_contains({_words(good)}, w) THEN 1.0::DOUBLE WHEN list_contains({_words(bad)}, w) THEN -1.0::DOUBLE END * CASE WHEN i > 1 AND list_has_any({k}[greatest(i - 3, 1):i - 1], {_words(rb.NEGATORS)}) THEN -0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN i > 1 AND list_contains({_words(rb.BOOSTERS)}, {k}[i - 1]) THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)"
    known = f"list_filter(list_transform({k}, lambda w, i: {score}), lambda v: v IS NOT NULL)"
    return f"CASE WHEN len({known}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(-1.0::DOUBLE, list_avg({known}))) END"


def _sentiment(name):
    tones = [(f"list_has_any(k, {_words(v.split())})", f"sentiment.{x}", "medium") for x, v in rb.TONES.items()]
    hits = _hits(*tones, (f"{valence_sql('k')} < -0.3", "sentiment.excessively_negative", "medium"))
    return _verdict(name, f"CASE WHEN length(t) >= 15 THEN {hits} ELSE [] END", _action("WARN"))


def _compliance(name):
    found = []
    for industry, (words, bank, note) in rb.COMPLIANCE.items():
        topic = f"list_has_any(k, {_words(words.split())})"
        found += [(f"{topic} AND {c}", i, s) for c, i, s in _bank(bank)]
        found.append((f"{topic} AND NOT contains(p, {q(note.lower())})", f"compliance.{industry}.disclaimer", "medium"))
    return _verdict(name, _hits(*found, *_bank(rb.COMPLIANCE_GENERAL)), _action("TRANSFORM"))


def _competitor(name):
    found = []
    for c, forms in (("lumadock", "lumadock"), ("norvik_pad", "norvik pad"), ("quelbit", "quelbit|quelbit cloud")):
        around = f"regexp_extract(p, {q(f'([^.!?]{{0,40}})(^|[^a-z0-9])({forms})($|[^a-z0-9])([^.!?]{{0,40}})')})"
        has = f"regexp_matches(p, {q(f'(^|[^a-z0-9])({forms})($|[^a-z0-9])')})"
        kinds = [("low", "(api|sdk|integrat|export|import|plugin)"), ("high", "(worse|bad|terrible|hate|avoid|scam)"), ("medium", "(compare|comparison|versus|vs|better than|alternative)"), ("low", "(partner|partnership|together with)")]
        w = "CASE " + " ".join(f"WHEN regexp_matches({around}, {q(p)}) THEN {_W[s]}" for s, p in kinds) + " ELSE 30 END"
        name_ = c.replace("_", " ")
        nearly = f"len(list_filter(k, lambda x: length(x) >= 3 AND (levenshtein(x, '{name_}') * 2 <= (length(x) + {len(name_)}) * 0.15 OR (length(x) >= 5 AND x[1:5] = '{name_[:5]}')))) > 0"
        found.append(f"CASE WHEN {has} THEN {{'r': 'competitor.{c}', 'w': {w}}} WHEN {nearly} THEN {{'r': 'competitor.{c}', 'w': 30}} END")
    return _verdict(name, f"list_filter([{', '.join(found)}], lambda h: h IS NOT NULL)", _action("TRANSFORM"))


def _jailbreak(name):
    hits = _hits(*_bank(rb.JAILBREAK))
    one = "regexp_matches(p, '^(what is|what does|define|explain the term|who invented) ')"
    game = "regexp_matches(p, '(chess|board game|video game|role-?playing game)')"
    kept = f"CASE WHEN ({one} AND len(g) = 1) OR ({game} AND len(list_filter(g, lambda x: x.w = 50)) = 0) THEN [] ELSE g END"
    return _verdict(name, kept, _threshold(60), rows=f"(SELECT *, {hits} AS g FROM {_rows(name)})")


def _urls(name):
    host = "lower(regexp_extract(u, '(?i)^https?://(?:[^/@]*@)?\\[?([^/:?#\\]]+)', 1))"
    base = f"CASE WHEN len(string_split({host}, '.')) > 2 THEN array_to_string(string_split({host}, '.')[-2:], '.') ELSE {host} END"
    near = "least(" + ", ".join(f"levenshtein({base}, {q(x)})" for x in rb.POPULAR) + ")"
    ip = f"regexp_matches({host}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$')"
    checks = _hits(
        (ip, "url.ip_address", "high"), (f"list_contains({_words(rb.SHORTENERS)}, {base}) OR list_contains({_words(rb.SHORTENERS)}, {host})", "url.shortener", "medium"),
        (f"list_contains({_words(rb.RISKY_TLDS)}, string_split({host}, '.')[-1])", "url.tld", "medium"), (f"NOT {ip} AND len(string_split({host}, '.')) - 2 > 3", "url.subdomains", "medium"),
        (f"regexp_matches({host}, '(^|\\.)xn--')", "url.punycode", "medium"), (f"NOT {ip} AND {near} = 1", "url.typosquat", "high"),
    )
    urls = "regexp_extract_all(t, '(?i)(https?://[^\\s\"''<>)\\]]+)', 1)"
    hits = f"list_concat(flatten(list_transform({urls}, lambda u: {checks})), {_hits(('contains(p, ' + q('data:text/html') + ')', 'url.data_uri', 'high'))})"
    first = "list_filter(g, lambda x, i: list_position(g, x) = i)"
    return _verdict(name, first, _action("REDACT"), rows=f"(SELECT *, {hits} AS g FROM {_rows(name)})")


def _grams(k: str, n: int) -> str:
    return f"list_transform(generate_series(1, len({k}) - {n - 1}), lambda i: array_to_string({k}[i:i + {n - 1}], ' '))"


def _copyright(name):
    found = _hits(*[(f"contains(p, {q(x)})", "copyright.licence", "medium") for x in rb.LICENCES])
    # hits carry the licence in their message, so two licences are two hits
    repeats = f"len({_grams('k', 8)}) - len(list_distinct({_grams('k', 8)})) >= 3"
    lyrics = f"regexp_matches(p, {q(rb.LYRICS)}) AND len({_grams('k', 6)}) > len(list_distinct({_grams('k', 6)}))"
    return _verdict(name, f"list_concat({found}, {_hits((lyrics, 'copyright.lyrics', 'medium'), (repeats, 'copyright.repetition', 'low'))})", _action("WARN"))


def _code(name):
    code = "CASE WHEN length(array_to_string(regexp_extract_all(p, '(?s)```[a-z]*\\n(.*?)```', 1), '\n')) > 0 THEN array_to_string(regexp_extract_all(p, '(?s)```[a-z]*\\n(.*?)```', 1), '\n') ELSE p END"
    bank = [r for b in rb.CODE.values() for r in b]
    return _verdict(name, _hits(*_bank(bank, "c", "ck")), _action("BLOCK"), rows=f"(SELECT *, {tx.tokens_sql('c')} AS ck FROM (SELECT *, {code} AS c FROM {_rows(name)}))")


def _hallucination(name):
    given = f"list_concat(CASE WHEN (m->>'$.source_context') IS NULL THEN [] ELSE [m->>'$.source_context'] END, list_transform({_jsons('$.grounding_sources')}, lambda s: coalesce(s->>'$.text', s->>'$.content', s->>'$.snippet', '')))"
    claims = f"list_filter(list_transform({_sentences('t')}, lambda s: {_content('s')}), lambda c: len(c) >= 3)"
    best = f"list_transform(claims, lambda c: greatest({_overlap('c', 'flatten(bags)')}, coalesce(list_max(list_transform(bags, lambda b: {_overlap('c', 'b')})), 0.0)))"
    rows = f"(SELECT *, {best} AS v FROM (SELECT *, list_transform(given, lambda g: {_content('g')}) AS bags, {claims} AS claims FROM (SELECT *, {given} AS given FROM {_rows(name)})))"
    hits = "CASE WHEN len(given) = 0 THEN [] ELSE list_concat(list_transform(list_filter(v, lambda x: x < 0.3), lambda x: {'r': 'hallucination.ungrounded', 'w': 50}), list_transform(list_filter(v, lambda x: x >= 0.3 AND x < 0.5), lambda x: {'r': 'hallucination.weak', 'w': 30})) END"
    n = "len(list_filter(h, lambda x: x.w = {}))"
    risk = f"least(100, floor(80.0 * {n.format(50)} / greatest(len(v), 1) + 30.0 * {n.format(30)} / greatest(len(v), 1)))"
    return _verdict(name, hits, _action("WARN"), risk, rows=rows)


def _citations(name):
    given, texts = _jsons("$.grounding_sources"), f"array_to_string(list_transform({_jsons('$.grounding_sources')}, lambda s: lower(coalesce(s->>'$.text', s->>'$.content', s->>'$.snippet', ''))), ' ')"
    keep = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
    numbers = keep.format("regexp_extract_all(t, '\\[(\\d{1,3})\\]', 1)")
    urls = keep.format("regexp_extract_all(t, '(https?://[^\\s\"''<>)\\]]+)', 1)")
    bad = f"list_concat(list_filter({numbers}, lambda v: NOT CAST(v AS INTEGER) BETWEEN 1 AND len({given})), list_filter({urls}, lambda v: NOT list_contains(list_transform({given}, lambda s: s->>'$.url'), v)))"
    quotes = "regexp_extract_all(t, '[\"“]([^\"”]{20,})[\"”]', 1)"
    unproven = f"list_filter({quotes}, lambda x: {_overlap('list_distinct(' + tx.tokens_sql('x') + ')', tx.tokens_sql(texts))} < 0.6)"
    hits = f"CASE WHEN len({given}) = 0 THEN [] ELSE list_concat(list_transform({bad}, lambda v: {{'r': 'citation.unsupported', 'w': 50}}), list_transform({unproven}, lambda v: {{'r': 'citation.unverified_quote', 'w': 30}})) END"
    return _verdict(name, hits, _action("WARN"))


def _leak(name):
    pad = lambda b: "".join(f"\\x{x:02X}" for x in (bytes(v ^ b for v in _KEY.encode().ljust(64, b"\0"))))
    mac = f"substring(sha256('{pad(0x5C)}'::BLOB || unhex(sha256('{pad(0x36)}'::BLOB || encode(g)))), 1, 32)"
    digests = lambda k: f"list_transform(list_distinct({_grams(k, 8)}), lambda g: {mac})"
    notes = "(SELECT tenant_id AS nt, arg_min(text, doc_id) AS prompt FROM documents WHERE source = 'policy_notes' AND text IS NOT NULL GROUP BY tenant_id)"
    samples = ", ".join(f"({-1 - i}, {q(t)}, '')" for i, (t, _) in enumerate(SAMPLES[name]))
    rows = f"""(SELECT doc_id, {digests('k')} AS mine, {digests('pk')} AS theirs FROM (SELECT doc_id, {tx.tokens_sql('t')} AS k, {tx.tokens_sql('prompt')} AS pk FROM (
        SELECT doc_id, coalesce(text, '') AS t, coalesce(prompt, '') AS prompt FROM documents LEFT JOIN {notes} ON tenant_id = nt UNION ALL SELECT CAST(column0 AS BIGINT), column1, column2 FROM (VALUES {samples}) AS s(column0, column1, column2))))"""
    return _verdict(name, _hits(("len(list_intersect(mine, theirs)) >= 1", "system_prompt.leak", "high")), _action("BLOCK"), rows=rows)


def _numbers(name):
    num = "(-?\\d+(?:\\.\\d+)?)"
    pattern = q(f"{num} ?([-+*/x]) ?{num} ?= ?{num}")
    part = lambda g: f"regexp_extract_all(t, {pattern}, {g})"
    rows = f"(SELECT *, {part(1)} AS a, {part(2)} AS o, {part(3)} AS b, {part(4)} AS c FROM {_rows(name)})"
    x, y, z = (f"CAST({v}[i] AS DOUBLE)" for v in "abc")
    want = f"CASE o[i] WHEN '+' THEN {x} + {y} WHEN '-' THEN {x} - {y} WHEN '/' THEN CASE WHEN {y} <> 0 THEN {x} / {y} END ELSE {x} * {y} END"
    wrong = f"list_filter(generate_series(1, len(a)), lambda i: NOT coalesce(abs(({want}) - {z}) <= greatest(0.01, abs({want}) * 0.001), true))"
    return _verdict(name, f"list_transform({wrong}, lambda i: {{'r': 'numerical.inconsistent', 'w': 50}})", _threshold(60), rows=rows)


def _embedding(name):
    hidden = f"(length(t) - length(regexp_replace(t, {q(tx.INVISIBLE)}, '', 'g')))"
    hits = _hits(
        (f"len(k) >= 20 AND {_most('k')} / len(k) >= 0.3", "embedding.keyword_stuffing", "medium"), (f"{hidden} >= 20 OR {hidden} / greatest(length(t), 1) >= 0.05", "embedding.hidden_text", "high"),
        ("regexp_matches(t, '\\[\\s*(-?\\d+\\.\\d+\\s*,\\s*){15,}-?\\d+\\.\\d+')", "embedding.raw_vector", "high"), ("regexp_matches(t, '[A-Za-z0-9+/]{512,}')", "embedding.base64", "medium"),
    )
    return _verdict(name, hits, _action("WARN"))


def _tenants(name):
    chunks, own = _jsons("$.retrieval.chunks"), "(m->>'$.tenant_id')"
    foreign = f"list_transform(list_filter({chunks}, lambda c: coalesce((c->>'$.tenant_id') <> {own}, false)), lambda c: {{'r': 'tenant_scope.cross_tenant', 'w': 50}})"
    rest = _hits((f"len(list_filter({chunks}, lambda c: (c->>'$.tenant_id') IS NULL)) > 0", "tenant_scope.untagged", "high"), (f"NOT {_bool('$.scope_enforced_in_query', 'true')}", "tenant_scope.post_filter", "medium"))
    return _verdict(name, f"list_concat({foreign}, {rest})", "CASE WHEN len(h) = 0 THEN 'ALLOW' WHEN h[1].r = 'tenant_scope.cross_tenant' THEN 'BLOCK' ELSE 'WARN' END")


def _jamming(name):
    refusals = ["i cannot answer", "i can't answer", "i am unable to", "no information is available", "i cannot help", "this question cannot be answered", "i must decline", "not allowed to answer"]
    n = " + ".join(f"CASE WHEN contains(p, {q(r)}) THEN 1 ELSE 0 END" for r in refusals)
    chunks = _jsons("$.retrieval.chunks")
    far = f"(len(list_filter({chunks}, lambda c: (c->>'$.score_kind') = 'distance')) > 0)"
    scores = f"list_sort(list_filter(list_transform({chunks}, lambda c: TRY_CAST(c->>'$.score' AS DOUBLE)), lambda s: s IS NOT NULL))"
    rows = f"(SELECT *, CASE WHEN far THEN s[2:] ELSE s[:-2] END AS rest FROM (SELECT *, {far} AS far, {scores} AS s FROM {_rows(name)}))"
    mid = "rest[CAST(floor(len(rest) / 2) AS INTEGER) + 1]"
    hits = _hits(
        (f"{n} >= 2", "retrieval_jamming.refusal", "high"), ("regexp_matches(p, '(do not|don''t|never) (use|cite|read|trust) (the )?other (documents|chunks|sources|results)')", "retrieval_jamming.suppression", "high"),
        (f"len({chunks}) > 0 AND len(k) < 25", "retrieval_jamming.contentless", "medium"), (f"len(s) >= 3 AND CASE WHEN far THEN {mid} / s[1] ELSE s[-1] / {mid} END >= 3", "retrieval_jamming.dominance", "medium"),
    )
    return _verdict(name, hits, _action("WARN"), rows=rows)


_SPACED = "regexp_replace(p, '[_\\-\"{}\\[\\]:,]+', ' ', 'g')"


def _agency(name):
    spaced = f"regexp_replace({_SPACED}, ' +', ' ', 'g')"
    rows = f"(SELECT *, {tx.tokens_sql('sp')} AS sk FROM (SELECT *, {spaced} AS sp FROM {_rows(name)}))"
    both = f"list_concat({_hits(*_bank(rb.AGENCY))}, {_hits(*_bank(rb.AGENCY, 'sp', 'sk'))})"
    first = "list_filter(g, lambda x, i: list_position(g, x) = i)"
    decision = "CASE WHEN risk >= 50 THEN 'BLOCK' WHEN risk >= 30 THEN 'WARN' ELSE 'ALLOW' END"
    return _verdict(name, first, decision, rows=f"(SELECT *, {both} AS g FROM {rows})")


def _approval(name):
    gated = [(c, "approval.missing", "high") for c, _, s in _bank(rb.AGENCY, "sp", "sk") if s == "high"]
    rows = f"(SELECT *, {_hits(*gated)} AS g FROM (SELECT *, {tx.tokens_sql('sp')} AS sk FROM (SELECT *, {_SPACED} AS sp FROM {_rows(name)})))"
    ok = _bool("$.approval.approved")
    hits = f"CASE WHEN len(g) = 0 THEN [] WHEN NOT {ok} THEN g ELSE {_hits((chr(40) + 'coalesce(m->>' + q('$.approval.approved_by') + chr(44) + q('') + ') = ' + q('') + chr(41), 'approval.anonymous', 'medium'))} END"
    return _verdict(name, hits, _action("BLOCK"), rows=rows)


def _consumption(name):
    step = "$.usage.agent_step"
    it, depth, most = (f"TRY_CAST(m->>'{step}.{x}' AS INTEGER)" for x in ("iteration", "tool_depth", "max_iterations"))
    tokens, thinking = _num("$.usage.tokens"), _num("$.usage.thinking_tokens")
    hits = _hits(
        (f"{tokens} > 200000", "consumption.tokens", "high"), (f"{_num('$.usage.cost_usd')} > 10", "consumption.cost", "high"), (f"{it} >= least(50, CASE WHEN {most} > 0 THEN {most} ELSE 50 END)", "consumption.iterations", "high"),
        (f"{depth} > 25", "consumption.depth", "high"), (f"{thinking} > 32000", "consumption.thinking", "high"), (f"{thinking} >= 4000 AND {thinking} / greatest({tokens}, 1.0) > 50", "consumption.thinking_ratio", "high"),
    )
    return _verdict(name, hits, _action("BLOCK"), "least(100, 50 * len(h))")


def _poisoning(name):
    claims = ("official answer", "the only correct answer", "authoritative source", "this document supersedes", "verified by the vendor")
    n = " + ".join(f"CASE WHEN contains(p, {q(c)}) THEN 1 ELSE 0 END" for c in claims)
    parts = "list_filter(list_transform(regexp_split_to_array(replace(p, '?', '?\n'), '[.!\n]+'), lambda s: trim(s, ' ')), lambda s: suffix(s, '?'))"
    low, high = "untrusted public external user unknown low".split(), "trusted curated internal verified high".split()
    trust = lambda path, w: f"list_has_any({tx.tokens_sql('m->>' + q(path))}, {_words(w)})"
    hits = _hits((f"{n} >= 1", "corpus.authority", "high"), (f"{_most(parts)} >= 3", "corpus.question_stuffing", "high"), (f"{trust('$.corpus.source_trust', low)} AND {trust('$.corpus.corpus_trust', high)}", "corpus.trust_boundary", "high"))
    return _verdict(name, hits, _action("WARN"))


def _trace(name):
    long_, gated = "length(m->>'$.trace.reasoning_trace') >= 40", "lower(coalesce(m->>'$.trace.env', '')) IN ('prod', 'production', 'live', '')"
    top, plain = _bool("$.trace.top_logprobs"), _bool("$.trace.logprobs")
    hits = _hits(
        (f"{long_} AND NOT {_bool('$.trace.trace_scanned')}", "trace.unscanned", "high"), (f"{long_} AND {_bool('$.trace.answer_redacted')}", "trace.unredacted", "high"),
        (f"{gated} AND {top}", "trace.logprobs", "high"), (f"{gated} AND NOT {top} AND {plain}", "trace.logprobs", "medium"), (_bool("$.trace.raw_tool_args"), "trace.tool_args", "medium"),
    )
    return _verdict(name, hits, _action("WARN"))


def _attachments(name):
    given = _jsons("$.attachments")
    text = "array_to_string(list_filter([a->>'$.extracted_text', a->>'$.transcript'], lambda x: x IS NOT NULL), ' ')"
    joined = f"array_to_string(list_transform({given}, lambda a: {text}), '\n')"
    dark = f"len(list_filter({given}, lambda a: lower(a->>'$.type') <> 'text' AND trim({text}, ' ') = '')) > 0"
    rows = f"(SELECT *, {tx.tokens_sql('ap')} AS ak FROM (SELECT *, {tx.plain_sql(joined)} AS ap FROM {_rows(name)}))"
    hits = _hits((f"len({_hits(*_bank(rb.INJECTION, 'ap', 'ak'))}) >= 1", "multimodal.injection", "high"), (dark, "multimodal.unextracted", "medium"))
    return _verdict(name, hits, "CASE WHEN len(h) = 0 THEN 'ALLOW' WHEN h[1].r = 'multimodal.injection' THEN 'BLOCK' ELSE 'WARN' END", rows=rows)


def _cache(name):
    c = "$.semantic_cache"
    on, own, theirs = _bool(f"{c}.hit"), "(m->>'$.tenant_id')", f"(m->>'{c}.tenant_id')"
    other = f"list_distinct({tx.tokens_sql(f'm->>' + q(c + '.cached_query'))})"
    jaccard = f"len(list_intersect(list_distinct(k), {other})) / greatest(len(list_distinct(list_concat(k, {other}))), 1)"
    hits = _hits(
        (f"{on} AND coalesce({theirs} <> {own}, false)", "semantic_cache.cross_tenant", "high"), (f"{on} AND NOT {_bool(f'{c}.partitioned')}", "semantic_cache.unpartitioned", "high"),
        (f"{on} AND TRY_CAST(m->>'{c}.similarity' AS DOUBLE) < 0.9", "semantic_cache.similarity", "medium"), (f"{on} AND {jaccard} < 0.3", "semantic_cache.divergence", "high"),
        (f"{on} AND TRY_CAST(m->>'{c}.entry_age_seconds' AS DOUBLE) > 86400", "semantic_cache.stale", "medium"),
    )
    return _verdict(name, hits, "CASE WHEN len(h) = 0 THEN 'ALLOW' WHEN h[1].r = 'semantic_cache.cross_tenant' THEN 'BLOCK' ELSE 'WARN' END")


def _structure(name):
    body = "trim(regexp_replace(t, '(?s)^\\s*```(?:json|xml)?\\s*|\\s*```\\s*$', '', 'g'), ' ')"
    return _verdict(name, _hits((f"NOT json_valid({body})", "structure.invalid", "medium")), _action("BLOCK"))


def _tools(name):
    denied = "run_sql send_mail".split()
    tool, args = "(m->>'$.tool_name')", "CAST(json_extract(m, '$.tool_args.*') AS JSON[])"
    cond = f"coalesce(list_contains({_words(denied)}, {tool}), false) OR ({tool} IS NULL AND ({' OR '.join(f'contains(p, {q(d)})' for d in denied)}))"
    hits = _hits((cond, "tools.denied", "high"), (f"NOT coalesce(list_contains({_words(denied)}, {tool}), false) AND len(list_filter(coalesce({args}, []), lambda a: length(a->>'$') > 10000)) > 0", "tools.argument_length", "high"))
    return _verdict(name, hits, _action("BLOCK"), "40 * len(h)")


def _language(name):
    n = "greatest(length(regexp_replace(t, '[^\\p{L}]', '', 'g')), 1)"
    scripts = {"ja": "\\p{Hiragana}\\p{Katakana}", "zh": "\\p{Han}", "ru": "\\p{Cyrillic}", "ar": "\\p{Arabic}", "el": "\\p{Greek}", "he": "\\p{Hebrew}", "hi": "\\p{Devanagari}", "ko": "\\p{Hangul}"}
    share = {k: f"(length(regexp_replace(t, '[^{v}]', '', 'g')) / {n})" for k, v in scripts.items()}
    script = "CASE " + " ".join(f"WHEN {s} > 0.3 THEN '{k}'" for k, s in share.items()) + " END"
    letters = "regexp_replace(p, '[^a-zà-ÿ]+', ' ', 'g')"
    tri = f"list_distinct(list_transform(generate_series(1, length({letters}) - 2), lambda i: substring({letters}, i, 3)))"
    cut = lambda v: [v[i : i + 3] for i in range(0, len(v), 4)]
    scored = "[" + ", ".join(f"{{'s': len(list_intersect(tri, {_words(cut(v))})), 'l': '{k}'}}" for k, v in TRIGRAMS.items()) + "]"
    rows = f"(SELECT *, list_sort({scored})[-1] AS b FROM (SELECT *, {script} AS script, {tri} AS tri FROM {_rows(name)}))"
    sure = f"CASE WHEN script IS NOT NULL THEN least(1.0, greatest({', '.join(share.values())}) + 0.2) ELSE least(1.0, b.s / 6.0) END"
    lang = f"CASE WHEN {sure} >= 0.5 THEN coalesce(script, b.l) ELSE 'unknown' END"
    mixed = " + ".join(f"CASE WHEN {s} > 0.2 THEN 1 ELSE 0 END" for s in [*share.values(), f"(length(regexp_replace(t, '[^\\p{{Latin}}]', '', 'g')) / {n})"])
    hits = _hits((f"({lang}) NOT IN ('en', 'unknown')", "language.not_allowed", "high"), (f"{mixed} > 1", "language.mixed", "medium"))
    return _verdict(name, f"CASE WHEN length(t) >= 20 THEN {hits} ELSE [] END", _action("WARN"), "least(100, coalesce(list_sum(list_transform(h, lambda x: CASE WHEN x.w = 50 THEN 60 ELSE 20 END)), 0))", rows=rows)


def _toxicity(name):
    c = "regexp_extract_all({0}, '(?s).')"
    single = lambda i: f"regexp_matches(coalesce(c[{i}], ''), '^[a-z]$')"
    outside = lambda i: f"NOT regexp_matches(coalesce(c[{i}], ''), '^[a-z0-9]$')"
    # blanks and dots between letters that stand alone, then letters beyond the first of three or more
    gap = f"list_contains([' ', '.', '-', '_'], x) AND i > 1 AND {single('i - 1')} AND (i = 2 OR {outside('i - 2')}) AND {single('i + 1')} AND {outside('i + 2')}"
    again = "regexp_matches(x, '^[a-z]$') AND i > 1 AND c[i - 1] = x AND ((i > 2 AND c[i - 2] = x) OR coalesce(c[i + 1] = x, false))"
    rows = f"(SELECT *, {c.format('p')} AS c FROM {_rows(name)})"
    rows = f"(SELECT * EXCLUDE (c), {c.format('u')} AS c FROM (SELECT *, translate(array_to_string(list_filter(c, lambda x, i: NOT coalesce({gap}, false)), ''), {q(tx.LEET[0])}, {q(tx.LEET[1])}) AS u FROM {rows}))"
    rows = f"(SELECT *, {tx.tokens_sql('b')} AS bk FROM (SELECT *, array_to_string(list_filter(c, lambda x, i: NOT coalesce({again}, false)), '') AS b FROM {rows}))"
    found = []
    for cat, (sev, _, terms) in rb.TOXIC.items():
        conds = [f"list_has_any({k}, {_words(terms.split())})" for k in ("k", "bk") if terms]
        if cat in rb.TOXIC_PHRASES:
            conds.append(f"regexp_matches(p, {q(rb.TOXIC_PHRASES[cat])})")
        if conds:
            found.append((f"({' OR '.join(conds)})", f"toxicity.{cat}", sev))
    forced = f"len(list_filter({{0}}, lambda x: list_contains({_words(f'toxicity.{c}' for c, (_, f, _) in rb.TOXIC.items() if f)}, x.r))) > 0"
    rows = f"(SELECT *, {_hits(*found)} AS g FROM {rows})"
    hits = f"CASE WHEN len(g) > 0 AND NOT {forced.format('g')} AND regexp_matches(p, {q(rb.SAFE_QUERY)}) THEN [] ELSE g END"
    total = "least(100, coalesce(list_sum(list_transform(h, lambda x: x.w)), 0))"
    return _verdict(name, hits, _threshold(40), f"CASE WHEN {forced.format('h')} THEN greatest(90, {total}) ELSE {total} END", rows=rows)


def _control(name):
    control = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1a\\x1c-\\x1f\\x7f]"
    ansi, osc = "\\x1b\\[[0-9;?]*[A-Za-z]", "\\x1b\\][^\\x07\\x1b]*(\\x07|\\x1b\\\\)"
    rest = "regexp_replace(t, '\\x1b\\[[0-9;]*m', '', 'g')"
    count = lambda p: f"len(regexp_extract_all(t, {q(p)}))"
    osc_any, osc_52 = r"\x1b\]", r"\x1b\]52;"
    hits = _hits(
        (f"{count(osc_52)} > 0", "output_control_char.osc52", "high"), (f"{count(osc_any)} > {count(osc_52)}", "output_control_char.osc", "high"),
        ("regexp_matches(t, '\\x1b\\[[0-9;]*[HJKABCDsu]|\\r[^\\n]|\\r$')", "output_control_char.screen", "high"), (f"regexp_matches({rest}, '{ansi}')", "output_control_char.ansi", "medium"),
        (f"regexp_matches(regexp_replace({rest}, '{ansi}|{osc}', '', 'g'), '{control}')", "output_control_char.control", "medium"),
    )
    return _verdict(name, hits, _action("REDACT"))


_BANKS = {
    "exfiltration": (rb.EXFILTRATION, _threshold(40)),
    "document_metadata_leakage": (rb.METADATA, _threshold(60)),
    "retrieval_chunk_injection": (rb.INJECTION + rb.ACTION_LURES, _action("WARN")),
    "tool_output_injection": (rb.INJECTION + rb.ACTION_LURES + rb.EXFILTRATION, _action("WARN")),
    "memory_write_poisoning": (rb.INJECTION + rb.FUTURE, _threshold(50)),
    "sensitive_business_data": (rb.SENSITIVE, _threshold(60, "REDACT")),
}
_OTHERS = {
    "abuse": _abuse, "secrets": _secrets, "gibberish": _gibberish, "topic_restriction": _topics, "bias": _bias, "sentiment": _sentiment, "compliance": _compliance, "competitor": _competitor, "jailbreak": _jailbreak,
    "malicious_url": _urls, "copyright": _copyright, "code_safety": _code, "hallucination": _hallucination, "citation_integrity": _citations, "system_prompt_leakage": _leak, "numerical_consistency": _numbers,
    "embedding_integrity": _embedding, "tenant_scope_assertion": _tenants, "retrieval_jamming": _jamming, "excessive_agency": _agency, "human_approval_gate": _approval, "unbounded_consumption": _consumption,
    "corpus_poisoning_monitor": _poisoning, "reasoning_trace_disclosure": _trace, "multimodal_injection": _attachments, "semantic_cache_integrity": _cache, "structure": _structure, "toxicity": _toxicity, "output_control_char_sanitizer": _control, "tools": _tools, "language": _language,
}


def detector(name: str) -> str | None:
    """The SQL of one detector's query, or None."""
    if name in _BANKS:
        bank, decision = _BANKS[name]
        return _verdict(name, _hits(*_bank(bank)), decision)
    return _OTHERS[name](name) if name in _OTHERS else None


#: Detectors of the fact table that is compared; none of them rewrites the text of others.
FACTS = ("abuse", "gibberish", "topic_restriction", "bias", "jailbreak", "copyright", "unbounded_consumption", "corpus_poisoning_monitor", "semantic_cache_integrity", "tenant_scope_assertion")


def facts() -> str:
    """Decisions by detector and stage: each detector's SQL, where its stages hold."""
    from guardloom.plans.pipeline import PIPELINE, STAGES

    parts = []
    for name in FACTS:
        stages = ", ".join(map(q, PIPELINE[name][0] or STAGES))
        parts.append(f"SELECT '{name}' AS detector, stage, decision, risk, CASE WHEN rules = '' THEN 0 ELSE len(string_split(rules, ',')) END AS n FROM ({detector(name)}) r JOIN documents d USING (doc_id) WHERE stage IN ({stages})")
    return f"SELECT detector, stage, decision, CAST(count(*) AS BIGINT) AS n, CAST(max(risk) AS INTEGER) AS max_risk, CAST(sum(n) AS BIGINT) AS n_hits FROM ({' UNION ALL '.join(parts)}) GROUP BY detector, stage, decision"
