"""The quality scores as DuckDB SQL."""

from __future__ import annotations

from guardloom import sql_guard as g
from guardloom import sql_nested
from guardloom.functions import text as tx
from guardloom.operators import quality


def _mean(items: str) -> str:
    return f"coalesce(list_avg({items}), 0.0)"


def _ratio(a: str, b: str) -> str:
    """Share of the distinct items of a list that another has; 0 for none."""
    return g._overlap(f"list_distinct({a})", b)


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b})) / {union} ELSE 0.0 END"


def scores() -> str:
    """All scores of each trace's output against the input text of its first stage."""
    nodes = sql_nested._nodes()
    base = f"""
    SELECT trace_no, coalesce(q, '') AS q, coalesce(final_output, '') AS a FROM round_trip_traces LEFT JOIN (SELECT trace_no, {sql_nested._text('o', 'input_text')} AS q FROM stages WHERE i = 0) USING (trace_no)"""
    lists = f"""
    SELECT *, {tx.tokens_sql('q')} AS qk, {tx.tokens_sql('a')} AS ak, {g._content('q')} AS qc, {g._sentences('a')} AS s FROM ({base})"""
    more = f"""
    SELECT *, list_transform(list_filter(s, lambda x: length(x) > 10), lambda x: {g._content('x')}) AS claims, list_filter(s, lambda x: length(x) > 5) AS cs,
      list_transform(s, lambda x: CAST(len({tx.tokens_sql('x')}) AS DOUBLE)) AS lens,
      list_transform(list_filter(regexp_extract_all(q, '[ \t\n\x0b\f\r]([A-Z][a-z]+[\\p{{L}}\\p{{N}}_]*)', 1), lambda x: regexp_matches(x, '^[A-Z][a-z]+$')), lambda x: lower(x)) AS names FROM ({lists})"""
    bags = f"SELECT *, list_transform(cs, lambda x: {g._content('x')}) AS bags FROM ({more})"
    grounded = f"CASE WHEN len(qc) = 0 OR len(claims) = 0 THEN 1.0 ELSE {_mean(f'list_transform(claims, lambda c: CASE WHEN {g._overlap(chr(99), chr(113) + chr(99))} >= 0.3 THEN 1.0 ELSE 0.0 END)')} END"
    count = lambda bag: f"len(list_filter({bag}, lambda v: v = w))"
    dot = lambda x, y: f"list_sum(list_transform(list_distinct({x}), lambda w: CAST({count(x)} * {count(y)} AS DOUBLE)))"
    cosine = f"{dot('qk', 'ak')} / (sqrt({dot('qk', 'qk')}) * sqrt({dot('ak', 'ak')}))"
    entity = f"CASE WHEN len(names) > 0 THEN {_ratio('names', 'ak')} ELSE 1.0 END"
    relevance = f"CASE WHEN len(qk) = 0 OR len(ak) = 0 THEN 0.5 ELSE least(1.0, 0.5 * {cosine} + 0.25 * {entity} + 0.25 * {g._overlap('qc', 'ak')}) END"
    marked = _mean(f"list_transform(cs, lambda x: CASE WHEN list_has_any({tx.tokens_sql('x')}, {g._words(quality._MARKERS)}) THEN 1.0 ELSE 0.0 END)")
    shared = _mean(f"list_transform(generate_series(1, len(bags) - 1), lambda i: {_jaccard('bags[i]', 'bags[i + 1]')})")
    unique = "len(list_distinct(list_transform(cs, lambda x: lower(x)))) / len(cs)"
    coherence = f"CASE WHEN len(cs) <= 1 THEN 0.8 ELSE 0.3 * least(1.0, {marked} * 2) + 0.4 * least(1.0, {shared} * 3) + 0.3 * {unique} END"
    mean, good = _mean("lens"), _mean("list_transform(lens, lambda v: CASE WHEN v BETWEEN 3 AND 80 THEN 1.0 ELSE 0.0 END)")
    var = f"list_sum(list_transform(lens, lambda v: (v - m) * (v - m))) / greatest(len(lens) - 1, 1)"
    cv = f"CASE WHEN m > 0 THEN sqrt({var}) / m ELSE 0.0 END"
    length = f"least(1.0, {good} + CASE WHEN {cv} BETWEEN 0.2 AND 0.8 THEN 0.1 ELSE 0.0 END)"
    whole = _mean("list_transform(s, lambda v: CASE WHEN regexp_matches(v, '^[\\p{Lu}\\d\"''(]') AND regexp_matches(v, '[.!?][\"'')]?$') THEN 1.0 ELSE 0.0 END)")
    signs = "CASE WHEN regexp_matches(a, '[.!?]') THEN 1.0 ELSE 0.3 END - CASE WHEN regexp_matches(a, '[!?.,]{4,}') THEN 0.3 ELSE 0.0 END"
    variety = "CASE WHEN len(ak) > 0 THEN least(1.0, 1.5 * len(list_distinct(ak)) / len(ak)) ELSE 0.0 END"
    fluency = f"CASE WHEN len(s) = 0 THEN 0.0 ELSE 0.3 * {length} + 0.3 * {whole} + 0.2 * ({signs}) + 0.2 * {variety} END"
    form = "CASE " + " ".join(f"WHEN regexp_matches(lower(q), {g.q(asks)}) THEN CASE WHEN regexp_matches(a, {g.q(shows)}) THEN 1.0 ELSE 0.3 END" for asks, shows in quality._INTENTS) + " ELSE 0.5 END"
    intent = f"0.6 * {form} + 0.4 * {g._overlap('qc', 'ak')}"
    adherence = "(CASE WHEN len(ak) <= 60 THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(a), 'password') THEN 0.0 ELSE 1.0 END) / 2"
    out = {"groundedness": grounded, "relevance": relevance, "coherence": coherence, "fluency": fluency, "intent_resolution": intent, "task_adherence": adherence}
    return f"{nodes} SELECT trace_no, {', '.join(f'round(CAST({v} AS DOUBLE), 4) AS {k}' for k, v in out.items())} FROM (SELECT *, {mean} AS m FROM ({bags}))"
