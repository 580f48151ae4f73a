"""The tables of the nested trace records as DuckDB SQL, with the shapes that older clients write."""

from __future__ import annotations


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def _field(o: str, name: str) -> str:
    """A field in either spelling, as JSON."""
    return f"coalesce({o}->'$.{name}', {o}->'$.{_camel(name)}')"


def _text(o: str, name: str) -> str:
    return f"coalesce({o}->>'$.{name}', {o}->>'$.{_camel(name)}')"


def _read(x: str) -> str:
    """JSON that was stored as a string inside JSON is read on."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' THEN TRY_CAST({x}->>'$' AS JSON) ELSE {x} END"


def _members(x: str) -> str:
    return f"list_transform(json_keys({x}), lambda k: json_extract({x}, '$.\"' || k || '\"'))"


def _list(x: str, label: str = "", mapping: bool = False) -> str:
    """{o, n}: the objects of a list, a single object, an object keyed by ``label`` or a mapping; n is the key."""
    one = f"[{{'o': {x}, 'n': NULL::VARCHAR}}]"
    keyed = f"list_transform(json_keys({x}), lambda k: {{'o': json_extract({x}, '$.\"' || k || '\"'), 'n': k}})"
    if mapping:
        single = keyed
    elif label:
        single = f"CASE WHEN {_field(x, label)} IS NULL AND len(list_filter({_members(x)}, lambda v: json_type(v) NOT IN ('OBJECT', 'NULL'))) = 0 THEN {keyed} ELSE {one} END"
    else:
        single = one
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN list_transform(CAST({x} AS JSON[]), lambda v: {{'o': v, 'n': NULL::VARCHAR}}) WHEN 'OBJECT' THEN CASE WHEN len(json_keys({x})) = 0 THEN [] ELSE {single} END ELSE [] END"


def _nodes() -> str:
    """CTEs by schema path: trace_no, o (the object), id and parent (Dewey labels as text), i (ordinal), name."""
    pad = "CASE WHEN i > 99999 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 5, '0') END"

    def level(name: str, source: str, items: str, label: str = "") -> str:
        own = f"coalesce({_text('o', label)}, n)" if label else "''"
        return f"""{name} AS (SELECT trace_no, o, i, parent, CASE WHEN parent = '' THEN '' ELSE parent || '.' END || {pad} AS id, {own} AS name, up, n FROM (
            SELECT trace_no, parent, up, CAST(k - 1 AS INTEGER) AS i, items[k].o AS o, items[k].n AS n FROM (SELECT *, unnest(generate_series(1, len(items))) AS k FROM (SELECT trace_no, parent, up, {items} AS items FROM ({source})))) WHERE o IS NOT NULL AND json_type(o) <> 'NULL')"""

    def below(parent: str, name: str, field: str, label: str = "", mapping: bool = False) -> str:
        source = f"SELECT trace_no, id AS parent, name AS up, {_field('o', field)} AS x FROM {parent}"
        return level(name, source, _list("x", label, mapping), label if not mapping else "")

    root = f"SELECT trace_no, '' AS parent, '' AS up, CASE WHEN json_type(x) = 'OBJECT' AND (x->'$.stages') IS NOT NULL THEN x->'$.stages' ELSE x END AS x FROM (SELECT trace_no, {_read('x')} AS x FROM (SELECT trace_no, TRY_CAST(stages AS JSON) AS x FROM round_trip_traces))"
    parts = [
        level("stages", root, _list("x", "kind"), "kind"),
        below("stages", "stage_hits", "rule_hits"),
        below("stages", "errors", "llm_error"),
        below("stages", "detectors", "detector_results", "detector_name"),
        below("detectors", "detector_hits", "rule_hits"),
        below("detectors", "layers", "layer_results"),
        below("layers", "scores", "label_scores", "label", True),
    ]
    return "WITH " + ",\n".join(parts)


#: Names of the CTEs by schema path.
_CTE = {
    "stages": "stages", "stages.rule_hits": "stage_hits", "stages.llm_error": "errors", "stages.detector_results": "detectors", "stages.detector_results.rule_hits": "detector_hits",
    "stages.detector_results.layer_results": "layers", "stages.detector_results.layer_results.label_scores": "scores",
}


def table(path: str, fields: dict[str, str]) -> str:
    """One row per node of a schema path: ids, ordinal and typed fields."""
    sql_type = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER"}
    cols = []
    for f, t in fields.items():
        v = _text("o", f)
        if path.endswith("label_scores"):
            v = "n" if f == "label" else "o->>'$'"
        elif f == "detector_name":
            v = "name"
        cols.append(f"TRY_CAST({v} AS {sql_type.get(t, t.upper())}) AS {f}")
    return f"{_nodes()} SELECT trace_no, id AS node_id, parent AS parent_id, i AS ordinal, {', '.join(cols)} FROM {_CTE[path]}"


def found() -> str:
    part = lambda cte, kind, name: f"SELECT trace_no, CAST(string_split(id, '.')[1] AS INTEGER) AS stage_no, {name} AS detector_name, '{kind}' AS item_kind, i AS item_no FROM {cte}"
    up = "coalesce(up, '')"
    return f"{_nodes()} SELECT DISTINCT * FROM ({part('stage_hits', 'rule_hit', chr(39) * 2)} UNION ALL {part('detector_hits', 'detector_hit', up)} UNION ALL {part('layers', 'layer', up)})"
