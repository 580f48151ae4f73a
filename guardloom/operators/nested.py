"""Flat, linked tables from deeply nested records, by Dewey labels.

Every node of a record gets the list of ordinals on its path from the root
(its Dewey label). A parent's label is its child's label without the last
ordinal, and its schema path the child's without the last name, so links need
no generated keys; the nodes of one schema path form one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entity:
    """A repeated part of a record that becomes a table of its own.

    name: the key (in snake case) below the parent. label: the field by which
    children name this parent; where the source keys an object by that field
    instead of holding a list, the key fills it. scalar: the field that a bare
    value stands for. mapping: an object of names and values, one row for each
    (label and scalar hold them).
    """

    name: str
    label: str = ""
    scalar: str = "value"
    mapping: bool = False
    children: tuple["Entity", ...] = field(default=())


_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_snake_of: dict[str, str] = {}


def snake(key: str) -> str:
    """``ruleHits`` and ``Rule-Hits`` to ``rule_hits``."""
    got = _snake_of.get(key)
    if got is None:
        got = _HUMP.sub("_", key.strip()).replace("-", "_").replace(" ", "_").lower()
        if len(_snake_of) < 10_000:
            _snake_of[key] = got
    return got


def _decoded(x):
    """A JSON document that was stored as a string inside JSON is read on."""
    while isinstance(x, str):
        s = x.strip()
        if not s or s[0] not in "[{\"":
            return x
        try:
            y = json.loads(s)
        except ValueError:
            return x
        if y == x:
            return x
        x = y
    return x


def _items(entity: Entity, x) -> list:
    """The (ordinal, object) pairs of an entity, whatever shape it was written in."""
    x = _decoded(x)
    if x is None or x == "":
        return []
    if isinstance(x, dict) and entity.mapping:
        return [(i, {entity.label: k, entity.scalar: v}) for i, (k, v) in enumerate(x.items()) if v is not None]
    if isinstance(x, dict):
        keys = {snake(k) for k in x}
        if entity.name in keys:  # {"stages": [...]} around the list
            return _items(entity, next(v for k, v in x.items() if snake(k) == entity.name))
        if entity.label and entity.label not in keys and x and all(v is None or isinstance(v, dict) for v in x.values()):
            return [(i, {entity.label: k, **v}) for i, (k, v) in enumerate(x.items()) if v is not None]
        return [(0, x)] if x else []
    if not isinstance(x, list):
        return [(0, {entity.scalar: x})]
    out = []
    for i, v in enumerate(x):
        v = _decoded(v)
        if v is not None:
            out.append((i, v if isinstance(v, dict) else {entity.scalar: v}))
    return out


def _walk(entity: Entity, x, dewey: tuple[int, ...], path: str, nodes: list, labels: dict) -> None:
    """Appends (label, schema path, fields) of every node, and notes the names of those that have one."""
    below = {c.name: c for c in entity.children}
    for i, obj in _items(entity, x):
        here = (*dewey, i)
        fields, later = {}, []
        for k, v in obj.items():
            k = snake(k)
            if k in below:
                later.append((below[k], v))
            elif v is not None:
                fields[k] = v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        nodes.append((here, path, fields))
        if entity.label in fields:
            labels[path, here] = fields[entity.label]
        for child, v in later:
            _walk(child, v, here, f"{path}.{child.name}", nodes, labels)


def dewey_nodes(df: DataFrame, key: str, json_col: str, root: Entity) -> DataFrame:
    """All entity nodes of the JSON in ``json_col``, in one pass without a shuffle.

    Columns: key, dewey ARRAY<INT>, schema_path, parent_label, fields
    MAP<STRING,STRING>. Records that are null, blank or no JSON give no row;
    null elements keep their ordinal and give no row; fields that are null are
    absent. Other columns of ``df`` are not carried, so none can clash.
    """
    key_type = df.schema[key].dataType.simpleString()
    out = f"`{key}` {key_type}, dewey array<int>, schema_path string, parent_label string, fields map<string,string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, deweys, paths, labels, maps = [], [], [], [], []
            ks = b.column(0).to_pylist()

            for key_, text in zip(ks, b.column(1).to_pylist()):
                x = _decoded(text)
                if not isinstance(x, (list, dict)):
                    continue
                nodes, names = [], {}
                _walk(root, x, (), root.name, nodes, names)
                for d, p, f in nodes:
                    keys.append(key_)
                    deweys.append(d)
                    paths.append(p)
                    # the parent is what the label and the path are without their last part
                    labels.append(names.get((p.rpartition(".")[0], d[:-1]), ""))
                    maps.append(list(f.items()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, b.schema.field(0).type),
                    pa.array(deweys, pa.list_(pa.int32())),
                    pa.array(paths, pa.string()),
                    pa.array(labels, pa.string()),
                    pa.array(maps, pa.map_(pa.string(), pa.string())),
                ],
                names=[key, "dewey", "schema_path", "parent_label", "fields"],
            )

    rows = df.select(F.col(key), F.col(json_col)).filter(F.col(json_col).isNotNull())
    return rows.mapInArrow(run, out)


def first_field(col: Column | str, root: Entity, name: str) -> Column:
    """The field ``name`` (snake case) of the first root item, in any shape that dewey_nodes reads."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(text):
            x = _decoded(text)
            first = next((v for i, v in _items(root, x) if i == 0), {}) if isinstance(x, (list, dict)) else {}
            v = next((v for k, v in first.items() if snake(k) == name and v is not None), None)
            return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

        return pd.Series([one(t) for t in s], dtype=object)

    return run(col)


def dewey_text(col: Column | str) -> Column:
    """A label as text, ``00002.00000``; sortable up to 99999, longer ordinals are whole."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(c, lambda i: F.when(i > 99_999, i.cast("string")).otherwise(F.lpad(i.cast("string"), 5, "0"))), ".")


def parent_of(dewey: Column | str) -> Column:
    """The parent's label: the label cut by its last ordinal."""
    c = F.col(dewey) if isinstance(dewey, str) else dewey
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def node_table(nodes: DataFrame, key: str, schema_path: str, fields: dict[str, str]) -> DataFrame:
    """The nodes of one schema path as a table; ``fields`` gives names and SQL types.

    ``node_id`` and ``parent_id`` are the labels as text ('' at the root); a
    value that cannot be cast is null.
    """
    n = nodes.filter(F.col("schema_path") == schema_path)
    cols = [F.col("fields").getItem(f).try_cast(t).alias(f) for f, t in fields.items()]
    return n.select(key, dewey_text("dewey").alias("node_id"), dewey_text(parent_of("dewey")).alias("parent_id"), (F.element_at("dewey", -1)).alias("ordinal"), *cols)


def array_table(df: DataFrame, key: str, array_col: str) -> DataFrame:
    """Elements of an ARRAY<STRUCT> column as rows: key, ordinal from 0, the fields.

    Null and empty arrays give no row, null elements keep their ordinal and
    give no row. The key and ``ordinal`` win over fields of the same name.
    """
    element = df.schema[array_col].dataType.elementType
    x = df.select(F.col(key).alias("__key"), F.posexplode(array_col).alias("__pos", "__item")).filter("__item is not null")
    cols = [F.col("__item").getField(f.name).alias(f.name) for f in element.fields if f.name not in (key, "ordinal")]
    return x.select(F.col("__key").alias(key), F.col("__pos").alias("ordinal"), *cols)


# --- the round-trip trace records -------------------------------------------------

_RULE_HITS = Entity("rule_hits", scalar="rule_id")
STAGES = Entity(
    "stages",
    label="kind",
    children=(
        _RULE_HITS,
        Entity("detector_results", label="detector_name", scalar="detector_name", children=(_RULE_HITS, Entity("layer_results", scalar="execution_mode", children=(Entity("label_scores", label="label", scalar="score", mapping=True),)))),
        Entity("llm_error", scalar="message"),
    ),
)

#: Columns of the tables, by schema path: all fields that the records hold.
TRACE_TABLES = {
    "stages": {"kind": "string", "started_at": "double", "latency_ms": "bigint", "skipped": "boolean", "blocked": "boolean", "decision": "string", "risk_score": "int", "llm_provider": "string", "llm_model": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint", "input_text": "string", "user_message": "string"},
    "stages.llm_error": {"kind": "string", "message": "string", "status_code": "int"},
    "stages.rule_hits": {"rule_id": "string", "severity": "string", "message": "string"},
    "stages.detector_results": {"detector_name": "string", "decision": "string", "risk_score": "int", "latency_ms": "bigint", "transformed": "boolean"},
    "stages.detector_results.rule_hits": {"rule_id": "string", "severity": "string", "message": "string"},
    "stages.detector_results.layer_results": {"execution_mode": "string", "selected": "boolean", "normalized_score": "double", "latency_ms": "int", "cost_usd": "double"},
    "stages.detector_results.layer_results.label_scores": {"label": "string", "score": "double"},
}


def innermost_children(nodes: DataFrame, key: str) -> DataFrame:
    """Rule hits, detector hits and layers: key, stage_no, detector_name, item_kind, item_no.

    A detector that a stage lists twice gives equal rows once.
    """
    kind = (
        F.when(F.col("schema_path") == "stages.rule_hits", "rule_hit")
        .when(F.col("schema_path") == "stages.detector_results.rule_hits", "detector_hit")
        .when(F.col("schema_path") == "stages.detector_results.layer_results", "layer")
    )
    name = F.when(F.col("schema_path") == "stages.rule_hits", "").otherwise(F.coalesce("parent_label", F.lit("")))
    x = nodes.select(key, F.element_at("dewey", 1).alias("stage_no"), name.alias("detector_name"), kind.alias("item_kind"), F.element_at("dewey", -1).alias("item_no")).filter("item_kind is not null")
    return x.dropDuplicates([key, "stage_no", "detector_name", "item_kind", "item_no"])
