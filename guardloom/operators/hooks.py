"""Checks of declarations before anything runs: server manifests and tool permissions.

Manifests are small and nested without a schema, so they are walked in an
Arrow batch; depth and size are bounded as the walk is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.operators import rulebooks as rb
from guardloom.operators.layering import legacy_ipv4

_WEIGHT = {"low": 10, "medium": 30, "high": 50}
_RESULT = "struct<decision:string,risk:int,rules:array<string>>"
_PERMISSION_KEYS = ("permissions", "scopes", "scope", "capabilities", "access", "grants")
_DANGEROUS = re.compile(r"(^|[^a-z])(\*|all|admin|root|sudo|write_all|full_access|shell|exec|filesystem:write)($|[^a-z])", re.I)
_PRIVATE = re.compile(r"^(127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|0\.)")
_HOST = re.compile(r"https?://(?:[^/@\s]*@)?\[?([^/:\s\]]+)", re.I)


def _strings(x) -> Iterator[tuple[str, str]]:
    """(path, text) of every string of a document, however large or deep, in its order."""
    todo = [("", x)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}.{k}".lower(), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(path, v) for v in reversed(x)]
        elif isinstance(x, str):
            yield path, x


_INJECTION = [(re.compile(r.pattern), r) for r in rb.INJECTION + rb.EXFILTRATION]


def scan_manifest(text: str | None) -> list[tuple[str, str]]:
    """(rule, severity) of a server manifest: injected descriptions, dangerous rights, inner hosts."""
    try:
        x = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return [("mcp.unreadable", "low")]
    out: dict[str, str] = {}
    for path, s in _strings(x):
        low = s.lower()
        for p, r in _INJECTION:
            if p.search(low):
                out[f"mcp.{r.rule_id}"] = r.severity
        if any(f".{k}" in path for k in _PERMISSION_KEYS) and _DANGEROUS.search(s):
            out["mcp.permission"] = "high"
        for m in _HOST.finditer(s):
            host = m[1].lower()
            address = legacy_ipv4(host) or host
            if host in ("localhost", "metadata.google.internal") or _PRIVATE.match(address) or host == "::1":
                out["mcp.inner_host"] = "high"
            elif legacy_ipv4(host) and not re.fullmatch(r"\d+(\.\d+){3}", host):
                out["mcp.obscured_host"] = "high"
    return sorted(out.items())


_OPEN = re.compile(r"(any|arbitrary|all) (command|code|query|sql|url|file|path)s?", re.I)
_DESTROY = re.compile(r"(delete|drop|remove|destroy|truncate|purge)", re.I)
_READ = re.compile(r"(read|get|list|search|fetch|view)", re.I)


def _declarations(x) -> list[dict]:
    """Bare, listed, under ``tools`` or wrapped as ``{type, function}``."""
    if isinstance(x, dict) and isinstance(x.get("tools"), list):
        x = x["tools"]
    items = x if isinstance(x, list) else [x]
    return [i["function"] if isinstance(i.get("function"), dict) else i for i in items if isinstance(i, dict)]


def audit_tools(text: str | None) -> list[tuple[str, str]]:
    """(rule, severity): open-ended tools, destruction beside reading, admin scopes, free parameters."""
    try:
        x = json.loads(text) if text else None
    except ValueError:
        return [("tool_audit.unreadable", "low")]
    out: dict[str, str] = {}
    for t in _declarations(x):
        said = f"{t.get('name', '')} {t.get('description', '')}".replace("_", " ")
        if _OPEN.search(said):
            out["tool_audit.open_ended"] = "high"
        if _DESTROY.search(said) and _READ.search(said):
            out["tool_audit.bundled_destruction"] = "high"
        for k in _PERMISSION_KEYS:
            if k in t and _DANGEROUS.search(json.dumps(t[k])):
                out["tool_audit.scope"] = "high"
        props = (t.get("parameters") or t.get("inputSchema") or {}).get("properties") or {} if isinstance(t.get("parameters") or t.get("inputSchema") or {}, dict) else {}
        for p in props.values():
            if isinstance(p, dict) and p.get("type") == "string" and not {"enum", "pattern", "maxLength", "format", "const"} & set(p):
                out["tool_audit.free_parameter"] = "medium"
    return sorted(out.items())


def _check(find, action: str, threshold: int):
    @F.pandas_udf(_RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                hits = find(t)
                risk = min(100, sum(_WEIGHT[x] for _, x in hits))
                rows.append(("ALLOW" if not hits else action if risk >= threshold else "WARN", risk, [r for r, _ in hits]))
            yield pd.DataFrame({"decision": pd.Series([r[0] for r in rows], dtype=object), "risk": pd.Series([r[1] for r in rows], dtype="int32"), "rules": pd.Series([r[2] for r in rows], dtype=object)})

    return run


def manifest_verdict(col: Column | str, action: str = "WARN", threshold: int = 50) -> Column:
    return _check(scan_manifest, action, threshold)(col)


def tool_audit_verdict(col: Column | str, action: str = "WARN") -> Column:
    return _check(audit_tools, action, 0)(col)


# --- JSON schema --------------------------------------------------------------------

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _typed(x, kind: str) -> bool:
    if kind == "integer":
        return isinstance(x, int) and not isinstance(x, bool)
    if kind == "number":
        return isinstance(x, (int, float)) and not isinstance(x, bool)
    return isinstance(x, _TYPES.get(kind, object))


def schema_errors(x, schema: dict, path: str = "$") -> list[tuple[str, str]]:
    """(path, message) where a value breaks a JSON schema (the common part of draft 7)."""
    out: list[tuple[str, str]] = []
    kinds = schema.get("type")
    if kinds and not any(_typed(x, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return [(path, f"is no {kinds}")]
    if "enum" in schema and x not in schema["enum"]:
        out.append((path, "is not one of the given values"))
    if "const" in schema and x != schema["const"]:
        out.append((path, "is not the given value"))
    if isinstance(x, dict):
        props = schema.get("properties", {})
        out += [(f"{path}.{k}", "is missing") for k in schema.get("required", []) if k not in x]
        for k, v in x.items():
            if k in props:
                out += schema_errors(v, props[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append((f"{path}.{k}", "is not allowed"))
    if isinstance(x, list):
        if isinstance(schema.get("items"), dict):
            for i, v in enumerate(x):
                out += schema_errors(v, schema["items"], f"{path}[{i}]")
        out += [(path, "has too few items")] * (len(x) < schema.get("minItems", 0)) + [(path, "has too many items")] * (len(x) > schema.get("maxItems", len(x)))
    if isinstance(x, str):
        if len(x) < schema.get("minLength", 0) or len(x) > schema.get("maxLength", len(x)):
            out.append((path, "has a wrong length"))
        if "pattern" in schema and not re.search(schema["pattern"], x):
            out.append((path, "does not match"))
    if _typed(x, "number"):
        if x < schema.get("minimum", x) or x > schema.get("maximum", x):
            out.append((path, "is out of range"))
    for s in schema.get("allOf", []):
        out += schema_errors(x, s, path)
    if "anyOf" in schema and all(schema_errors(x, s, path) for s in schema["anyOf"]):
        out.append((path, "fits none of anyOf"))
    if "oneOf" in schema and sum(not schema_errors(x, s, path) for s in schema["oneOf"]) != 1:
        out.append((path, "does not fit one of oneOf"))
    if "not" in schema and not schema_errors(x, schema["not"], path):
        out.append((path, "fits what it must not"))
    if "if" in schema:
        branch = "else" if schema_errors(x, schema["if"], path) else "then"
        out += schema_errors(x, schema.get(branch, {}), path)
    return out


def field_errors(df: DataFrame, id_col: str, json_col: str, schema: dict) -> DataFrame:
    """id, path, message of every schema error; unreadable JSON gives one at ``$``; null gives none."""
    @F.pandas_udf("array<struct<path string, message string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                try:
                    found = schema_errors(json.loads(t), schema) if t is not None else []
                except ValueError:
                    found = [("$", "is no JSON")]
                out.append([{"path": p, "message": m} for p, m in found])
            yield pd.Series(out, dtype=object)

    return df.select(F.col(id_col), F.explode(run(F.col(json_col))).alias("__e")).select(id_col, "__e.path", "__e.message")
