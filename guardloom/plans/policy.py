"""Policies: layered trees, bundles of scopes, versions, lint. Small, so resolved on the driver."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from guardloom.plans.pipeline import ALIASES, PIPELINE, STAGES

_LEVELS = ("apps", "agents", "envs", "tenants")


def merged(base: dict, over: dict) -> dict:
    """Maps merge into maps; any other value replaces. The structural keys are left out."""
    out = {k: v for k, v in base.items() if k not in _LEVELS}
    for k, v in over.items():
        if k in _LEVELS:
            continue
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def resolve(tree: dict, tenant: str = "", app: str = "", agent: str = "default", env: str = "prod") -> dict:
    """default, then the tenant's, its app's, its agent's, its env's settings."""
    out, at = merged({}, tree.get("default") or {}), tree
    for level, name in (("tenants", tenant), ("apps", app), ("agents", agent), ("envs", env)):
        at = (at.get(level) or {}).get(name) or {}
        if not at:
            break
        out = merged(out, at)
    return out


def shaped(tree: object, scope: str = "") -> dict:
    """A flat policy from any shape it is written in.

    A dotted ``scope`` picks a part first. Of a layered tree it is the default;
    a ``detectors`` list of (name, enabled, config) becomes a map, enabled unless
    said otherwise; a flat policy is itself. Anything else is an error.
    """
    at = tree
    for part in filter(None, scope.split(".")):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(f"no {part} in {scope}")
        at = at[part]
    if not isinstance(at, dict):
        raise TypeError("a policy is a map")
    if isinstance(at.get("default"), dict):
        return at["default"]
    listed = at.get("detectors")
    if isinstance(listed, list):
        return {d["name"]: {"enabled": d.get("enabled", True)} | (d.get("config") or {}) for d in listed if isinstance(d, dict) and d.get("name")}
    return at


def version(policy: dict) -> str:
    """First 16 hex digits of the sha256 of the sorted compact JSON."""
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def read_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def read_bundle(path: str) -> dict:
    """A bundle with ``scope_policies``; a plain policy becomes the one of every scope."""
    b = json.loads(Path(path).read_text())
    return b if "scope_policies" in b else {"scope_policies": {"*:*:*:*": b}}


def save_bundle(bundle: dict, path: str) -> None:
    """Written beside and moved into place; the file before stays as .bak."""
    p = Path(path)
    new = p.with_suffix(p.suffix + ".new")
    new.write_text(json.dumps(bundle, sort_keys=True, indent=1))
    if p.exists():
        p.replace(p.with_suffix(p.suffix + ".bak"))
    new.replace(p)


def scope_table(spark: SparkSession, bundle: dict) -> DataFrame:
    """scope_key, policy (JSON), policy_version of a bundle."""
    rows = [(k, json.dumps(v, sort_keys=True), version(v)) for k, v in sorted(bundle["scope_policies"].items())]
    return spark.createDataFrame(rows, "scope_key string, policy string, policy_version string")


def lint(policy: dict) -> list[str]:
    """Remote layers where no call may leave, and layers without a backend."""
    out = []
    closed = bool(policy.get("no_external_calls"))
    for name, cfg in policy.items():
        if not isinstance(cfg, dict):
            continue
        for mode in (cfg.get("strategy") or {}).get("order", []):
            if closed and mode.startswith("remote"):
                out.append(f"{name}: {mode} with no_external_calls")
            if mode != "local_deterministic" and mode not in (cfg.get("backends") or {}):
                out.append(f"{name}: {mode} has no backend")
    return out


def validate(policy: dict) -> tuple[list[str], list[str]]:
    """(blockers, warnings): wrong types and stages; keys that mean nothing here."""
    wrong, odd = [], []
    for name, cfg in policy.items():
        if name not in PIPELINE and name not in ALIASES and name not in ("no_external_calls", "on_fail"):
            odd.append(f"unknown key {name}")
        if name in PIPELINE:
            if not isinstance(cfg, dict):
                wrong.append(f"{name} is no map")
                continue
            if not isinstance(cfg.get("enabled", False), bool):
                wrong.append(f"{name}.enabled is no boolean")
            wrong += [f"{name}: unknown stage {s}" for s in cfg.get("stages") or [] if s not in STAGES]
    return wrong, odd
