"""Detectors that users add: a registry, rules given as patterns, and how their results join the others."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from guardloom.operators.detectors import Text
from guardloom.operators.hits import hit, hits_of, let, result

Plugin = Callable[[Text, dict], Column]


def usable(pattern: str) -> bool:
    """Whether a pattern is one that the engine can run."""
    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # noqa: BLE001 - whatever is wrong with it
        logging.getLogger(__name__).warning("pattern left out: %s", pattern)
        return False
    return True


def regex_rules(t: Text, cfg: dict) -> Column:
    """Rules of a policy (id, pattern, severity, score, message): each at most one hit, the risk is the largest score.

    Case does not matter. A pattern that cannot be compiled is left out. With a
    hit the action (WARN by default) is the decision.
    """
    rules = [r for r in cfg.get("rules", []) if r.get("pattern") and usable(r["pattern"])]
    found = [F.when(t.raw.rlike(f"(?i){r['pattern']}"), F.struct(hit(r.get("id", f"regex_{r['pattern'][:20]}"), r.get("severity", "medium"), r.get("message", "A configured pattern")).alias("h"), F.lit(int(r.get("score", 50))).alias("s"))) for r in rules]

    def of(x: Column) -> Column:
        risk = F.coalesce(F.array_max(F.transform(x, lambda v: v["s"])), F.lit(0))
        return result("regex", F.when(F.size(x) > 0, cfg.get("action", "WARN")).otherwise("ALLOW"), risk, F.transform(x, lambda v: v["h"]))

    if not found:
        return result("regex", F.lit("ALLOW"), F.lit(0), hits_of())
    return let(F.filter(F.array(*found), lambda v: v.isNotNull()), of)


class Plugins:
    """Named plugins. The built-in one cannot be taken away."""

    BUILT_IN = {"regex": regex_rules}

    def __init__(self) -> None:
        self._own: dict[str, Plugin] = {}

    def register(self, name: str, run: Plugin) -> None:
        if not callable(run):
            raise TypeError(f"plugin {name} cannot be called")
        self._own[name] = run

    def unregister(self, name: str) -> bool:
        return name not in self.BUILT_IN and self._own.pop(name, None) is not None

    def names(self) -> list[str]:
        return [*self.BUILT_IN, *self._own]

    def get(self, name: str) -> Plugin | None:
        return {**self.BUILT_IN, **self._own}.get(name)

    def result(self, name: str, t: Text, cfg: dict) -> Column:
        """The plugin's result; one that is unknown, fails to build or builds no column allows."""
        none = result(name, F.lit("ALLOW"), F.lit(0), hits_of())
        run = self.get(name)
        try:
            got = run(t, cfg) if run else none
        except Exception:  # noqa: BLE001 - a plugin must not take the others down
            logging.getLogger(__name__).exception("plugin %s", name)
            return none
        if not isinstance(got, Column):
            return none
        return let(got, lambda r: F.coalesce(result(name, F.coalesce(r["decision"], F.lit("ALLOW")), F.coalesce(r["risk"], F.lit(0)), r["hits"], r["sanitized"]), none))


def until_block(results: list[Column]) -> Column:
    """The results in order up to the first BLOCK, without those that say nothing (ALLOW, no hit)."""

    def step(acc: Column, r: Column) -> Column:
        says = (r["decision"] != "ALLOW") | (F.size(r["hits"]) > 0)
        return F.struct(F.when(~acc["stop"] & says, F.concat(acc["kept"], F.array(r))).otherwise(acc["kept"]).alias("kept"), (acc["stop"] | (r["decision"] == "BLOCK")).alias("stop"))

    all_ = F.array(*results)
    start = F.struct(F.slice(all_, 1, 0).alias("kept"), F.lit(False).alias("stop"))
    return F.aggregate(all_, start, step, lambda acc: acc["kept"])
