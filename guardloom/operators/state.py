"""Keyed, event-time state: rates, floods, budgets, repeats, breakers.

Each operator is a fold over one key's events in order, written once: a
``step(state, event) -> (state, output)`` function. ``fold`` runs it over a
table and ``guardloom.streaming.stateful`` over a stream. What a window can
say exactly is a window instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[object, dict], tuple[object, object]]


def fold(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str], step: Step, start, out: str, out_type: str) -> DataFrame:
    """key, order and cols with ``out``: the fold's output at each event.

    Events of a key must be in order, so they are sorted by the shuffle and
    streamed through their task: a key's events are never held at once, and
    only the state is kept, however hot the key is. ``order`` must be total.
    """
    keep = list(dict.fromkeys([*key, *order, *cols]))
    rows = df.select(*keep).repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` {out_type}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for b in batches:
            found = []
            for event in b.to_dict("records"):
                k = tuple(None if pd.isna(event[c]) else event[c] for c in key)
                if k != last:
                    last, state = k, start()
                state, y = step(state, event)
                found.append(y)
            b[out] = found
            yield b

    return rows.mapInPandas(run, schema)


def token_bucket(per_minute: int, time: str = "t") -> tuple[Step, Callable]:
    """Allowed or not: a bucket of ``per_minute`` tokens that refills evenly; ``time`` in seconds."""

    def step(s, e):
        now = float(e[time])
        tokens, last = s or (float(per_minute), now)
        tokens = round(min(float(per_minute), tokens + max(0.0, now - last) * per_minute / 60.0), 6)
        ok = tokens >= 1
        return (tokens - 1 if ok else tokens, now), ok

    return step, lambda: None


def sliding_limit(limit: int, seconds: float = 60.0, time: str = "t") -> tuple[Step, Callable]:
    """Allowed or not: at most ``limit`` allowed events within the span before; denied ones do not count."""

    def step(s, e):
        now = float(e[time])
        kept = [x for x in s if x > now - seconds]
        ok = len(kept) < limit
        return ([*kept, now] if ok else kept), ok

    return step, list


def prompt_flood(seconds: float = 60.0, times: int = 3, remembered: int = 10, time: str = "t", digest: str = "digest") -> tuple[Step, Callable]:
    """Whether an equal prompt came ``times`` times before, among the last ten within the span."""

    def step(s, e):
        now = float(e[time])
        s = [x for x in s if now - x[0] <= seconds]
        n = sum(x[1] == e[digest] for x in s)
        return [*s, (now, e[digest])][-remembered:], n >= times

    return step, list


def anchored_budget(limit: float, seconds: float = 3600.0, time: str = "t", amount: str = "amount") -> tuple[Step, Callable]:
    """Whether a sum exceeds its limit; it starts anew once its first event is older than the span."""

    def step(s, e):
        now, v = float(e[time]), e[amount]
        v = float(v) if v is not None and v == v and v >= 0 and v != float("inf") else 0.0
        first, total = s or (now, 0.0)
        if now - first > seconds:
            first, total = now, 0.0
        return (first, total + v), total + v > limit

    return step, lambda: None


def state_repeats(times: int = 3, remembered: int = 64, digest: str = "digest") -> tuple[Step, Callable]:
    """Whether an agent's state came up ``times`` times; the 64 latest states are remembered."""

    def step(s, e):
        d = e[digest]
        n = s.pop(d, 0) + 1
        s[d] = n
        if len(s) > remembered:
            s.pop(next(iter(s)))
        return s, n >= times

    return step, dict


def circuit_breaker(failures: int = 5, cooldown: float = 30.0, time: str = "t", ok: str = "ok") -> tuple[Step, Callable]:
    """closed, open or half_open before each call; opens after so many failures in a row."""

    def step(s, e):
        n, since = s
        now = float(e[time])
        name = "closed" if since is None else "half_open" if now - since >= cooldown else "open"
        if name == "open":
            return (n, since), name
        if e[ok]:
            return (0, None), name
        n += 1
        return (n, now if name == "half_open" or n >= failures else None), name

    return step, lambda: (0, None)


# --- what windows say exactly -------------------------------------------------------


def fixed_window_allowed(df: DataFrame, key: Sequence[str], time: str, order: str, limit: int, seconds: int = 60) -> DataFrame:
    """``df`` with ``allowed``: the first ``limit`` events of each key and fixed span."""
    span = F.floor(F.col(time).cast("timestamp").cast("double") / seconds).alias("span")
    w = Window.partitionBy(*key, "span").orderBy(time, order)
    return df.withColumn("span", span).withColumn("allowed", F.row_number().over(w) <= limit).drop("span")


def escalation(df: DataFrame, key: Sequence[str], order: Sequence[str], risk: str) -> DataFrame:
    """``df`` with ``escalated``: 15 more for each suspicious one (risk > 0) of the five before, 100 at most.

    Only whether a stored risk is above 0 matters, and raising it does not
    change that, so a plain window is exact.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-5, -1)
    prior = F.coalesce(F.sum((F.col(risk) > 0).cast("int")).over(w), F.lit(0))
    return df.withColumn("escalated", F.when(F.col(risk) > 0, F.least(F.lit(100), F.col(risk) + 15 * prior)).otherwise(F.col(risk)))


def seconds_of(c: Column) -> Column:
    return c.cast("timestamp").cast("double")
