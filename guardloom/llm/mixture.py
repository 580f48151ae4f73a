"""Mixing sources to target shares of tokens by entropy balancing.

Each document gets a rate r = min(cap, exp(l * n / m)): of all rates that give
its source the wanted tokens they are the closest to one copy each, in relative
entropy. The multipliers l solve a convex dual that falls apart by source: its
Newton iterations run in the tasks, on each source's counts of documents by
length. Rates are then rounded to whole copies by systematic sampling, which
keeps the totals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardloom.operators.joins import small
from guardloom.session import materialize

#: Newton steps at most; a step that leaves its bracket is replaced by a bisection.
STEPS = 60
#: Relative error of a source's tokens at which its multiplier is good enough.
CLOSE = 1e-6
#: Documents of a source that are rounded together, about.
ROUNDED_TOGETHER = 2_000


def lengths(docs: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    """source, n_tokens, n_docs: all that the dual needs of the documents.

    Documents without tokens or without a source cannot carry a share.
    """
    t = docs.select(F.col(source_col).alias("source"), F.col(tokens_col).cast("bigint").alias("n_tokens")).filter("source is not null and n_tokens > 0")
    return t.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def wanted(hist: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """source, have, docs, mean, cap, want: the sources that can carry a share, with the tokens wanted of each.

    Shares are those among the targeted sources that have tokens and a cap. By
    default the total is the largest at which every such source can hold its
    share within its cap; for a given total, sources that are too small give
    all they can and the others keep their tokens. Two numbers reach the driver.
    """
    facts = hist.groupBy("source").agg(F.sum(F.col("n_docs") * F.col("n_tokens")).alias("have"), F.sum("n_docs").alias("docs"))
    t = targets.select("source", F.col("target_share").cast("double").alias("p"), F.greatest(F.lit(0), F.coalesce(F.col("max_repeats"), F.lit(1))).cast("double").alias("cap"))
    able = facts.join(t.filter("source is not null and p > 0 and cap > 0"), "source").filter("have > 0")
    mass = able.agg(F.sum("p").alias("m"), F.min(F.col("have") * F.col("cap") / F.col("p")).alias("most")).first()
    m = mass.m or 1.0
    size = (mass.most or 0.0) * m if total is None else float(total)
    want = F.least(F.lit(size) * F.col("p") / F.lit(m), F.col("have") * F.col("cap"))
    return able.select("source", "have", "docs", (F.col("have") / F.col("docs")).alias("mean"), "cap", want.alias("want"))


def solve(n: np.ndarray, docs: np.ndarray, mean: float, cap: float, want: float) -> float:
    """The multiplier of one source: sum of docs * n * min(cap, exp(l * n / mean)) = want.

    The sum rises with l, so a bracket is kept, and a Newton step that leaves
    it is replaced by a bisection. A source that must give all it has gets one
    at which every rate is the cap.
    """
    tokens = n * docs
    if want >= tokens.sum() * cap * (1 - 1e-12):
        return 60.0 * mean / max(1.0, n.min())
    low, high, now = -60.0 * mean / n.min(), 60.0 * mean / n.min(), 0.0
    for _ in range(STEPS):
        rate = np.exp(np.minimum(now * n / mean, 50.0))
        gap = float((tokens * np.minimum(rate, cap)).sum()) - want
        if abs(gap) <= CLOSE * want:
            break
        low, high = (low, now) if gap > 0 else (now, high)
        slope = float((tokens * n / mean * rate)[rate < cap].sum())
        step = now - gap / slope if slope else math.inf
        now = step if low < step < high else (low + high) / 2
    return now


def multipliers(hist: DataFrame, wants: DataFrame) -> DataFrame:
    """source, multiplier (per token), cap, groups: what a document's rate is worked out from.

    A source's counts by length meet in one task; they are as many as there are
    lengths, not documents.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        order = np.argsort(part["n_tokens"].to_numpy())
        l = solve(part["n_tokens"].to_numpy(float)[order], part["n_docs"].to_numpy(float)[order], float(one["mean"]), float(one["cap"]), float(one["want"]))
        return pd.DataFrame({"source": [key[0]], "multiplier": [l / float(one["mean"])], "cap": [float(one["cap"])], "groups": [max(1, int(one["docs"]) // ROUNDED_TOGETHER)]})

    both = hist.join(small(wants), "source")
    return both.groupBy("source").applyInPandas(run, "source string, multiplier double, cap double, groups bigint")


def mix(docs: DataFrame, id_col: str, source_col: str, tokens_col: str, targets: DataFrame, total: float | None = None) -> DataFrame:
    """id, source, n_tokens, rate, copies of every document that is used at least once.

    copies is the rate rounded down or up and so never above the source's cap.
    Sources without a target, documents without tokens and null sources are not
    used. What is known of the sources is joined to the documents, broadcast
    only if it is small. Copies of a source are rounded in groups of about
    ROUNDED_TOGETHER by hash, sorted by length, so no source is ever sorted in
    one task.
    """
    thin = docs.select(F.col(id_col), F.col(source_col).alias("source"), F.col(tokens_col).cast("bigint").alias("n_tokens"))
    hist = materialize(lengths(thin, "source", "n_tokens"))
    known = materialize(multipliers(hist, wanted(hist, targets, total)))
    used = thin.filter("source is not null and n_tokens > 0").join(small(known), "source")
    used = used.withColumn("rate", F.least(F.exp(F.least(F.col("multiplier") * F.col("n_tokens"), F.lit(50.0))), F.col("cap")))
    used = used.withColumn("__g", F.pmod(F.xxhash64(F.lit("mix"), id_col), F.col("groups")))
    order = Window.partitionBy("source", "__g").orderBy("n_tokens", id_col)
    upto = F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.pmod(F.xxhash64(F.lit("start"), "source", "__g"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    used = used.withColumn("__u", upto + start)
    copies = (F.floor(F.col("__u") + F.lit(1e-9)) - F.floor(F.col("__u") - F.col("rate") + F.lit(1e-9))).cast("bigint")
    copies = F.least(copies, F.col("cap").cast("bigint"))
    return used.withColumn("copies", copies).filter("copies > 0").select(id_col, "source", "n_tokens", "rate", "copies")


def shares(mixed: DataFrame, targets: DataFrame, docs: DataFrame, source_col: str, tokens_col: str) -> DataFrame:
    """What was reached, one row per source of either table.

    target_share is as given; aimed_share is that among the sources that have
    tokens; actual_share is that of the mixture (null while it is empty).
    """
    have = docs.select(F.col(source_col).alias("source"), F.col(tokens_col).alias("t")).filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("t").alias("n_tokens"))
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"))
    all_ = targets.select("source", "target_share", "max_repeats").join(have, "source", "full").join(got, "source", "left")
    usable = F.when((F.coalesce("n_tokens", F.lit(0)) > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0), F.col("target_share"))
    one = Window.partitionBy(F.lit(1))  # one row per source
    return all_.select(
        "source", "target_share", (usable / F.sum(usable).over(one)).alias("aimed_share"), "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("docs_used", F.lit(0)).alias("docs_used"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        (F.coalesce("tokens_used", F.lit(0)) / F.sum("tokens_used").over(one)).alias("actual_share"),
    )
