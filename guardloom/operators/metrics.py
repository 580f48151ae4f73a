"""Certification metrics as relational aggregation: no collect, no per-row Python.

Undefined values are null. Scores are doubles in [0, 1] unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardloom.operators.joins import small


def confusion(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """expected, actual, n."""
    return df.groupBy(F.col(expected).alias("expected"), F.col(actual).alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4))


def classification(df: DataFrame, expected: str, actual: str, groups: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1, fp_rate, n. Everything but ALLOW is positive; ERROR, NONE and null are never a positive prediction."""
    e = F.col(expected).isNotNull() & (F.col(expected) != "ALLOW")
    a = F.col(actual).isNotNull() & ~F.col(actual).isin("ALLOW", "ERROR", "NONE")
    c = df.groupBy(*groups).agg(
        F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn"), F.count_if(~e & ~a).alias("tn"), F.count(F.lit(1)).alias("n")
    )
    c = c.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when((p > 0) & (r > 0), F.round(2 * p * r / (p + r), 4))
    return c.select(*groups, "n", "precision", "recall", f1.alias("f1"), _ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fp_rate"))


def _by_score(df: DataFrame, label: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: what rank statistics need, counted before any sort."""
    x = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return x.groupBy(*groups, F.col(score).alias("s")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))


def auroc(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with ties counted half; null where one class is absent.

    Windows run over distinct scores, not over rows, so ties never pile up.
    """
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    below = F.sum("neg").over(w.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    x = _by_score(df, label, score, groups).withColumn("wins", F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2))
    t = x.groupBy(*groups).agg(F.sum("wins").alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return t.select(*groups, F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("wins") / (F.col("p") * F.col("n")), 4)).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str, order: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mean precision at each positive, by score descending, ties by ``order``.

    Rows are ranked within their score; what precedes a score comes from counts
    of distinct scores, so only rows of one score meet in a task.
    """
    x = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*groups, F.col(label).alias("y"), F.col(score).alias("s"), F.col(order).alias("o"))
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    per = x.groupBy(*groups, "s").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("int")).alias("p"))
    above = w.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("n0", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("p0", F.coalesce(F.sum("p").over(above), F.lit(0)))
    own = Window.partitionBy(*groups, "s").orderBy("o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = x.withColumn("k", F.count(F.lit(1)).over(own)).withColumn("tp", F.sum(F.col("y").cast("int")).over(own)).filter("y")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*groups, "s")]
    y = ranked.alias("a").join(per.alias("b"), same).select(*[F.col(f"a.{c}").alias(c) for c in groups], ((F.col("tp") + F.col("p0")) / (F.col("k") + F.col("n0"))).alias("v"))
    got = y.groupBy(*groups).agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("c"))
    every = x.groupBy(*groups).agg(F.count(F.lit(1)).alias("all"))
    if not groups:
        return every.select(F.lit(1).alias("j")).join(got.withColumn("j", F.lit(1)), "j", "left").select(F.when(F.col("c") > 0, F.round(F.col("v") / F.col("c"), 4)).alias("pr_auc"))
    joined = every.alias("a").join(got.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in groups], "left")
    return joined.select(*[F.col(f"a.{c}").alias(c) for c in groups], F.when(F.col("c") > 0, F.round(F.col("v") / F.col("c"), 4)).alias("pr_auc"))


def _bins(df: DataFrame, label: str, prob: str, groups: Sequence[str], bins: int) -> DataFrame:
    p = F.col(prob)
    x = df.filter(p.isNotNull() & F.col(label).isNotNull())
    conf, right = F.greatest(p, 1 - p), (p >= 0.5) == F.col(label)
    b = F.greatest(F.lit(0), F.ceil(conf * bins).cast("int") - 1)  # (lo, hi]; the first bin has 0 as well
    return x.groupBy(*groups, b.alias("bin")).agg(F.avg(conf).alias("confidence"), F.avg(right.cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def calibration_error(df: DataFrame, label: str, prob: str, groups: Sequence[str] = (), bins: int = 10) -> DataFrame:
    b = _bins(df, label, prob, groups, bins)
    t = b.groupBy(*groups).agg(F.sum(F.abs(F.col("confidence") - F.col("accuracy")) * F.col("n")).alias("e"), F.sum("n").alias("n"))
    return t.select(*groups, F.when(F.col("n") > 0, F.round(F.col("e") / F.col("n"), 4)).alias("ece"))


def reliability(df: DataFrame, label: str, prob: str, bins: int = 10) -> DataFrame:
    """bin, confidence, accuracy, n; empty bins are kept."""
    own = _bins(df, label, prob, (), bins)
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(F.broadcast(own), "bin", "left").select("bin", F.round("confidence", 4).alias("confidence"), F.round("accuracy", 4).alias("accuracy"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, score: str, bins: int = 10, top: float = 100.0) -> DataFrame:
    """bin, n over equal widths of [0, top]; outliers go to the ends, empty bins are kept."""
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col(score) / (top / bins)))).cast("int")
    own = df.filter(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_ = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_.join(F.broadcast(own), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def stability_index(expected: DataFrame, actual: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Population stability index of two samples' histograms; null if one is empty."""
    e, a = histogram(expected, score, bins).withColumnRenamed("n", "e"), histogram(actual, score, bins).withColumnRenamed("n", "a")
    eps = 1e-6
    w = Window.partitionBy(F.lit(1))  # one row per bin
    x = e.join(a, "bin").select(F.col("e") / F.sum("e").over(w) + eps, F.col("a") / F.sum("a").over(w) + eps).toDF("p", "q")
    return x.agg(F.round(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))), 4).alias("psi"))


def latency_percentiles(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Exact p50, p95, p99 with linear interpolation, to one digit; 0.0 for no values."""
    pick = lambda p: F.coalesce(F.round(F.percentile(F.col(value), F.lit(p)), 1), F.lit(0.0))
    return df.groupBy(*groups).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"), F.count(value).alias("n"))


# --- votes and gates ----------------------------------------------------------------


def consensus(votes: DataFrame, key: Sequence[str], decision: str, risk: str, weight: str | None = None) -> DataFrame:
    """Decision of most weight; ties go to the more severe; risk is the weighted mean, agreement the winner's share.

    Without weights, or where they add up to 0, every vote counts 1. Votes
    with an unknown decision are left out.
    """
    from guardloom.operators.hits import rank

    v = votes.filter(rank(F.col(decision)) > 0)
    r = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(risk).cast("double")))
    w = F.greatest(F.lit(0.0), F.coalesce(F.col(weight), F.lit(0.0))) if weight else F.lit(1.0)
    per = v.groupBy(*key, F.col(decision).alias("d")).agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.sum(w * r).alias("wr"), F.sum(r).alias("r"))
    t = per.groupBy(*key).agg(
        F.max_by("d", F.struct("w", rank(F.col("d")))).alias("dw"), F.max_by("d", F.struct("n", rank(F.col("d")))).alias("dn"),
        F.max("w").alias("mw"), F.max("n").alias("mn"), F.sum("w").alias("sw"), F.sum("n").alias("sn"), F.sum("wr").alias("wr"), F.sum("r").alias("sr"),
    )
    by_w = F.col("sw") > 0
    return t.select(
        *key,
        F.when(by_w, F.col("dw")).otherwise(F.col("dn")).alias("decision"),
        F.round(F.when(by_w, F.col("wr") / F.col("sw")).otherwise(F.col("sr") / F.col("sn")), 2).alias("risk"),
        F.round(F.when(by_w, F.col("mw") / F.col("sw")).otherwise(F.col("mn") / F.col("sn")), 4).alias("agreement"),
    )


#: Limits of the two tiers, and of categories for enforcement.
GATES = {
    "advisory": {"f1": 0.60, "auroc": 0.70, "ece": 0.15, "fp_rate": 0.15, "p95_ms": 1500.0, "samples": 50, "age_days": 365},
    "enforcement": {"f1": 0.80, "auroc": 0.85, "ece": 0.10, "fp_rate": 0.05, "p95_ms": 1000.0, "samples": 100, "age_days": 180},
}
GATE_OVERRIDES = {
    "healthcare": {"f1": 0.88, "auroc": 0.92, "fp_rate": 0.02, "ece": 0.07},
    "legal": {"f1": 0.85, "auroc": 0.90, "fp_rate": 0.03, "ece": 0.08},
    "finance": {"f1": 0.85, "auroc": 0.90, "fp_rate": 0.03, "ece": 0.08},
}


def language_counts(df: DataFrame, language: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, per_language MAP<STRING,BIGINT>, least: samples of each language (null is 'en'), and the fewest of any."""
    x = df.groupBy(*groups, F.coalesce(F.col(language), F.lit("en")).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return x.groupBy(*groups).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l", "n")))).alias("per_language"), F.min("n").alias("least"))  # one entry a language


def gate(cards: DataFrame, tier: str, category: str | None = None) -> DataFrame:
    """Scorecards (f1, auroc, ece, fp_rate, p95_ms, samples, age_days) with passed and failures.

    A missing, NaN or infinite value fails; an age must lie in [-1, limit] days.
    """
    limits = {**GATES[tier], **(GATE_OVERRIDES.get(category, {}) if tier == "enforcement" else {})}

    def bad(name: str) -> Column:
        v = F.col(name).cast("double")
        wrong = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        if name in ("f1", "auroc", "samples"):
            return wrong | (v < limits[name])
        if name == "age_days":
            return wrong | (v < -1) | (v > limits[name])
        return wrong | (v > limits[name])

    failures = F.filter(F.array(*[F.when(bad(k), F.lit(k)) for k in limits]), lambda x: x.isNotNull())
    return cards.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def gated_decision(decision: Column, model_backed: Column, enforcement_passed: Column) -> Column:
    """A model's BLOCK or REDACT only warns until its scorecard passed; rules are unaffected."""
    held = model_backed & decision.isin("BLOCK", "REDACT") & ~F.coalesce(enforcement_passed, F.lit(False))
    return F.when(held, "WARN").otherwise(decision)


#: Weights of quality metrics; unknown ones weigh 0.1.
QUALITY_WEIGHTS = {"groundedness": 0.3, "relevance": 0.25, "coherence": 0.15, "fluency": 0.1, "intent_resolution": 0.1, "task_adherence": 0.05, "tool_call_accuracy": 0.05}


def quality_mean(scores: DataFrame, key: Sequence[str], metric: str, score: str) -> DataFrame:
    """Weighted mean of the metrics that have a score, to three digits."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in QUALITY_WEIGHTS.items() for x in kv])[F.col(metric)], F.lit(0.1))
    x = scores.filter(F.col(score).isNotNull())
    return x.groupBy(*key).agg(F.round(F.sum(F.col(score) * w) / F.sum(w), 3).alias("quality"))


#: Upper bounds in seconds of the exported latency buckets.
BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def exported_histogram(df: DataFrame, labels: Sequence[str], seconds: Column, most: int = 500) -> DataFrame:
    """labels, le, n: cumulative buckets; label sets beyond the ``most`` frequent ones become 'other'."""
    keyed = df.withColumn("__s", seconds).filter("__s is not null")
    sets = keyed.groupBy(*labels).agg(F.count(F.lit(1)).alias("__n"))
    top = sets.orderBy(F.col("__n").desc(), *labels).limit(most).withColumn("__keep", F.lit(True)).drop("__n")
    x = keyed.groupBy(*labels).agg(*[F.count_if(F.col("__s") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count(F.lit(1)).alias("all"))
    x = x.alias("x").join(F.broadcast(top).alias("t"), [F.col(f"x.{c}").eqNullSafe(F.col(f"t.{c}")) for c in labels], "left")
    named = [F.when(F.col("__keep"), F.coalesce(F.col(f"x.{c}"), F.lit(""))).otherwise("other").alias(c) for c in labels]
    counts = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)], F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    y = x.select(*named, F.explode(counts).alias("c"))
    return y.groupBy(*labels, F.col("c.le").alias("le")).agg(F.sum("c.n").alias("n"))


def coverage(catalog: DataFrame, enabled: DataFrame) -> DataFrame:
    """category, ratio, status: share of a category's controls that are enabled.

    ``catalog`` has category, detector, adjacent (a quarter of the credit);
    ``enabled`` has detector. A category without controls has status no_control.
    """
    on = enabled.select("detector").distinct().withColumn("on", F.lit(True))
    x = catalog.join(small(on), "detector", "left")
    credit = F.when(F.col("on"), F.when(F.col("adjacent"), 0.25).otherwise(1.0)).otherwise(0.0)
    full = F.when(F.col("detector").isNotNull(), F.when(F.col("adjacent"), 0.25).otherwise(1.0)).otherwise(0.0)
    t = x.groupBy("category").agg(F.sum(credit).alias("c"), F.sum(full).alias("f"))
    ratio = F.when(F.col("f") > 0, F.round(F.col("c") / F.col("f"), 4))
    status = F.when(F.col("f") == 0, "no_control").when(F.col("c") == F.col("f"), "full").when(F.col("c") > 0, "partial").otherwise("uncovered")
    return t.select("category", ratio.alias("ratio"), status.alias("status"))
