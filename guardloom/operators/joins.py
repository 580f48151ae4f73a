"""The engine's lookups as joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardloom.functions import text as tx
from guardloom.session import input_bytes

#: Sides up to this many bytes (Catalyst's estimate) are broadcast; larger ones are shuffled.
SMALL = 32 << 20
#: Characters of protected texts that one task holds the shingles of (some 2 million, 0.2 GB).
BLOCK = 12 << 20
#: Bytes of texts (Catalyst's estimate) in one part that meets the protected ones.
PART = 256 << 20
#: Shared shingles that are counted at a time.
HITS = 1 << 19


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its estimated size is small, else as it is."""
    return F.broadcast(df) if input_bytes(df) <= SMALL else df


def distinct_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The smallest id of each text, the text, and ``copies``: how many rows have it. Null texts have none."""
    x = df.filter(F.col(text_col).isNotNull()).groupBy(F.md5(text_col).alias("__d"), F.length(text_col).alias("__n"))
    return x.agg(F.min(id_col).alias(id_col), F.first(text_col).alias(text_col), F.count(F.lit(1)).alias("copies")).drop("__d", "__n")


def copies_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and class_id: the smallest id of the rows with the same text; the membership behind ``fingerprint_overlap``.

    Ids and digests alone are moved; the join's other side has one row per text.
    """
    x = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col), F.md5(text_col).alias("__d"), F.length(text_col).alias("__n"))
    first = x.groupBy("__d", "__n").agg(F.min(id_col).alias("class_id"))
    return x.join(first, ["__d", "__n"]).select(id_col, "class_id")


class _Shingles:
    """Which of ``n`` texts has which shingles.

    Shingles of exactly the same texts (those of one stock sentence) are one
    class, so a text is listed once for all of them. Classes are told apart by
    the number of texts and two sums of random 64-bit marks.
    """

    def __init__(self, grams: np.ndarray, owner: np.ndarray, n: int):
        order = np.argsort(grams, kind="stable")
        grams, self.owner, self.n = grams[order], owner[order], n
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        count = np.diff(np.r_[first, len(grams)])
        marks = np.random.default_rng(0).integers(0, 1 << 64, (2, n), dtype=np.uint64)
        sums = [np.add.reduceat(m[self.owner], first) for m in marks]
        by = np.lexsort((count, *sums))
        new = np.r_[True, np.any([x[by][1:] != x[by][:-1] for x in (count, *sums)], axis=0)]
        self.grams, self.cls = grams[first], np.empty(len(first), np.int64)
        self.cls[by] = np.cumsum(new) - 1
        self.start, self.count = first[by[new]], count[by[new]]

    def shared(self, grams: np.ndarray, sizes: np.ndarray, own: np.ndarray, at_least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """row, text, shingles shared, some rows at a time. Row i has the next ``sizes[i]`` of the shingles and does not meet text ``own[i]`` (-1: meets all)."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        ok = self.grams[at] == grams
        row = np.repeat(np.arange(len(sizes)), sizes)[ok]
        key, times = np.unique(row * len(self.start) + self.cls[at[ok]], return_counts=True)
        row, cls = np.divmod(key, len(self.start))
        hits = self.count[cls]
        per_row = np.bincount(row, hits, len(sizes)).astype(np.int64)
        part = (np.cumsum(per_row) - per_row) // HITS
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(sizes)]
        for r0, r1 in zip(cuts[:-1], cuts[1:]):
            a, b = np.searchsorted(row, (r0, r1))
            if a == b:
                continue
            cells, total = int(r1 - r0) * self.n, int(hits[a:b].sum())
            mine = np.flatnonzero(own[r0:r1] >= 0)
            mine = mine * self.n + own[r0:r1][mine]
            if cells <= 16 * total:  # a counter for every pair
                piece = (np.cumsum(hits[a:b]) - hits[a:b]) // HITS
                ends = a + np.r_[0, np.flatnonzero(piece[1:] != piece[:-1]) + 1, b - a]
                n = np.zeros(cells)
                for x, y in zip(ends[:-1], ends[1:]):
                    pairs, w = self._pairs(row[x:y] - r0, cls[x:y], times[x:y])
                    n += np.bincount(pairs, w, cells)
                n[mine] = 0
                pairs = np.flatnonzero(n >= at_least)
                n = n[pairs]
            else:
                pairs, where = np.unique((x := self._pairs(row[a:b] - r0, cls[a:b], times[a:b]))[0], return_inverse=True)
                n = np.bincount(where, x[1])
                keep = (n >= at_least) & ~np.isin(pairs, mine)
                pairs, n = pairs[keep], n[keep]
            r, t = np.divmod(pairs, self.n)
            yield r + r0, t, n.astype(np.int64)

    def _pairs(self, row: np.ndarray, cls: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[cls]
        at = np.arange(count.sum()) + np.repeat(self.start[cls] - np.cumsum(count) + count, count)
        return np.repeat(row * self.n, count) + self.owner[at], np.repeat(times, count)


def fingerprint_overlap(texts: DataFrame, id_col: str, text_col: str, protected: DataFrame, pid_col: str, ptext_col: str, n: int = 8, at_least: int = 2) -> DataFrame:
    """id, protected id, shared: texts that share ``at_least`` word shingles with a protected one.

    Both sides are represented by the smallest id of each text (``copies_of``
    tells which rows a class has), so copies cost nothing; ids are unique and of
    one type. A text that occurs once and is protected itself does not meet
    itself. There can be as many pairs as texts times protected ones, so pairs
    are never moved or kept: every part of the texts meets the protected ones in
    one task, which counts what a text shares with all of them and goes on. The
    protected texts are moved once for each part (one a core, more for large
    tables: one for each ``PART``, at most ``spark.sql.shuffle.partitions``), the
    texts once for each ``BLOCK`` of protected ones. Shingles are compared by their digests.
    """
    whole = protected.filter(F.col(pid_col).isNotNull() & F.col(ptext_col).isNotNull())
    blocks = 1 + (whole.agg(F.sum(F.length(ptext_col))).first()[0] or 0) // BLOCK
    spark = texts.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, min(input_bytes(texts) // PART, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind, pkind = texts.schema[id_col].dataType, protected.schema[pid_col].dataType
    least = max(1, at_least)

    def of(text: str, k: int) -> Column:
        return F.pmod(F.xxhash64(text), F.lit(k)).cast("int")

    def every(k: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    theirs = distinct_texts(whole, pid_col, ptext_col)
    theirs = theirs.select(F.lit(0).alias("__side"), every(parts).alias("__part"), of(ptext_col, blocks).alias("__block"), F.lit(None).cast(kind).alias("__id"), F.col(pid_col).alias("__pid"), F.col(ptext_col).alias("__text"), F.lit(0).cast("bigint").alias("__copies"))
    mine = distinct_texts(texts, id_col, text_col).filter(F.col(id_col).isNotNull() | (F.col("copies") > 1))
    mine = mine.select(F.lit(1).alias("__side"), of(text_col, parts).alias("__part"), every(blocks).alias("__block"), F.col(id_col).alias("__id"), F.lit(None).cast(pkind).alias("__pid"), F.col(text_col).alias("__text"), F.col("copies").alias("__copies"))
    both = theirs.unionByName(mine).repartitionById(parts * blocks, F.col("__part") * blocks + F.col("__block")).sortWithinPartitions("__side")
    grams = F.array_distinct(tx.ngrams(tx.tokens(F.col("__text")), n))
    rows = both.select("__side", "__id", "__pid", F.transform(grams, lambda g: F.xxhash64(g)).alias("__grams"), "__copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, pids = [], None, None
        for b in batches:
            split = int(pc.sum(pc.equal(b.column(0), 0)).as_py() or 0)
            if split:  # the protected ones come first
                x = b.slice(0, split)
                held.append((x.column(2), x.column(3).flatten().to_numpy(), pc.list_value_length(x.column(3)).to_numpy()))
            b = b.slice(split)
            if not b.num_rows or not held and index is None:
                continue
            if index is None:
                pids, sizes = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[2] for x in held])
                index = _Shingles(np.concatenate([x[1] for x in held]), np.repeat(np.arange(len(sizes)), sizes), len(sizes)) if sizes.sum() else False
                held = []
            if not index:
                continue
            ids, copies = b.column(1), b.column(4).to_numpy()
            own = pc.fill_null(pc.index_in(ids, value_set=pids, skip_nulls=True), -1).to_numpy().astype(np.int64)
            for row, text, shared in index.shared(b.column(3).flatten().to_numpy(), pc.list_value_length(b.column(3)).to_numpy(), np.where(copies > 1, -1, own), least):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pids.take(pa.array(text)), pa.array(shared)], names=[id_col, pid_col, "shared"])

    return rows.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, `{pid_col}` {pkind.simpleString()}, shared bigint")


def resolve_scope(requests: DataFrame, policies: DataFrame, parts: Sequence[str] = ("tenant", "app", "agent", "env")) -> DataFrame:
    """Each request with the policy of its most specific scope (``policy``, null if none fits).

    ``policies`` has scope_key ``tenant:app:agent:env`` and policy. Exact, then
    agent default, agent any, tenant and env, tenant, everything.
    """
    t, a, g, e = (F.coalesce(F.col(p), F.lit("")) for p in parts)
    keys = [F.concat_ws(":", t, a, g, e), F.concat_ws(":", t, a, F.lit("default"), e), F.concat_ws(":", t, a, F.lit("*"), e), F.concat_ws(":", t, F.lit("*"), F.lit("*"), e), F.concat_ws(":", t, F.lit("*"), F.lit("*"), F.lit("*")), F.lit("*:*:*:*")]
    out, found = requests, []
    for i, k in enumerate(keys):
        p = policies.select(F.col("scope_key").alias(f"__k{i}"), F.col("policy").alias(f"__p{i}"))
        out = out.withColumn(f"__q{i}", k).join(small(p), F.col(f"__q{i}") == F.col(f"__k{i}"), "left")
        found.append(F.col(f"__p{i}"))
    return out.select(*requests.columns, F.coalesce(*found).alias("policy"))


def budget_of(calls: DataFrame, budgets: DataFrame, env: str, key: str) -> DataFrame:
    """Each call with its most specific budget: (env, key), (env, any), (any, key), (any, any)."""
    b = budgets.select(F.col("env").alias("__e"), F.col("detector_key").alias("__d"), "max_cost_usd", "max_calls")
    on = F.col("__e").isin("*") | (F.col("__e") == F.col(env))
    on = on & (F.col("__d").isin("*") | (F.col("__d") == F.col(key)))
    # one row per (env, key) is matched, then joined back on both: the calls are joined once, on equality
    pairs = calls.select(env, key).distinct()
    got = pairs.join(small(b), on, "left")
    rank = (F.col("__e") != "*").cast("int") * 2 + (F.col("__d") != "*").cast("int")
    best = got.groupBy(env, key).agg(F.max_by(F.struct("max_cost_usd", "max_calls"), rank).alias("__b"))
    return calls.join(small(best), [env, key], "left").select(*calls.columns, "__b.max_cost_usd", "__b.max_calls")


def spent(calls: DataFrame, budgets: DataFrame, env: str, key: str, time: str, now: str, seconds: int) -> DataFrame:
    """env, key, calls, cost_usd, max_calls, max_cost_usd, denied: what was spent in the ``seconds`` up to ``now``.

    A call is denied once its most specific budget is reached. Sums are made
    before budgets are looked up; a null cost counts as 0.
    """
    end = F.to_timestamp(F.lit(now))
    recent = calls.filter((F.col(time) > end - F.make_interval(secs=F.lit(seconds))) & (F.col(time) <= end))
    sums = recent.groupBy(env, key).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))
    got = budget_of(sums, budgets, env, key)
    over = F.coalesce(F.col("calls") >= F.col("max_calls"), F.lit(False)) | F.coalesce(F.col("cost_usd") >= F.col("max_cost_usd"), F.lit(False))
    return got.withColumn("denied", over)


def artifact_diff(baseline: DataFrame, reported: DataFrame) -> DataFrame:
    """path, change: added, removed or changed by sha256; equal ones give no row."""
    a, b = baseline.select("path", F.col("sha256").alias("a")), reported.select("path", F.col("sha256").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
