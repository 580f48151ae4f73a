"""Queries take all of their tables, not a part."""

import random
import re

import pytest

from guardloom import queries as core
from guardloom.operators import joins

DATA = "/root/testdata/sf0.001"


def test_entropy_of_every_text(spark):
    got = core.QUERIES["text_entropy"](spark, DATA)
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").filter("text is not null").count()


def test_policy_notes_are_protected(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").filter("source = 'policy_notes'")
    got = {r.protected_id for r in core.QUERIES["join_fingerprints"](spark, DATA).select("protected_id").distinct().collect()}
    assert got and got <= {r.doc_id for r in d.collect()}


_STOCK = [" ".join(f"s{k}w{i}" for i in range(12)) for k in range(6)]


def _grams(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return {" ".join(w[i : i + 8]) for i in range(len(w) - 7)}


def _overlap(rows):
    """Brute force over (id, text, protected)."""
    texts = {}
    for i, text, protected in sorted(r for r in rows if r[1] is not None):
        texts.setdefault(text, []).append((i, protected))
    mine = [(x[0][0], len(x), next((i for i, p in x if p), None), _grams(t)) for t, x in texts.items()]
    return {(a, p, len(g & h)) for a, n, _, g in mine for _, _, p, h in mine if p is not None and (a != p or n > 1) and len(g & h) >= 2}


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 500}, {"HITS": 3}, {"PART": 1000, "BLOCK": 2000, "HITS": 40}])
def test_overlap_in_pieces(spark, monkeypatch, limits):
    pick = random.Random(3)
    rows = [(i, " ".join(pick.choices(_STOCK, k=pick.randint(0, 4)) + [f"x{pick.randint(0, 60)}"] * pick.randint(0, 1)), pick.random() < 0.3) for i in range(150)]
    alone = [(200 + i, " ".join(f"t{i // 2}v{j}" for j in range(20 + i % 2)), i < 60) for i in range(80)]  # few pairs of many texts
    rows += alone + [(i + 300, t, p) for i, t, p in rows[:40]] + [(400, None, True), (401, "", True), (402, "too short", True)]
    for k, v in limits.items():
        monkeypatch.setattr(joins, k, v)
    for some in (rows, alone):
        d = spark.createDataFrame(some, "id bigint, text string, protected boolean").repartition(3)
        got = joins.fingerprint_overlap(d, "id", "text", d.filter("protected").selectExpr("id AS pid", "text AS ptext"), "pid", "ptext")
        got = [tuple(r) for r in got.collect()]
        assert set(got) == _overlap(some) and len(got) == len(set(got)) > 0


def test_overlap_without_protected(spark):
    d = spark.createDataFrame([(1, _STOCK[0], False), (2, _STOCK[0], False)], "id bigint, text string, protected boolean")
    for of in ("protected", "protected or id = 0"):
        assert joins.fingerprint_overlap(d, "id", "text", d.filter(of).selectExpr("id AS pid", "text AS ptext"), "pid", "ptext").count() == 0


def test_overlap_does_not_move_pairs(spark):
    """A stock passage in n texts makes n² pairs; what is shuffled follows n."""
    n = 600
    d = spark.range(n).selectExpr("id", f"concat('{' '.join(_STOCK)} ', id) AS text").repartition(4)
    df = joins.fingerprint_overlap(d, "id", "text", d.selectExpr("id AS pid", "text AS ptext"), "pid", "ptext")
    group = f"overlap-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        df.write.format("noop").mode("overwrite").save()
        assert df.count() == n * (n - 1)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    assert 0 < moved < 50 * n
