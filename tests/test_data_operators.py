"""Nested records and repeated deliveries against brute force, and their edge cases."""

import json
import uuid

from pyspark.sql import functions as F

from guardloom.operators import dedup, nested


def _brute(stages):
    """Innermost children by the plainest reading of every shape."""
    out = set()

    def rows(x, name_key=None):
        if isinstance(x, str):
            x = json.loads(x) if x[:1] in "[{" else ([] if not x else [{"v": x}])
        if x is None:
            return []
        if isinstance(x, dict):
            if name_key and not {"detector_name", "detectorName"} & set(x):
                return [(i, {"detector_name": k, **v}) for i, (k, v) in enumerate(x.items())]
            return [(0, x)]
        return [(i, v) for i, v in enumerate(x) if v is not None]

    get = lambda d, a, b: d.get(a, d.get(b))
    x = json.loads(stages) if stages else []
    if isinstance(x, str):
        x = json.loads(x)
    if isinstance(x, dict):
        x = x["stages"]
    for s, stage in rows(x):
        for i, _ in rows(get(stage, "rule_hits", "ruleHits")):
            out.add((s, "", "rule_hit", i))
        for _, d in rows(get(stage, "detector_results", "detectorResults"), True):
            name = get(d, "detector_name", "detectorName") or ""
            for i, _ in rows(get(d, "rule_hits", "ruleHits")):
                out.add((s, name, "detector_hit", i))
            for i, _ in rows(get(d, "layer_results", "layerResults")):
                out.add((s, name, "layer", i))
    return out


def test_p6_matches_brute_force(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/round_trip_traces.parquet")
    got = {}
    for r in nested.innermost_children(nested.dewey_nodes(t, "trace_no", "stages", nested.STAGES), "trace_no").collect():
        got.setdefault(r.trace_no, set()).add((r.stage_no, r.detector_name, r.item_kind, r.item_no))
    for r in t.select("trace_no", "stages").collect():
        assert got.get(r.trace_no, set()) == _brute(r.stages), r.trace_no


def test_p6_edges(spark):
    docs = [None, "", "no json", "[]", "[null]", '"[]"', '{"stages": null}', '[{"kind": "a", "rule_hits": [null, "r1", {"rule_id": "r2"}]}]']
    df = spark.createDataFrame(list(enumerate(docs)), "trace_no bigint, stages string").withColumn("dewey", F.lit("clash"))
    rows = nested.innermost_children(nested.dewey_nodes(df, "trace_no", "stages", nested.STAGES), "trace_no").collect()
    assert {(r.trace_no, r.item_no) for r in rows} == {(7, 1), (7, 2)}
    empty = nested.dewey_nodes(df.limit(0), "trace_no", "stages", nested.STAGES)
    assert empty.count() == 0


def test_first_prompt_in_every_shape(spark):
    docs = ['[{"input_text": "q"}]', '{"stages": [{"inputText": "q"}]}', '"[{\\"input_text\\": \\"q\\"}]"', '{"input": {"input_text": "q"}, "output": {}}', '[null, {"input_text": "no"}]', "no json", None]
    df = spark.createDataFrame(list(enumerate(docs)), "n bigint, stages string")
    got = df.select("n", nested.first_field("stages", nested.STAGES, "input_text").alias("q")).orderBy("n").collect()
    assert [r.q for r in got] == ["q"] * 4 + [None] * 3


def test_long_ordinals_stay_apart(spark):
    df = spark.createDataFrame([([10_000],), ([100_000],), ([2, 0],)], "d array<int>")
    assert [r.t for r in df.select(nested.dewey_text("d").alias("t")).collect()] == ["10000", "100000", "00002.00000"]


def test_parents_exist(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/round_trip_traces.parquet")
    n = nested.dewey_nodes(t, "trace_no", "stages", nested.STAGES)
    ids = n.select("trace_no", nested.dewey_text("dewey").alias("id"))
    parents = n.select("trace_no", nested.dewey_text(nested.parent_of("dewey")).alias("id")).filter("id <> ''")
    assert parents.join(ids, ["trace_no", "id"], "left_anti").count() == 0


def test_uuid_spellings(spark):
    u = uuid.UUID(int=0xABCDEF)
    forms = [str(u), str(u).upper(), u.hex, "{%s}" % u, f"urn:uuid:{u}", f" {u}\n", None, "", "not", "0" * 32, str(uuid.UUID(int=0))]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "n bigint, e string")
    keys = [r.k for r in df.orderBy("n").select(F.hex(dedup.uuid_key("e")).alias("k")).collect()]
    assert len(set(keys[:6])) == 1 and keys[0] and keys[6:] == [None] * 5


def test_repeats_with_a_hot_key(spark):
    rows = [(i, "a" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "n bigint, k string")
    got = {r.n for r in dedup.repeated_deliveries(df, F.col("k"), ["n"], ["n"]).collect()}
    seen, want = set(), set()
    for n, k in rows:
        if k is not None:
            (want if k in seen else seen).add(n if k in seen else k)
    assert got == want
    assert dedup.first_deliveries(df, F.col("k"), ["n"], "n").count() == 3000 - len(want)
    assert dedup.repeated_deliveries(df.limit(0), F.col("k"), ["n"], ["n"]).count() == 0


def test_admit_batch(spark):
    old = spark.createDataFrame([("a",), (None,)], "key string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None), (5, None)], "n bigint, k string")
    assert sorted(r.n for r in dedup.admit_batch(new, old, F.col("k"), ["n"], "n").collect()) == [2, 4, 5]
