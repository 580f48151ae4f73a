"""Joins, quality scores, layering, remediation and text functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardloom import sql_guard, sql_quality
from guardloom.functions import checksums as ck
from guardloom.functions import text as tx
from guardloom.operators import agentic, hooks, joins, layering, metrics, nested, quality
from guardloom.operators.detectors import equations, valence
from guardloom.operators.hits import rank, rank_sql
from guardloom.plans import policy as po
from guardloom.plans.round_trip import round_trip
from guardloom.queries import query
from guardloom.session import spread, table


# --- joins --------------------------------------------------------------------------


_GRAMS = "list_distinct(list_transform(generate_series(1, len(k) - 7), lambda i: array_to_string(k[i:i + 7], ' ')))"


@query(
    f"""
    WITH t AS (SELECT min(doc_id) AS doc_id, count(*) AS copies, min(CASE WHEN source = 'policy_notes' THEN doc_id END) AS protected_id, {tx.tokens_sql('text')} AS k FROM documents WHERE text IS NOT NULL GROUP BY text),
    g AS (SELECT doc_id, copies, protected_id, unnest({_GRAMS}) AS g FROM t)
    SELECT a.doc_id, b.protected_id, CAST(count(*) AS BIGINT) AS shared FROM g AS a JOIN g AS b ON a.g = b.g AND b.protected_id IS NOT NULL AND (a.doc_id <> b.protected_id OR a.copies > 1) GROUP BY ALL HAVING count(*) >= 2
    """
)
def join_fingerprints(spark, sf_dir):
    """Texts that share 8-word shingles with the policy notes (the protected texts), each side by its smallest id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    protected = d.filter("source = 'policy_notes'").select(F.col("doc_id").alias("protected_id"), F.col("text").alias("protected_text"))
    return joins.fingerprint_overlap(d, "doc_id", "text", protected, "protected_id", "protected_text")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM documents WHERE text IS NOT NULL")
def join_fingerprint_classes(spark, sf_dir):
    """Which text of ``join_fingerprints`` every document has."""
    return joins.copies_of(table(spark, sf_dir, "documents"), "doc_id", "text")


_SCOPES = {
    "*:*:*:*": {"risk_limit": 60},
    "org-galnim:*:*:*": {"risk_limit": 40},
    "org-pelmar:*:*:prod": {"risk_limit": 30},
    "org-zemhul:chat_widget:default:prod": {"risk_limit": 20},
}


@query(
    """
    SELECT rec_no, CASE WHEN tenant_id = 'org-zemhul' AND source = 'chat_widget' THEN 20 WHEN tenant_id = 'org-pelmar' THEN 30 WHEN tenant_id = 'org-galnim' THEN 40 ELSE 60 END::INTEGER AS risk_limit FROM infer_requests
    """
)
def join_policy_scopes(spark, sf_dir):
    r = table(spark, sf_dir, "infer_requests").select("rec_no", F.col("tenant_id").alias("tenant"), F.col("source").alias("app"), F.lit("default").alias("agent"), F.lit("prod").alias("env"))
    got = joins.resolve_scope(r, po.scope_table(spark, {"scope_policies": _SCOPES}))
    return got.select("rec_no", F.get_json_object("policy", "$.risk_limit").cast("int").alias("risk_limit"))


@query(
    """
    SELECT detector_key, mode, CAST(count(*) AS BIGINT) AS calls, CAST(sum(coalesce(bytes_out, 0)) AS BIGINT) AS bytes, CASE WHEN mode = 'remote_llm' AND detector_key = 'pii' THEN 100 WHEN mode = 'remote_llm' THEN 500 WHEN detector_key = 'toxicity' THEN 200 ELSE 1000 END::BIGINT AS max_calls,
           count(*) >= CASE WHEN mode = 'remote_llm' AND detector_key = 'pii' THEN 100 WHEN mode = 'remote_llm' THEN 500 WHEN detector_key = 'toxicity' THEN 200 ELSE 1000 END AS denied
    FROM egress_events GROUP BY detector_key, mode
    """
)
def join_budgets(spark, sf_dir):
    """Calls per detector and mode against their most specific budget; reaching it denies."""
    e = table(spark, sf_dir, "egress_events").groupBy("detector_key", "mode").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("bytes_out", F.lit(0))).alias("bytes"))
    b = spark.createDataFrame([("remote_llm", "pii", None, 100), ("remote_llm", "*", None, 500), ("*", "toxicity", None, 200), ("*", "*", None, 1000)], "env string, detector_key string, max_cost_usd double, max_calls bigint")
    got = joins.budget_of(e, b, "mode", "detector_key")
    return got.select("detector_key", "mode", "calls", "bytes", "max_calls", (F.col("calls") >= F.col("max_calls")).alias("denied"))


@query(
    """
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (SELECT CAST(p_partkey AS VARCHAR) AS path, p_brand AS sha256 FROM part WHERE p_size < 30) a
    FULL JOIN (SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_retailprice > 1500 THEN 'new' ELSE p_brand END AS sha256 FROM part WHERE p_size > 10) b ON a.path = b.path
    WHERE a.path IS NULL OR b.path IS NULL OR a.sha256 <> b.sha256
    """
)
def join_artifact_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_brand", "p_size", "p_retailprice")
    a = p.filter("p_size < 30").select("path", F.col("p_brand").alias("sha256"))
    b = p.filter("p_size > 10").select("path", F.when(F.col("p_retailprice") > 1500, "new").otherwise(F.col("p_brand")).alias("sha256"))
    return joins.artifact_diff(a, b)


@query(
    f"""
    SELECT request_id, arg_max(decision, k * 1000000000000 - timing_no) AS decision, CAST(max(risk_score) AS INTEGER) AS risk, CAST(count(*) AS BIGINT) AS n_detectors
    FROM (SELECT *, {rank_sql('decision')} AS k FROM (SELECT DISTINCT request_id, timing_no, decision, risk_score FROM detector_timings WHERE request_id IS NOT NULL)) GROUP BY request_id
    """
)
def aggregate_decisions(spark, sf_dir):
    """One decision per request from its detectors: highest precedence, first of equals; largest risk."""
    t = table(spark, sf_dir, "detector_timings").select("request_id", "timing_no", "decision", "risk_score").distinct().filter("request_id is not null")
    first = F.max_by("decision", F.struct(rank(F.col("decision")).alias("k"), (-F.col("timing_no")).alias("i")))
    return t.groupBy("request_id").agg(first.alias("decision"), F.max("risk_score").cast("int").alias("risk"), F.count(F.lit(1)).alias("n_detectors"))


# --- layering -----------------------------------------------------------------------


def _layers(spark, sf_dir):
    t = table(spark, sf_dir, "detector_timings").select("timing_no", "layer_results").dropDuplicates(["timing_no"])
    x = t.select("timing_no", F.posexplode("layer_results").alias("i", "l"))
    return x.select("timing_no", "i", "l.execution_mode", "l.decision", "l.normalized_score", "l.selected", "l.cost_usd")


_LAYERS_SQL = "SELECT timing_no, unnest(layer_results) AS l FROM (SELECT timing_no, any_value(layer_results) AS layer_results FROM detector_timings GROUP BY timing_no)"


@query(f"SELECT timing_no, CAST(count(*) AS BIGINT) AS n_layers, CAST(count(DISTINCT l.decision) AS BIGINT) AS n_decisions, round(max(l.normalized_score) - min(l.normalized_score), 4) AS spread FROM ({_LAYERS_SQL}) GROUP BY timing_no")
def layer_divergence(spark, sf_dir):
    return layering.layer_divergence(_layers(spark, sf_dir), ["timing_no"])


_ONE_LAYER = """arg_max({{'d': l.decision, 'r': CAST(trunc(coalesce(l.normalized_score, 0.0)) AS INTEGER), 'c': l.normalized_score / 100}}, i) FILTER (WHERE {0}) """


@query(
    f"""
    WITH x AS (SELECT timing_no, l, i FROM (SELECT timing_no, layer_results AS ls, unnest(generate_series(1, len(layer_results))) AS i, layer_results[i] AS l FROM (SELECT timing_no, any_value(layer_results) AS layer_results FROM detector_timings GROUP BY timing_no))),
    o AS (SELECT timing_no, {_ONE_LAYER.format("l.execution_mode = 'local_deterministic'")} AS a, {_ONE_LAYER.format("l.execution_mode IN ('local_ml', 'local_embedding')")} AS b, {_ONE_LAYER.format("coalesce(l.execution_mode, '') NOT IN ('local_deterministic', 'local_ml', 'local_embedding')")} AS c FROM x GROUP BY timing_no),
    m AS (SELECT *, CASE WHEN a IS NOT NULL AND NOT (a.r BETWEEN 35 AND 70) THEN 'deterministic' WHEN b IS NULL THEN 'fallback' WHEN NOT (b.c IS NULL OR b.c < 0.7) THEN 'ml' WHEN c IS NULL THEN 'ml' ELSE 'llm' END AS selected_mode FROM o)
    SELECT timing_no, CASE selected_mode WHEN 'ml' THEN b.d WHEN 'llm' THEN c.d ELSE a.d END AS decision, CASE selected_mode WHEN 'ml' THEN b.r WHEN 'llm' THEN c.r ELSE a.r END AS risk, selected_mode FROM m
    """
)
def escalation_fold(spark, sf_dir):
    """Which layer decides: rules, then a local model, then a judge, each only where the one before leaves it open."""
    m = F.col("execution_mode")
    mode = F.when(m == "local_deterministic", "deterministic").when(m.isin("local_ml", "local_embedding"), "ml").otherwise("llm")
    x = _layers(spark, sf_dir).select("timing_no", mode.alias("mode"), "decision", F.coalesce("normalized_score", F.lit(0.0)).alias("risk"), (F.col("normalized_score") / 100).alias("confidence"), F.lit(True).alias("available"))
    return layering.escalation_fold(x, ["timing_no"])


@query(
    """
    SELECT delivery_no, CASE WHEN mode LIKE 'local%' THEN 'in_boundary' WHEN NOT coalesce(destination_host LIKE '%.example', false) THEN 'not_allowlisted' WHEN NOT coalesce(destination_region IN ('eu-1', 'us-1'), false) THEN 'residency' ELSE 'allowed' END AS reason FROM egress_events
    """
)
def egress_gate(spark, sf_dir):
    """Why each outgoing call may or may not leave."""
    e = table(spark, sf_dir, "egress_events")
    host = F.when(F.col("destination_host").like("%.example"), "allowed-host").otherwise(F.col("destination_host"))
    reason = layering.egress_reason(host, F.col("destination_region"), ~F.col("mode").like("local%"), F.lit(False), F.array(F.lit("allowed-host")), F.array(F.lit("eu-1"), F.lit("us-1")))
    return e.select("delivery_no", reason.alias("reason"))


@query(
    """
    SELECT timing_no, CASE WHEN decision = 'ALLOW' THEN 'noop' WHEN list_contains(p, 'pii') THEN 'fix' WHEN list_contains(p, 'jailbreak') THEN 'refrain' WHEN list_contains(p, 'toxicity') THEN 'ask_human' ELSE 'reask' END AS action
    FROM (SELECT timing_no, any_value(decision) AS decision, coalesce(any_value([regexp_extract(h.rule_id, '^([^:.]*)', 1) for h in rule_hits]), []) AS p FROM detector_timings GROUP BY timing_no)
    """
)
def remediation_actions(spark, sf_dir):
    t = table(spark, sf_dir, "detector_timings").select("timing_no", "decision", "rule_hits").dropDuplicates(["timing_no"])
    hits = F.coalesce("rule_hits", F.array().cast("array<struct<rule_id:string,severity:string,message:string>>"))
    return t.select("timing_no", layering.remediation(hits, F.coalesce("decision", F.lit("")), {"pii": "fix", "jailbreak": "refrain", "toxicity": "ask_human"}, "reask").alias("action"))


@query(
    f"""
    SELECT rec_no, s AS score, CASE WHEN s >= 0.5 THEN 'BLOCK' WHEN s > 0 THEN 'WARN' ELSE 'ALLOW' END AS decision FROM (
      SELECT rec_no, CAST(least(1.0, {' + '.join(f"CASE WHEN list_contains(k, '{w}') THEN {v}::DOUBLE ELSE 0.0::DOUBLE END" for w, v in layering.STUB["toxicity"].items())}) AS DOUBLE) AS s
      FROM (SELECT rec_no, {tx.tokens_sql(tx.plain_sql("coalesce(text, '')"))} AS k FROM infer_requests))
    """
)
def stub_model_scores(spark, sf_dir):
    r = table(spark, sf_dir, "infer_requests").select("rec_no", "text")
    k = tx.tokens(tx.plain(F.col("text")))
    return r.select("rec_no", layering.stub_score(k, "toxicity").alias("s")).select("rec_no", "s.score", "s.decision")


# --- quality ------------------------------------------------------------------------


@query(sql_quality.scores())
def quality_scores(spark, sf_dir):
    """Scores of every model output against the text that was sent in."""
    t = spread(table(spark, sf_dir, "round_trip_traces").select("trace_no", "stages", "final_output")).select("trace_no", nested.first_field("stages", nested.STAGES, "input_text").alias("q"), F.coalesce("final_output", F.lit("")).alias("a"))
    q = F.coalesce("q", F.lit(""))
    return t.select(
        "trace_no", quality.groundedness(F.col("a"), F.array(q)).alias("groundedness"), quality.relevance(q, F.col("a")).alias("relevance"), quality.coherence(F.col("a")).alias("coherence"),
        quality.fluency(F.col("a")).alias("fluency"), quality.intent_resolution(q, F.col("a")).alias("intent_resolution"), quality.task_adherence(F.col("a"), [("max_words", 60), ("must_not_include", "password")]).alias("task_adherence"),
    )


@query(
    """
    SELECT doc_id, round((CASE WHEN n IS NULL THEN 0.0 ELSE 1.0 END + 1.0 + CASE WHEN p IS NULL THEN 0.0 ELSE 1.0 END + CASE WHEN c IS NULL THEN 1.0 WHEN TRY_CAST(c AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) / 4, 4) AS score
    FROM (SELECT doc_id, j->>'$.name' AS n, j->>'$.parameters' AS p, j->>'$.cost' AS c FROM (SELECT doc_id, TRY_CAST(text AS JSON) AS j FROM documents WHERE source = 'tool_manifests'))
    """
)
def quality_tool_calls(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source = 'tool_manifests'").select("doc_id", "text")
    return d.select("doc_id", quality.tool_call_accuracy(F.col("text"), {"name": "string", "version": "string", "parameters": "object", "cost": "number"}, ["name", "parameters"]).alias("score"))


# --- text functions -----------------------------------------------------------------


_PARTS = "list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1\x01', 'g'), '\x01'), lambda s: trim(s, ' '))"


@query(
    f"""
    SELECT doc_id, CAST(len(list_filter({_PARTS}, lambda s: length(s) > 0)) AS INTEGER) AS n_sentences, CAST(len(list_filter({_PARTS}, lambda s: length(s) > 10)) AS INTEGER) AS n_longer, round({sql_guard.valence_sql("k")}, 4) AS valence
    FROM (SELECT doc_id, text, {tx.tokens_sql("text")} AS k FROM documents)
    """
)
def sentence_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(tx.sentences(F.coalesce("text", F.lit("")))).alias("n_sentences"), F.size(tx.sentences(F.coalesce("text", F.lit("")), 10)).alias("n_longer"), F.round(valence(tx.tokens(F.col("text"))), 4).alias("valence"))


@query(
    """
    SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' * ' || CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS VARCHAR) || ' = ' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS equation,
           abs(CAST(l_quantity AS BIGINT) * (floor(l_extendedprice / l_quantity)) - floor(l_extendedprice)) <= greatest(0.01, CAST(l_quantity AS BIGINT) * (floor(l_extendedprice / l_quantity)) * 0.001) AS "right"
    FROM lineitem
    """
)
def arithmetic_claims(spark, sf_dir):
    """Claims about the lines of orders, some right within the tolerance and some not."""
    x, price = table(spark, sf_dir, "lineitem"), F.floor(F.col("l_extendedprice") / F.col("l_quantity"))
    claim = F.concat(F.lit("The sum "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" * "), price.cast("string"), F.lit(" = "), F.floor("l_extendedprice").cast("string"), F.lit(" was paid."))
    d = x.select("l_orderkey", "l_linenumber", F.explode_outer(equations(claim)).alias("e")).filter("e is not null")
    return d.select("l_orderkey", "l_linenumber", "e.equation", "e.right")


@query(
    """
    SELECT c_custkey, length(d) >= 13 AND (list_sum([CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN CAST(d[i] AS INT) * 2 > 9 THEN CAST(d[i] AS INT) * 2 - 9 ELSE CAST(d[i] AS INT) * 2 END ELSE CAST(d[i] AS INT) END for i in generate_series(1, len(d))]) % 10 = 0) AS luhn
    FROM (SELECT c_custkey, '4' || lpad(CAST(c_custkey AS VARCHAR), 14, '7') || CAST(c_custkey % 10 AS VARCHAR) AS d FROM customer)
    """
)
def checksum_luhn(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    d = F.concat(F.lit("4"), F.lpad(F.col("c_custkey").cast("string"), 14, "7"), (F.col("c_custkey") % 10).cast("string"))
    return c.select("c_custkey", ck.luhn(d).alias("luhn"))


def _sum_sql(d: str, weights: list[int]) -> str:
    return "(" + " + ".join(f"CAST(substring({d}, {i}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights, 1)) + ")"


def _mod_sql(d: str, weights: list[int]) -> str:
    return f"(({_sum_sql(d, weights)} * 10) % 11 % 10)"


_TABLES = [", ".join(f"[{', '.join(row)}]" for row in t) for t in (ck._VERHOEFF_D, ck._VERHOEFF_P)]
_VERHOEFF = "list_reduce(list_prepend(0, generate_series(0, 11)), lambda acc, i: ([{0}])[acc + 1][(([{1}])[i % 8 + 1])[CAST(substring(reverse(v), i + 1, 1) AS INTEGER) + 1] + 1]) = 0".format(*_TABLES)


@query(
    f"""
    SELECT c_custkey, {_VERHOEFF} AS verhoeff,
      (11 - {_sum_sql('d', list(range(10, 1, -1)))} % 11) % 11 = CAST(substring(d, 10, 1) AS INTEGER) AS nhs,
      {_mod_sql('d', list(range(10, 1, -1)))} = CAST(substring(d, 10, 1) AS INTEGER) AND {_mod_sql('d', list(range(11, 1, -1)))} = CAST(substring(d, 11, 1) AS INTEGER) AND replace(d, d[1], '') <> '' AS cpf,
      ({_sum_sql('d', [9, 8, 7, 6, 5, 4, 3, 2])} - CAST(substring(d, 9, 1) AS INTEGER)) % 11 = 0 AND substring(d, 1, 9) <> '000000000' AS bsn,
      {_sum_sql('d', [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0 AS tfn, ({_sum_sql('d', [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0 AS abn,
      (10 - {_sum_sql('d', [8, 7, 6, 5, 4, 3, 2, 1])} % 10) % 10 = CAST(substring(d, 9, 1) AS INTEGER) AS acn,
      list_sum([CASE WHEN i % 2 = 0 THEN (CAST(d[i] AS INTEGER) * 2) // 10 + (CAST(d[i] AS INTEGER) * 2) % 10 ELSE CAST(d[i] AS INTEGER) END for i in generate_series(1, 9)]) % 10 = 0 AND NOT d[1] IN ('0', '8') AS sin
    FROM (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '1') AS d, lpad(CAST(c_custkey * 7919 AS VARCHAR), 11, '1') || '3' AS v FROM customer)
    """
)
def checksums_national(spark, sf_dir):
    """Check digits of several countries over made-up numbers."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919).cast("string"), 11, "1").alias("d"))
    d = F.col("d")
    nine = F.substring(d, 1, 9)
    return c.select("c_custkey", ck.verhoeff(F.concat(d, F.lit("3"))).alias("verhoeff"), ck.nhs_uk(F.substring(d, 1, 10)).alias("nhs"), ck.cpf_br(d).alias("cpf"), ck.bsn_nl(nine).alias("bsn"), ck.tfn_au(nine).alias("tfn"), ck.abn_au(d).alias("abn"), ck.acn_au(nine).alias("acn"), ck.sin_ca(nine).alias("sin"))


@query(
    """
    WITH u AS (SELECT doc_id, tenant_id, source, unnest(list_distinct(regexp_extract_all(text, '(https?://[^\\s"''<>)\\]]+)', 1))) AS url FROM documents)
    SELECT doc_id, url FROM u AS a WHERE source = 'release_notes' AND NOT EXISTS (SELECT 1 FROM u AS b WHERE b.source = 'kb_chunks' AND b.tenant_id = a.tenant_id AND b.url = a.url)
    """.replace("\\\\", "\\")
)
def citation_check(spark, sf_dir):
    """Links that release notes cite but no knowledge chunk of the tenant holds (an anti-join)."""
    d = table(spark, sf_dir, "documents")
    url = lambda s: d.filter(F.col("source") == s).select("doc_id", "tenant_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(https?://[^\s\"'<>)\]]+)"), 1))).alias("url"))
    return url("release_notes").join(url("kb_chunks").select("tenant_id", "url").distinct(), ["tenant_id", "url"], "left_anti").select("doc_id", "url")


@query(f"SELECT doc_id, CAST(len({_GRAMS}) AS INTEGER) AS n_shingles FROM (SELECT doc_id, {tx.tokens_sql('text')} AS k FROM documents WHERE source = 'policy_notes')")
def shingle_registry(spark, sf_dir):
    """How many keyed shingles each policy note registers."""
    d = table(spark, sf_dir, "documents").filter("source = 'policy_notes'")
    return d.select("doc_id", F.size(agentic.shingle_digests(F.coalesce("text", F.lit("")), "k")).alias("n_shingles"))


# --- declarations -------------------------------------------------------------------


def _manifests(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("source = 'tool_manifests'").select("doc_id", "text")


@query()
def manifest_scan(spark, sf_dir):
    """Server manifests: injected descriptions, dangerous rights, inner hosts."""
    return _manifests(spark, sf_dir).select("doc_id", hooks.manifest_verdict("text").alias("v")).select("doc_id", "v.decision", "v.risk", F.array_join("v.rules", ",").alias("rules"))


@query()
def tool_permission_audit(spark, sf_dir):
    return _manifests(spark, sf_dir).select("doc_id", hooks.tool_audit_verdict("text").alias("v")).select("doc_id", "v.decision", "v.risk", F.array_join("v.rules", ",").alias("rules"))


@query()
def schema_field_errors(spark, sf_dir):
    """Manifests against a schema; one row per error."""
    schema = {"type": "object", "required": ["name", "version", "permissions"], "properties": {"name": {"type": "string", "pattern": "^[a-z_0-9]+$"}, "version": {"type": "string"}, "parameters": {"type": "object", "required": ["type"]}}, "additionalProperties": False}
    return hooks.field_errors(_manifests(spark, sf_dir), "doc_id", "text", schema)


# --- round trips and replies --------------------------------------------------------


@query()
def round_trips(spark, sf_dir):
    """Each trace's prompt and output under a small policy, guarded in order."""
    t = spread(table(spark, sf_dir, "round_trip_traces").select("trace_no", "stages", "final_output")).select("trace_no", nested.first_field("stages", nested.STAGES, "input_text").alias("prompt"), F.col("final_output").alias("answer"))
    policy = {n: {"enabled": True} for n in ("secrets", "exfiltration", "jailbreak", "toxicity", "pii")}
    x = round_trip(t, "prompt", "answer", policy)
    return x.select("trace_no", F.col("input_verdict.decision").alias("input_decision"), F.col("output_verdict.decision").alias("output_decision"), "final_decision", F.sha2(F.coalesce("final_output_shown", F.lit("")), 256).alias("shown_sha256"))


_CATALOG = [("injection", "jailbreak", False), ("injection", "exfiltration", True), ("disclosure", "pii", False), ("disclosure", "secrets", False), ("supply_chain", "mcp_manifest_scanner", False), ("overreliance", "hallucination", False), ("overreliance", "citation_integrity", True), ("theft", None, False)]


@query(
    f"""
    SELECT category, CASE WHEN f > 0 THEN round(c / f, 4) END AS ratio, CASE WHEN f = 0 THEN 'no_control' WHEN c = f THEN 'full' WHEN c > 0 THEN 'partial' ELSE 'uncovered' END AS status FROM (
      SELECT category, sum(CASE WHEN d IS NOT NULL THEN w ELSE 0 END)::DOUBLE AS c, sum(CASE WHEN detector IS NOT NULL THEN w ELSE 0 END)::DOUBLE AS f FROM (
        SELECT category, detector, CASE WHEN adjacent THEN 0.25 ELSE 1.0 END AS w FROM (VALUES {', '.join(f"('{c}', {'NULL' if d is None else repr(d)}, {str(a).lower()})" for c, d, a in _CATALOG)}) AS v(category, detector, adjacent)) k
      LEFT JOIN (SELECT DISTINCT detector_name AS d FROM detector_timings) e ON k.detector = e.d GROUP BY category)
    """
)
def control_coverage(spark, sf_dir):
    """How much of each risk category the detectors seen in the timings cover."""
    catalog = spark.createDataFrame(_CATALOG, "category string, detector string, adjacent boolean")
    return metrics.coverage(catalog, table(spark, sf_dir, "detector_timings").select(F.col("detector_name").alias("detector")))
