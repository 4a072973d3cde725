"""Queries of bitemporal facts, change sets, provenance and training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import temporal as T
from orrery.operators import training as M
from orrery.plans.catalog import add
from orrery.session import table

V = "(SELECT 't' AS tenant_id, user_id || ':' || event_type AS fact_id, user_id AS object_id, event_type AS field, value, ts AS valid_from, NULL::TIMESTAMP AS valid_to, ts AS tx_from, lead(ts) OVER w AS tx_to, row_number() OVER w AS version FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts))"


def versions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    facts = e.select(F.lit("t").alias("tenant_id"), F.concat_ws(":", "user_id", "event_type").alias("fact_id"), F.col("user_id").alias("object_id"), F.col("event_type").alias("field"), "value", F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.col("ts").alias("recorded_at"))
    return T.assert_versions(facts)


@add("n6_versions", f"SELECT fact_id, version, tx_from, tx_to FROM {V}")
def n6(spark, sf_dir):
    return versions(spark, sf_dir).select("fact_id", "version", "tx_from", "tx_to")


@add("j6_as_of", f"SELECT fact_id, value FROM {V} WHERE valid_from <= TIMESTAMP '2024-01-15' AND tx_from <= TIMESTAMP '2024-01-15' AND (tx_to IS NULL OR tx_to > TIMESTAMP '2024-01-15')")
def j6(spark, sf_dir):
    at = F.lit("2024-01-15").cast("timestamp_ntz")
    return T.as_of(versions(spark, sf_dir), at, at).select("fact_id", "value")


@add("z2_snapshot", f"SELECT object_id, false AS conflict, field, value FROM {V} WHERE valid_from <= TIMESTAMP '2024-01-15' AND tx_from <= TIMESTAMP '2024-01-20' AND (tx_to IS NULL OR tx_to > TIMESTAMP '2024-01-20')")
def z2(spark, sf_dir):
    out = T.snapshot(versions(spark, sf_dir), F.lit("2024-01-15").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return out.select("object_id", "conflict", F.explode("values").alias("field", "value"))


@add("z3_verify", f"SELECT fact_id, version FROM {V} WHERE version % 5 = 0")
def z3(spark, sf_dir):
    """Every fifth version's value was changed behind its digest."""
    v = versions(spark, sf_dir).withColumn("value", F.when(F.col("version") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return T.verify_digests(v).select("fact_id", "version")


@add("j8_change_set", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 3 <> 0) SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.p <> b.p")
def j8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = o.where("o_orderkey % 3 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return T.change_set(o.where("o_orderkey % 5 <> 0"), new, "o_orderkey")


@add("j9_renames", """WITH o AS (SELECT 'a/' || page_id AS path, md5(html) AS h FROM pages WHERE page_id % 5 <> 0), n AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'b/' ELSE 'a/' END || page_id AS path, CASE WHEN page_id % 7 = 0 THEN md5(html || 'x') ELSE md5(html) END AS h FROM pages WHERE page_id % 11 <> 0),
    j AS (SELECT coalesce(o.path, n.path) AS path, o.h AS was, n.h AS now FROM o FULL JOIN n ON o.path = n.path),
    g AS (SELECT path, was AS h, row_number() OVER (PARTITION BY was ORDER BY path) AS k FROM j WHERE now IS NULL), c AS (SELECT path, now AS h, row_number() OVER (PARTITION BY now ORDER BY path) AS k FROM j WHERE was IS NULL)
    SELECT coalesce(c.path, g.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END AS change, CASE WHEN c.path IS NOT NULL THEN g.path END AS old_path FROM c FULL JOIN g ON c.h = g.h AND c.k = g.k
    UNION ALL SELECT path, CASE WHEN was = now THEN 'unchanged' ELSE 'modified' END, NULL FROM j WHERE was IS NOT NULL AND now IS NOT NULL""")
def j9(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    old = p.where("page_id % 5 <> 0").select(F.concat(F.lit("a/"), "page_id").alias("path"), F.md5("html").alias("content_hash"))
    new = p.where("page_id % 11 <> 0").select(F.concat(F.when(F.col("page_id") % 3 == 0, "b/").otherwise("a/"), "page_id").alias("path"), F.when(F.col("page_id") % 7 == 0, F.md5(F.concat("html", F.lit("x")))).otherwise(F.md5("html")).alias("content_hash"))
    return T.renames(old, new)


@add("z6_watermark", "SELECT event_type AS source, greatest('0', coalesce(max(lpad(event_id::VARCHAR, 12, '0')) FILTER (event_id % 4 <> 3), '0')) AS cursor FROM events GROUP BY 1")
def z6(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("cursor"), (F.col("event_id") % 4 != 3).alias("complete"))
    return T.advance_watermark(spark.createDataFrame([], "source string, cursor string"), e)


@add("z5_identity_faults", "SELECT o_custkey, count(*) AS n, 'duplicate' AS fault FROM orders GROUP BY 1 HAVING count(*) > 1")
def z5(spark, sf_dir):
    return T.identity_faults(table(spark, sf_dir, "orders"), "o_custkey")


@add("n7_hash_chain", "WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS payload FROM events), c AS (SELECT user_id, event_id, n, payload, '' AS previous_hash, sha256(payload) AS hash FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.payload, c.hash, sha256(e.payload || c.hash) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1) SELECT user_id, event_id::VARCHAR AS event_id, previous_hash, hash FROM c")
def n7(spark, sf_dir):
    return T.build_chain(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "previous_hash", "hash")


@add("n7_verify_chain", "WITH e AS (SELECT user_id, event_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) % 10 = 7, false) AS cut FROM events) SELECT user_id, event_id FROM e WHERE event_id % 10 <> 7 AND (event_id % 10 = 3 OR cut)")
def n7v(spark, sf_dir):
    """Entries that were changed (3) or whose predecessor was taken out (7)."""
    chain = T.build_chain(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").withColumn("n", F.col("event_id").cast("long"))
    chain = chain.where("n % 10 <> 7").withColumn("payload", F.when(F.col("n") % 10 == 3, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return T.chain_faults(chain, "user_id", "n").select("user_id", F.col("n").alias("event_id"))


@add("n8_latest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def n8(spark, sf_dir):
    from orrery.operators.metrics import latest

    return latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@add("n13_last_query", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_query FROM conversations")
def n13(spark, sf_dir):
    return T.current_query(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "last_query")


@add("j20_artifact_impact", "SELECT o_orderkey AS artifact FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 50 = 0 GROUP BY 1")
def j20(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    artifacts = li.groupBy(F.col("l_orderkey").alias("artifact")).agg(F.collect_set("l_partkey").alias("inputs"))
    return T.artifact_impact(artifacts, table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("revision"))).select("artifact")


@add("k12_legal_hold", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'pending_review' ELSE 'deleted' END AS status FROM customer WHERE c_acctbal < 0")
def k12(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    holds = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit(True).alias("active"))
    return T.delete_unless_held(c, c.where("c_acctbal < 0").select("c_custkey"), holds, "c_custkey")[1]


# --- training samples --------------------------------------------------------------------------------------------------


def _nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.col("c_mktsegment").alias("type"), F.concat_ws(" ", F.lit("A customer in"), "c_mktsegment").alias("description"), "c_acctbal", "c_nationkey")


def _triples(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("src"), F.col("n_nationkey").alias("dst"), F.col("c_name").alias("source"), F.lit("lives_in").alias("relation"), F.col("n_name").alias("target"))


@add("s22_conversations", "SELECT conv_id, count(*) AS n, sha256(string_agg(role || ':' || text, '|' ORDER BY turn)) AS h FROM conversations GROUP BY 1")
def s22(spark, sf_dir):
    c = M.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.size("messages").cast("long").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"), 256).alias("h"))


@add("d19_sft_checks", """WITH c AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS q, arg_max(text, turn) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1)
    SELECT conv_id, CASE WHEN u = 0 THEN 'no_user_message' WHEN length(trim(coalesce(q, ''))) < 5 THEN 'question_too_short' WHEN length(trim(q)) > 500 THEN 'question_too_long' WHEN length(trim(coalesce(a, ''))) < 10 THEN 'answer_too_short' WHEN length(trim(a)) > 8000 THEN 'answer_too_long' END AS reason FROM c""")
def d19(spark, sf_dir):
    return M.conversations(table(spark, sf_dir, "conversations")).select("conv_id", M.sft_reason(F.col("messages")).alias("reason"))


@add("a10_quality_report", """WITH d AS (SELECT CASE WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' ELSE 'passed' END AS r, sha256(text) AS k FROM documents)
    SELECT r AS reason, count(*) AS n FROM d WHERE r <> 'passed' GROUP BY 1 UNION ALL SELECT 'passed', count(DISTINCT k) FROM d WHERE r = 'passed' UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT k) FROM d WHERE r = 'passed'""")
def a10(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return M.quality_report(d, F.sha2("text", 256), F.when(F.col("n_chars") < 100, "too_short").when(F.col("n_chars") > 8000, "too_long"))


#: Distinct trigrams of a text in lower case.
GRAMS = "list_distinct([substr(lower(text), i, 3) FOR i IN range(1, length(text) - 1)])"


@add("a11_diversity", f"""WITH s AS (SELECT item_id, {GRAMS} AS g, row_number() OVER (ORDER BY sha256(item_id::VARCHAR), item_id) AS r FROM benchmark), t AS (SELECT * FROM s WHERE r <= 100)
    SELECT round(coalesce(1 - avg(CASE WHEN len(a.g) + len(b.g) = 0 THEN 1 ELSE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) END), 1), 3) AS diversity FROM t a JOIN t b ON a.r < b.r""")
def a11(spark, sf_dir):
    return M.diversity(table(spark, sf_dir, "benchmark"), "item_id", "text")


#: The split of exact_split over rows with a key and a number n of rows.
SPLIT = "CASE WHEN r < floor(n * 0.8) THEN 'train' WHEN r < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split"


def ranked(key: str) -> str:
    return f"row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || {key}), 1, 15))::BIGINT, {key}) - 1 AS r, count(*) OVER () AS n"


@add("w3_exact_split", f"SELECT doc_id, {SPLIT} FROM (SELECT doc_id, {ranked('doc_id')} FROM documents)")
def w3(spark, sf_dir):
    return M.exact_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@add("m1_entity_qa", "SELECT c_custkey AS id, 'entity' AS kind, 'What is ' || c_name || '?' AS question FROM customer UNION ALL SELECT c_custkey, 'attribute', 'What is the c_nationkey of ' || c_name || '?' FROM customer")
def m1(spark, sf_dir):
    return M.entity_qa(_nodes(spark, sf_dir), ["c_nationkey"]).select("id", "kind", F.col("messages")[0]["content"].alias("question"))


@add("m2_relation_qa", "SELECT c_custkey AS src, c_name || ' lives in ' || n_name || '.' AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey")
def m2(spark, sf_dir):
    return M.relation_qa(_triples(spark, sf_dir)).select("src", F.col("messages")[1]["content"].alias("answer"))


@add("m3_summaries", r"""SELECT doc_id, sha256('Summarise this text:' || chr(10) || substr(text, 1, 800)) AS prompt, sha256(array_to_string(list_filter(string_split(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')[1:3], ' ')) AS summary FROM documents WHERE length(text) >= 100""")
def m3(spark, sf_dir):
    m = M.summaries(table(spark, sf_dir, "documents"), "doc_id", "text")
    return m.select("doc_id", F.sha2(F.col("messages")[0]["content"], 256).alias("prompt"), F.sha2(F.col("messages")[1]["content"], 256).alias("summary"))


@add("m4_multi_turn", """WITH t AS (SELECT n_nationkey, n_name, c_name, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY n_nationkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_nationkey AS src, string_agg('user:What does ' || n_name || ' have to do with ' || c_name || '?|assistant:' || n_name || ' is home of ' || c_name || '.', '|' ORDER BY k) || '|user:Thank you. That is all on ' || n_name || '.' AS messages FROM t WHERE k <= 3 AND n >= 2 GROUP BY n_nationkey, n_name""")
def m4(spark, sf_dir):
    t = _triples(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("target").alias("source"), F.lit("is_home_of").alias("relation"), F.col("source").alias("target"))
    return M.multi_turn(t).select("src", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


@add("m5_rag_aggregational", "SELECT c_mktsegment AS type, count(*)::VARCHAR AS answer, 'How many ' || c_mktsegment || ' are there?' AS question, 'hard' AS difficulty FROM customer GROUP BY 1")
def m5(spark, sf_dir):
    return M.rag_aggregational(_nodes(spark, sf_dir)).select("type", "answer", "question", "difficulty")


@add("m5_rag_factual", "SELECT c_custkey AS src, n_name AS answer, [c_name || ' lives in ' || n_name || '.'] AS contexts FROM customer JOIN nation ON c_nationkey = n_nationkey")
def m5f(spark, sf_dir):
    return M.rag_factual(_triples(spark, sf_dir)).select("src", "answer", "contexts")


@add("m6_tool_samples", """SELECT c_custkey AS id, '{"name":"lookup","arguments":{"query":"' || c_name || '"}}' AS call FROM customer""")
def m6(spark, sf_dir):
    return M.tool_samples(_nodes(spark, sf_dir)).select("id", F.col("tool_calls")[0].alias("call"))


SAY = """'[{"role":"user","content":' || to_json(q)::VARCHAR || '},{"role":"assistant","content":' || to_json(a)::VARCHAR || '}]'"""


@add("m9_pipeline", f"""WITH g AS (SELECT 'entity' AS generator, 'What is ' || c_name || '?' AS q, 'A customer in ' || c_mktsegment AS a FROM customer UNION ALL SELECT 'entity', 'What is the c_nationkey of ' || c_name || '?', 'The c_nationkey of ' || c_name || ' is ' || c_nationkey || '.' FROM customer
    UNION ALL SELECT 'relation', 'How is ' || c_name || ' related to ' || n_name || '?', c_name || ' lives in ' || n_name || '.' FROM customer JOIN nation ON c_nationkey = n_nationkey),
    k AS (SELECT generator, sha256({SAY}) AS key FROM g WHERE length(q) BETWEEN 5 AND 500 AND length(a) BETWEEN 10 AND 8000), c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY generator ORDER BY sha256('42:' || key), key) <= 500)
    SELECT generator, key, {SPLIT} FROM (SELECT generator, key, {ranked('key')} FROM (SELECT key, min(generator) AS generator FROM c GROUP BY 1))""")
def m9(spark, sf_dir):
    parts = {"entity": M.entity_qa(_nodes(spark, sf_dir), ["c_nationkey"]), "relation": M.relation_qa(_triples(spark, sf_dir))}
    return M.pipeline(parts, 1000).select("generator", "key", "split")


@add("k4_implicit_usage", "SELECT doc_id AS id, 'license' AS name, least(1.0::DOUBLE, 0.1::DOUBLE * ((length(text) - length(replace(lower(text), 'license', ''))) / 7)) AS relevance FROM documents WHERE contains(lower(text), 'license')")
def k4(spark, sf_dir):
    return M.implicit_usage(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), ["license"])


@add("k10_sequence_gaps", "SELECT l_orderkey, missing FROM (SELECT l_orderkey, unnest(range(min(l_linenumber), max(l_linenumber)))::INT AS missing FROM lineitem GROUP BY 1) g WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = g.l_orderkey AND l.l_linenumber = g.missing)")
def k10(spark, sf_dir):
    from orrery.sources.documents import sequence_gaps

    return sequence_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")
