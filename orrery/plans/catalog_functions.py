"""Queries of the scalar functions (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import audit, metrics
from orrery.plans.catalog import add
from orrery.plans.catalog_sources import q
from orrery.plans.query_plane import render
from orrery.session import table


@add("x1_digest", """SELECT c_custkey, 'sha256:' || sha256('{"k":' || c_custkey || ',"name":"' || c_name || '"}') AS digest FROM customer""")
def x1(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.digest(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).alias("digest"))


@add("x5_entity_candidates", """WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_-]{2,})', 1)) AS t FROM benchmark), k AS (SELECT item_id, t FROM w WHERE lower(t) NOT IN ('the', 'and') UNION ALL SELECT item_id, unnest(['数据模型', '数据模', '据模型', '数据', '据模', '模型']) FROM benchmark)
    SELECT item_id, list(t ORDER BY length(t) DESC, t DESC) AS candidates FROM k GROUP BY 1""")
def x5(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.entity_candidates(F.concat("text", F.lit(" 数据模型")), ("the", "and")).alias("candidates"))


@add("x8_instant", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL '2 hours' END AS at FROM events")
def x8(spark, sf_dir):
    k = F.col("event_id") % 3
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k == 0, "").when(k == 1, "Z").otherwise("+02:00"))
    return table(spark, sf_dir, "events").select("event_id", X.instant(text).cast("timestamp_ntz").alias("at"))


@add("x9_fingerprint", "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 9000 THEN sha256(text) ELSE 'sampled' END AS fingerprint FROM documents")
def x9(spark, sf_dir):
    """Whole texts below the bound; above it the sampled hash, which must differ from the whole one."""
    c = F.col("text").cast("binary")
    made = X.sampled_fingerprint(c, 9000)
    large = F.octet_length(c) > 9000
    return table(spark, sf_dir, "documents").select("doc_id", F.when(large & (made != F.sha2(c, 256)) & (F.length(made) == 64), "sampled").otherwise(made).alias("fingerprint"))


@add("x10_front_matter", "SELECT c_custkey, c_name AS title, c_mktsegment AS type, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a' END AS tag FROM customer")
def x10(spark, sf_dir):
    text = F.concat(q('---\ntitle: "{c_name}"\ntype : {c_mktsegment}\n# note\ntag: a\n'), F.when(F.col("c_custkey") % 2 == 0, "tag: 'b'\n").otherwise(""), F.lit("---\nbody: no"))
    m = X.front_matter(text)
    return table(spark, sf_dir, "customer").select("c_custkey", m["title"].alias("title"), m["type"].alias("type"), m["tag"].alias("tag"))


@add("x11_normalise_link", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a/' || c_custkey WHEN 1 THEN 'b/' || c_custkey || '.md' WHEN 2 THEN 'Page ' || c_custkey ELSE c_custkey || '.md' END AS link FROM customer")
def x11(spark, sf_dir):
    k = F.col("c_custkey") % 4
    link = F.when(k == 0, q("/a/./x/../{c_custkey}#top")).when(k == 1, q("../../b//{c_custkey}.md")).when(k == 2, q("[[Page {c_custkey}|the page]]")).otherwise(q("./{c_custkey}.md"))
    return table(spark, sf_dir, "customer").select("c_custkey", X.normalise_link(link).alias("link"))


@add("x12_concepts", "SELECT p_partkey, list_sort(list_distinct(['bold ' || p_partkey, 'it ' || p_partkey, 'under ' || p_size, 'code ' || p_brand, 'CamelCase', 'Head ' || p_name, 'Term'])) AS concepts FROM part")
def x12(spark, sf_dir):
    text = q("# Head {p_name}\nA **bold {p_partkey}** and *it {p_partkey}* and _under {p_size}_ with `code {p_brand}` in CamelCase, a snake_case_name, 2 * 3 * 4, and Term (x).")
    return table(spark, sf_dir, "part").select("p_partkey", X.concepts(text).alias("concepts"))


@add("x13_code_language", "SELECT c_custkey, ['python', 'sql', 'java', 'javascript', 'html', 'text'][1 + c_custkey % 6] AS language FROM customer")
def x13(spark, sf_dir):
    texts = F.array(*[q(t) for t in ("def f{c_custkey}(x):\n  pass", "SELECT a{c_custkey} FROM t", "public class A{c_custkey} {}", "const x{c_custkey} = 1", "<div id='{c_custkey}'>", "plain {c_custkey}")])
    return table(spark, sf_dir, "customer").select("c_custkey", X.code_language(F.element_at(texts, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("language"))


@add("x14_sql_features", "SELECT c_custkey, list_sort(['db.t' || c_nationkey, 'u']) AS tables, ['n' || c_custkey, 'm'] AS aliases FROM customer")
def x14(spark, sf_dir):
    sql = q("SELECT count(*) AS n{c_custkey}, max(x) as m FROM db.T{c_nationkey} JOIN u ON 1 = 1 join U on 2 = 2")
    return table(spark, sf_dir, "customer").select("c_custkey", X.sql_tables(sql).alias("tables"), X.sql_aliases(sql).alias("aliases"))


@add("x16_red_lines", "SELECT c_custkey, list_filter(['You must pay ' || c_custkey, '禁止共享密码', 'It NEVER ends'], lambda s: length(s) >= 6) AS lines FROM customer")
def x16(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.red_lines(q("You must pay {c_custkey}. Nice day; must\n禁止共享密码。It NEVER ends")).alias("lines"))


@add("x17_intent_scores", """WITH s AS (SELECT item_id, ((contains(lower(text), 'the'))::INT + (contains(lower(text), 'tion'))::INT) / 2 AS a, (contains(lower(text), 'zzz'))::INT / 1 AS b, ((contains(lower(text), 'sh'))::INT + (contains(lower(text), 'qu'))::INT + (contains(lower(text), 'ed'))::INT) / 3 AS c FROM benchmark)
    SELECT item_id, round(CASE WHEN a + b + c > 0 THEN a / (a + b + c) ELSE 0 END, 9) AS a, round(CASE WHEN a + b + c > 0 THEN b / (a + b + c) ELSE 0 END, 9) AS b, round(CASE WHEN a + b + c > 0 THEN c / (a + b + c) ELSE 0 END, 9) AS c FROM s""")
def x17(spark, sf_dir):
    m = X.intent_scores(F.col("text"), {"a": ["the", "tion"], "b": ["zzz"], "c": ["sh", "qu", "ed"]})
    return table(spark, sf_dir, "benchmark").select("item_id", *[F.round(m[k], 9).alias(k) for k in "abc"])


@add("x18_intent_route", "SELECT item_id, CASE WHEN regexp_matches(lower(text), '^th') THEN 'starts' WHEN regexp_matches(lower(text), 'tion|ment') THEN 'noun' ELSE 'other' END AS route FROM benchmark")
def x18(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.route(F.col("text"), [("starts", "^th"), ("noun", "tion|ment")], "other").alias("route"))


@add("x19_render", "SELECT n_nationkey, 'MATCH (n:' || n_name || ') RETURN n LIMIT ' || n_regionkey AS text FROM nation")
def x19(spark, sf_dir):
    """Templates are metadata: one is rendered for each nation on the driver."""
    rows = table(spark, sf_dir, "nation").collect()
    return spark.createDataFrame([(r.n_nationkey, render("MATCH (n:${label}) RETURN n LIMIT ${k}", {"label": r.n_name, "k": r.n_regionkey})) for r in rows], "n_nationkey int, text string")


@add("x20_mapping_relevance", "SELECT p_partkey, least(1.0, CASE WHEN contains(lower(p_brand), 'brand#2') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(p_name), 'brand#2') THEN 0.9 ELSE 0 END + CASE WHEN contains(lower(p_type), 'brand#2') THEN 0.5 ELSE 0 END + CASE WHEN contains('see brand#' || p_size, 'brand#2') THEN 0.7 ELSE 0 END)::DOUBLE AS score FROM part")
def x20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.mapping_relevance(F.lit("BRAND#2"), F.col("p_brand"), F.col("p_name"), F.col("p_type"), q("see Brand#{p_size}")).alias("score"))


@add("x21_substring_weights", """WITH h AS (SELECT p_partkey, contains(lower(p_name), 'red') AS a, contains(lower(p_brand), 'red') AS b, contains(lower(p_name), '2') AS c, contains(lower(p_brand), '2') AS d FROM part)
    SELECT p_partkey, CASE WHEN (a OR b) AND (c OR d) THEN 12 * a::INT + 4 * b::INT + 12 * c::INT + 4 * d::INT ELSE 0 END::DOUBLE AS score FROM h""")
def x21(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.weighted_substrings(["RED", "2"], {"display_name": F.col("p_name"), "tags": F.col("p_brand")}).alias("score"))


@add("x23_human_bytes", "WITH b AS (SELECT c_custkey, (c_custkey + 1) * (1::BIGINT << (10 * (c_custkey % 4))) AS n FROM customer) SELECT c_custkey, CASE WHEN n < 1024 THEN format('{:,.1f} B', n::DOUBLE) WHEN n < 1048576 THEN format('{:,.1f} KB', n / 1024) WHEN n < 1073741824 THEN format('{:,.1f} MB', n / 1048576) WHEN n < 1099511627776 THEN format('{:,.1f} GB', n / 1073741824) ELSE format('{:,.1f} TB', n / 1099511627776) END AS size FROM b")
def x23(spark, sf_dir):
    n = (F.col("c_custkey") + 1) * F.pow(F.lit(1024), F.col("c_custkey") % 4).cast("long")
    return table(spark, sf_dir, "customer").select("c_custkey", X.human_bytes(n).alias("size"))


@add("x25_improvement_terms", "SELECT c_custkey, list_sort(list_distinct(['quoted ' || c_custkey, 'CamelCase', 'API', c_mktsegment])) AS terms FROM customer")
def x25(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.improvement_terms(q('say "quoted {c_custkey}" of CamelCase and API in {c_mktsegment}, A')).alias("terms"))


@add("x26_csv_guard", "SELECT c_custkey, CASE WHEN c_custkey % 7 < 5 THEN '''' ELSE '' END || ['=', '+', '-', '@', ' =', 'x', ' x'][1 + c_custkey % 7] || c_name AS cell FROM customer")
def x26(spark, sf_dir):
    first = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", " =", "x", " x")]), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", audit.csv_guard(F.concat(first, "c_name")).alias("cell"))


@add("x27_finite", "SELECT c_custkey, c_acctbal AS n FROM customer")
def x27(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", metrics.finite(F.col("c_acctbal")).alias("n"))


@add("x28_path_text", "SELECT c_custkey, c_name || ' --lives_in--> ' || n_name || ' --part_of--> ' || r_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def x28(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("c_custkey", X.path_text(F.array("c_name", "n_name", "r_name"), F.array(F.lit("lives_in"), F.lit("part_of"))).alias("text"))


@add("x29_pick_label", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'zh' WHEN c_custkey % 3 = 1 THEN 'none' ELSE 'en' END || c_custkey AS label FROM customer")
def x29(spark, sf_dir):
    k = F.col("c_custkey") % 3
    item = lambda name, lang: F.struct(q(name + "{c_custkey}").alias("text"), F.lit(lang).cast("string").alias("lang"))
    labels = F.when(k == 0, F.array(item("en", "en"), item("zh", "zh"), item("none", None))).when(k == 1, F.array(item("de", "de"), item("en", "en"), item("none", None))).otherwise(F.array(item("de", "de"), item("en", "en")))
    return table(spark, sf_dir, "customer").select("c_custkey", X.pick_label(labels).alias("label"))


@add("x30_triplet", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS source, CASE WHEN c_custkey % 3 <> 0 THEN 'lives in' END AS relation, CASE WHEN c_custkey % 3 <> 0 THEN 'N' || c_nationkey END AS target FROM customer")
def x30(spark, sf_dir):
    t = X.parse_triplet(F.when(F.col("c_custkey") % 3 == 0, q("{c_name} -> nothing")).otherwise(q("{c_name} -> lives in->N{c_nationkey}")))
    return table(spark, sf_dir, "customer").select("c_custkey", t["source"].alias("source"), t["relation"].alias("relation"), t["target"].alias("target"))
