"""Queries of the Cypher subset and the smaller operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import governance as G
from orrery.plans import cypher
from orrery.plans.catalog import add
from orrery.session import table


def _graph(spark, sf_dir):
    c, n, o = (table(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col))
    nodes = c.select(key("c", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.array(F.lit("Customer"), F.col("c_mktsegment")).alias("labels"), F.col("c_acctbal").alias("balance"))
    nodes = nodes.unionByName(n.select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array(F.lit("Nation")).alias("labels"), F.lit(None).cast("double").alias("balance")))
    edges = c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("lives_in").alias("relation"))
    return nodes, edges.unionByName(o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")).where("k > 20").select(key("c", "o_custkey").alias("src"), F.lit("n0").alias("dst"), F.lit("ships_to").alias("relation")))


@add("g17_cypher_path", "SELECT c_name AS a_name, n_name AS b_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 AND (contains(c_name, '1') OR starts_with(n_name, 'C')) AND c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 30")
def g17(spark, sf_dir):
    return cypher.run("MATCH (a:BUILDING)-[r:lives_in]->(b:Nation) WHERE a.balance > 9000 AND (a.name CONTAINS '1' OR b.name STARTS WITH 'C') RETURN a.name, b.name ORDER BY a.name LIMIT 30", *_graph(spark, sf_dir))


@add("g17_cypher_count", "SELECT n_name AS b_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey NOT IN (1, 2) GROUP BY 1")
def g17c(spark, sf_dir):
    return cypher.run("MATCH (b:Nation)<-[r:lives_in]-(a:Customer) WHERE NOT b.id IN ['n1', 'n2'] RETURN b.name, count(*) ORDER BY count(*) DESC", *_graph(spark, sf_dir))


@add("p6_query_template", "SELECT 'c' || c_custkey AS n_id, c_name AS n_name FROM customer WHERE contains(c_name, '7') ORDER BY 1 LIMIT 15")
def p6(spark, sf_dir):
    return cypher.template("label_search", {"label": "Customer", "text": "7", "limit": 15}, *_graph(spark, sf_dir))


@add("f12_label_page", "SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY 1 LIMIT 20 OFFSET 10")
def f12(spark, sf_dir):
    return G.label_page(_graph(spark, sf_dir)[0], ["BUILDING", "MACHINERY"], 10, 20).select("id")


@add("a21_history", "SELECT event_type, count(*) AS n, avg((event_id % 5 <> 0)::INT) AS success_rate, sum(event_id)::BIGINT AS bytes FROM events GROUP BY 1")
def a21(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 5 != 0, "success").otherwise("failed").alias("status"), F.col("event_id").alias("bytes"))
    return G.history(e, "event_type")


@add("n10_refresh_average", "WITH r AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, round(sum(x * 0.9::DOUBLE ** (n - i) * CASE WHEN i = 1 THEN 1 ELSE 0.1::DOUBLE END), 6) AS average FROM r GROUP BY 1")
def n10(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return G.refresh_average(e, "user_id", "at", "value").withColumn("average", F.round("average", 6))


@add("k7_schema_faults", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ['type:k'] ELSE ['missing:z', 'type:k'] END AS faults FROM events""")
def k7(spark, sf_dir):
    value = F.when(F.col("event_id") % 2 == 0, F.regexp_replace("props", r"\}$", ', "z": true}')).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", G.schema_faults(value, {"k": "string", "z": "boolean"}, ["z"], False).alias("faults"))


@add("k14_config_faults", "SELECT c_custkey, 'range:c_acctbal' AS fault FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000")
def k14(spark, sf_dir):
    return G.config_faults(table(spark, sf_dir, "customer"), {"c_acctbal": (0.0, 9000.0)}, ["c_name"], "c_custkey")


@add("j16_table_references", "SELECT page_id, list_sort(list(DISTINCT t)) AS tables FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '([a-z_][\\w]*(?:\\.[a-z_][\\w]*)?)')) AS w FROM pages) JOIN (VALUES ('db.title'), ('db.body'), ('db.none')) v(t) ON w = t OR 'db.' || w = t GROUP BY 1")
def j16(spark, sf_dir):
    tables = spark.createDataFrame([("db.title",), ("db.body",), ("db.none",)], "`table` string")
    return G.table_references(table(spark, sf_dir, "pages"), tables, "page_id", "html")


@add("s18_parse_route", "SELECT page_id, 'unsupported' AS route FROM pages WHERE NOT regexp_matches(lower(url), '\\.(txt|md|json|jsonl|csv|html)$') UNION ALL SELECT page_id, 'direct' FROM pages WHERE regexp_matches(lower(url), '\\.(txt|md|json|jsonl|csv|html)$')")
def s18(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", G.parse_route(F.col("url"), True).alias("route"))


@add("d16_regressions", "SELECT n_nationkey AS case_id, CASE WHEN n_nationkey % 5 = 0 THEN 'missing' WHEN n_nationkey % 3 = 0 THEN 'sql' ELSE 'ids' END AS fault FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 3 = 0 OR n_nationkey % 7 = 0")
def d16(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id"), F.col("n_name").alias("sql"), F.array("n_regionkey", F.lit(9)).alias("ids"))
    now = n.where("case_id % 5 <> 0").select("case_id", F.when(F.col("case_id") % 3 == 0, "x").otherwise(F.col("sql")).alias("sql"), F.when(F.col("case_id") % 7 == 0, F.array(F.lit(9))).otherwise(F.reverse("ids")).alias("ids"))
    return G.contract_regressions(n, now)
