"""Queries of routing, catalogues and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import routing as R
from orrery.plans.catalog import add
from orrery.session import table


@add("u3_release_diff", "SELECT o_orderkey AS resource_id, CASE WHEN o_orderkey % 5 = 0 THEN 'added' WHEN o_orderkey % 3 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 3 = 0) OR (o_orderkey % 7 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0)")
def u3(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource_id"), F.sha2("o_orderstatus", 256).alias("revision_id"))
    new = o.where("resource_id % 3 <> 0").withColumn("revision_id", F.when(F.col("resource_id") % 7 == 0, F.lit("x")).otherwise(F.col("revision_id")))
    return R.release_diff(o.where("resource_id % 5 <> 0"), new)


@add("j22_template_tools", "SELECT DISTINCT p_partkey AS resource_id, p_brand AS revision_id, p_name AS template, 'ship-' || l_linestatus AS tool FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 45 AND p_partkey % 4 <> 0")
def j22(spark, sf_dir):
    """Templates of parts at their brand; tools of lines, of which some name an older brand."""
    p, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").where("l_quantity > 45")
    tools = line.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_partkey").alias("resource_id"), F.when(F.col("p_partkey") % 4 == 0, "older").otherwise(F.col("p_brand")).alias("revision_id"), F.concat(F.lit("ship-"), "l_linestatus").alias("tool")).distinct()
    return R.template_tools(p.select(F.col("p_partkey").alias("resource_id"), F.col("p_brand").alias("revision_id"), F.col("p_name").alias("template")), tools)


@add("r4_search_text", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, 'part', 'sum p_retailprice') AS search_text FROM part")
def r4(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lit("Metric").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("display_name"), F.col("p_type").alias("description"), F.array(F.lit("part")).alias("tags"), F.create_map(F.lit("aggregation"), F.lit("sum"), F.lit("measure"), F.lit("p_retailprice")).alias("spec"))
    return R.search_text(p).select("p_partkey", "search_text")


@add("r7_route_questions", """WITH q AS (SELECT item_id AS qid, lower(text) AS t FROM benchmark), v AS (SELECT * FROM (VALUES ('m1', 'the', 'metric'), ('m2', 'tion', 'metric'), ('d1', 'and', 'dimension')) x(card, term, kind)),
    h AS (SELECT qid, card, kind, 1.0 AS score, 'vocabulary' AS way FROM q JOIN v ON contains(t, term)), s AS (SELECT DISTINCT qid, 's1' AS card, 'scene' AS kind, 0.8 AS score, 'scene' AS way FROM h WHERE card = 'm1')
    SELECT * FROM h UNION ALL SELECT * FROM s UNION ALL SELECT qid, 'f' AS card, 'fallback' AS kind, 0.5 AS score, 'search' AS way FROM q WHERE qid NOT IN (SELECT qid FROM h)""")
def r7(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    v = spark.createDataFrame([("m1", "the", "metric"), ("m2", "tion", "metric"), ("d1", "and", "dimension")], "card string, term string, kind string")
    scenes = spark.createDataFrame([("m1", "s1")], "metric string, scene string")
    fallback = q.select("qid", F.lit("f").alias("card"), F.lit("fallback").alias("kind"), F.lit(0.5).alias("score"))
    return R.route_questions(q, v, scenes, fallback)


@add("t7_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def t7(spark, sf_dir):
    return R.top_k(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 25)


@add("p9_sql_functions", "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN '****' ELSE substr(c_name, 1, 2) || '****' || substr(c_name, -2, 2) END AS masked FROM customer")
def p9(spark, sf_dir):
    R.register_functions(spark)
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr("orrery_mask(c_name)").alias("masked"))


@add("z15_sync_plan", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'download' WHEN o_orderkey % 5 = 0 THEN 'upload' WHEN o_orderkey % 2 = 0 THEN 'upload' ELSE 'download' END AS action FROM orders WHERE (o_orderkey % 4 = 0) <> (o_orderkey % 5 = 0) OR (o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 3 = 0)")
def z15(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("hash"), F.lit(5).alias("updated_at"))
    theirs = o.where("key % 5 <> 0").withColumn("hash", F.when(F.col("key") % 3 == 0, "x").otherwise(F.col("hash"))).withColumn("updated_at", F.when(F.col("key") % 2 == 0, 1).otherwise(9))
    return R.sync_plan(o.where("key % 4 <> 0"), theirs, "merge")


@add("f4_graph_predicates", "SELECT c_custkey FROM customer WHERE (c_acctbal >= 500 AND starts_with(c_mktsegment, 'B')) OR NOT (contains(c_name, '1') OR c_nationkey NOT IN (1, 2, 3))")
def f4(spark, sf_dir):
    p = R.compare
    test = (p("c_acctbal", ">=", 500) & p("c_mktsegment", "STARTS WITH", "B")) | ~(p("c_name", "CONTAINS", "1") | ~p("c_nationkey", "IN", [1, 2, 3]))
    return table(spark, sf_dir, "customer").where(test).select("c_custkey")


@add("d7_explain_fact", "SELECT n_nationkey::VARCHAR AS t0, CASE WHEN n_regionkey = 1 THEN NULL WHEN n_nationkey < 10 THEN 'ruleset:rule-1' ELSE 'ruleset:rule-2' END AS rule_id, CASE WHEN n_regionkey = 1 THEN 'asserted' ELSE 'derived' END AS how FROM nation WHERE n_nationkey IN (0, 1, 6, 12, 14)")
def d7(spark, sf_dir):
    from orrery.operators.datalog import infer

    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("t0"), "n_nationkey", "n_regionkey")
    facts = {"place": n.where("n_regionkey = 1").select("t0"), "low": n.where("n_nationkey < 10").select("t0"), "nation": n.select("t0")}
    derived = infer(spark, "place(X) :- low(X).\nplace(X) :- nation(X), not low(X).", facts, proofs=True)["place"]
    out = None
    for k in (0, 1, 6, 12, 14):
        one = R.explain_fact(derived, [str(k)])
        out = one if out is None else out.unionByName(one)
    return out