"""Queries of graphs and rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import datalog, graph
from orrery.plans.catalog import add
from orrery.session import table

#: Who bought from whom; and nations whose trade is above a tenth over the mean, a graph sparse enough for paths.
EDGE = "(SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
#: Which order follows which: a customer's orders of one status, and of one priority, in the order of their dates; and, for
#: every seventh customer, the first order after the last, which closes cycles. All orders are in it.
NEXT = """(SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS dst FROM orders
    UNION SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) FROM orders
    UNION SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)), arg_min(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey HAVING count(*) > 1) WHERE dst IS NOT NULL)"""


def edges(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.lit(1000000) + F.col("l_suppkey")).alias("dst")).distinct()


def succession(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    then = lambda by: o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey", by).orderBy("o_orderdate", "o_orderkey")).alias("dst"))
    at = F.struct("o_orderdate", "o_orderkey")
    back = o.where("o_custkey % 7 = 0").groupBy("o_custkey").agg(F.max(at)["o_orderkey"].alias("src"), F.min(at)["o_orderkey"].alias("dst"), F.count(F.lit(1)).alias("n")).where("n > 1").select("src", "dst")
    return then("o_orderstatus").unionByName(then("o_orderpriority")).unionByName(back).where("dst is not null").distinct()


def nodes_of(e):
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@add("g1_degrees", f"WITH e AS {EDGE} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1")
def g1(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


HOME = "(SELECT o_orderkey AS src, o_custkey + 10000000 AS dst FROM orders)"


def homes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 10000000).alias("dst"))


@add("g2_statistics", f"""WITH RECURSIVE e AS {HOME}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS root, src AS id FROM u UNION SELECT r.root, u.dst FROM r JOIN u ON r.id = u.src),
    c AS (SELECT id, min(root) AS c FROM r GROUP BY 1), d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
    SELECT count(*) AS n, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM e) / (count(*) * (count(*) - 1)) AS density, avg(k) AS avg_degree, min(k) AS min_degree, max(k) AS max_degree, (SELECT count(DISTINCT c) FROM c) AS components FROM d""")
def g2(spark, sf_dir):
    e = homes(spark, sf_dir)
    return graph.statistics(nodes_of(e), e)


@add("g5_components", "WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_custkey + 10000000 AS dst FROM orders), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS root, src AS id FROM u UNION SELECT r.root, u.dst FROM r JOIN u ON r.id = u.src) SELECT id, min(root) AS component FROM r GROUP BY 1")
def g5(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + 10000000).alias("dst"))
    return graph.weak_components(nodes_of(e), e)


@add("g3_pagerank", f"WITH e AS {EDGE}, w AS (SELECT src, count(*) AS w FROM e GROUP BY 1), y AS (SELECT src AS id, 1.0::DOUBLE AS y FROM w UNION ALL SELECT dst, 1 + 0.85::DOUBLE * sum(1.0::DOUBLE / w) FROM e JOIN w USING (src) GROUP BY 1) SELECT id, round(y / (SELECT sum(y) FROM y), 9) AS rank FROM y ORDER BY y DESC, id LIMIT 20")
def g3(spark, sf_dir):
    """Edges go from customers to suppliers only, so the ranks have a closed form; tests hold cyclic graphs to plain rounds."""
    e = edges(spark, sf_dir)
    return graph.pagerank(nodes_of(e), e, k=20).withColumn("rank", F.round("rank", 9))


@add("g4_degree_centrality", f"WITH e AS {EDGE}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT id, k / ((SELECT count(*) FROM d) - 1) AS centrality FROM d")
def g4(spark, sf_dir):
    e = edges(spark, sf_dir)
    return graph.degree_centrality(nodes_of(e), e)


@add("g4_closeness", f"""WITH RECURSIVE e AS {NEXT}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id AS root, id, 0 AS d FROM n UNION SELECT root, e.src, d + 1 FROM r JOIN e ON e.dst = r.id WHERE d < 40),
    b AS (SELECT root, id, min(d) AS d FROM r GROUP BY ALL), s AS (SELECT root, sum(d) AS s, count(*) - 1 AS r FROM b GROUP BY 1) SELECT root AS id, CASE WHEN s > 0 THEN r / s * r / ((SELECT count(*) FROM n) - 1) ELSE 0 END AS closeness FROM s""")
def g4c(spark, sf_dir):
    e = succession(spark, sf_dir)
    return graph.closeness(nodes_of(e), e, nodes_of(e))


@add("g4_betweenness")
def g4b(spark, sf_dir):
    e = succession(spark, sf_dir)
    return graph.betweenness(nodes_of(e), e)


@add("g4_eigenvector")
def g4e(spark, sf_dir):
    """Over all trade between nations (customers and suppliers alone are two sides, on which power iteration settles slowly);
    held to numpy's eigenvector by a test."""
    e = trade(spark, sf_dir)
    return graph.eigenvector(nodes_of(e), e).withColumn("eigenvector", F.round("eigenvector", 4))


@add("g9_closure", f"WITH RECURSIVE e AS {NEXT}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c")
def g9(spark, sf_dir):
    return graph.closure(succession(spark, sf_dir)).select("src", "dst")


@add("g10_reach", f"WITH RECURSIVE e AS {NEXT}, r AS (SELECT src AS root, dst AS id, 1 AS depth FROM e UNION SELECT root, e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 2) SELECT root, id, min(depth) AS depth FROM r WHERE id <> root GROUP BY ALL")
def g10(spark, sf_dir):
    e = succession(spark, sf_dir)
    return graph.reach(e, nodes_of(e), 2)


@add("g18_cycles", f"WITH RECURSIVE e AS {NEXT}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src AS id FROM c WHERE src = dst")
def g18(spark, sf_dir):
    return graph.cycles(succession(spark, sf_dir))


LONGEST = "(SELECT list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS path, o_custkey FROM orders WHERE o_custkey % 7 <> 0 GROUP BY o_custkey, o_orderstatus ORDER BY count(*) DESC, o_custkey, o_orderstatus LIMIT 1)"


def _ends(spark, sf_dir):
    """First and last order of the longest run of one customer's orders of one status."""
    rows = table(spark, sf_dir, "orders").where("o_custkey % 7 <> 0").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o_orderdate", "o_orderkey")).alias("a"), F.max(F.struct("o_orderdate", "o_orderkey")).alias("b"))
    best = rows.orderBy(F.desc("n"), "o_custkey", "o_orderstatus").first()
    return best["a"]["o_orderkey"], best["b"]["o_orderkey"]


@add("g6_shortest_path", f"""WITH RECURSIVE e AS {NEXT}, x AS {LONGEST}, p AS (SELECT path[1] AS id, [path[1]] AS path FROM x UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.id, x WHERE p.id <> x.path[-1] AND NOT list_contains(p.path, e.dst))
    SELECT p.path, true AS exists FROM p, x WHERE p.id = x.path[-1] ORDER BY len(p.path), p.path LIMIT 1""")
def g6(spark, sf_dir):
    return graph.shortest_path(succession(spark, sf_dir), *_ends(spark, sf_dir))


@add("g7_all_paths", f"""WITH RECURSIVE e AS {NEXT}, x AS {LONGEST}, p AS (SELECT path[1] AS id, [path[1]] AS path FROM x UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.id, x WHERE p.id <> x.path[-1] AND NOT list_contains(p.path, e.dst) AND len(p.path) < 6) SELECT DISTINCT p.path FROM p, x WHERE p.id = x.path[-1]""")
def g7(spark, sf_dir):
    return graph.all_paths(succession(spark, sf_dir), *_ends(spark, sf_dir))


@add("g8_label_propagation")
def g8(spark, sf_dir):
    """Until labels settle, on the whole graph of trade; tests hold the settled labels to their definition."""
    e = edges(spark, sf_dir)
    return graph.label_propagation(nodes_of(e), e)


def trade(spark, sf_dir):
    """Every line as an edge between the nations of its supplier and its customer: weights are numbers of lines."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"))


@add("g8_louvain")
def g8l(spark, sf_dir):
    e = trade(spark, sf_dir)
    return graph.louvain(nodes_of(e), e)


@add("g8_greedy_modularity")
def g8g(spark, sf_dir):
    e = trade(spark, sf_dir)
    return graph.greedy_modularity(nodes_of(e), e)


@add("g8_modularity", f"WITH e AS {EDGE}, l AS (SELECT src, dst, src % 5 AS la, dst % 5 AS lb FROM e), k AS (SELECT lab, count(*) AS k FROM (SELECT la AS lab FROM l UNION ALL SELECT lb FROM l) GROUP BY 1), i AS (SELECT la AS lab, count(*) AS l FROM l WHERE la = lb GROUP BY 1) SELECT round(sum(coalesce(l, 0) / (SELECT count(*) FROM e) - (k / (2.0 * (SELECT count(*) FROM e))) ** 2), 9) AS modularity FROM k LEFT JOIN i USING (lab)")
def g8m(spark, sf_dir):
    e = edges(spark, sf_dir)
    labels = nodes_of(e).select("id", (F.col("id") % 5).alias("label"))
    return graph.modularity(e, labels).select(F.round("modularity", 9).alias("modularity"))


@add("g15_neighbourhood", f"WITH e AS {EDGE}, s AS (SELECT unnest([1000001, 1000002]) AS id), n AS (SELECT id FROM s UNION SELECT dst FROM e JOIN s ON src = id UNION SELECT src FROM e JOIN s ON dst = id) SELECT src, dst FROM e WHERE src IN (FROM n) AND dst IN (FROM n)")
def g15(spark, sf_dir):
    seeds = spark.createDataFrame([(1000001,), (1000002,)], "id long")
    e = edges(spark, sf_dir)
    return graph.induced(nodes_of(e), e, seeds)


@add("j4_two_hops", f"WITH e AS {NEXT} SELECT a.src, a.dst AS mid, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst")
def j4(spark, sf_dir):
    return graph.two_hops(succession(spark, sf_dir))


@add("j3_triples", "SELECT c_custkey AS src, n_nationkey + 100000000 AS dst, 'lives_in' AS relation, c_name AS source, 'customer' AS source_type, n_name AS target, 'nation' AS target_type FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j3(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    base = F.lit(100000000)
    nodes = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), F.lit("customer").alias("type")).unionByName(n.select((F.col("n_nationkey") + base).cast("long").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type")))
    e = c.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + base).cast("long").alias("dst"), F.lit("lives_in").alias("relation"))
    return graph.triples(nodes, e)


@add("j5_incident_edges", f"WITH e AS {EDGE} SELECT src, 'buys' AS relation, dst FROM e WHERE src = 1000003 OR dst = 1000003 ORDER BY src::VARCHAR, dst::VARCHAR LIMIT 100")
def j5(spark, sf_dir):
    return graph.incident(edges(spark, sf_dir).withColumn("relation", F.lit("buys")), 1000003)


@add("a7_label_counts", "SELECT unnest([c_mktsegment, 'customer']) AS label, count(*) AS n FROM customer GROUP BY 1")
def a7(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.explode(F.array("c_mktsegment", F.lit("customer"))).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


RULES = """
reach(X, Y) :- then(X, Y).
reach(X, Z) :- reach(X, Y), then(Y, Z).
urgent(X) :- priority(X, '1-URGENT').
quiet(X, Y) :- reach(X, Y), not then(X, Y), urgent(Y).
"""


def _facts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("t0"), F.col("o_orderpriority").alias("t1"))
    return {"then": succession(spark, sf_dir).select(F.col("src").cast("string").alias("t0"), F.col("dst").cast("string").alias("t1")), "priority": o}


CLOSURE = f"e AS {NEXT}, c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)"


@add("d3_datalog_fixed_point", f"WITH RECURSIVE {CLOSURE} SELECT src::VARCHAR AS t0, dst::VARCHAR AS t1 FROM c WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e) AND dst IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def d3(spark, sf_dir):
    return datalog.infer(spark, RULES, _facts(spark, sf_dir))["quiet"]


@add("d4_proofs", f"WITH RECURSIVE {CLOSURE} SELECT src::VARCHAR AS t0, dst::VARCHAR AS t1, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM e) THEN 'ruleset:rule-2' ELSE 'ruleset:rule-3' END AS rule_id FROM c")
def d4(spark, sf_dir):
    return datalog.infer(spark, RULES, _facts(spark, sf_dir), proofs=True)["reach"]


@add("d6_fold_changes", "SELECT predicate, t0 FROM (SELECT event_type AS predicate, user_id::VARCHAR AS t0, arg_max(event_id % 3 <> 0, (ts, event_id)) AS live FROM events GROUP BY ALL) WHERE live")
def d6(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    changes = e.select(F.col("event_id").alias("change_id"), F.col("ts").alias("effective_at"), F.when(F.col("event_id") % 3 != 0, "assert").otherwise("retract").alias("op"), F.col("event_type").alias("predicate"), F.col("user_id").cast("string").alias("t0"))
    return datalog.fold(changes)


@add("u2_delta", "WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') (SELECT *, 'added' AS change FROM (FROM b EXCEPT FROM a)) UNION ALL (SELECT *, 'removed' FROM (FROM a EXCEPT FROM b))")
def u2(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return datalog.delta(o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderstatus = 'O'").select("o_custkey"))


@add("u1_overlay", "(SELECT n_nationkey AS k FROM nation UNION SELECT unnest([100, 101])) EXCEPT SELECT unnest([1, 2, 100])")
def u1(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return datalog.apply_overlay(base, spark.createDataFrame([(100,), (101,)], "k int"), spark.createDataFrame([(1,), (2,), (100,)], "k int"))


@add("d9_simulation", f"""WITH RECURSIVE {CLOSURE}, f AS (SELECT src, dst FROM e WHERE src % 50 <> 1 UNION SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 1000 = 0), d AS (SELECT src, dst FROM f UNION SELECT d.src, f.dst FROM d JOIN f ON d.dst = f.src)
    SELECT src::VARCHAR AS t0, dst::VARCHAR AS t1, 'removed' AS change FROM (FROM c EXCEPT FROM d) UNION ALL SELECT src::VARCHAR, dst::VARCHAR, 'added' FROM (FROM d EXCEPT FROM c)""")
def d9(spark, sf_dir):
    """Some orders lose what follows them, and some lead to a new one."""
    f = _facts(spark, sf_dir)
    gone = f["then"].where("t0 % 50 = 1")
    more = table(spark, sf_dir, "orders").where("o_orderkey % 1000 = 0").select(F.col("o_orderkey").cast("string").alias("t0"), F.lit("-1").alias("t1"))
    return datalog.simulate(spark, RULES, f, {"then": more}, {"then": gone}, "reach")[0]


@add("d10_row_facts", "SELECT DISTINCT c_custkey::VARCHAR AS t0, c_mktsegment AS t1 FROM customer WHERE c_acctbal > 0")
def d10(spark, sf_dir):
    return datalog.bind_rows(table(spark, sf_dir, "customer"), [("solvent", ["c_custkey", "c_mktsegment"], "c_acctbal")])["solvent"]
