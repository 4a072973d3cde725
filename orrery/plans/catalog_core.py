"""Queries of filters, joins, aggregates, orders and sets that have no other catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import datalog, graph, metrics, rdf, retrieval, routing, temporal, training
from orrery.plans import model, query_plane, semantic
from orrery.plans.catalog import add
from orrery.plans.catalog_semantic import LINEITEM
from orrery.session import table


def named(df, **columns):
    return df.select(*[(F.col(c) if isinstance(c, str) else c).cast("string").alias(k) for k, c in columns.items()])


@add("f1_dimension_projection", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def f1(spark, sf_dir):
    """Dimensions of an intent by their fields' names, as its text projects them; the text runs as Spark SQL."""
    compiled = semantic.compile_intent(LINEITEM, semantic.Intent(("line_count",), ("l_returnflag", "l_linestatus")))
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(compiled.sql.replace('"', "`"), args=compiled.parameters).select("l_returnflag", "l_linestatus")


@add("f3_identifier_guard", r"SELECT c, regexp_full_match(c, '[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)*') AS ok FROM (SELECT DISTINCT event_type AS c FROM events UNION SELECT p_name FROM part UNION SELECT o_orderpriority FROM orders UNION SELECT 'a.' || n_name FROM nation)")
def f3(spark, sf_dir):
    """The guard over names from the tables; few distinct ones."""

    def ok(name: str) -> bool:
        try:
            return bool(model.guard_identifier(name))
        except ValueError:
            return False

    t = lambda n: table(spark, sf_dir, n)
    names = t("events").select(F.col("event_type").alias("c")).union(t("part").select("p_name")).union(t("orders").select("o_orderpriority")).union(t("nation").select(F.concat(F.lit("a."), "n_name"))).distinct()
    return spark.createDataFrame([(r.c, ok(r.c)) for r in names.collect()], "c string, ok boolean")


@add("f6_row_field_scope", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def f6(spark, sf_dir):
    return query_plane.scoped(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], ["c_custkey", "c_mktsegment"])


@add("f11_read_only_guard", "SELECT event_type AS word, unnest(['sql', 'sql', 'sql', 'cypher', 'sparql']) AS language, unnest([true, false, true, false, true]) AS allowed, unnest([0, 1, 2, 3, 4]) AS n FROM (SELECT DISTINCT event_type FROM events)")
def f11(spark, sf_dir):
    """Reads and writes that are made from the table's words."""
    words = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    texts = [("sql", "select replace({w}, 'a', 'drop') as `set`, t.update from t -- delete"), ("sql", "with x as (select 1) delete from {w}"), ("sql", "select '{w}; drop table t' as c from t;"), ("cypher", "match (n:{w}) set n.a = 1 return n"), ("sparql", "PREFIX add: <http://delete/> SELECT ?insert WHERE {{ ?insert add:{w} ?o }}")]

    def allowed(text: str, language: str) -> bool:
        try:
            return bool(query_plane.guard_plan(spark, text.rstrip(";")) if language == "sql" else query_plane.guard_read_only(text, language))
        except ValueError:
            return False

    return spark.createDataFrame([(w, k, allowed(t.format(w=w), k), i) for w in words for i, (k, t) in enumerate(texts)], "word string, language string, allowed boolean, n int")


@add("f13_kind_allow_list", "SELECT p_partkey, p_type AS kind FROM part WHERE p_type IN ('ECONOMY', 'PROMO')")
def f13(spark, sf_dir):
    return routing.of_kinds(table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind")), ["ECONOMY", "PROMO"])


def _trade_facts(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return [
        named(t("orders"), t0="o_orderkey", t1="o_custkey"),
        named(t("customer"), t0="c_custkey", t1="c_nationkey"),
        named(t("nation"), t0="n_nationkey", t1="n_regionkey"),
    ]


@add("j1_rule_body", "SELECT o_orderkey::VARCHAR AS o, c_custkey::VARCHAR AS c, n_nationkey::VARCHAR AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def j1(spark, sf_dir):
    """Written so that the first two atoms share no variable: the join order follows the variables."""
    rule = datalog.parse("found(O, C, N) :- placed(O, C), nation(N, '2'), lives(C, N).")[0]
    placed, lives, nation = _trade_facts(spark, sf_dir)
    out = datalog.body_bindings(rule.body, [placed, nation, lives])
    return out.select(*[F.col(f"v_{v}").alias(v.lower()) for v in "OCN"])


@add("j2_negated_atom", "SELECT c_custkey::VARCHAR AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_nationkey <> 3")
def j2(spark, sf_dir):
    rule = datalog.parse("idle(C) :- lives(C, N), not placed(C), not lives(C, '3').")[0]
    lives = _trade_facts(spark, sf_dir)[1]
    urgent = named(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'"), t0="o_custkey")
    return datalog.body_bindings(rule.body, [lives, urgent, lives]).select(F.col("v_C").alias("c"))


@add("j7_not_revoked", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'license') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j7(spark, sf_dir):
    revoked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return retrieval.public_search(table(spark, sf_dir, "documents").select("doc_id", "text"), revoked, ["The", "license"], "doc_id", "text").select("doc_id")


@add("j11_drop_similar", """WITH RECURSIVE h AS (SELECT item_id AS pos, list_distinct(string_split_regex(trim(regexp_replace(lower(t), '\\s+', ' ', 'g')), ' ')) AS w FROM (SELECT item_id * 2 AS item_id, text AS t FROM benchmark UNION ALL SELECT item_id * 2 + 1, text || CASE WHEN item_id % 3 = 0 THEN ' more' ELSE repeat(' other' || item_id, 1) || ' ' || left(text, 200) END FROM benchmark)),
    p AS MATERIALIZED (SELECT a.pos AS early, b.pos AS late FROM h a JOIN h b ON a.pos < b.pos AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) > 0.85),
    n AS (SELECT pos, row_number() OVER (ORDER BY pos) AS i FROM h), r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT n.i, CASE WHEN len(list_intersect(kept, (SELECT coalesce(list(early), []) FROM p WHERE late = n.pos))) > 0 THEN kept ELSE list_append(kept, n.pos) END FROM r JOIN n ON n.i = r.i + 1)
    SELECT unnest(kept) AS pos FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)""")
def j11(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    twin = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" more"))).otherwise(F.concat("text", F.lit(" other"), "item_id", F.lit(" "), F.substring("text", 1, 200)))
    hits = b.select((F.col("item_id") * 2).alias("pos"), F.col("text").alias("chunk_text")).unionByName(b.select((F.col("item_id") * 2 + 1).alias("pos"), twin.alias("chunk_text")))
    return retrieval.drop_similar(hits).select("pos")


@add("j12_pair_similarity", """WITH t AS (SELECT *, row_number() OVER (ORDER BY sha256(p_partkey::VARCHAR), p_partkey) AS r FROM (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || p_brand) AS x FROM part)), s AS (SELECT r, list_distinct([substr(x, i, 3) FOR i IN range(1, length(x) - 1)]) AS g FROM t WHERE r <= 100)
    SELECT round(1 - avg(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))), 3) AS diversity FROM s a JOIN s b ON a.r < b.r""")
def j12(spark, sf_dir):
    return training.diversity(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")), "p_partkey", "text")


SEEDS = """SELECT *, CASE WHEN lower(n.label) = c THEN 10.0 WHEN contains(lower(n.label), c) THEN greatest(2.0, 6.0 * length(c) / length(n.label)) WHEN contains(c, lower(n.label)) AND length(n.label) > 1 THEN 5.0 * length(n.label) / greatest(1, length(c)) ELSE 0 END AS s
    FROM (SELECT p_partkey AS id, p_name AS label FROM part) n, (SELECT DISTINCT lower(c) AS c FROM (SELECT unnest(['ring', 'red widget', 'the small ring of it', 'x']) AS c UNION ALL SELECT r_name FROM region))"""


@add("j13_seeds", f"SELECT id, max(s) AS score FROM ({SEEDS}) GROUP BY 1 HAVING max(s) >= 2 ORDER BY 2 DESC, 1 LIMIT 500")
def j13(spark, sf_dir):
    words = spark.createDataFrame([("ring",), ("Red Widget",), ("the small ring of it",), ("x",), (None,)], "c string").unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("c")))
    return graph.seeds(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), words, 500)


@add("j15_metric_scenes", "SELECT DISTINCT c_custkey AS qid, 'scene-' || n_regionkey AS card, 0.8::DOUBLE AS score FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0")
def j15(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    routed = c.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("m"), "c_nationkey").alias("card"), F.col("c_nationkey").alias("metric"))
    # Every fifth question found its scene itself.
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("scene-"), "n_regionkey").alias("card"), F.lit(None).cast("int").alias("metric"))
    return retrieval.metric_scenes(routed.unionByName(own), n.select(F.col("n_nationkey").alias("metric"), F.concat(F.lit("scene-"), "n_regionkey").alias("scene")))


def _located(spark, sf_dir):
    """Customers in nations in regions, as nodes and is_a edges; names are keys of one space."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    key = lambda p, k: F.concat(F.lit(p), k)
    nodes = c.select(key("c", "c_custkey").alias("id"), F.col("c_name").alias("label")).unionByName(n.select(key("n", "n_nationkey").alias("id"), F.col("n_name").alias("label"))).unionByName(r.select(key("r", "r_regionkey").alias("id"), F.col("r_name").alias("label")))
    up = c.select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")).unionByName(n.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst")))
    return nodes, up.withColumn("relation", F.lit("is_a"))


@add("j17_instances_by_class", "SELECT n_name AS class, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT r_name, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j17(spark, sf_dir):
    from orrery.operators.governance import instance_counts

    return instance_counts(*_located(spark, sf_dir))


@add("j19_disjoint_classes", "SELECT 'o' || o_custkey AS id, 'F' AS \"left\", 'O' AS \"right\" FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'O') > 0")
def j19(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    iri = lambda s, p, o_: [s.alias("s"), F.lit(p).alias("p"), o_.alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")]
    types = o.select(*iri(F.concat(F.lit("o"), "o_custkey"), rdf.TYPE, F.col("o_orderstatus")))
    apart = spark.createDataFrame([("F", rdf.OWL + "disjointWith", "O", "iri", None, None)], rdf.SCHEMA)
    return rdf.disjoint_conflicts(types.unionByName(apart))


@add("a15_domain_rollup", "SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT 'r' || c.n_regionkey AS a, 'r' || s.n_regionkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey) GROUP BY ALL")
def a15(spark, sf_dir):
    nodes, up = _located(spark, sf_dir)
    t = lambda n: table(spark, sf_dir, n)
    up = up.unionByName(t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit("is_a").alias("relation")))
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph.domain_rollup(up.select("src", "dst"), t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")), sold)


@add("a23_feedback", """WITH t AS (SELECT o_totalprice / 600000 AS score, lower(o_orderpriority) AS answer, unnest(['high', 'low', 'urgent']) AS term FROM orders), g AS (SELECT term, count(*) AS n, avg(score) AS mean FROM t WHERE score < 0.5 AND NOT contains(answer, term) GROUP BY 1)
    SELECT term, n, round(0.6 * mean + 0.4 * least(n / 10, 1), 9) AS confidence FROM g""")
def a23(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 600000).alias("score"), F.col("o_orderpriority").alias("answer"), F.array(F.lit("High"), F.lit("low"), F.lit("urgent")).alias("terms"))
    out = metrics.feedback(o, 0.5).withColumn("confidence", F.round("confidence", 9))
    return out.withColumn("term", F.lower("term"))


@add("a24_health", """WITH s AS (SELECT o_orderpriority AS graph, count(DISTINCT o_custkey) AS nodes, count(*) AS edges, count(*) FILTER (o_totalprice < 30000) AS orphans, count(DISTINCT o_orderstatus) * 5 AS components FROM orders GROUP BY 1),
    c AS (SELECT graph, (nodes = 0)::INT + (orphans > 0.5 * nodes)::INT AS critical, (edges / (nodes * (nodes - 1)) < 0.001)::INT + (orphans BETWEEN nodes * 0.1 AND nodes * 0.5)::INT + (components > 10)::INT AS warning FROM s)
    SELECT *, greatest(0, 100 - 20 * critical - 10 * warning) AS health FROM c""")
def a24(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("graph"))
    return metrics.health(o.agg(F.count_distinct("o_custkey").alias("nodes"), F.count(F.lit(1)).alias("edges"), F.count_if(F.col("o_totalprice") < 30000).alias("orphans"), (F.count_distinct("o_orderstatus") * 5).alias("components")))


@add("t2_search_order", """WITH s AS (SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'red') THEN 8 ELSE 0 END + CASE WHEN contains(lower(p_type), 'red') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_name), 'pro') THEN 8 ELSE 0 END + CASE WHEN contains(lower(p_type), 'pro') THEN 3 ELSE 0 END)::DOUBLE AS score,
    (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red')) AND (contains(lower(p_name), 'pro') OR contains(lower(p_type), 'pro')) AS ok FROM part) SELECT p_partkey, score FROM s WHERE ok ORDER BY score DESC, p_partkey LIMIT 25""")
def t2(spark, sf_dir):
    return retrieval.weighted_search(table(spark, sf_dir, "part"), ["red", "PRO"], {"name": F.col("p_name"), "description": F.col("p_type")}, "p_partkey", 25)


@add("t3_contains_order", "SELECT item_id FROM benchmark WHERE contains(lower(text), 'tion') ORDER BY 1 LIMIT 12")
def t3(spark, sf_dir):
    return retrieval.contains_search(table(spark, sf_dir, "benchmark"), "TION", "item_id", "text", 12)


@add("t4_edge_order", "SELECT o_custkey AS src, o_orderstatus AS relation, o_orderkey AS dst FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderstatus IN ('F', 'O') ORDER BY relation, dst::VARCHAR LIMIT 7")
def t4(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("relation"), F.col("o_orderkey").alias("dst"))
    first = e.agg(F.min("src")).first()[0]
    return graph.incident(e, first, "out", ["F", "O"], 7)


@add("u5_both_ways", "SELECT DISTINCT src, relation, dst FROM (SELECT s_nationkey AS src, 'sells' AS relation, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) WHERE src = 3 OR dst = 3")
def u5(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.incident(j.select(F.col("s_nationkey").alias("src"), F.lit("sells").alias("relation"), F.col("c_nationkey").alias("dst")), 3, "both", None, 1000)


@add("t8_row_cap", "SELECT 'within' AS run, (SELECT count(*) FROM nation) AS n, false AS refused UNION ALL SELECT 'beyond', 25 - 1, (SELECT count(*) FROM nation) > 24")
def t8(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")

    def tried(run: str, most: int):
        rows = query_plane.row_cap(nation, most).collect()  # most + 1 rows
        try:
            return run, len(query_plane.check_cap(rows, most)), False
        except ValueError:
            return run, most, True

    return spark.createDataFrame([tried("within", 25), tried("beyond", 24)], "run string, n long, refused boolean")


@add("t9_precedent_order", "WITH d AS (SELECT o_orderkey AS id, (o_orderstatus IN ('F', 'P'))::INT + (o_orderpriority IN ('1-URGENT'))::INT AS hits, o_orderdate FROM orders) SELECT id, hits / 3 AS similarity FROM d WHERE hits > 0 ORDER BY hits DESC, o_orderdate DESC, id LIMIT 40")
def t9(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.col("o_orderdate").alias("recorded_at"))
    return retrieval.precedents(d, ["F", "P", "1-URGENT"], 40).select("id", "similarity")


@add("t10_concept_order", "WITH p AS (SELECT p_name || ' ' || p_partkey AS title, 16 * (contains(lower(p_name), 'ring'))::INT + 8 * (p_brand = 'Brand#2')::INT + 4 * (p_type = 'PROMO')::INT + 2 * (contains(lower(p_brand || ' of ' || p_type), 'ring'))::INT AS s1 FROM part) SELECT title, s1 AS score FROM p WHERE s1 > 0 ORDER BY score DESC, title LIMIT 30")
def t10(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), "p_partkey").alias("title"), F.array(F.when(F.col("p_brand") == "Brand#2", "RING").otherwise("x")).alias("tags"), F.when(F.col("p_type") == "PROMO", "ring").otherwise("y").alias("type"), F.concat("p_brand", F.lit(" of "), "p_type").alias("text"))
    return retrieval.bundle_search(p, ["Ring"], 30).select("title", "score")


@add("t11_term_order", "SELECT item_id, list_reduce(list_transform(w, lambda x: x), lambda a, b: a || ' ' || b) AS terms FROM (SELECT item_id, list(t ORDER BY length(t) DESC, t DESC) AS w FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '([a-z]{6,})', 1)) AS t FROM benchmark) GROUP BY 1)")
def t11(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), 1))
    return table(spark, sf_dir, "benchmark").where(F.size(words) > 0).select("item_id", F.array_join(routing.by_length(words), " ").alias("terms"))


@add("u4_schema_drift", "WITH a AS (SELECT DISTINCT column_name FROM duckdb_columns() WHERE table_name = 'customer'), b AS (SELECT DISTINCT replace(column_name, 'c_mktsegment', 'c_segment') AS column_name FROM a WHERE column_name <> 'c_acctbal') (SELECT 'added' AS change, column_name AS field FROM b WHERE column_name NOT IN (FROM a)) UNION ALL (SELECT 'removed', column_name FROM a WHERE column_name NOT IN (FROM b))")
def u4(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    drift = temporal.schema_drift(c, c.drop("c_acctbal").withColumnRenamed("c_mktsegment", "c_segment"))
    if temporal.schema_drift(None, c) != {"added": [], "removed": []}:
        raise AssertionError("a first batch drifts")
    return spark.createDataFrame([(k, f) for k, fields in drift.items() for f in fields], "change string, field string")


@add("u6_distinct_paths", "WITH e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT ['c' || c, 's' || s] AS path FROM e WHERE c = (SELECT min(c) FROM e) AND s = (SELECT min(s) FROM e WHERE c = (SELECT min(c) FROM e))")
def u6(spark, sf_dir):
    """Each line is an edge, so pairs stand more than once; a path is given once."""
    t = lambda n: table(spark, sf_dir, n)
    j = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = j.agg(F.min(F.struct("o_custkey", "l_suppkey")).alias("x")).first()["x"]
    e = j.select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph.all_paths(e, f"c{first[0]}", f"s{first[1]}", 5)


@add("u7_common_purposes", "SELECT o_orderpriority AS purpose FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def u7(spark, sf_dir):
    grants = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.collect_set("o_orderpriority").alias("p")).collect()  # one row a status
    return spark.createDataFrame([(p,) for p in query_plane.allowed_purposes([g.p for g in grants])], "purpose string")


@add("u8_evidence_union", "SELECT o_orderkey AS evidence_id FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 300000")
def u8(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return query_plane.federated_evidence([o.where(c).select(F.col("o_orderkey").alias("evidence_id")) for c in ("o_orderstatus = 'F'", "o_totalprice > 300000", "o_orderstatus = 'F' AND o_totalprice > 1000")])


@add("u9_last_wins", "SELECT p_name AS term, max(p_partkey) AS p_partkey FROM part GROUP BY 1")
def u9(spark, sf_dir):
    return retrieval.keep_first(table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), "p_partkey"), ["term"], [F.desc("p_partkey")])
