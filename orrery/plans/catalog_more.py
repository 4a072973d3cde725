"""Queries of graph walks, search modes, rules, state, extension points and the smaller operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from orrery.operators import datalog, governance, graph, rdf, retrieval, temporal, training
from orrery.plans import extension
from orrery.plans.catalog import add
from orrery.plans.catalog_core import _located, named
from orrery.plans.catalog_graph import NEXT, succession
from orrery.plans.catalog_rdf import EX
from orrery.plans.catalog_sources import q
from orrery.plans.model import Release, Resource, topological
from orrery.plans.query_plane import Policy, QueryPlane
from orrery.session import scratch, table
from orrery.streaming import events as E


# --- graphs -----------------------------------------------------------------------------------------------------------


@add("g11_impact", f"WITH RECURSIVE e AS {NEXT}, s AS (SELECT min(src) AS id FROM e GROUP BY src % 50), r AS (SELECT id AS root, id, 0 AS depth FROM s UNION SELECT root, e.dst, depth + 1 FROM r JOIN e ON e.src = r.id WHERE depth < 6) SELECT root, l_partkey AS output FROM (SELECT DISTINCT root, id FROM r WHERE depth > 0 AND id <> root) JOIN lineitem ON l_orderkey = id GROUP BY ALL")
def g11(spark, sf_dir):
    """Orders that follow some orders, and the parts that they deliver."""
    e = succession(spark, sf_dir)
    seeds = e.groupBy(F.col("src") % 50).agg(F.min("src").alias("id")).select("id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("output"))
    return graph.reach(e, seeds, 6).join(lines, "id").select("root", "output").distinct()


def _release(spark, sf_dir) -> Release:
    """A release of metadata: a dataset a nation's region, a metric a nation."""
    rows = table(spark, sf_dir, "nation").collect()
    base = "sem://demo/sales/"
    sets = [Resource(f"{base}physicaldataset/r{r}", "PhysicalDataset", f"r{r}", spec={"physical_name": f"r{r}"}) for r in sorted({r.n_regionkey for r in rows})]
    return Release("r1", tuple(sets + [Resource(f"{base}metric/{r.n_name}", "Metric", r.n_name, depends_on=(f"{base}physicaldataset/r{r.n_regionkey}",), spec={"aggregation": "count", "measure": "*"}) for r in rows]))


@add("g12_dependency_closure", "SELECT 'sem://demo/sales/metric/' || n_name AS id FROM nation WHERE n_nationkey < 7 UNION SELECT 'sem://demo/sales/physicaldataset/r' || n_regionkey FROM nation WHERE n_nationkey < 7")
def g12(spark, sf_dir):
    release = _release(spark, sf_dir)
    wanted = [f"sem://demo/sales/metric/{r.n_name}" for r in table(spark, sf_dir, "nation").where("n_nationkey < 7").collect()]
    return spark.createDataFrame([(r.resource_id,) for r in release.closure(wanted)], "id string")


@add("g13_topological_order", "SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS step, row_number() OVER (ORDER BY n_nationkey // 5, n_nationkey) - 1 AS place FROM nation")
def g13(spark, sf_dir):
    """Steps that need the one five before them: in order of dependence, the least name first."""
    name = lambda k: f"n{k:02d}"
    keys = [r.n_nationkey for r in table(spark, sf_dir, "nation").collect()]
    order = topological({name(k): [name(j) for j in keys if j // 5 == k // 5 - 1] for k in keys})
    return spark.createDataFrame([(s, i) for i, s in enumerate(order)], "step string, place long")


@add("g14_neighbours", f"WITH RECURSIVE e AS {NEXT}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s AS (SELECT min(src) AS id FROM e GROUP BY src % 200), r AS (SELECT id AS root, id, 0 AS depth FROM s UNION SELECT root, b.dst, depth + 1 FROM r JOIN b ON b.src = r.id WHERE depth < 3) SELECT root, id, min(depth) AS depth FROM r WHERE id <> root GROUP BY ALL")
def g14(spark, sf_dir):
    e = succession(spark, sf_dir)
    return graph.reach(e, e.groupBy(F.col("src") % 200).agg(F.min("src").alias("id")).select("id"), 3, "both")


PATHS = f"""e AS {NEXT}, s AS (SELECT DISTINCT src AS id, 4 + src % 3 AS score FROM e WHERE src IN (SELECT min(src) FROM e GROUP BY src % 6)),
    a AS (SELECT [s.id, e.dst] AS path, ['then'] AS relations, 1 AS hops, score FROM s JOIN e ON e.src = s.id ORDER BY score DESC, path LIMIT 8),
    b AS (SELECT DISTINCT ON (path) [s.id, e.dst, f.dst] AS path, ['then', 'then'] AS relations, 2 AS hops, score FROM s JOIN e ON e.src = s.id JOIN e f ON f.src = e.dst WHERE f.dst <> s.id ORDER BY path),
    c AS (FROM b ORDER BY score DESC, path LIMIT 8)"""


@add("g16_path_retrieval", f"WITH {PATHS} SELECT path, relations, hops, round(CASE WHEN hops = 1 THEN 1.0 ELSE 0.6 END * score / 10, 3)::DOUBLE AS score FROM (FROM a UNION ALL FROM c)")
def g16(spark, sf_dir):
    e = succession(spark, sf_dir).withColumn("relation", F.lit("then"))
    some = e.groupBy(F.col("src") % 6).agg(F.min("src").alias("id")).select("id", (4 + F.col("id") % 3).alias("score"))
    return graph.path_retrieval(e.select(F.col("src").alias("id")).distinct(), e, some)


@add("t5_path_order", f"WITH {PATHS} SELECT hops, round(CASE WHEN hops = 1 THEN 1.0 ELSE 0.6 END * score / 10, 3)::DOUBLE AS score, path FROM (FROM a UNION ALL FROM c) ORDER BY hops, score DESC, path LIMIT 5")
def t5(spark, sf_dir):
    return g16(spark, sf_dir).limit(5).select("hops", "score", "path")


@add("g19_adjacency", "SELECT DISTINCT src, dst, 'trade' AS relation FROM (SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49 UNION ALL SELECT c_nationkey, s_nationkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49)")
def g19(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").where("l_quantity > 49").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.adjacency(j.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst"), F.lit("trade").alias("relation")))


# --- search -----------------------------------------------------------------------------------------------------------

COUNTS = """w AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), k AS (SELECT p_partkey, unnest(regexp_extract_all(t, '[a-z0-9_-]+')) AS x FROM w), c AS (SELECT p_partkey, x, count(*) AS n FROM k GROUP BY ALL),
    s AS (SELECT p_partkey, round(sum(n * CASE x WHEN 'red' THEN 2 WHEN 'promo' THEN 1 ELSE 0 END) / sqrt(sum(n * n) * 5), 8) AS score FROM c GROUP BY 1)"""


@add("r6_sparse_modes", f"""WITH {COUNTS} SELECT * FROM (SELECT 'vector' AS mode, p_partkey, score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'skill', p_partkey, score FROM s WHERE score > 0 AND p_partkey % 4 = 1 ORDER BY score DESC, p_partkey LIMIT 30)""")
def r6(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resource_id"), F.when(F.col("p_partkey") % 4 == 1, "Workflow").otherwise("Metric").alias("kind"), q("name {p_partkey}").alias("name"), q("{p_name} {p_type}").alias("text"))
    one = lambda mode: retrieval.sparse_search(p, "red RED promo", mode, 30).select(F.lit(mode).alias("mode"), F.col("resource_id").alias("p_partkey"), "score")
    return one("vector").unionByName(one("skill"))


@add("r1_trigram_index", """WITH d AS (SELECT item_id, lower(text) AS t, greatest(length(text) - 2, 0) AS len FROM benchmark), g AS (SELECT unnest(['lic', 'ice', 'tio', 'ion']) AS gram), f AS (SELECT item_id, len, gram, len([1 FOR i IN range(1, len + 1) IF substr(t, i, 3) = gram]) AS tf FROM d, g),
    n AS (SELECT gram, count(*) FILTER (tf > 0) AS df FROM f GROUP BY 1), z AS (SELECT count(*) AS total, avg(len) AS mean FROM d WHERE len > 0)
    SELECT item_id AS id, round(sum(ln((total - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM f JOIN n USING (gram), z WHERE gram IN ('tio', 'ion') GROUP BY 1 HAVING min(tf) > 0""")
def r1t(spark, sf_dir):
    return retrieval.trigram_search(retrieval.trigram_index(table(spark, sf_dir, "benchmark"), "item_id", "text"), "Tion of")


def _fused(spark, sf_dir):
    """Hits whose texts tell pages, types and near repeats: two of three parts repeat another's text."""
    p = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_name", "p_type", "p_brand", (F.col("p_partkey") / 3).cast("long"))
    return p.select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("s"), (F.col("p_partkey") % 40)).alias("slug"), F.col("p_type").alias("type"), text.alias("chunk_text"), (1000 - F.col("p_partkey")).alias("score")).where("p_partkey < 400")


@add("r9_dedup_layers", """WITH RECURSIVE f AS (SELECT p_partkey, 's' || (p_partkey % 40) AS slug, p_type AS type, list_distinct(string_split_regex(lower(concat_ws(' ', p_name, p_type, p_brand, p_partkey // 3)), '\\s+')) AS w, 1000 - p_partkey AS score, p_partkey::VARCHAR AS key FROM part WHERE p_partkey < 400),
    a AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS pos FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY slug ORDER BY score DESC, key) <= 3)),
    p AS MATERIALIZED (SELECT x.pos AS early, y.pos AS late FROM a x JOIN a y ON x.pos < y.pos AND len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) > 0.85),
    r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS kept UNION ALL SELECT a.pos, CASE WHEN len(list_intersect(kept, (SELECT coalesce(list(early), []) FROM p WHERE late = a.pos))) > 0 THEN kept ELSE list_append(kept, a.pos) END FROM r JOIN a ON a.pos = r.i + 1),
    b AS (SELECT * FROM a WHERE pos IN (SELECT unnest(kept) FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1))), n AS (SELECT greatest(1, floor(count(*) * 0.6 + 0.999)::INT) AS most FROM b),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY type ORDER BY pos) <= (SELECT most FROM n)) SELECT key, pos FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY pos) <= 2""")
def r9(spark, sf_dir):
    return retrieval.dedup_layers(_fused(spark, sf_dir)).select("key", F.col("pos").cast("long").alias("pos"))


@add("r10_expand_query", "SELECT event_type AS query, unnest(CASE WHEN event_type = 'view' THEN [event_type || ' of the shop', 'reworded'] ELSE [event_type] END) AS expanded FROM (SELECT DISTINCT event_type FROM events)")
def r10(spark, sf_dir):
    """With a model's rewordings for queries of three words and more; without one the query itself."""
    words = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())
    model = lambda text: ["reworded"]
    rows = [(w, x) for w in words for x in retrieval.expand_query(f"{w} of the shop" if w == "view" else w, model)]
    return spark.createDataFrame(rows, "query string, expanded string")


@add("r11_provenance", "SELECT source AS slug, sha256(substr(text, 1, 600)) AS text_sha256, round(n_chars / 7, 4) AS score, 1 AS list FROM documents")
def r11(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("slug"), F.col("text").alias("chunk_text"), (F.col("n_chars") / 7).alias("score"), F.lit(1).alias("list"))
    return retrieval.with_provenance(hits).select("slug", F.sha2("text", 256).alias("text_sha256"), "score", "list")


@add("r12_mapping_search", """WITH s AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 AND contains(lower(p_name), 'ring') THEN 0.8 ELSE least(1.0, CASE WHEN contains(p_partkey::VARCHAR, 'ring') THEN 1.0 ELSE 0 END + CASE WHEN contains(lower(p_name), 'ring') THEN 0.9 ELSE 0 END + CASE WHEN contains(lower(p_type), 'ring') THEN 0.5 ELSE 0 END + CASE WHEN contains('ring ' || p_size, 'ring') AND p_size = 7 THEN 0.7 ELSE 0 END) END::DOUBLE AS score FROM part)
    SELECT key::VARCHAR AS key, score FROM s WHERE score > 0 ORDER BY score DESC, key::VARCHAR LIMIT 60""")
def r12(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.when(F.col("p_size") == 7, q("ring {p_size}")).otherwise("").alias("alias"), F.when(F.col("p_partkey") % 5 == 0, "pattern").otherwise("term").alias("kind"))
    return retrieval.mapping_search(p, "RING", 60).select("key", "score")


@add("r16_strategy", "SELECT o_orderstatus AS strategy FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def r16(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return spark.createDataFrame([(retrieval.strategies({s: o.where(F.col("o_orderstatus") == s) for s in "FOP"}),)], "strategy string")


@add("r17_grounding", "SELECT item_id, CASE WHEN regexp_matches(lower(text), '\\d|\\b(today|yesterday|last|between|before|after|more than|less than|greater|compare)\\b') THEN 'refused' ELSE coalesce((SELECT string_agg(id, ',' ORDER BY id) FROM (VALUES ('m:in', 'in'), ('m:on', 'on'), ('m:the', 'the')) v(id, w) WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || w || '($|[^a-z0-9_])')), '') END AS found FROM benchmark")
def r17(spark, sf_dir):
    """Questions are asked one by one; the benchmark's texts stand for them."""

    def answer(text: str) -> str:
        try:
            return ",".join(retrieval.ground(text, {"m:in": ["in"], "m:on": ["zzz", "on"], "m:the": ["the"]}))
        except ValueError:
            return "refused"

    rows = table(spark, sf_dir, "benchmark").select("item_id", "text").collect()
    return spark.createDataFrame([(r.item_id, answer(r.text)) for r in rows], "item_id long, found string")


# --- rules and shapes -------------------------------------------------------------------------------------------------


@add("d1_parse_rules", "SELECT unnest(['rules:rule-2', 'rules:rule-3', 'refused', 'refused', 'refused']) AS outcome, unnest(['reach', 'quiet', 'head :- a(X)', 'unbound', 'fact']) AS what")
def d1(spark, sf_dir):
    rules = datalog.parse("# two rules\nreach(X, Z) :- reach(X, Y), 'is'(Y, Z).\n".replace("'is'", "sells") + "quiet(X) :- nation(X), not sells(X, X). # safe", "rules")

    def refused(text: str) -> str:
        try:
            return datalog.parse(text)[0].rule_id
        except ValueError:
            return "refused"

    rows = [(r.rule_id, r.head.predicate) for r in rules] + [(refused("head(Y) :- a(X)."), "head :- a(X)"), (refused("h(X) :- a(X), not b(Y)."), "unbound"), (refused("a(x)."), "fact")]
    return spark.createDataFrame(rows, "outcome string, what string")


@add("d2_strata", "SELECT unnest(['base', 'reach', 'lonely', 'calm']) AS predicate, unnest([0, 0, 1, 2]) AS stratum UNION ALL SELECT 'cycle', -1")
def d2(spark, sf_dir):
    level = datalog.stratify(datalog.parse("reach(X) :- base(X).\nreach(X) :- reach(X), base(X).\nlonely(X) :- base(X), not reach(X).\ncalm(X) :- base(X), not lonely(X)."))
    try:
        datalog.stratify(datalog.parse("a(X) :- b(X), not c(X).\nc(X) :- a(X)."))
    except ValueError:
        level["cycle"] = -1
    return spark.createDataFrame(sorted(level.items()), "predicate string, stratum int")


@add("d5_rule_set_versions", "SELECT user_id AS ruleset, max(event_id) AS version FROM events GROUP BY 1")
def d5(spark, sf_dir):
    return datalog.latest_version(table(spark, sf_dir, "events").select(F.col("user_id").alias("ruleset"), F.col("event_id").alias("version")), ["ruleset"], "version")


@add("d8_event_rules", "WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY ALL), a AS (SELECT b.user_id, greatest(b.e, p.e) AS e FROM f b JOIN f p ON b.user_id = p.user_id WHERE b.event_type = 'error' AND p.event_type = 'purchase') SELECT user_id::VARCHAR AS t0 FROM a")
def d8(spark, sf_dir):
    """A stream of three files: users who met an error and bought; each is told once, in whatever batch it comes true."""
    src, out = scratch(spark), scratch(spark)
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), "event_type")
    for k in range(3):
        e.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema("event_id long, user_id string, event_type string").option("maxFilesPerTrigger", 1).json(src)
    facts = lambda d: {"failed": d.where("event_type = 'error'").select("user_id"), "bought": d.where("event_type = 'purchase'").select("user_id")}
    E.run_rules(spark, stream, "alert(X) :- failed(X), bought(X).", "alert", out, facts).awaitTermination()
    return spark.read.parquet(f"{out}/out").select("t0")


@add("d12_shape_targets", "SELECT 'http://example.org/customer/' || c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION SELECT 'http://example.org/x' UNION SELECT 'http://example.org/nation/' || c_nationkey FROM customer")
def d12(spark, sf_dir):
    from orrery.plans.catalog_rdf import triples

    return rdf.targets(triples(spark, sf_dir), rdf.Shape("t", target_class=EX + "Customer", target_node=EX + "x", objects_of=EX + "livesIn"))


@add("d15_skos", """SELECT 'p' || p_partkey AS id, unnest(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'duplicate_pref_label' END, CASE WHEN p_partkey % 7 = 0 THEN 'self_broader' END, CASE WHEN p_partkey % 11 = 0 AND p_partkey % 2 = 1 THEN 'deprecated_without_replacement' END, CASE WHEN p_partkey % 10 IN (3, 4) THEN 'broader_cycle' END], lambda x: x IS NOT NULL)) AS finding FROM part""")
def d15(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), "p_partkey").alias("id"))
    lit = lambda d, prop, o, lang=None: d.select(F.col("id").alias("s"), F.lit(prop).alias("p"), o.alias("o"), F.lit("literal").alias("kind"), F.lit(None).cast("string").alias("datatype"), F.lit(lang).cast("string").alias("lang"))
    up = lambda d, o: lit(d, rdf.SKOS + "broader", o).withColumn("kind", F.lit("iri"))
    k = F.col("p_partkey")
    parts = [lit(p, rdf.SKOS + "prefLabel", F.col("id"), "en"), lit(p.where(k % 5 == 0), rdf.SKOS + "prefLabel", F.lit("other"), "en"), up(p.where(k % 7 == 0), F.col("id")), lit(p.where(k % 11 == 0), rdf.OWL + "deprecated", F.lit("true")), lit(p.where((k % 11 == 0) & (k % 2 == 0)), "http://purl.org/dc/terms/isReplacedBy", F.lit("x"))]
    parts += [up(p.where(k % 10 == 3), F.concat(F.lit("p"), k + 1)), up(p.where(k % 10 == 4), F.concat(F.lit("p"), k - 1))]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return rdf.skos_findings(out)


@add("d18_policy", """SELECT n_nationkey, list_filter([CASE WHEN n_nationkey % 2 = 1 THEN 'role_denied' END, CASE WHEN n_nationkey % 5 = 0 THEN 'limit_exceeded' END, CASE WHEN n_regionkey = 3 THEN 'resource_denied:' || n_name END, CASE WHEN n_nationkey % 3 = 0 THEN 'field_denied:pay' END], lambda x: x IS NOT NULL) AS findings,
    list_filter([CASE WHEN n_nationkey % 4 = 0 THEN 'purpose_denied' END], lambda x: x IS NOT NULL) AS waived FROM nation""")
def d18(spark, sf_dir):
    rows = []
    nations = table(spark, sf_dir, "nation").collect()
    policy = Policy(frozenset({"analyst"}), frozenset({"report"}), 100, deny=frozenset(r.n_name for r in nations if r.n_regionkey == 3), fields=frozenset({"name"}), waivers=frozenset({"purpose_denied", "role_denied"}))
    for r in nations:
        k = r.n_nationkey
        v = policy.evaluate("guest" if k % 2 else "analyst", "sale" if k % 4 == 0 else "report", 101 if k % 5 == 0 else 100, [r.n_name], ["name", "pay"] if k % 3 == 0 else ["name"])
        if v["allowed"] != (not v["findings"]):
            raise AssertionError("findings and verdict differ")
        rows.append((k, v["findings"], v["waived"]))
    return spark.createDataFrame(rows, "n_nationkey int, findings array<string>, waived array<string>")


# --- state ------------------------------------------------------------------------------------------------------------


@add("z1_bitemporal_assert", "SELECT user_id AS fact_id, event_id AS value, row_number() OVER w AS version, event_id AS tx_from, lead(event_id) OVER w AS tx_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def z1(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.lit("t").alias("tenant_id"), F.col("user_id").alias("fact_id"), F.col("event_type").alias("field"), F.col("event_id").alias("value"), F.lit(0).alias("valid_from"), F.lit(None).cast("int").alias("valid_to"), F.col("event_id").alias("recorded_at"))
    out = temporal.assert_versions(f)
    # Closing a version leaves its digest as it was.
    return out.where(F.sha2(F.to_json(F.struct(*[F.col(c) for c in ("tenant_id", "fact_id", "version", "field", "value", "valid_from", "valid_to", "tx_from")])), 256) == F.col("fact_digest")).select("fact_id", "value", "version", "tx_from", "tx_to")


@add("z4_keyed_ingest", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'late' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 3 <> 2 OR o_orderkey % 4 = 0")
def z4(spark, sf_dir):
    """Two files of one stream: rows that are new, and rows that replace others."""
    src, out = scratch(spark), scratch(spark)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    o.where("k % 3 <> 2").coalesce(1).write.json(src)
    o.where("k % 4 = 0").withColumn("v", F.lit("late")).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(src)
    E.ingest(spark, stream, "k", out).awaitTermination()
    return spark.read.parquet(f"{out}/state/batch=1")


@add("z7_out_of_order", "SELECT user_id::VARCHAR AS t0 FROM events GROUP BY user_id HAVING arg_max(event_id % 3 <> 0, (ts, event_id))")
def z7(spark, sf_dir):
    """Changes in the reverse of their order: effective time decides, not arrival."""
    e = table(spark, sf_dir, "events").orderBy(F.desc("event_id"))
    changes = e.select(F.col("event_id").alias("change_id"), F.col("ts").alias("effective_at"), F.when(F.col("event_id") % 3 != 0, "assert").otherwise("retract").alias("op"), F.lit("live").alias("predicate"), F.col("user_id").cast("string").alias("t0"))
    return datalog.fold(changes.unionByName(changes)).select("t0")


@add("z9_outbox", "SELECT event_id FROM events WHERE event_id % 10 = 7")
def z9(spark, sf_dir):
    """Deliveries fail at first for every third event and for ever for every tenth; only these are dead letters."""
    src, out = scratch(spark), scratch(spark)
    table(spark, sf_dir, "events").select("event_id").write.json(src)
    tries = iter(range(1000))

    def deliver(rows):
        first = next(tries) == 0
        return rows.where((F.col("event_id") % 10 == 7) | (F.lit(first) & (F.col("event_id") % 3 == 0)))

    E.dispatch(spark, spark.readStream.schema("event_id long").json(src), deliver, 3, out).awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{out}/dead").select("event_id")


@add("z12_view", "SELECT unnest([1, 1, 2, 3]) AS run, (SELECT count(*) FROM orders) AS n, unnest([0, 5, 11, 12]) AS at")
def z12(spark, sf_dir):
    """A view is computed once, read until its time is up, and computed anew when an input of it was."""
    o, runs = table(spark, sf_dir, "orders"), []

    def compute():
        runs.append(1)
        return o.agg(F.count(F.lit(1)).alias("n"))

    views = E.Views(spark, scratch(spark))
    views.define("base", lambda: o.limit(1), 100)
    views.define("total", compute, 10, ("base",))
    rows = []
    for at in (0, 5, 11, 12):
        if at == 12:
            views.get("base", 12)
        n = views.get("total", at).first()["n"]
        rows.append((len(runs), n, at))
    return spark.createDataFrame(rows, "run int, n long, at int")


@add("z13_cache", "SELECT unnest(['computed', 'l1', 'l2']) AS name, unnest(['3', '1', '1']) AS value")
def z13(spark, sf_dir):
    now = [0.0]
    cache = extension.TwoLevelCache(spark, most=1, ttl=10, clock=lambda: now[0])
    n = table(spark, sf_dir, "nation")
    counted = lambda: n.agg(F.count(F.lit(1)).alias("n"))
    cache.get("a", counted)  # computed
    cache.get("a", counted)  # l1
    cache.get("empty", lambda: n.where("false"))  # computed, pushes a out of l1
    cache.get("a", counted)  # l2
    now[0] = 11.0
    cache.get("a", counted)  # its time is up
    return extension.rows_of(spark, cache.hits)


@add("z14_directory_scan", "SELECT '/d/' || p_partkey || '.txt' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'deleted' WHEN p_partkey % 7 = 0 THEN 'updated' END AS change FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 UNION ALL SELECT '/d/new' || p_partkey || '.txt', 'added' FROM part WHERE p_partkey % 13 = 0")
def z14(spark, sf_dir):
    """Two states of a directory: path and content hash of each file; files that are ignored are in neither."""
    p = table(spark, sf_dir, "part").select("p_partkey", q("/d/{p_partkey}.txt").alias("path"), F.col("p_name").alias("content_hash"))
    files = lambda d: d.select("path", "content_hash").where(~F.col("path").endswith(".tmp"))
    old = files(p.unionByName(p.where("p_partkey % 17 = 0").withColumn("path", q("/d/{p_partkey}.tmp"))))
    now = p.where("p_partkey % 5 <> 0").withColumn("content_hash", F.when(F.col("p_partkey") % 7 == 0, "changed").otherwise(F.col("content_hash")))
    new = files(now.unionByName(p.where("p_partkey % 13 = 0").withColumn("path", q("/d/new{p_partkey}.txt"))))
    return temporal.change_set(old, new, "path")


@add("z16_circuit", "SELECT unnest(range(9)) AS call, unnest(['failed', 'failed', 'refused', 'ok', 'ok', 'ok', 'failed', 'failed', 'refused']) AS outcome, unnest(['closed', 'open', 'open', 'half_open', 'closed', 'closed', 'closed', 'open', 'open']) AS state")
def z16(spark, sf_dir):
    """Two failures open it; after a rest two successes close it; a retry waits 1, 2, 4, ... seconds in between."""
    now, rows = [0.0], []
    breaker = extension.CircuitBreaker(failures=2, rest=10, clock=lambda: now[0])

    def outcome(works: bool) -> str:
        try:
            return breaker.call(lambda: "ok" if works else 1 // 0)
        except extension.CircuitOpen:
            return "refused"
        except ZeroDivisionError:
            return "failed"

    for call, (step, works) in enumerate([(0, False), (0, False), (5, True), (6, True), (0, True), (0, True), (0, False), (0, False), (9, True)]):
        now[0] += step
        rows.append((call, outcome(works), breaker.state))
    return spark.createDataFrame(rows, "call long, outcome string, state string")


# --- extension points -------------------------------------------------------------------------------------------------


@add("p1_capabilities", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 5001")
def p1(spark, sf_dir):
    """An executor for a capability, replaced once, run by the query plane under its plan's digest."""
    release = _release(spark, sf_dir)
    plane = QueryPlane(release, Policy(frozenset({"analyst"}), frozenset({"report"})))
    c = table(spark, sf_dir, "customer")
    plane.executors.register("semantic_search", lambda plan: c.limit(0))
    plane.executors.register("semantic_search", lambda plan: c.where(F.col("c_mktsegment") == plan.request["segment"]).select("c_custkey").orderBy("c_custkey"), replace=True)
    plan = plane.plan("semantic_search", {"segment": "BUILDING"}, "analyst", "report", 5000, [release.resources[-1].resource_id])
    return plane.execute(plan, plan.digest)


@add("p2_connectors", "SELECT s_suppkey, s_name FROM supplier")
def p2(spark, sf_dir):
    connectors = extension.Connectors()
    connectors.offer("table", lambda name: table(spark, sf_dir, name), ("name",))
    try:
        connectors.connect("table")
    except ValueError:
        return connectors.connect("table", name="supplier").select("s_suppkey", "s_name")
    raise AssertionError("a source without its options was connected")


@add("p3_compilers", "SELECT 'owl' AS target, p_brand AS name FROM part GROUP BY p_brand UNION ALL SELECT 'shacl', p_brand || ':shape' FROM part GROUP BY p_brand UNION ALL SELECT 'sdk', count(DISTINCT p_brand)::VARCHAR FROM part")
def p3(spark, sf_dir):
    c = extension.Compilers()
    c.target("sdk", lambda r, made: made["shacl"].agg(F.count(F.lit(1)).cast("string").alias("name")), ("shacl",))
    c.target("shacl", lambda r, made: made["owl"].select(F.concat("name", F.lit(":shape")).alias("name")), ("owl",))
    c.target("owl", lambda r, made: r.select(F.col("p_brand").alias("name")).distinct())
    out = c.compile(table(spark, sf_dir, "part"), ["sdk"])
    rows = [d.select(F.lit(k).alias("target"), "name") for k, d in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@add("p4_generators", "SELECT 'relations' AS generator, count(*) AS n FROM customer UNION ALL SELECT 'tools', (SELECT count(*) FROM nation)")
def p4(spark, sf_dir):
    from orrery.plans.catalog_temporal import _triples

    g = extension.Generators()
    g.generator("relations", training.relation_qa, ("triples",))
    g.generator("tools", training.tool_samples, ("nodes",))
    g.generator("unread", lambda d: d, ("documents",))
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))
    made = g.generate({"triples": _triples(spark, sf_dir), "nodes": nodes})
    rows = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("generator"), "n") for k, d in made.items()]
    return rows[0].unionByName(rows[1])


@add("p5_view_functions", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def p5(spark, sf_dir):
    views = E.Views(spark, scratch(spark))
    views.define("by_priority", lambda: table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n")), 60)
    return views.get("by_priority", dt.datetime(2024, 1, 1).timestamp())


@add("p7_graph_backends", "SELECT unnest(['lazy', 'stored']) AS backend, (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + 1 AS nodes, (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + (SELECT count(*) FROM nation) AS edges")
def p7(spark, sf_dir):
    """The same changes to both backends: a node is added, one is renamed, the customers of a nation go."""
    nodes, edges = _located(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("c"), "c_custkey").alias("id"))
    rows = []
    for name in extension.graph_backends().names():
        b = extension.graph_backends().get(name)(nodes, edges)
        b.upsert(spark.createDataFrame([("new", "New"), ("n1", "Renamed")], "id string, label string"), edges.limit(0))
        b.delete(gone)
        rows.append((name, b.nodes().count(), b.edges().count()))
    return spark.createDataFrame(rows, "backend string, nodes long, edges long")


@add("p8_task_executors", "SELECT unnest(['count', 'broken', 'none']) AS task_type, unnest(['completed', 'failed', 'failed']) AS status, unnest([(SELECT count(*) FROM part)::VARCHAR, 'None', 'None']) AS result")
def p8(spark, sf_dir):
    tasks = extension.TaskExecutors()
    tasks.register("count", lambda name: table(spark, sf_dir, name).count())
    tasks.register("broken", lambda name: 1 // 0)
    done = [tasks.run(extension.Task(t, {"name": "part"})) for t in ("count", "broken", "none")]
    return spark.createDataFrame([(t.task_type, t.status, str(t.result)) for t in done], "task_type string, status string, result string")


# --- samples and the smaller operators --------------------------------------------------------------------------------


@add("m7_trajectories", "SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'system' WHEN 'assistant' THEN 'assistant' ELSE 'user' END || ':' || sha256(text), '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1")
def m7(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "user", "Customer").otherwise(F.col("role")))
    out = training.conversations(m)
    return out.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), F.sha2(x["content"], 256))), "|").alias("messages"))


@add("m8_satisfactory", "SELECT o_custkey AS run, o_orderkey AS number, 'q' || o_orderkey AS question, o_orderpriority AS answer FROM orders WHERE o_totalprice / 500000 >= 0.7")
def m8(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("number"), (F.col("o_totalprice") / 500000).alias("score"), q("q{o_orderkey}").alias("question"), F.col("o_orderpriority").alias("answer"))
    m = training.satisfactory(o, 0.7)
    return m.select("run", "number", F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@add("k1_title_links", "WITH t AS (SELECT p_name AS title, count(*) AS n, min('p' || p_partkey) AS path FROM part GROUP BY 1) SELECT 's' || s_suppkey AS source, title AS target, CASE WHEN n = 1 THEN path END AS path, n > 1 AS ambiguous FROM supplier JOIN part ON p_partkey = s_suppkey JOIN t ON title = p_name")
def k1(spark, sf_dir):
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    links = s.join(p, F.col("p_partkey") == F.col("s_suppkey")).select(q("s{s_suppkey}").alias("source"), F.col("p_name").alias("target"))
    return rdf.unique_title_links(links, p.select(F.col("p_name").alias("title"), q("p{p_partkey}").alias("path")))


@add("k2_snapshot_cursor", "SELECT count(*) AS n, true AS same_in_any_order, true AS moved_by_a_change FROM orders")
def k2(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    at = lambda d: temporal.snapshot_cursor(d, ["o_orderkey", "o_orderstatus"]).first()
    a, b, c = at(o), at(o.repartition(5).orderBy(F.desc("o_orderkey"))), at(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 0, "x").otherwise(F.col("o_orderstatus"))))
    return spark.createDataFrame([(a["n"], a == b, a["cursor"] != c["cursor"])], "n long, same_in_any_order boolean, moved_by_a_change boolean")


@add("k3_explicit_usage", "SELECT event_id AS call_id, event_type AS asset, event_type IN ('view', 'click') AS known FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0")
def k3(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    arguments = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("asset"))))
    calls = e.select(F.col("event_id").alias("call_id"), F.when(F.col("event_id") % 3 == 0, "other").otherwise("use").alias("tool"), arguments.alias("arguments"))
    registry = spark.createDataFrame([("view", 1), ("click", 1)], "asset string, known int")
    return training.explicit_usage(calls, registry, "use").select("call_id", "asset", F.col("known").isNotNull().alias("known"))


@add("k5_feedback_candidates", "WITH l AS (SELECT o_custkey AS run, arg_max(o_orderkey, o_orderkey) AS k FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1) SELECT run, unnest([0, 1]) AS pos, unnest(['t' || k, 'u' || k]) AS term FROM l")
def k5(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("number"), (F.col("o_orderkey") % 4).alias("unmatched_count"), F.array(q("t{o_orderkey}"), q("u{o_orderkey}"), q("v{o_orderkey}")).alias("terms"))
    return training.feedback_candidates(o, 2)


@add("k6_guard_tokens", "SELECT DISTINCT unnest([p_brand, p_type]) AS token FROM part")
def k6(spark, sf_dir):
    return governance.guard_tokens(table(spark, sf_dir, "part").select(F.array("p_brand", "p_type").alias("must_contain")))


@add("k8_release_facts", "SELECT o_custkey AS release_id, o_orderkey AS fact_id, l_linenumber AS line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 2 = 0")
def k8(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    releases = o.groupBy(F.col("o_custkey").alias("release_id")).agg(F.collect_list("o_orderkey").alias("fact_ids")).withColumn("approved", F.col("release_id") % 2 == 0)
    facts = o.select(F.col("o_orderkey").alias("fact_id"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.col("l_linenumber").alias("line"))
    return temporal.release_facts(releases, facts, evidence).select("release_id", "fact_id", "line")


@add("k9_sections", "SELECT c_custkey, unnest([1, 2]) AS n, unnest([c_name, 'Two']) AS title, unnest(['in ' || c_mktsegment, 'What of ' || c_name || '? Really?']) AS body, ['What of ' || c_name || '?'] AS questions FROM customer")
def k9(spark, sf_dir):
    text = q("preface\n# {c_name}\n\nin {c_mktsegment}\n## Two\nWhat of {c_name}? Really?")
    d = table(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    return governance.sections(d, "c_custkey", "text").join(governance.questions(d, "c_custkey", "text"), "c_custkey")


@add("k11_acl", "SELECT o_orderkey AS request_id, o_custkey % 3 = 0 OR coalesce(CASE WHEN o_orderkey % 5 < 3 THEN o_orderkey % 2 = 0 END, o_orderkey % 4 <> 1) AS allowed FROM orders")
def k11(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    requests = o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("object_id"), F.col("o_custkey").cast("string").alias("user_id"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise("someone").alias("owner"))
    first = o.where("o_orderkey % 5 < 3").select(F.col("o_orderkey").alias("object_id"), F.lit(1).alias("position"), F.col("o_custkey").cast("string").alias("subject"), (F.col("o_orderkey") % 2 == 0).alias("allow"))
    anyone = o.select(F.col("o_orderkey").alias("object_id"), F.lit(2).alias("position"), F.lit("*").alias("subject"), (F.col("o_orderkey") % 4 != 1).alias("allow"))
    return temporal.acl(requests, first.unionByName(anyone).unionByName(anyone.select("object_id", F.lit(0).alias("position"), F.lit("nobody").alias("subject"), F.lit(True).alias("allow"))))


@add("k15_action_policy", "SELECT o_orderkey AS request_id, o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' AND o_orderkey % 10 <= 5 AND o_orderstatus <> 'P' AND o_custkey % 4 <> 3 AS allowed FROM orders")
def k15(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_custkey") % 4 == 3, "unknown").otherwise("ship").alias("action"), F.col("o_orderstatus").alias("role"), F.col("o_orderpriority").alias("purpose"), (F.col("o_orderkey") % 10).alias("impacted"))
    policies = spark.createDataFrame([("ship", ["F", "O"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], 5)], "action string, roles array<string>, purposes array<string>, max_impacted int")
    return governance.action_allowed(requests, policies)
