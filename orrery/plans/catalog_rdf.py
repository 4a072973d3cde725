"""Queries of RDF, shapes and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import rdf
from orrery.plans.catalog import add
from orrery.session import table

EX = "http://example.org/"


def triples(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    rows = rdf.from_rows(c, F.concat(F.lit(EX + "customer/"), "c_custkey"), EX).unionByName(rdf.from_rows(n, F.concat(F.lit(EX + "nation/"), "n_nationkey"), EX))
    iri = lambda d, s, p, o: d.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    lives = iri(c, F.concat(F.lit(EX + "customer/"), "c_custkey"), EX + "livesIn", F.concat(F.lit(EX + "nation/"), "c_nationkey"))
    kinds = iri(c, F.concat(F.lit(EX + "customer/"), "c_custkey"), rdf.TYPE, F.concat(F.lit(EX), "c_mktsegment"))
    sub = spark.createDataFrame([(EX + s, rdf.RDFS + "subClassOf", EX + "Customer", "iri", None, None) for s in ("BUILDING", "MACHINERY")], rdf.SCHEMA)
    return rows.unionByName(lives).unionByName(kinds).unionByName(sub)


@add("j21_graph_pattern", "SELECT c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j21(spark, sf_dir):
    return rdf.bgp(triples(spark, sf_dir), [("?c", EX + "c_name", "?name"), ("?c", EX + "livesIn", "?n"), ("?n", EX + "n_name", "?nation")]).select("name", "nation")


@add("d11_sparql_select", "SELECT c_name AS name, c_acctbal AS balance FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING' ORDER BY c_name LIMIT 20")
def d11(spark, sf_dir):
    q = 'PREFIX e: <http://example.org/> SELECT ?name ?balance WHERE { ?c e:c_name ?name . ?c e:c_mktsegment "BUILDING" . ?c e:c_acctbal ?balance . FILTER(?balance > 9000) } ORDER BY ?name LIMIT 20'
    return rdf.sparql(triples(spark, sf_dir), q).select("name", F.col("balance").cast("double").alias("balance"))


@add("d11_sparql_ask", "SELECT 'in 1' AS question, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 1) AS answer UNION ALL SELECT 'in 99', EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 99)")
def d11a(spark, sf_dir):
    ask = lambda n: rdf.sparql(triples(spark, sf_dir), f"PREFIX e: <http://example.org/> ASK {{ ?c e:livesIn <{EX}nation/{n}> }}").select(F.lit(f"in {n}").alias("question"), "answer")
    return ask(1).unionByName(ask(99))


@add("d11_sparql_construct", "SELECT 'http://example.org/nation/' || c_nationkey AS s, 'http://example.org/homeOf' AS p, c_name AS o FROM customer WHERE c_acctbal > 5000 UNION SELECT 'http://example.org/nation/' || c_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://example.org/Home' FROM customer WHERE c_acctbal > 5000")
def d11c(spark, sf_dir):
    return rdf.sparql(triples(spark, sf_dir), "PREFIX e: <http://example.org/> CONSTRUCT { ?n e:homeOf ?name ; a e:Home } WHERE { ?c e:livesIn ?n ; e:c_name ?name ; e:c_acctbal ?b . FILTER(?b > 5000) }")


@add("d11_sparql_describe", "SELECT 'http://example.org/nation/' || n_nationkey AS s, unnest(['http://example.org/n_nationkey', 'http://example.org/n_name', 'http://example.org/n_regionkey']) AS p, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS o FROM nation WHERE n_regionkey = 2 OR n_nationkey = 0")
def d11d(spark, sf_dir):
    t = triples(spark, sf_dir)
    some = rdf.sparql(t, 'PREFIX e: <http://example.org/> DESCRIBE ?n WHERE { ?n e:n_regionkey "2" }')
    return some.unionByName(rdf.sparql(t, f"DESCRIBE <{EX}nation/0>")).distinct()


@add("d11_sparql_union", "SELECT n_name AS nation, count(*)::BIGINT AS n, max(c_acctbal) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1 ORDER BY n DESC, nation LIMIT 9")
def d11u(spark, sf_dir):
    q = 'PREFIX e: <http://example.org/> SELECT ?nation (COUNT(?c) AS ?n) (MAX(?b) AS ?most) WHERE { { ?c e:c_mktsegment "BUILDING" } UNION { ?c a e:MACHINERY } ?c e:livesIn ?x . ?c e:c_acctbal ?b . ?x e:n_name ?nation } GROUP BY ?nation ORDER BY DESC(?n) ?nation LIMIT 9'
    return rdf.sparql(triples(spark, sf_dir), q)


@add("d13_shapes", "SELECT 'http://example.org/customer/' || c_custkey AS focus, 'http://example.org/c_acctbal' AS path, 'minInclusive' AS component FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal < 0")
def d13(spark, sf_dir):
    shape = rdf.Shape("customer", target_class=EX + "Customer", properties=[rdf.PropertyShape(EX + "c_acctbal", min_count=1, max_count=1, datatype=rdf.XSD + "double", min_inclusive=0.0), rdf.PropertyShape(EX + "c_name", min_count=1, min_length=3, pattern="^Customer")])
    return rdf.validate(triples(spark, sf_dir), shape)


@add("j18_instances", "SELECT 'http://example.org/customer/' || c_custkey AS id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def j18(spark, sf_dir):
    return rdf.instances(triples(spark, sf_dir), EX + "Customer")


@add("d14_functional", "SELECT 'o' || o_custkey AS s, 'status' AS p, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1")
def d14(spark, sf_dir):
    """A customer should have one status over all orders, and most do not; each name stands once."""
    o = table(spark, sf_dir, "orders")
    row = lambda p, v: [F.concat(F.lit("o"), "o_custkey").alias("s"), F.lit(p).alias("p"), v.cast("string").alias("o")]
    claims = o.select(*row("status", F.col("o_orderstatus"))).unionByName(o.select(*row("name", F.col("o_custkey")))).unionByName(o.select(*row("any", F.col("o_orderkey"))))
    return rdf.functional_conflicts(claims, ["status", "name"])


@add("s19_property_graph", "SELECT 'http://example.org/customer/' || c_custkey AS src, 'http://example.org/nation/' || c_nationkey AS dst FROM customer")
def s19(spark, sf_dir):
    return rdf.to_property_graph(triples(spark, sf_dir))[1].where(F.col("relation") == EX + "livesIn").select("src", "dst")


@add("d17_duplicates", "SELECT 'content' AS kind, sha256(text) AS key, count(*) AS n FROM documents GROUP BY 2 HAVING count(*) > 1")
def d17(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("type"), F.col("doc_id").cast("string").alias("title"), "text")
    return rdf.bundle_duplicates(d)


@add("d17_conflicts", "SELECT o_custkey AS entity, 'status' AS property, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def d17c(spark, sf_dir):
    return rdf.property_conflicts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.lit("status").alias("property"), F.col("o_orderstatus").alias("value")))


@add("j10_broken_links", "WITH l AS (SELECT url AS source, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT source, target FROM l WHERE target NOT IN (SELECT url FROM pages) AND target NOT IN (SELECT regexp_replace(url, '\\.md$', '') FROM pages)")
def j10(spark, sf_dir):
    from orrery.sources.documents import page_links

    p = table(spark, sf_dir, "pages")
    links = page_links(p).join(p.select("page_id", "url"), "page_id").select(F.col("url").alias("source"), F.col("link").alias("target"))
    return rdf.broken_links(links, p.select(F.col("url").alias("path")))
