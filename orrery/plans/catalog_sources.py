"""Queries of sources, parsers and sinks: files are written to the shared folder from the tables and read back."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from orrery.operators import rdf, temporal
from orrery.operators.graph import triples
from orrery.plans.catalog import add
from orrery.plans.extension import Connectors
from orrery.session import scratch, store, table
from orrery.sources import documents as D
from orrery.sources import readers, writers


def q(*parts):
    """Texts from columns and literals: names of columns stand in braces."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in re.split(r"(\{\w+\})", "".join(parts)) if p])


@add("s1_csv", "SELECT item_id::VARCHAR AS item_id, sha256(text) AS text_sha256 FROM benchmark")
def s1(spark, sf_dir):
    path = scratch(spark)
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table(spark, sf_dir, "benchmark").write.options(header=True, escape='"', **keep).csv(path)
    return readers.read_csv(spark, path).select("item_id", F.sha2("text", 256).alias("text_sha256"))


@add("s2_json", """SELECT (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS "index", '{"k":' || c_custkey || ',"name":"' || c_name || '"}' AS record FROM customer
    UNION ALL SELECT 0, '{"n":' || n_nationkey || ',"z":{"r":' || n_regionkey || '}}' FROM nation UNION ALL SELECT (i - 1)::INT, '{"_index":' || (i - 1) || ',"value":' || i || '}' FROM range(1, 4) t(i)""")
def s2(spark, sf_dir):
    path = scratch(spark)
    item = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_custkey").alias("k")))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", item.alias("j")))), lambda x: x["j"]).alias("a"))
    text = F.concat(F.lit("["), F.array_join("a", ", "), F.lit("]"))
    files = rows.select(F.col("c_nationkey").cast("string").alias("part"), F.when(F.col("c_nationkey") % 2 == 0, text).otherwise(F.concat(F.lit('{"data":'), text, F.lit("}"))).alias("value"))
    one = table(spark, sf_dir, "nation").select(F.concat(F.lit("one"), "n_nationkey").alias("part"), q('{ "z": {"r": {n_regionkey}}, "n": {n_nationkey} }').alias("value"))
    scalars = spark.createDataFrame([("scalars", "[1, 2, 3]")], "part string, value string")
    files.unionByName(one).unionByName(scalars).repartition("part").write.partitionBy("part").text(path)
    return readers.read_json(spark, path).select("index", "record")


@add("s3_sql_dump", """SELECT 'supplier' AS "table", CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE ['s_suppkey', 's_name'] END AS columns, '(' || s_suppkey || ', ''' || s_name || '; it''''s (ok)'')' AS values_sql FROM supplier
    UNION ALL SELECT 'orders', NULL, 'SELECT * FROM orders WHERE k = ' || n_nationkey FROM nation""")
def s3(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    values = q("({s_suppkey}, '{s_name}; it''s (ok)');")
    dumps = s.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("INSERT INTO supplier VALUES "), values)).otherwise(F.concat(F.lit("-- a; comment\ninsert into `supplier` (s_suppkey, \"s_name\")\nvalues "), values)).alias("text"))
    return readers.read_sql_dump(dumps.unionByName(table(spark, sf_dir, "nation").select(q("SELECT * FROM orders WHERE k = {n_nationkey}").alias("text"))))


@add("s4_sniff", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'csv' WHEN page_id % 4 = 1 THEN 'xml' WHEN page_id % 4 = 2 THEN 'jupyter' ELSE 'yaml' END AS kind FROM pages")
def s4(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("a/"), "page_id", F.lit(".CSV"))).otherwise(F.concat(F.lit("a/"), "page_id"))
    content = F.when(k == 2, '{"cells": [], "metadata": {}}').when(k == 3, "name: x\nkind: y\n- one\n").otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", D.sniff(path, content).alias("kind"))


@add("s5_fenced_blocks", """SELECT p_partkey, n, kind, language, body FROM part, LATERAL (SELECT unnest([{'n': 0, 'kind': 'text', 'language': NULL, 'body': '# ' || p_name}, {'n': 1, 'kind': 'code', 'language': 'sql', 'body': 'select ' || p_partkey || E'\\nfrom part'},
    {'n': 2, 'kind': 'text', 'language': NULL, 'body': p_brand}]) AS r) t(r), LATERAL (SELECT r.n, r.kind, r.language, r.body) x""")
def s5(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", q("# {p_name}\n\n```sql\nselect {p_partkey}\nfrom part\n```\n{p_brand}\n").alias("text"))
    return D.fenced_blocks(d, "p_partkey", "text")


@add("s6_notebook_cells", "SELECT s_suppkey, 0 AS n, 'markdown' AS kind, '# ' || s_name AS body FROM supplier UNION ALL SELECT s_suppkey, 1, 'code', E'x = ' || s_suppkey || E'\\nx' FROM supplier")
def s6(spark, sf_dir):
    text = q('{"nbformat": 4, "metadata": {}, "cells": [{"cell_type": "markdown", "source": "# {s_name}"}, {"cell_type": "code", "source": ["x = {s_suppkey}\\n", "x"]}]}')
    return D.notebook_cells(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@add("s7_xml_snippets", "SELECT s_suppkey, 0 AS n, 'f(' || s_suppkey || ')' AS code, s_name AS annotation, ['a', 'b'] AS tags FROM supplier UNION ALL SELECT s_suppkey, 1, 'g', NULL, [] FROM supplier")
def s7(spark, sf_dir):
    text = q("<all><snippet id='1'><code>f({s_suppkey})</code>\n<annotation> {s_name} </annotation><tags>a, b,</tags></snippet><sample><code>g</code></sample></all>")
    return D.xml_snippets(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@add("s8_yaml_records", "SELECT s_suppkey, 0 AS n, 'f(' || s_suppkey || ')' AS code, s_name AS annotation FROM supplier UNION ALL SELECT s_suppkey, 1, 'plain', NULL FROM supplier")
def s8(spark, sf_dir):
    text = F.when(F.col("s_suppkey") % 2 == 0, q("examples:\n- snippet: f({s_suppkey})\n  description: '{s_name}'\n- plain\n")).otherwise(q("- code: f({s_suppkey})\n  comment: '{s_name}'\n- plain\n"))
    return D.yaml_records(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", "text")


CODE = "# about {s_name}\n# two lines\n\nx = {s_suppkey}\ny = 2\n// last\nz"


@add("s9_comment_blocks", """SELECT s_suppkey, unnest([0, 1, 2, 3]) AS n, unnest(['comment', 'code', 'comment', 'code']) AS kind, unnest(['# about ' || s_name || E'\\n# two lines', 'x = ' || s_suppkey || E'\\ny = 2', '// last', 'z']) AS body FROM supplier""")
def s9(spark, sf_dir):
    return D.comment_blocks(table(spark, sf_dir, "supplier").select("s_suppkey", q(CODE).alias("text")), "s_suppkey", "text")


@add("n9_link_annotation", "SELECT s_suppkey, unnest([1, 3]) AS n, unnest(['# about ' || s_name || E'\\n# two lines', '// last']) AS annotation FROM supplier")
def n9(spark, sf_dir):
    blocks = D.comment_blocks(table(spark, sf_dir, "supplier").select("s_suppkey", q(CODE).alias("text")), "s_suppkey", "text")
    return D.link_annotation(blocks, "s_suppkey").where("kind = 'code'").select("s_suppkey", "n", "annotation")


SCRIPT = "-- how many {s_name}?\nuse x;\nselect count(*) from t;\n\n\n\n\n\n\n\n\n\nselect 2 from a join b.c on 1 = 1;"


@add("n11_question_hints", "SELECT s_suppkey, 2 AS n, 'how many ' || s_name || '?' AS hint FROM supplier UNION ALL SELECT s_suppkey, 12, NULL FROM supplier")
def n11(spark, sf_dir):
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.split(q(SCRIPT), "\n")).alias("n", "line"))
    return D.question_hints(lines, "s_suppkey").select("s_suppkey", "n", "hint")


@add("k13_regression_cases", "SELECT s_suppkey, unnest([2, 12]) AS n, unnest(['select count(*) from t;', 'select 2 from a join b.c on 1 = 1;']) AS expected_sql, unnest([['t'], ['a', 'b.c']]) AS must_contain FROM supplier")
def k13(spark, sf_dir):
    from orrery.operators.governance import regression_cases

    return regression_cases(table(spark, sf_dir, "supplier").select("s_suppkey", q(SCRIPT).alias("text")), "s_suppkey", "text").select("s_suppkey", "n", "expected_sql", "must_contain")


@add("s10_jsonl_connector", "SELECT o_orderkey, o_orderpriority, true AS snapshot, true AS unchanged_is_empty FROM orders")
def s10(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").write.json(path)
    connectors = Connectors()
    connectors.offer("jsonl", lambda path, roots: readers.jsonl_connector(spark, path, roots), ("path", "roots"))
    fetch = connectors.connect("jsonl", path=path, roots=[path.rsplit("/", 1)[0]])
    batch = fetch(None)
    again = fetch(batch.cursor).rows.isEmpty()
    return batch.rows.select("o_orderkey", "o_orderpriority", F.lit(batch.snapshot).alias("snapshot"), F.lit(again).alias("unchanged_is_empty"))


@add("s13_event_stream", "SELECT event_id, event_type FROM events")
def s13(spark, sf_dir):
    src, out = scratch(spark), scratch(spark)
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(src)
    stream = readers.event_stream(spark, src, "event_id long, event_type string")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@add("s14_registry", "SELECT unnest(['events', 'jsonl', 'table']) AS name")
def s14(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in readers.connectors().names()], "name string")


@add("s15_discover", "SELECT '/in/' || source AS directory, count(*) AS file_count, sum(n_chars)::BIGINT AS bytes FROM documents WHERE lang <> 'fr' AND n_chars <= 5000 GROUP BY ALL HAVING count(*) >= 2")
def s15(spark, sf_dir):
    path = F.concat(F.lit("/in/"), "source", F.lit("/"), "doc_id", F.when(F.col("lang") == "fr", ".exe").otherwise(".MD"))
    return D.discover(table(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("length")), 2, 5000)


@add("s16_listing", "SELECT r_regionkey AS region, CASE WHEN r_regionkey = 0 THEN 'deleted' WHEN r_regionkey = 1 THEN 'updated' ELSE 'added' END AS change FROM region WHERE r_regionkey IN (0, 1, 4)")
def s16(spark, sf_dir):
    """Two listings of one prefix, before and after files went, changed and came: etag diff against the state."""
    path = scratch(spark)
    n = table(spark, sf_dir, "nation").coalesce(1)
    put = lambda rows, r: rows.coalesce(1).write.mode("overwrite").json(f"{path}/region={r}")
    name = F.regexp_extract("path", r"region=(\d+)", 1).cast("int").alias("region")
    # Part files have new names after a rewrite, so a listing by folder is what is compared.
    state = lambda regions: readers.listing(spark, path, "*.json").select(name, "length").where(F.col("region").isin(regions))
    for r in range(4):
        put(n.where(f"n_regionkey = {r}"), r)
    before = temporal.row_hash(["length"])
    old = store(state([0, 1, 2, 3]).select("region", before.alias("etag")))
    put(n.where("n_regionkey = 1 and n_nationkey < 10"), 1)
    put(n.where("n_regionkey = 4"), 4)
    return temporal.change_set(old, state([1, 2, 3, 4]).select("region", before.alias("etag")), "region")


@add("s20_rdf_formats", """SELECT 'http://e/' || n_nationkey AS s, 'http://e/name' AS p, n_name AS o, 'literal' AS kind, CASE WHEN n_nationkey % 3 = 1 THEN NULL ELSE 'http://www.w3.org/2001/XMLSchema#string' END AS datatype, CASE WHEN n_nationkey % 3 = 1 THEN 'en' END AS lang FROM nation
    UNION ALL SELECT 'http://e/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://e/Nation', 'iri', NULL, NULL FROM nation
    UNION ALL SELECT 'http://e/' || n_nationkey, 'http://e/in', 'http://e/r' || n_regionkey, 'iri', NULL, NULL FROM nation""")
def s20(spark, sf_dir):
    turtle = q('@prefix e: <http://e/> .\n<http://e/{n_nationkey}> a e:Nation ; e:name "{n_name}" ; e:in e:r{n_regionkey} .')
    xml = q('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:Nation rdf:about="http://e/{n_nationkey}"><e:name xml:lang="en">{n_name}</e:name><e:in rdf:resource="http://e/r{n_regionkey}"/></e:Nation></rdf:RDF>')
    ld = q('{"@context": {"e": "http://e/", "name": "e:name", "in": {"@id": "e:in", "@type": "@id"}}, "@id": "e:{n_nationkey}", "@type": "e:Nation", "name": "{n_name}", "in": "e:r{n_regionkey}"}')
    k = F.col("n_nationkey") % 3
    return rdf.read_rdf(table(spark, sf_dir, "nation").select(F.when(k == 0, turtle).when(k == 1, xml).otherwise(ld).alias("text")))


#: Names of DuckDB's types, as Spark names them.
TYPES = "CASE data_type WHEN 'BIGINT' THEN 'xsd:long' WHEN 'INTEGER' THEN 'xsd:integer' WHEN 'DOUBLE' THEN 'xsd:double' WHEN 'TIMESTAMP' THEN 'xsd:dateTime' ELSE 'xsd:string' END"


@add("s21_schema_ontology", f"""WITH c AS (SELECT DISTINCT table_name, column_name, data_type, upper(table_name[1]) || table_name[2:] AS t FROM duckdb_columns() WHERE table_name IN ('customer', 'nation', 'orders'))
    SELECT DISTINCT 'class' AS kind, t AS name, '' AS domain, '' AS "range" FROM c
    UNION ALL SELECT CASE WHEN column_name IN ('o_custkey', 'c_nationkey') THEN 'object_property' ELSE 'datatype_property' END, column_name, t, CASE column_name WHEN 'o_custkey' THEN 'Customer' WHEN 'c_nationkey' THEN 'Nation' ELSE {TYPES} END FROM c""")
def s21(spark, sf_dir):
    keys = {("orders", "o_custkey"): "customer", ("customer", "c_nationkey"): "nation"}
    entries = readers.schema_to_ontology({n: table(spark, sf_dir, n) for n in ("customer", "nation", "orders")}, keys)
    return spark.createDataFrame([(e["kind"], e["name"], e["domain"], e["range"]) for e in entries], "kind string, name string, domain string, range string")


@add("s23_graph_loader", "SELECT s_suppkey AS src, 100000000 + n_nationkey AS dst, 'based_in' AS relation, s_name AS source, 'supplier' AS source_type, n_name AS target, 'nation' AS target_type FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def s23(spark, sf_dir):
    """Nodes and edges from files; edges to nodes that are not there fall out."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    far = lambda c: (F.col(c) + 100000000).cast("long")
    paths = [scratch(spark), scratch(spark)]
    s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("type")).unionByName(n.where("n_regionkey <> 2").select(far("n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("nation").alias("type"))).write.json(paths[0])
    s.select(F.col("s_suppkey").alias("src"), far("s_nationkey").alias("dst"), F.lit("based_in").alias("relation")).write.json(paths[1])
    nodes, edges = spark.read.schema("id long, label string, type string").json(paths[0]), spark.read.schema("src long, dst long, relation string").json(paths[1])
    return triples(nodes, edges)


@add("s24_chunks", "SELECT doc_id, sha256(trim(text)) AS chunk_sha256 FROM documents WHERE length(trim(text)) > 10 AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, sha256('a body of ' || doc_id) FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, sha256('written in ' || lang) FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL")
def s24(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("  ").alias("text"), F.when(F.col("doc_id") % 3 == 0, q("a body of {doc_id}")).alias("body"), F.when(F.col("doc_id") % 2 == 0, q("written in {lang}")).alias("summary"))
    return D.chunks(d, "doc_id").select("doc_id", F.sha2("chunk", 256).alias("chunk_sha256"))


@add("s25_audit_lines", "SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0")
def s25(spark, sf_dir):
    path = scratch(spark)
    line = F.to_json(F.struct("event_id", "event_type"))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return readers.read_audit(spark, path, "event_id long, event_type string")


@add("s26_normalise_result", "SELECT c_custkey, c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'unknown' END AS type, CASE WHEN c_custkey % 2 <> 0 THEN 'of ' || c_nationkey END AS text FROM customer")
def s26(spark, sf_dir):
    even = F.to_json(F.struct(F.struct(F.col("c_custkey").alias("uuid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category")).alias("node")))
    odd = F.to_json(F.struct(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("label"), q("of {c_nationkey}").alias("content")))
    return readers.normalise_result(table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd).alias("json")), "json")


@add("w2_jsonl", "SELECT o_orderkey, o_orderstatus, 2::BIGINT AS n FROM orders")
def w2(spark, sf_dir):
    path = scratch(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    writers.write_jsonl(o, path)
    writers.write_jsonl(o, path)
    return spark.read.schema("o_orderkey long, o_orderstatus string").json(path).groupBy("o_orderkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@add("w4_csv_export", "SELECT c_custkey::VARCHAR AS a_key, CASE WHEN c_custkey % 2 = 0 THEN '''=1+' || c_custkey ELSE c_name END AS b_cell FROM customer")
def w4(spark, sf_dir):
    path = scratch(spark)
    cell = F.when(F.col("c_custkey") % 2 == 0, q("=1+{c_custkey}")).otherwise(F.col("c_name"))
    writers.write_csv(table(spark, sf_dir, "customer").select(cell.alias("b_cell"), F.col("c_custkey").alias("a_key")), path)
    return readers.read_csv(spark, path)


@add("w5_gexf", """SELECT n, value FROM (SELECT 0 AS n, '<gexf version="1.3"><graph defaultedgetype="directed"><nodes>' AS value UNION ALL SELECT 1, '<node id="' || n_nationkey || '" label="' || n_name || ' &amp; &quot;co&quot;"/>' FROM nation
    UNION ALL SELECT 2, '</nodes><edges>' UNION ALL SELECT 3, '<edge source="' || n_nationkey || '" target="' || n_regionkey || '"/>' FROM nation UNION ALL SELECT 4, '</edges></graph></gexf>')""")
def w5(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return writers.gexf(n.select(F.col("n_nationkey").alias("id"), q('{n_name} & "co"').alias("label")), n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")))


@add("w6_html_report", "SELECT '<tr><td>' || c_custkey || '</td><td>&lt;' || c_name || '&amp;' || '</td></tr>' AS value FROM customer")
def w6h(spark, sf_dir):
    return writers.html_report(table(spark, sf_dir, "customer").select("c_custkey", q("<{c_name}&").alias("name")))


@add("w8_compiled_artifacts", """WITH r AS (SELECT p_partkey AS resource_id, CASE WHEN p_partkey % 3 = 0 THEN 'Metric' WHEN p_partkey % 3 = 1 THEN 'Class' ELSE 'Rule' END AS kind, p_name AS name FROM part),
    x AS (SELECT target, resource_id, '{"kind":"' || kind || '","name":"' || name || '","resource_id":' || resource_id || '}' AS artifact FROM r JOIN (VALUES ('owl', 'Class'), ('rag', 'Class'), ('rag', 'Metric'), ('datalog', 'Rule')) v(target, k) ON k = kind)
    SELECT *, 'sha256:' || sha256(artifact) AS artifact_hash FROM x""")
def w8(spark, sf_dir):
    k = F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resource_id"), F.when(k == 0, "Metric").when(k == 1, "Class").otherwise("Rule").alias("kind"), F.col("p_name").alias("name"))
    return writers.compiled_artifacts(p, {"owl": ["Class"], "rag": ["Class", "Metric"], "datalog": ["Rule"]})


@add("w9_batch_insert", "SELECT s_suppkey AS src, s_nationkey AS dst FROM supplier UNION ALL SELECT c_custkey, c_nationkey FROM customer")
def w9(spark, sf_dir):
    path = scratch(spark)
    writers.append(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst")), path)
    writers.append(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")), path)
    return spark.read.parquet(path)
