"""Sources, sinks, functions, RDF, graphs and streams on small inputs of our own."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from orrery.functions import text as X
from orrery.operators import audit, graph, metrics, rdf, retrieval, temporal, training
from orrery.plans.query_plane import Registry
from orrery.sources import documents, readers, writers
from orrery.streaming import events as E


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"x, ""y"""\n2,\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'x, "y"'), ("2", None)]
    for name, text in (("list", '[{"b":1,"a":2},3,"s"]'), ("data", '{"data":[{"x":1}]}'), ("object", '{"z":1,"y":2}')):
        (tmp_path / f"{name}.json").write_text(text)
    get = lambda n: [r.record for r in readers.read_json(spark, str(tmp_path / f"{n}.json")).orderBy("index").collect()]
    assert get("list") == ['{"a":2,"b":1}', '{"_index":1,"value":3}', '{"_index":2,"value":"s"}']
    assert get("data") == ['{"x":1}'] and get("object") == ['{"y":2,"z":1}']


def test_sql_dump(spark):
    df = spark.createDataFrame([("INSERT INTO `inv` (`sku`, name) VALUES (1, 'a');\ninsert into b (x) values (2);",), ("SELECT a FROM t.u WHERE x = 1;",)], "text string")
    rows = {(r.table, tuple(r.columns or ()), r.values_sql) for r in readers.read_sql_dump(df).collect()}
    assert rows == {("inv", ("sku", "name"), "(1, 'a')"), ("b", ("x",), "(2)"), ("t.u", (), "SELECT a FROM t.u WHERE x = 1;")}


def test_connectors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id":1}\n{"id":2}\n')
    fetch = readers.jsonl_connector(spark, str(tmp_path / "x.jsonl"), [str(tmp_path)])
    first = fetch(None)
    assert first.rows.count() == 2 and fetch(first.cursor).rows.count() == 0
    with pytest.raises(PermissionError):
        readers.jsonl_connector(spark, str(tmp_path / "../x.jsonl"), [str(tmp_path)])
    assert readers.connectors().names() == ["events", "jsonl", "table"]
    registry = Registry()
    registry.register("a", 1)
    with pytest.raises(ValueError):
        registry.register("a", 2)
    assert readers.listing(spark, str(tmp_path), "*.jsonl").count() == 1


def test_json_pages(spark):
    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            first = self.path.endswith("=")
            body = json.dumps({"records": [{"n": 1}, {"n": 2}] if first else [{"n": 3}], "next_cursor": "x" if first else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(readers.JsonPages)
    rows = spark.read.format("json_pages").option("endpoint", f"http://127.0.0.1:{server.server_port}/?c={{cursor}}").load().collect()
    server.shutdown()
    assert [(r.record, r.next_cursor) for r in rows] == [('{"n":1}', "x"), ('{"n":2}', "x"), ('{"n":3}', None)]


def test_schema_ontology(spark):
    t = {"tbl_order_item": spark.createDataFrame([], "id long, order_id long, price decimal(9,2)")}
    out = readers.schema_to_ontology(t, {("tbl_order_item", "order_id"): "orders"})
    assert [(e["kind"], e["name"], e["range"]) for e in out] == [("class", "OrderItem", ""), ("datatype_property", "id", "xsd:long"), ("object_property", "order_id", "Orders"), ("datatype_property", "price", "xsd:decimal")]
    assert readers.ontology_diff(out, out[:-1])["removed"] == ["datatype_property:OrderItem:price:xsd:decimal"]


def test_document_parsers(spark):
    df = spark.createDataFrame([(1, "intro\n```sql\nselect 1\n```\nend")], "id int, t string")
    assert [tuple(r)[2:] for r in documents.fenced_blocks(df, "id", "t").orderBy("n").collect()] == [("text", None, "intro"), ("code", "sql", "select 1"), ("text", None, "end")]
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, {"cell_type": "markdown", "source": "t"}]})
    df = spark.createDataFrame([(1, nb)], "id int, t string")
    assert [tuple(r)[2:] for r in documents.notebook_cells(df, "id", "t").orderBy("n").collect()] == [("code", "a\nb"), ("markdown", "t")]
    df = spark.createDataFrame([(1, "<a><snippet><code>x</code><annotation>n</annotation><tags>p, q</tags></snippet></a>")], "id int, t string")
    assert tuple(documents.xml_snippets(df, "id", "t").first()) == (1, 0, "x", "n", ["p", "q"])
    df = spark.createDataFrame([(1, "data:\n - code: c\n   description: d\n - plain"), (2, ": : bad")], "id int, t string")
    assert [tuple(r) for r in documents.yaml_records(df, "id", "t").orderBy("n").collect()] == [(1, 0, "c", "d"), (1, 1, "plain", None)]
    df = spark.createDataFrame([(1, "# a\n# b\nx = 1\ny = 2\n\n# c")], "id int, t string")
    blocks = documents.comment_blocks(df, "id", "t")
    assert [tuple(r)[2:] for r in blocks.orderBy("n").collect()] == [("comment", "# a\n# b"), ("code", "x = 1\ny = 2"), ("comment", "# c")]
    assert documents.link_annotation(blocks, "id").where("kind = 'code'").first()["annotation"] == "# a\n# b"
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate(["-- how many", "", "SELECT 1"])], "id int, n int, line string")
    assert documents.question_hints(lines, "id").first()["hint"] == "how many"
    files = spark.createDataFrame([("/d/a.csv", 5), ("/d/b.bin", 5), ("/e/c.md", 7)], "path string, length long")
    assert [tuple(r) for r in documents.discover(files).collect()] == [("/d", 1, 5), ("/e", 1, 7)]
    assert one(spark, documents.sniff(F.col("p"), F.col("c")), p="x.dat", c="a: 1\nb: 2\nc: 3") == "yaml"


def test_text_functions(spark):
    assert one(spark, X.slug(F.col("t")), t="  Héllo, World-中 ") == "h_llo_world-中"
    assert one(spark, X.mentions(F.col("t"), "Sale"), t="presale only") is False
    assert one(spark, X.normalise_link(F.col("t")), t="./a/../b/c.md#x") == "b/c.md"
    assert one(spark, X.normalise_link(F.col("t")), t="[[page|label]]") == "page"
    assert one(spark, X.front_matter(F.col("t")), t='---\ntitle: "A"\nk: 1\nk: 2\n---\nbody') == {"title": "A", "k": "2"}
    assert one(spark, X.concepts(F.col("t")), t="use `spark` and **bold** in DataFrame") == ["DataFrame", "bold", "spark"]
    assert one(spark, X.sql_smells(F.col("t")), t="select * from a join b join c join d join e") == ["select_star", "unbounded", "many_joins"]
    assert one(spark, X.sql_tables(F.col("t")), t="select 1 from B join a.c on 1=1") == ["a.c", "b"]
    assert one(spark, X.human_bytes(F.col("t").cast("long")), t="1536") == "1.5 KB"
    assert one(spark, X.parse_triplet(F.col("t")), t="A -> r -> B").asDict() == {"source": "A", "relation": "r", "target": "B"}
    assert one(spark, X.parse_triplet(F.col("t")), t="nothing") is None
    assert one(spark, X.code_language(F.col("t")), t="def f():\n  pass") == "python"
    assert one(spark, X.entity_candidates(F.col("t"), ("the",)), t="the Spark 数据引擎") == ["Spark", "数据引擎", "数据引", "据引擎", "数据", "据引", "引擎"]
    assert one(spark, X.instant(F.col("t")), t="2024-01-01T00:00:00") is None
    assert one(spark, X.path_text(F.split("a", ","), F.split("b", ",")), a="A,B,C", b="r,s") == "A --r--> B --s--> C"
    assert one(spark, X.intent_scores(F.col("t"), {"a": ["x"], "b": ["y", "z"]}), t="x y") == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    big = F.sha2("t", 256)
    assert one(spark, X.sampled_fingerprint(F.col("t").cast("binary")), t="abc") == one(spark, big, t="abc")


def test_minimise_and_guards(spark):
    df = spark.createDataFrame([("abcdefgh", "a@b", "=1+1")], "token string, email string, cell string")
    r = audit.minimise(df).first()
    assert r.token == "ab****gh" and r.email.startswith("sha256:") and r.cell == "=1+1"
    assert df.select(audit.csv_guard(F.col("cell")).alias("c")).first().c == "'=1+1"
    with pytest.raises(Exception, match="sentinel"):
        audit.leak_check(df, "=1").collect()


TURTLE = """
@prefix ex: <http://e/> . @prefix sh: <http://s/> .
ex:alice a ex:Person ; ex:name "Alice", "Al"@en ; ex:age 17 ; ex:manager ex:bob .
ex:bob a ex:Robot ; ex:knows [ ex:name "x\\n" ] . # note
"""


def test_rdf(spark):
    df = rdf.read_turtle(spark.createDataFrame([(TURTLE,), ("",)], "text string"))
    assert df.count() == 8
    shape = rdf.Shape("p", target_class="http://e/Person", properties=[rdf.PropertyShape("http://e/name", max_count=1), rdf.PropertyShape("http://e/age", min_inclusive=18, datatype=rdf.XSD + "integer"), rdf.PropertyShape("http://e/manager", cls="http://e/Person"), rdf.PropertyShape("http://e/mail", min_count=1)])
    found = sorted((r.path, r.component) for r in rdf.validate(df, shape).collect())
    assert found == [("http://e/age", "minInclusive"), ("http://e/mail", "minCount"), ("http://e/manager", "class"), ("http://e/name", "maxCount")]
    got = rdf.sparql(df, 'PREFIX e: <http://e/> SELECT ?n ?k WHERE { ?p e:name ?n . OPTIONAL { ?p e:knows ?k } FILTER(regex(?n, "^al$", "i")) }')
    assert [tuple(r) for r in got.collect()] == [("Al", None)]
    with pytest.raises(ValueError):
        rdf.sparql(df, "DELETE WHERE { ?s ?p ?o }")
    with pytest.raises(ValueError):
        rdf.parse_turtle("x:y <p> <o> .")
    nodes, edges = rdf.to_property_graph(df)
    assert nodes.count() == 3 and edges.count() == 2
    skos = rdf.read_turtle(spark.createDataFrame([(f'<a> <{rdf.SKOS}broader> <b> . <b> <{rdf.SKOS}broader> <a> . <a> <{rdf.SKOS}prefLabel> "x"@en, "y"@en . <c> <{rdf.OWL}deprecated> true .',)], "text string"))
    assert {tuple(r) for r in rdf.skos_findings(skos).collect()} == {("a", "broader_cycle"), ("b", "broader_cycle"), ("a", "duplicate_pref_label"), ("c", "deprecated_without_replacement")}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "r"), (2, 3, "r"), (3, 1, "r"), (3, 4, "s"), (6, 7, "s")], "src int, dst int, relation string")
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "id int")
    assert {r.id: r.component for r in graph.weak_components(n, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}
    assert graph.shortest_path(e, 1, 4).first().path == [1, 2, 3, 4]
    assert graph.shortest_path(e, 4, 1).first().exists is False
    assert [r.id for r in graph.cycles(e).orderBy("id").collect()] == [1, 2, 3]
    ranks = {r.id: r["rank"] for r in graph.pagerank(n, e).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6) and ranks[5] == min(ranks.values())
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src int, dst int")
    b = {r.id: r.betweenness for r in graph.betweenness(n.where("id < 5"), path).collect()}
    assert b == {1: 0.0, 2: pytest.approx(2 / 6), 3: pytest.approx(2 / 6), 4: 0.0}
    assert graph.all_paths(e, 1, 4, 5).count() == 1 and graph.two_hops(e).count() == 4
    assert graph.modularity(e, n.select("id", F.when(F.col("id") < 5, 1).otherwise(2).alias("label"))).first()[0] == pytest.approx(4 / 5 + 1 / 5 - (0.8**2 + 0.2**2))
    assert graph.communities(n, e).first()["size"] >= 3


def test_retrieval_layers(spark):
    rows = [(0, "a b c d"), (1, "a b c d"), (2, "a b c d e"), (3, "x y"), (4, "a b c d e f"), (5, "")]
    hits = spark.createDataFrame(rows, "pos int, chunk_text string")
    kept, out = [], []
    for pos, text in rows:
        w = set(text.split())
        if not any(len(w & k) / len(w | k) > 0.79 for k in kept if w | k):
            kept.append(w)
            out.append(pos)
    assert sorted(r.pos for r in retrieval.drop_similar(hits, 0.79).collect()) == out
    two = [("l1", 0, "s", "t", "k"), ("l2", 0, "s", "t", "k"), ("l2", 1, "s", "u", "k")]
    fused = retrieval.rrf(spark.createDataFrame(two, "list string, rank int, slug string, chunk_text string, type string"))
    assert {r.chunk_text: r.score for r in fused.collect()} == {"t": pytest.approx(2 / 60), "u": pytest.approx(1 / 61)}
    with pytest.raises(ValueError):
        retrieval.ground("sales in 2024", {})
    assert retrieval.ground("show gross sales", {"r": ["Sales"], "q": ["ale"]}) == ["r"]


def test_temporal(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "9")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "5"), ("d", "3"), ("f", "7")], "path string, content_hash string")
    assert {tuple(r) for r in temporal.renames(old, new).collect()} == {("a", "unchanged", None), ("b", "modified", None), ("d", "renamed", "c"), ("e", "deleted", None), ("f", "added", None)}
    assert temporal.schema_drift(None, new) == {"added": [], "removed": []}
    assert temporal.schema_drift(old, new.withColumnRenamed("path", "p")) == {"added": ["p"], "removed": ["path"]}
    chain = temporal.build_chain(spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "k string, n int, p string"), "k", "n", "p")
    assert temporal.chain_faults(chain, "k", "n").count() == 0
    assert temporal.chain_faults(chain.withColumn("payload", F.lit("z")), "k", "n").count() == 2
    assert temporal.snapshot_cursor(old, ["path"]).first() == temporal.snapshot_cursor(old.repartition(3), ["path"]).first()


def test_training_and_metrics(spark):
    df = spark.createDataFrame([(i,) for i in range(1003)], "id int")
    counts = {r.split: r["count"] for r in training.exact_split(df, "id").groupBy("split").count().collect()}
    assert counts == {"train": 802, "val": 100, "test": 101}
    reason = lambda m: spark.createDataFrame([(m,)], "m array<struct<role:string,content:string>>").select(training.sft_reason(F.col("m")).alias("r")).first().r
    assert reason([]) == "empty_messages" and reason([("assistant", "x" * 20)]) == "no_user_message"
    assert reason([("user", "long enough"), ("assistant", "short")]) == "answer_too_short"
    assert reason([("user", "long enough"), ("assistant", "x" * 20)]) is None
    with pytest.raises(Exception, match="finite"):
        metrics.finance_variance(spark.createDataFrame([("r", "p", float("inf"), 1.0, 1.0)], "region string, period string, revenue double, budget double, outstanding double")).collect()


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def write_events(folder, name, rows):
    (folder / name).write_text("".join(json.dumps(dict(zip(("event_id", "ts", "user_id", "event_type", "value"), r, strict=True))) + "\n" for r in rows))


def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [(i, f"2024-01-01T{i % 5:02d}:{i % 60:02d}:00Z", i % 3, "click", float(i)) for i in range(60)]
    write_events(src, "a.json", rows[:30])
    write_events(src, "b.json", rows[30:] + rows[:5])
    stream = readers.event_stream(spark, str(src), SCHEMA, 1)
    batch = spark.read.schema(SCHEMA).json(str(src))
    q = E.tumbling(E.idempotent(batch), "1 hour").collect()
    query = E.idempotent(stream, late="10 hours").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, E.tumbling(spark.table("once"), "1 hour").collect())) == sorted(map(tuple, q))
    done = E.ingest(spark, stream, "event_id", str(tmp_path / "t"))
    done.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "t/state/batch=1")).count() == 60
    assert spark.read.parquet(str(tmp_path / "t/changes/batch=1")).where("change = 'added'").count() == 30


def test_event_rules_emit_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write_events(src, "a.json", [(1, "2024-01-01T00:00:00Z", 7, "error", 1.0), (2, "2024-01-01T00:01:00Z", 8, "click", 1.0)])
    write_events(src, "b.json", [(1, "2024-01-01T00:00:00Z", 7, "error", 1.0), (3, "2024-01-01T00:02:00Z", 8, "error", 1.0)])
    facts = lambda d: {"failed": d.where("event_type = 'error'").select(F.col("user_id").cast("string").alias("t0"))}
    q = E.run_rules(spark, readers.event_stream(spark, str(src), SCHEMA, 1), "alert(X) :- failed(X).", "alert", str(tmp_path / "o"), facts)
    q.awaitTermination(200)
    assert sorted(r.t0 for r in spark.read.parquet(str(tmp_path / "o/out/batch=0"), str(tmp_path / "o/out/batch=1")).collect()) == ["7", "8"]


def test_token_bucket_and_views(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:00:01", 1), (3, "2024-01-01 00:00:02", 1), (4, "2024-01-01 00:01:00", 1)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long")
    assert [r.allowed for r in E.token_bucket(df, 1 / 50, 2.0).orderBy("event_id").collect()] == [True, True, False, True]
    views, calls = E.Views(spark, str(tmp_path)), []
    views.define("v", lambda: calls.append(1) or spark.range(0), 10.0)
    for now in (0.0, 5.0, 11.0):
        assert views.get("v", now).count() == 0
    assert len(calls) == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1)], "b string, a int")
    writers.write_csv(df, str(tmp_path / "o"))
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "o")).collect()] == [("1", "'=x")]
    nodes = spark.createDataFrame([("1", "A b", "t"), ("2", "a-b", "t")], "id string, label string, type string")
    edges = spark.createDataFrame([("1", "2", "r")], "src string, dst string, relation string")
    pages = {r.path: r.content for r in writers.concept_bundle(nodes, edges).collect()}
    assert set(pages) == {"a-b.md", "a-b-2.md"} and "- r: [a-b](a-b-2.md)" in pages["a-b.md"]
    assert writers.gexf(nodes, edges).count() == 6
    made = writers.compiled_artifacts(spark.createDataFrame([("r1", "Metric"), ("r2", "Rule")], "resource_id string, kind string"), {"owl": ["Metric"], "all": ["Metric", "Rule"]})
    assert made.count() == 3


def test_routing_and_cypher(spark):
    from orrery.operators import governance, routing
    from orrery.plans import cypher

    nodes = spark.createDataFrame([("1", "A x", ["T"]), ("2", "B", ["U"]), ("3", "A y", ["T", "U"])], "id string, name string, labels array<string>")
    edges = spark.createDataFrame([("1", "2", "r"), ("2", "3", "s"), ("3", "1", "r")], "src string, dst string, relation string")
    run = lambda q: [tuple(r) for r in cypher.run(q, nodes, edges).collect()]
    assert run("MATCH (a:T)-[e:r]->(b) WHERE a.name STARTS WITH 'A' AND NOT a.id IN ['3'] RETURN a.name, b.id") == [("A x", "2")]
    assert run("MATCH (a)-[e]-(b) WHERE a.id = '1' RETURN b.id ORDER BY b.id DESC SKIP 1 LIMIT 1") == [("2",)]
    assert sorted(run("MATCH (a)-[e]->(b) RETURN e.relation, count(*)")) == [("r", 2), ("s", 1)]
    for bad in ("MATCH (a) DELETE a", "MATCH (a)-[e]->(b) WHERE a.id RETURN a.id", "MATCH a RETURN a"):
        with pytest.raises((ValueError, IndexError)):
            run(bad)
    with pytest.raises(ValueError):
        cypher.template("neighbours", {"id": "'1' OR 1=1"}, nodes, edges)
    a = spark.createDataFrame([("k1", "h", 1), ("k2", "h", 5)], "key string, hash string, updated_at int")
    b = spark.createDataFrame([("k2", "g", 9), ("k3", "h", 1)], "key string, hash string, updated_at int")
    assert {tuple(r) for r in routing.sync_plan(a, b, "merge").collect()} == {("k1", "upload"), ("k2", "download"), ("k3", "download")}
    assert routing.sync_plan(a, b, "manual").where("action = 'conflict'").count() == 1
    cache = routing.Cached(1)
    assert cache.get("x", lambda: spark.range(3)).count() == 3 and cache.get("y", lambda: spark.range(2)).count() == 2 and list(cache.held) == ["y"]
    df = spark.createDataFrame([(1, "# One\ntext?\n## Two\nIs this a question? yes")], "id int, t string")
    assert [tuple(r)[2:] for r in governance.sections(df, "id", "t").orderBy("n").collect()] == [("One", "text?"), ("Two", "Is this a question? yes")]
    assert governance.questions(df, "id", "t").first()["questions"] == ["Is this a question?"]
    cases = governance.regression_cases(spark.createDataFrame([(1, "-- how many\nselect count(*) from a.b")], "id int, t string"), "id", "t").first()
    assert cases.hint == "how many" and cases.must_contain == ["a.b"]
    req = spark.createDataFrame([("q1", "x", "u", "p", 3), ("q2", "x", "u", "p", 9), ("q3", "z", "u", "p", 1)], "request_id string, action string, role string, purpose string, impacted int")
    pol = spark.createDataFrame([("x", ["u"], ["p"], 5)], "action string, roles array<string>, purposes array<string>, max_impacted int")
    assert {tuple(r) for r in governance.action_allowed(req, pol).collect()} == {("q1", True), ("q2", False), ("q3", False)}
    d = readers.normalise_result(spark.createDataFrame([('{"node":{"id":"7","title":"t"},"content":"c"}',)], "raw string"), "raw").first()
    assert tuple(d) == ("7", "t", "unknown", "c")
    acl = temporal.acl(
        spark.createDataFrame([("r1", "o", "ann", "bob"), ("r2", "o", "cyd", "bob"), ("r3", "p", "bob", "bob")], "request_id string, object_id string, user_id string, owner string"),
        spark.createDataFrame([("o", "ann", 2, False), ("o", "ann", 1, True), ("o", "*", 3, False)], "object_id string, subject string, position int, allow boolean"),
    )
    assert {tuple(r) for r in acl.collect()} == {("r1", True), ("r2", False), ("r3", True)}


def test_vocabulary_is_met_on_one_rare_gram(spark):
    import random

    from orrery.operators import retrieval as R

    rng = random.Random(5)
    made = sorted({" ".join(rng.choice(["red", "ring", "Bolt", "cold", "gear"]) for _ in range(3)) for _ in range(60)} | {"ab", "R", "\u9500\u552e\u989d\u8868\u683c"})
    cards = [(f"c{i % 40}", t) for i, t in enumerate(made)]
    asked = [f"is the {rng.choice(made)} of {rng.choice(made)}?" for _ in range(40)] + ["\u770b\u9500\u552e\u989d\u5417", "", None]
    rows = [(i, asked[i % len(asked)]) for i in range(3 * len(asked))]

    def score(q, t):
        q, t = q.lower(), t.lower()
        part = len(t) >= 4 and any("\u4e00" <= c <= "\u9fff" for c in t) and any(t[i : i + 3] in q for i in range(len(t) - 2))
        return 1.0 if t in q else 0.6 if part else 0.0

    want = {}
    for i, q in rows:
        for card, t in cards:
            if (s := score(q or "", t)) > 0:
                want[i, card] = max(want.get((i, card), (0.0, 0, "")), (s, len(t), t))
    terms = spark.createDataFrame(cards, "card string, term string")
    got = R.vocabulary_match(spark.createDataFrame(rows, "qid long, question string"), terms).collect()
    assert {(r.qid, r.card): (r.score, len(r.term), r.term) for r in got} == want and any(v[0] == 0.6 for v in want.values())
    keys = R._keys(terms.selectExpr("lower(term) AS lt"))
    assert keys.where("NOT lt rlike '[\u4e00-\u9fff]'").count() == len({t.lower() for t in made}) - 1 and keys.count() == len({t.lower() for t in made}) + 2


@pytest.mark.parametrize("most", [0, 4096])
def test_longest_prefix_broadcasts_nothing_that_grows_with_the_paths(spark, monkeypatch, most):
    from orrery.operators import retrieval as R

    monkeypatch.setattr(R, "ROUTES", most, raising=False)
    paths = ["/a/b/c", "/a/b", "/a", "/", "x", "", None, "/a/bc", "/a/b/c"]
    df = spark.createDataFrame(list(enumerate(paths)), "id int, path string")
    for kinds in ({"/a": "A", "/a/b": "AB", "/a/b/c/d": "D"}, {"": "all", "/a/b/": "AB"}):
        routes = spark.createDataFrame(list(kinds.items()), "prefix string, route string")
        made = R.longest_prefix(df, routes, "path", "none")
        rows = made.collect()
        best = lambda p: max((k for k in kinds if p is not None and p.startswith(k)), key=len, default=None)  # noqa: E731, B023
        assert {r.id: r.route for r in rows} == {i: kinds.get(best(p), "none") for i, p in enumerate(paths)}
        # The last join, with what was found for each path, is by shuffle even where it is small.
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "SortMergeJoin [path" in plan
