"""Extension points, guards of outside calls, sources that SQL has no words for."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from orrery.plans import extension
from orrery.plans.query_plane import guard_plan, guard_read_only
from orrery.sources import readers, writers


def test_retry_waits_longer_each_time():
    waits, left = [], iter([False, False, True])

    def f():
        if not next(left):
            raise OSError("no")
        return "yes"

    assert extension.retry(f, 3, 1.0, 60.0, 2.0, OSError, waits.append) == "yes" and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        extension.retry(lambda: 1 // 0, 2, sleep=waits.append)
    with pytest.raises(KeyError):
        extension.retry(lambda: {}["x"], 5, on=OSError, sleep=waits.append)
    assert waits == [1.0, 2.0, 1.0]


def test_cache_computes_once_for_many_threads(spark):
    made = []

    def compute():
        made.append(1)
        return spark.range(3)

    cache = extension.TwoLevelCache(spark)
    threads = [threading.Thread(target=lambda: cache.get("k", compute).count()) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(made) == 1 and cache.hits["computed"] == 1
    cache.drop("k")
    assert cache.get("k", compute).count() == 3 and len(made) == 2


def test_compilers_refuse_cycles_and_unknown_targets(spark):
    c = extension.Compilers()
    c.target("a", lambda r, made: r, ("b",))
    with pytest.raises(KeyError):
        c.compile(spark.range(1), ["a"])
    c.target("b", lambda r, made: r, ("a",))
    with pytest.raises(ValueError):
        c.compile(spark.range(1), ["a"])


def test_guards(spark):
    for good in ("SELECT replace(a, 'x', 'y') FROM t", "select `set`, add, load from t where copy = 1 and move > 2", "with x as (select 1 as update_at) select * from x"):
        assert guard_plan(spark, good) == good
    for bad in ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SELECT 1; DROP TABLE t", "DROP TABLE t", "SET a = 1"):
        with pytest.raises(Exception):  # noqa: B017 - the parser's own error counts too
            guard_plan(spark, bad)
    assert guard_read_only("MATCH (n) WHERE n.set = 1 RETURN n.create", "cypher")
    for bad in ("MATCH (n) DETACH DELETE n", "MATCH (n) REMOVE n.x", "MATCH (n) MERGE (m) RETURN m"):
        with pytest.raises(ValueError):
            guard_read_only(bad, "cypher")


def test_table_connector_reads_a_database(spark):
    """Derby comes with Spark; a database in memory of this one process."""
    url = "jdbc:derby:memory:orrery;create=true"
    spark.range(50).selectExpr("id", "concat('n', id) AS name").write.jdbc(url, "t", "overwrite", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    fetch = readers.table_connector(spark, url, "t", "id", 3, (0, 50), driver="org.apache.derby.jdbc.EmbeddedDriver")
    batch = fetch(None)
    assert batch.rows.count() == 50 and batch.snapshot and fetch(batch.cursor).rows.count() == 0
    with pytest.raises(ValueError):
        readers.table_connector(spark, url, "t; drop", "id")


@pytest.fixture()
def pages():
    """/N gives page N of three; /loop gives a cursor that comes back."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.strip("/") or "0"
            page = {"records": [{"p": name}], "next_cursor": "loop" if name == "loop" else str(int(name) + 1) if int(name) < 2 else None}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(page).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{cursor}}"
    server.shutdown()


def test_json_pages_to_the_end(spark, pages):
    spark.dataSource.register(readers.JsonPages)
    read = lambda **o: spark.read.format("json_pages").options(endpoint=pages, **o).load().collect()
    assert [json.loads(r.record)["p"] for r in read(cursor="0")] == ["0", "1", "2"]
    assert [r.next_cursor for r in read(cursor="0", pages="2")] == ["1", "2"]
    with pytest.raises(Exception, match="comes back"):
        read(cursor="loop")


def test_bundle_of_a_hub_loses_no_link(spark):
    nodes = spark.createDataFrame([("h", "Hub", "t")] + [(f"n{i}", "Leaf", "t") for i in range(25)], "id string, label string, type string")
    edges = spark.createDataFrame([("h", f"n{i}", "has") for i in range(25)] + [("n3", "h", "knows")], "src string, dst string, relation string")
    pages = {r.path: r.content for r in writers.bundle(nodes, edges, page_links=10).collect()}
    hub = [pages[p] for p in ("hub.md", "hub.2.md", "hub.3.md")]
    assert sum(p.count("\n- has: ") for p in hub) == 25 and sum(p.count("- from knows: ") for p in hub) == 1
    assert "[2](hub.2.md)" in pages["hub.md"] and "[3](hub.3.md)" in pages["hub.md"]
    assert sum(p.startswith("leaf") for p in pages) == 25 and sum(p.startswith("index/t") for p in pages) == 3
    assert "26 concepts and 26 relations" in pages["log.md"]


def test_bundle_has_one_page_a_node_and_type_however_long(spark):
    n = writers.LINES + 1
    nodes = spark.range(n).selectExpr("concat('n', id) AS id", "concat('Leaf ', id % 10000) AS label", "'t' AS type").unionByName(spark.sql("SELECT 'h' AS id, 'Hub' AS label, 'u' AS type"))
    edges = spark.range(n).selectExpr("concat('n', id) AS src", "'h' AS dst", "'in' AS relation")
    rows = writers.bundle(nodes, edges, numbered=False).collect()
    pages = {r.path: r.content for r in rows}
    assert len(rows) == n + 1 + 3 and [r.path for r in rows].count("leaf-0.md") == 2
    # The order of the lines is that of the names of their pages.
    names = sorted((f"leaf-{i % 10000}", f"Leaf {i % 10000}") for i in range(n))
    assert pages["hub.md"].split("---\n\n")[1] == "".join(f"- from in: [{label}]({base}.md)\n" for base, label in names)
    assert pages["index/t.md"] == "# t\n\n" + "".join(f"- [{label}]({base}.md)\n" for base, label in names)


def test_sql_dump_without_columns_and_with_quotes(spark):
    text = "INSERT INTO t VALUES (1,2); insert into `a.b` (x, \"y\") values ('a;b', ')'), (2, 'it''s') ;\n-- c; d\nINSERT INTO t VALUES (3)"
    got = readers.sql_records(text)
    assert got == [("t", None, "(1,2)"), ("a.b", ["x", "y"], "('a;b', ')'), (2, 'it''s')"), ("t", None, "(3)")]
    assert readers.sql_records("select 1 from a; SELECT ';' FROM b.c") == [("a", None, "select 1 from a;"), ("b.c", None, "SELECT ';' FROM b.c")]
    assert readers.sql_records("") == [] == readers.sql_records("nothing; here")


def test_hot_users_go_by_in_order(spark):
    from orrery.operators import temporal
    from orrery.streaming import events as E

    df = spark.range(30_000).selectExpr("1L AS user_id", "id AS event_id", "timestamp_seconds(id) AS ts")
    out = E.token_bucket(df, 0.5, 2.0)
    assert out.where("allowed").count() == 15_001
    chain = temporal.build_chain(df.selectExpr("user_id", "event_id", "'p' AS p"), "user_id", "event_id", "p")
    assert temporal.chain_faults(chain.selectExpr("*", "cast(event_id AS long) AS n"), "user_id", "n").isEmpty() and chain.count() == 30_000
