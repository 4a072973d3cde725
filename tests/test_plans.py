"""Driver-side planning: resources, intents, policy, federation, guards."""

import pytest

from orrery.operators import datalog
from orrery.plans import catalog_semantic, semantic
from orrery.plans.model import Release, Resource, canonical_json, digest, topological
from orrery.plans.query_plane import Policy, QueryPlane, Registry, allowed_purposes, check_cap, federated_evidence, guard_read_only, render, scoped
from orrery.plans.semantic import Filter, Intent


def test_canonical_json():
    assert canonical_json({"b": [1, True, None], "a": "é"}) == '{"a":"é","b":[1,true,null]}'
    assert digest({"a": 1, "b": 2}) == digest({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        canonical_json(float("nan"))


def test_intent_text_and_order_of_filters():
    a = Intent(("revenue",), ("l_returnflag",), (Filter("l_quantity", "lt", 5), Filter("l_linestatus", "eq", "F")))
    b = Intent(("revenue",), ("l_returnflag",), (Filter("l_linestatus", "eq", "F"), Filter("l_quantity", "lt", 5)))
    x, y = (semantic.compile_intent(catalog_semantic.LINEITEM, i) for i in (a, b))
    assert x.sql == y.sql and x.digest == y.digest
    assert x.sql == 'SELECT "l_returnflag" AS "l_returnflag", SUM("l_extendedprice") AS "revenue" FROM "lineitem" WHERE "l_linestatus" = :p1 AND "l_quantity" < :p2 GROUP BY "l_returnflag" ORDER BY "l_returnflag"'
    assert x.parameters == {"p1": "F", "p2": 5}


@pytest.mark.parametrize("bad", [Intent(()), Intent(("none",)), Intent(("revenue",), ("none",))])
def test_bad_intents(bad):
    with pytest.raises((ValueError, KeyError)):
        semantic.compile_intent(catalog_semantic.LINEITEM, bad)
    with pytest.raises(ValueError):
        Filter("x", "in", [])


def test_plan_is_pinned(spark):
    plane = QueryPlane(catalog_semantic.LINEITEM, Policy(frozenset({"analyst"}), frozenset({"report"}), max_rows=3))
    plane.executors.register("semantic_sql", lambda plan: spark.range(10))
    with pytest.raises(ValueError):
        plane.executors.register("semantic_sql", None)
    rid = "sem://demo/sales/metric/revenue"
    plan = plane.plan("semantic_sql", {}, "analyst", "report", 3, [rid])
    assert "sem://demo/sales/physicaldataset/lineitem" in plan.request["resources"]
    rows = plane.execute(plan, plan.digest).collect()
    assert len(rows) == 4
    with pytest.raises(ValueError):
        check_cap(rows, 3)
    with pytest.raises(ValueError):
        plane.execute(plan, "sha256:other")
    with pytest.raises(PermissionError):
        plane.plan("semantic_sql", {}, "guest", "report", 3, [rid])
    with pytest.raises(KeyError):
        plane.plan("semantic_sql", {}, "analyst", "report", 3, ["sem://demo/sales/metric/none"])


def test_federated_steps(spark):
    plane = QueryPlane(catalog_semantic.LINEITEM, Policy(frozenset(), frozenset()))
    plane.executors = Registry()
    plane.executors.register("a", lambda request, inputs: spark.range(request["n"]))
    plane.executors.register("b", lambda request, inputs: inputs["one"].where("id > 1"))
    got = plane.federated({"two": {"capability": "b", "request": {}, "needs": ["one"]}, "one": {"capability": "a", "request": {"n": 4}}})
    assert got["two"].count() == 2
    assert topological({"b": ["a"], "a": [], "c": ["b", "a"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        topological({"a": ["b"], "b": ["a"]})


def test_guards():
    assert guard_read_only("SELECT 'drop' AS x FROM t")
    assert guard_read_only("PREFIX e: <http://x/delete> SELECT ?s WHERE { ?s ?p ?o }", "sparql")
    for bad, language in (("DROP TABLE t", "sql"), ("SELECT 1; DELETE FROM t", "sql"), ("MATCH (n) DELETE n", "cypher"), ("SELECT (1", "sql")):
        with pytest.raises(ValueError):
            guard_read_only(bad, language)
    assert render("a ${b}", {"b": 1}) == "a 1"
    with pytest.raises(KeyError):
        render("${x}", {})
    with pytest.raises(ValueError):
        Resource("sem://t/d/metric/x y", "Metric", "x")
    assert allowed_purposes([["a", "b"], ["b", "c"]]) == ["b"]


def test_policy_waivers():
    p = Policy(frozenset({"r"}), frozenset({"p"}), deny=frozenset({"x"}), waivers=frozenset({"purpose_denied", "role_denied"}))
    verdict = p.evaluate("other", "other", 1, ["x"])
    assert verdict["findings"] == ["role_denied", "resource_denied:x"] and verdict["waived"] == ["purpose_denied"]


def test_scope_and_evidence(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "id string, x int, y int")
    assert scoped(df, "id", ["a"], ["id", "x"]).collect() == [("a", 1)]
    e = spark.createDataFrame([("e1",), ("e2",)], "evidence_id string")
    assert federated_evidence([e, e]).count() == 2


def test_release_digest_and_closure():
    r = Release("x", catalog_semantic.LINEITEM.resources[:2])
    assert r.digest != catalog_semantic.LINEITEM.digest
    assert [x.kind for x in r.closure([r.resources[1].resource_id])] == ["Metric", "PhysicalDataset"]


PROGRAM = """
ancestor(X, Y) :- parent(X, Y).
ancestor(X, Z) :- parent(X, Y), ancestor(Y, Z).
has_child(X) :- parent(X, Y).
leaf(X) :- person(X), not has_child(X).
"""


def test_datalog(spark):
    facts = {"parent": spark.createDataFrame([("alice", "bob"), ("bob", "carol")], "a string, b string"), "person": spark.createDataFrame([("alice",), ("bob",), ("carol",)], "a string")}
    out = datalog.infer(spark, PROGRAM, facts, proofs=True)
    assert {tuple(r) for r in out["ancestor"].collect()} == {("alice", "bob", "ruleset:rule-2"), ("bob", "carol", "ruleset:rule-2"), ("alice", "carol", "ruleset:rule-3")}
    assert [r.t0 for r in out["leaf"].collect()] == ["carol"]
    assert all(r.rule_id is None for r in out["person"].collect())


@pytest.mark.parametrize("bad", ["a(X) :- b(Y).", "a(X) :- b(X), not c(Y).", "a(X).", "p(X) :- b(X), not q(X).\nq(X) :- b(X), not p(X)."])
def test_bad_programs(bad):
    with pytest.raises(ValueError):
        datalog.stratify(datalog.parse(bad))


def test_changes_count_by_effective_time(spark):
    rows = [("c2", 11, "retract", "on", "a"), ("c1", 10, "assert", "on", "a"), ("c3", 10, "assert", "on", "b"), ("c3", 10, "assert", "on", "b")]
    changes = spark.createDataFrame(rows, "change_id string, effective_at int, op string, predicate string, t0 string")
    assert [tuple(r) for r in datalog.fold(changes).collect()] == [("on", "b")]


def test_simulation(spark):
    facts = {"debt": spark.createDataFrame([("a",)], "t0 string")}
    more = {"debt": spark.createDataFrame([("b",)], "t0 string")}
    d, blocked = datalog.simulate(spark, "review(X) :- debt(X).\nstop(X) :- debt(X), frozen(X).", facts, more, {}, "review", "stop")
    assert [tuple(r) for r in d.collect()] == [("b", "added")] and not blocked


def test_as_of_takes_the_last_row_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 7, "c")], "k int, u int, v string")
    got = {(r.k, r.t): r.v for r in semantic.as_of(left, right, ["k"], ["k"], "t", "u").collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}


def test_filters_reach_the_scan(spark):
    compiled = semantic.compile_intent(catalog_semantic.LINEITEM, Intent(("revenue",), ("l_returnflag",), (Filter("l_quantity", "gt", 45.0),)))
    df = semantic.run(compiled, spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan
    assert "l_comment" not in plan and plan.count("l_") and "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan
