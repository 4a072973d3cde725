"""Tool-call linking, order, validation and canonical JSON."""

import json

from orrery.llm import chat

SCHEMAS = chat.SCHEMAS | {
    "find": {"properties": {"q": "string", "n": "integer", "x": "number", "f": "boolean", "a": "array", "o": "object"}, "required": ["q"], "additional": False},
    "free": {"properties": {}, "additional": True},
}
COLUMNS = "conv_id long, turn long, role string, text string, call_id string"


def call(i, name="free", needs=None, **arguments):
    return {"id": i, "name": name, "arguments": arguments} | ({"depends_on": needs} if needs else {})


def run(spark, rows, schemas=SCHEMAS):
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)
    return {(r.conv_id, r.call_id, r.turn): r for r in chat.link(df, schemas).collect()}


def test_plain_exchanges(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", 'a "b"\n/é'), (1, 2, "assistant", "yes"), (1, 3, "assistant", "again"), (1, 5, "user", None)]
    got = run(spark, rows)
    assert got[1, "turn-1", 1].record == '{"arguments":{"prompt":"a \\"b\\"\\n/é"},"id":"turn-1","name":"respond","result":"yes"}'
    assert (got[1, "turn-1", 1].status, got[1, "turn-1", 1].valid) == ("linked", True)
    assert got[1, "turn-2", 3].status == "result_without_call"
    assert (got[1, "turn-5", 5].status, got[1, "turn-5", 5].errors) == ("call_without_result", ["missing:prompt"])
    assert got[1, None, 0].record == '{"content":"be kind","role":"system"}' and len(got) == 4


def test_validation_and_canonical_json(spark):
    calls = [call("a", "find", q="x", n=3, x=1.5, f=True, a=[1], o={"z": 1, "b": {"d": None, "c": 2}}), call("b", "find", n=True, x=False, zz=1), call("c", "none"), call("d", "find", q=None, n=1.5)]
    rows = [(1, 1, "assistant", json.dumps({"tool_calls": calls})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})), (1, 3, "tool", "no json")]
    got = run(spark, rows)
    assert got[1, "a", 1].valid and json.loads(got[1, "a", 1].record)["result"] == "ok"
    assert got[1, "a", 1].record == '{"arguments":{"a":[1],"f":true,"n":3,"o":{"b":{"c":2,"d":null},"z":1},"q":"x","x":1.5},"id":"a","name":"find","result":"ok"}'
    assert got[1, "b", 1].errors == ["missing:q", "type:n", "type:x", "unknown:zz"]
    assert got[1, "c", 1].errors == ["unknown_tool"]
    assert got[1, "d", 1].errors == ["type:n", "type:q"]
    assert got[1, None, 3].status == "result_without_id"


def test_topological_order(spark):
    late = [call("a", needs=["b"]), call("b", needs=["c", "none"]), call("c"), call("d", needs=["a", "c"])]
    ring = [call("a", needs=["b"]), call("b", needs=["a"]), call("c", needs=["b"]), call("d")]
    fine = [call("a"), call("b", needs=["a"]), call("c", needs=["b"])]
    rows = [(i, 1, "assistant", json.dumps({"tool_calls": calls})) for i, calls in enumerate([late, ring, fine])]
    got = run(spark, rows)
    layer = {k[:2]: r.layer for k, r in got.items()}
    assert [layer[0, x] for x in "abcd"] == [2, 1, 0, 3]
    assert [layer[1, x] for x in "abcd"] == [None, None, None, 0]
    assert [layer[2, x] for x in "abc"] == [0, 0, 0]


def test_repeats_and_nulls(spark):
    rows = [(1, 1, "user", "q")] * 3 + [(1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (None, 1, "user", "q"), (None, 2, "assistant", "r"), (1, None, "user", "q"), (1, 7, None, None), (1, 8, "USER", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)
    out = chat.link(df).collect()
    by = sorted((str(r.conv_id), r.status, r.n_calls, r.n_results) for r in out)
    assert by == [("1", "call_without_id", 1, 0), ("1", "call_without_result", 1, 0), ("1", "context", 0, 0), ("1", "linked", 3, 2), ("None", "call_without_id", 1, 0), ("None", "result_without_id", 0, 1)]
    assert next(r for r in out if r.status == "linked").record.endswith('"result":"a"}')
    assert chat.link(df.where("false")).count() == 0


def test_ids_of_exchanges_and_of_json_differ(spark):
    rows = [(1, 1, "user", "q"), (1, 2, "assistant", json.dumps({"tool_calls": [call("turn-1", "find", q="x")]})), (1, 3, "tool", json.dumps({"tool_call_id": "turn-1", "content": "found"}))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)
    got = sorted((r.tool, r.status, r.turn) for r in chat.link(df, SCHEMAS).collect())
    assert got == [("find", "linked", 2), ("respond", "call_without_result", 1)]


def test_json_after_white_space_and_other_json(spark):
    rows = [(1, 1, "assistant", " \r\n\t" + json.dumps({"tool_calls": [call("a", "find", q="x")]})), (1, 2, "tool", "  " + json.dumps({"tool_call_id": "a", "content": "yes"})), (1, 5, "assistant", '{"tool_calls":[]}'), (1, 7, "assistant", '{"other":1}'), (1, 9, "assistant", "{broken")]
    got = run(spark, rows)
    assert got[1, "a", 1].status == "linked" and json.loads(got[1, "a", 1].record)["result"] == "yes"
    assert {k[1] for k, r in got.items() if r.status == "result_without_call"} == {"turn-4", "turn-6", "turn-8"} and len(got) == 4


def brute_layers(calls):
    """{id: layer} by the longest path below each call; None on a cycle or after one."""
    needs = {c["id"]: [n for n in c.get("depends_on", []) if any(d["id"] == n for d in calls)] for c in calls}
    layer = {}
    while True:
        ready = [c for c in needs if c not in layer and all(n in layer for n in needs[c])]
        if not ready:
            return {c: layer.get(c) for c in needs}
        layer |= {c: max((layer[n] + 1 for n in needs[c]), default=0) for c in ready}


def test_layers_of_random_dependencies(spark):
    import random

    rng, rows, want = random.Random(4), [], {}
    for conv in range(30):
        names = [f"c{i}" for i in range(rng.randrange(2, 25))]
        calls = [call(n, needs=rng.sample(names, min(len(names), rng.choice([0, 1, 1, 1, 2, 3]))) or None) for n in names]
        if conv % 2:  # without cycles: only on earlier names, told in another order
            calls = [call(n, needs=[m for m in names[:i] if rng.random() < 0.2] or None) for i, n in enumerate(names)]
            rng.shuffle(calls)
        rows.append((conv, 1, "assistant", json.dumps({"tool_calls": calls})))
        order = {c["id"]: i for i, c in enumerate(calls)}
        late = any(order[n] >= order[c["id"]] for c in calls for n in c.get("depends_on", []))
        want |= {(conv, k): v if late else 0 for k, v in brute_layers(calls).items()}
    got = {k[:2]: r.layer for k, r in run(spark, rows).items()}
    assert got == want


def test_a_long_chain(spark):
    n = 10_000
    rows = [(1, n - i, "assistant", json.dumps({"tool_calls": [call(f"c{i}", needs=[f"c{i - 1}"] if i else None)]})) for i in range(n)]
    got = run(spark, rows)
    assert all(got[1, f"c{i}", n - i].layer == i for i in (0, 1, 57, 4096, n - 1)) and len(got) == n
