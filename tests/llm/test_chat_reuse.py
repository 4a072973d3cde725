"""Calls and results that reuse an id stay one row each."""

import json
import os

import duckdb

from orrery.llm import chat, queries
from tests.llm.test_chat import COLUMNS, SCHEMAS, call

DIR = "/root/testdata/sf0.001"


def test_reused_ids_keep_every_call_and_result(spark):
    ask = lambda turn, *calls: (1, turn, "assistant", json.dumps({"tool_calls": list(calls)}))
    tell = lambda turn, i, text: (1, turn, "tool", json.dumps({"tool_call_id": i, "content": text}))
    rows = [ask(1, call("c", q=1)), ask(1, call("c", q=1)), tell(2, "c", "one"), ask(3, call("c", q=1), call("d", needs=["e"]), call("e")), tell(4, "c", "two"), tell(5, "c", "three")]
    rows += [(2, 1, "user", "q"), (2, 1, "user", "p"), (2, 2, "assistant", "b"), (2, 2, "assistant", "a"), (2, 2, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)
    out = chat.link(df, SCHEMAS, each=True).collect()
    got = sorted((r.conv_id, r.turn, r.call_id, r.status, r.n_calls, r.n_results, json.loads(r.record).get("result"), r.layer) for r in out)
    assert got == [
        (1, 1, "c", "linked", 2, 1, "one", 0),
        (1, 3, "c", "linked", 1, 1, "two", 0),
        (1, 3, "d", "call_without_result", 1, 0, None, 1),
        (1, 3, "e", "call_without_result", 1, 0, None, 0),
        (1, 5, "c", "result_without_call", 0, 1, "three", 0),
        (2, 1, "turn-1", "linked", 1, 1, "b", 0),
        (2, 1, "turn-1", "linked", 1, 2, "a", 0),
    ]


def test_query_keeps_the_rows_of_its_sql(spark):
    duck = duckdb.connect()
    path = f"{DIR}/conversations.parquet"
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = queries.op1_chat(spark, DIR)
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES['op1_chat']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
