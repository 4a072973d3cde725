"""Exact and line de-duplication, and sharding, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from orrery.llm import exact_dedup, line_dedup, sharding


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


ROWS = [(1, "Abc", "x"), (2, "aBC", "x"), (3, "É", "x"), (4, "é", "x"), (5, None, "x"), (6, "", None), (None, "abc", "x"), (7, "solo", "x"), (7, "solo", "x"), (8, "ſ K", "x"), (9, "ſ k", "x"), (None, None, "x")]
COLUMNS = "doc_id long, text string, digest string"


def dedup_oracle(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[low(t)].append(i)
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
        for n, i in enumerate(order):
            out.append((i, order[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("tracked", [4096, 2])
def test_exact(spark, tracked):
    rows = ROWS + [(100 + i, "HOT text", "y") for i in range(400)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = exact_dedup.exact_duplicates(df, tracked=tracked)
    assert sorted(map(tuple, got.collect()), key=str) == dedup_oracle(rows)
    kept = exact_dedup.drop_exact_duplicates(df, tracked=tracked)
    assert kept.columns == df.columns
    want = Counter((r[0], r[4]) for r in dedup_oracle(rows) if r[3])
    assert Counter((r.doc_id, hashlib.sha256(low(r.text).encode()).hexdigest()) for r in kept.collect()) == want


def test_exact_of_nothing(spark):
    df = spark.createDataFrame([], COLUMNS)
    assert exact_dedup.exact_duplicates(df).count() == exact_dedup.drop_exact_duplicates(df).count() == 0


def lines_oracle(rows, least=40, docs=5):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(i)
    gone = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("tracked", [4096, 3])
def test_lines(spark, tracked):
    long = "This Line is of forty characters and more, É " * 2
    rows = [(i, f"{i}\n  {long.upper() if i % 2 else long}\t\n{'short' if i % 3 else long}\r", 1) for i in range(8)]
    rows += [(20 + i, f"second long line that only four documents ever hold {'x' * 9}\ny", 1) for i in range(4)]
    rows += [(50, None, 1), (51, "", 1), (52, "\n\n", 1), (None, long, 1), (None, long, 1), (3, rows[3][1], 1), (60, "\n".join([long] * 500), 1), (61, "x" * 40, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int").repartition(3)
    got = line_dedup.drop_frequent_lines(df, tracked=tracked)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == lines_oracle(rows)
    assert line_dedup.drop_frequent_lines(df.where("false")).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n))
        assert (sharding.permute(p, n, inverse=True) == np.arange(n)).all()
    p = sharding.permute(np.arange(100_000), 100_000)
    assert abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02


def test_shards(spark):
    rows = [(i, f"t{i % 7}" * (i % 50)) for i in range(997)] + [(None, None)] * 30 + [(5, "same")] * 40
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    got = sharding.shard_plan(df.repartition(4)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sharding.invert([r.shard], [r.slot], len(rows))[0] == r.row_number for r in got[:50])
    again = sharding.shard_plan(df.repartition(2)).drop("row_number").collect()
    assert Counter(map(str, again)) == Counter(str(r) for r in sharding.shard_plan(df).drop("row_number").collect())
    assert sharding.shard_plan(df.where("false")).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(500).selectExpr("id AS doc_id", "concat('t', id) AS text")
    sharding.write_shards(df, str(tmp_path / "s"), shards=4, tasks_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 500 and back.groupBy("shard").count().agg({"count": "max"}).first()[0] == 125


def test_shards_with_clashing_names_null_and_repeated_ids(spark, tmp_path):
    from orrery.llm import sharding

    rows = [(i % 40 if i % 7 else None, f"text {i % 90}", i, i, i, i) for i in range(200)] + [(1, None, 0, 0, 0, 0)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, row_number int, shard int, part int").repartition(3)
    plan = sharding.shard_plan(df, shards=5).collect()
    assert len(plan) == 203
    for s in range(5):
        assert sorted(r.slot for r in plan if r.shard == s) == list(range(len([r for r in plan if r.shard == s])))
    sharding.write_shards(df, str(tmp_path / "out"), shards=5, tasks_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 203 and set(back.columns) == {"doc_id", "text", "size", "row_number", "part", "shard", "slot"}
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.part)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
