"""Mixing against targets worked out by hand and by brute force."""

import re
from collections import Counter, defaultdict

import numpy as np

from orrery.llm import mixing


def docs(spark, n=900):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        source = ["a", "b", "é", None, "B"][int(rng.choice(5, p=[0.5, 0.2, 0.1, 0.1, 0.1]))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))) + "\x0b\n", source, 1))
    rows += [(None, "x y", "a", 1), (5, "x y", "a", 1), (5, "x y", "a", 1), (1000, None, "b", 1), (1001, "q " * 4000, "a", 1), (1002, "", "only-empty", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(4)


def brute_targets(sizes):
    """Pour the budget in, a little at a time per weight, by repeated proportional filling."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    goal, fixed = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if not s}
    while True:
        left = 1.5 * sum(sizes) - sum(goal[i] for i in fixed)
        open_ = [i for i in range(len(sizes)) if i not in fixed]
        for i in open_:
            goal[i] = left * weights[i] / sum(weights[j] for j in open_)
        over = [i for i in open_ if goal[i] > 2 * sizes[i]]
        if not over:
            return goal
        for i in over:
            goal[i] = 2.0 * sizes[i]
            fixed.add(i)


def test_plan(spark):
    rows, df = docs(spark)
    got = mixing.mix_plan(df, shards=7).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, brute_targets([sizes[s] for s in order]), strict=True))
    taken, blocks, largest = Counter(), defaultdict(set), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6 * max(1, goal[r.source])
        assert r.taken == r.size * len(r.draws) <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        for d in r.draws:
            blocks[r.source, d.block].add(d.shard)
    for s in order:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    assert all(len(v) == 1 and 0 <= min(v) < 7 for v in blocks.values())
    again = mixing.mix_plan(df.repartition(2), shards=7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_tree_deals_exactly():
    quotas = np.array([1000, 0, 37, 5, 801])
    dealt = mixing.split_quotas(quotas, 24, 3)
    assert (dealt.sum(axis=0) == quotas).all()
    assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 1
    assert np.ptp(dealt[:, 0]) > 0 and abs(dealt[:, 0].mean() - 1000 / 24) < 1e-9


def test_mix_repeats_rows(spark):
    rows, df = docs(spark, 60)
    plan = {(r.doc_id, r.size): len(r.draws) for r in mixing.mix_plan(df).collect() if r.doc_id is not None and r.doc_id > 5}
    mixed = mixing.mix(df)
    assert mixed.columns == ["doc_id", "text", "source", "shard", "local_key"]
    count = Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect() if r.doc_id is not None and r.doc_id > 5)
    assert count == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mix(df.where("false")).count() == 0


def test_equal_rows_meet_the_target(spark):
    rows = [(1, "a b c", "s")] * 1000 + [(2, "a b", "t"), (2, "a b", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix_plan(df).collect()
    taken = sum(r.taken for r in plan if r.source == "s")
    assert len(plan) == 1002 and abs(taken - plan[0].target if plan[0].source == "s" else 0) <= 3
    mixed = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert 3 * mixed[1] == taken and 2 * mixed[2] == sum(r.taken for r in plan if r.source == "t")
