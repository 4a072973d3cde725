"""Graph methods without SQL, against plain versions on small graphs."""

import random

import numpy as np
import pytest

from orrery.operators import graph


def random_graph(seed, n=24, p=0.12):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < p]


def frames(spark, edges, extra=()):
    ids = sorted({x for e in edges for x in e} | set(extra))
    return spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long")


def planted(groups=3, size=8, seed=1):
    """Dense groups with single edges between them."""
    rng = random.Random(seed)
    edges = [(g * 100 + a, g * 100 + b) for g in range(groups) for a in range(size) for b in range(a) if rng.random() < 0.8]
    return edges + [(g * 100, ((g + 1) % groups) * 100 + 1) for g in range(groups)]


def quality(edges, label, resolution=1.0):
    pairs = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    m, k = len(pairs), {}
    for a, b in pairs:
        k[label[a]] = k.get(label[a], 0) + 1
        k[label[b]] = k.get(label[b], 0) + 1
    inside = sum(label[a] == label[b] for a, b in pairs)
    return inside / m - resolution * sum((v / (2 * m)) ** 2 for v in k.values())


@pytest.mark.parametrize("method", ["louvain", "greedy_modularity", "label_propagation"])
def test_planted_communities(spark, method):
    nodes, edges = frames(spark, planted(), extra=(999,))
    got = {r.id: r.label for r in graph.METHODS[method](nodes, edges).collect()}
    assert len(got) == 25 and got[999] == 999
    groups = [{got[i] for i in got if i // 100 == g} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


@pytest.mark.parametrize("method", ["louvain", "greedy_modularity", "label_propagation"])
def test_estimated_size_does_not_grow_with_the_rounds(spark, method):
    nodes, edges = frames(spark, planted(groups=2, size=5))
    made = graph.METHODS[method](nodes, edges)
    assert made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**40


def test_mergers_stop_when_none_gains(spark):
    e = random_graph(1, 16, 0.15)
    nodes, edges = frames(spark, e)
    label = {r.id: r.label for r in graph.greedy_modularity(nodes, edges).collect()}
    assert quality(e, label) > quality(e, {i: i for i in label}) + 0.2
    pairs = [(min(x), max(x)) for x in e]
    found = sorted(set(label.values()))
    for a in found:
        for b in found:
            if a < b and len(set(pairs)) == len(pairs):
                assert quality(e, {i: a if x == b else x for i, x in label.items()}) <= quality(e, label) + 1e-9


@pytest.mark.parametrize("seed", [3])
def test_labels_settle_on_a_bipartite_graph(spark, seed):
    rng = random.Random(seed)
    e = [(a, 100 + b) for a in range(15) for b in range(12) if rng.random() < 0.25]
    nodes, edges = frames(spark, e)
    label = {r.id: r.label for r in graph.label_propagation(nodes, edges).collect()}
    near = {}
    for a, b in e:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    for i, others in near.items():
        votes = [label[o] for o in others]
        assert votes.count(label[i]) == max(votes.count(v) for v in votes)


def test_labels_that_do_not_settle_are_an_error(spark):
    nodes, edges = frames(spark, planted())
    with pytest.raises(RuntimeError):
        graph.label_propagation(nodes, edges, rounds=1)


def test_pagerank_of_a_cyclic_graph(spark):
    e = random_graph(5)
    nodes, edges = frames(spark, e, extra=(77,))
    ids = [r.id for r in nodes.collect()]
    out = {i: [b for a, b in e if a == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(200):
        loose = sum(rank[i] for i in ids if not out[i])
        new = {i: (0.5 + 0.5 * loose) / len(ids) for i in ids}
        for i in ids:
            for j in out[i]:
                new[j] += 0.5 * rank[i] / len(out[i])
        rank = new
    got = {r.id: r["rank"] for r in graph.pagerank(nodes, edges, 0.5, tolerance=1e-8).collect()}
    assert all(abs(got[i] - rank[i]) < 1e-5 for i in ids)


def test_eigenvector_against_numpy(spark):
    e = [x for a, b in random_graph(6) for x in ((a, b), (b, a))]
    nodes, edges = frames(spark, sorted(set(e)))
    ids = [r.id for r in nodes.orderBy("id").collect()]
    a = np.zeros((len(ids), len(ids)))
    for s, d in set(e):
        a[ids.index(d), ids.index(s)] = 1
    values, vectors = np.linalg.eigh(a)
    want = np.abs(vectors[:, np.argmax(values)])
    got = {r.id: r.eigenvector for r in graph.eigenvector(nodes, edges).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-3)


def hops(e, source):
    seen, front = {source: 0}, [source]
    while front:
        front = [b for a in front for x, b in e if x == a and b not in seen and not seen.update({b: seen[a] + 1})]
    return seen


def test_betweenness_and_closeness(spark):
    e = random_graph(7, 10, 0.2)
    nodes, edges = frames(spark, e)
    ids = [r.id for r in nodes.collect()]
    between = dict.fromkeys(ids, 0.0)
    for s in ids:
        for t in ids:
            if s == t or t not in hops(e, s):
                continue
            paths, front = [], [[s]]
            while not paths:
                front = [[*p, b] for p in front for a, b in e if a == p[-1] and b not in p]
                paths = [p for p in front if p[-1] == t]
            for p in paths:
                for x in p[1:-1]:
                    between[x] += 1 / len(paths)
    n = len(ids)
    got = {r.id: r.betweenness for r in graph.betweenness(nodes, edges).collect()}
    assert all(abs(got[i] - between[i] / ((n - 1) * (n - 2))) < 1e-9 for i in ids)
    close = {r.id: r.closeness for r in graph.closeness(nodes, edges, nodes).collect()}
    back = [(b, a) for a, b in e]
    for i in ids:
        d = hops(back, i)
        total, r = sum(d.values()), len(d) - 1
        assert abs(close[i] - (r / total * r / (n - 1) if total else 0.0)) < 1e-9


def test_shortest_path_is_shortest_and_least(spark):
    e = random_graph(8)
    nodes, edges = frames(spark, e)
    for source, target in ((0, 5), (2, 2), (0, 999)):
        got = graph.shortest_path(edges, source, target).first()
        front, best = [[source]], None
        while front and best is None:
            done = [p for p in front if p[-1] == target]
            best = min(done) if done else None
            front = [[*p, b] for p in front for a, b in e if a == p[-1] and b not in p] if len(front) < 5000 else []
        assert got["exists"] == (best is not None) and (got["path"] is None if best is None else len(got["path"]) == len(best))


def test_seeds_take_any_number_of_candidates(spark):
    nodes = spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (3, "x"), (4, None)], "id long, label string")
    words = spark.createDataFrame([(f"w{i}",) for i in range(500)] + [("ALPHA",), ("x",)], "c string")
    assert [(r.id, r.score) for r in graph.seeds(nodes, words).collect()] == [(1, 10.0), (3, 10.0), (2, 3.0)]


def test_tidied_components_are_the_same(spark):
    from orrery.operators import components

    edges = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    kept = {r.node: r.component for r in components.connected_components(edges, tidied=True).collect()}
    assert kept == {r.node: r.component for r in components.connected_components(edges).collect()} == dict.fromkeys(range(200), 0)
