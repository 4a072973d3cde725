"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from orrery.llm import embedding_dedup as ed


def brute(rows, threshold=0.93):
    good = []
    for k, (_, v, label) in enumerate(rows):
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(k if ok else None)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if good[i] is None or good[j] is None or rows[i][2] != rows[j][2] or len(rows[i][1]) != len(rows[j][1]):
                continue
            x, y = (np.array(np.array(rows[k][1], dtype=np.float32), dtype=np.float64) for k in (i, j))
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[top(k)] = min(row[0], least.get(top(k), row[0]))
    return sorted(((r[0], links[k], least.get(top(k)), r[0] is not None and r[0] == least.get(top(k))) for k, r in enumerate(rows)), key=str)


def rows(n=160, dim=16):
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        v = rng.normal(size=dim)
        out.append((3 * k, v.tolist(), int(k % 3)))
        if k % 4 == 0:
            out.append((3 * k + 1, (2 * v + rng.normal(size=dim) * 0.2).tolist(), int(k % 3)))
        if k % 10 == 0:
            out.append((3 * k + 2, v.tolist(), int(k % 3)))
    base = rng.normal(size=dim)
    out += [(10_000 + k, (base + rng.normal(size=dim) * 0.1).tolist(), 1) for k in range(60)]
    out += [(20_000, None, 1), (20_001, [0.0] * dim, 1), (20_002, base.tolist(), None), (20_003, [float("nan")] * dim, 1), (20_004, [1.0, None], 1)]
    out += [(20_005, [], 1), (None, base.tolist(), 1), (20_006, [1.0], 1), (20_007, [2.0], 1), (20_006, [1.0], 1)]
    return out


@pytest.mark.parametrize("block", [512, 8])
def test_same_as_brute_force(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(map(tuple, ed.near_duplicates(df, tables=10, block=block).collect()), key=str)
    assert got == brute(data)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * away
    a, b = ed.bucket_keys(x), ed.bucket_keys(y)
    met = (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.998


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    assert ed.near_duplicates(df).count() == 0


def test_columns_with_clashing_names(spark):
    data = [(1, [1.0, 0.0], 1, 7, 8, [1.0], "x"), (2, [1.0, 0.01], 1, 7, 8, [1.0], "x"), (3, [0.0, 1.0], 1, 7, 8, [1.0], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, id int, node int, vec array<double>, bucket string")
    got = sorted(map(tuple, ed.near_duplicates(df).collect()))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_a_large_group_is_compared_in_many_units(spark):
    """Every vector within the threshold of every other, and a few strangers: all links are counted once."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    data = [(k, (base + rng.normal(size=16) * 0.02).tolist(), 1) for k in range(300)] + [(1000 + k, rng.normal(size=16).tolist(), 1) for k in range(40)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    rows = {r.vec_id: r for r in ed.near_duplicates(df, block=16).collect()}
    assert all(rows[k].n_links == 299 and rows[k].component_id == 0 for k in range(300))
    assert all(rows[1000 + k].n_links == 0 for k in range(40))
