"""Near copies on five-word shingles against brute force."""

import random
import re

import pytest

import corpus_pipeline as cp
from orrery.llm import near_copies


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute_kept(rows):
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, t in enumerate(sets[:i]):
            if s == t or 5 * len(s & t) >= 4 * len(s | t) > 0:
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return sorted(least.values())


def family(rng, n, edits):
    """A text and copies of copies, each with a few words changed."""
    out = [[f"w{rng.randrange(4000)}" for _ in range(n)]]
    for _ in range(edits):
        words = list(rng.choice(out))
        for _ in range(rng.choice([1, 1, 2, 4])):
            words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
        out.append(words)
    return [" ".join(w) for w in out]


def test_same_as_brute_force(spark):
    rng = random.Random(3)
    texts = [t for n in (60, 80, 120, 300) for t in family(rng, n, 25)]
    texts += [None, "", " \n", "one", "One", "a b c d e", "A b  c d e f", "long " * 5000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == brute_kept(rows)
    assert near_copies.keep_one(df).columns == ["doc_id", "text"]
    assert near_copies.near_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("changed", [1, 2])
def test_stage_drops_ordinary_near_copies(spark, changed):
    words = [f"w{i}" for i in range(100)]
    other = [*words]
    for i in range(changed):
        other[30 * i + 10] = "changed"
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "far from both of them")], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(cp.STAGES)["near_copies"](spark, df, "").collect()) == [1, 3]


@pytest.mark.parametrize("block", [2, 128])
def test_blocks_and_groups_around_the_threshold(spark, block):
    """A group whose members are about 0.7 alike, some of them above 0.8, and buckets of many chunks."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(90):
        words = [*base]
        for _ in range(rng.choice([1, 3, 4, 5])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = near_copies.near_copies(df, block=block)
    assert sorted(r.doc_id for r in found.collect() if r.doc_id == r.component_id) == brute_kept(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (3, "a  b c d e f"), (3, "q r s t u v"), (5, "q r s t u v"), (3, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, near_copies.keep_one(df).collect()))
    assert got == [(3, "a  b c d e f"), (3, "q r s t u v"), (3, "q r s t u v")]


@pytest.mark.parametrize("most", [1, 512])
def test_units_meet_each_pair_that_is_not_linked_and_grow_with_the_bucket(spark, monkeypatch, most):
    """A bucket of 400 nodes, one component but for 12, in chunks of 8: in the second pass by pieces, or by pairs of chunks."""
    monkeypatch.setattr(near_copies, "MOST", most)
    n = 400
    places = spark.range(n).selectExpr("7L AS bucket", "3 AS band", "id AS node")
    sizes = spark.createDataFrame([(7, 50)], "bucket long, chunks int")
    comps = spark.range(12, n).selectExpr("id AS node", "12L AS comp")
    within = near_copies._within(places, sizes).collect()
    across = near_copies._across(places, sizes, comps, 8).collect()
    met = set()
    for rows in (within, across):
        units = {}
        for r in rows:
            units.setdefault((r.i, r.j), []).append(r)
        for unit in units.values():
            for x in unit:
                for y in unit:
                    if x.node != y.node and x.comp != y.comp and (x.side == y.side == 0 or x.side == y.side == 3 or (x.side == 1 and y.side >= 2)):
                        met.add(frozenset((x.node, y.node)))
    assert len(within) == n
    assert all(frozenset((a, b)) in met for a in range(12) for b in range(n) if a != b)
    if most == 512:
        assert len(across) <= 3 * n


def test_fingerprints_propose_links(spark, monkeypatch):
    """Without any bucket of minima, copies whose fingerprints are within two bits still link, those that are too unlike do not."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:-1] + ["changed"]), "a b c d e f", "q r s t u v"]
    monkeypatch.setattr(near_copies, "_places", lambda nodes: nodes.where("false").selectExpr("node AS bucket", "0 AS band", "node"))
    prints = [near_copies.simhash.majority(near_copies.hashes(t)) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == [0, 2, 3]
    pairs = spark.createDataFrame([(1, 2, texts[0], texts[2])], "a long, b long, x string, y string")
    assert near_copies._checked(pairs).count() == 0
