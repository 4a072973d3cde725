"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash

from orrery.llm import simhash
from orrery.operators.components import connected_components


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, ids, radius=2):
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, key in enumerate(ids):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [least.get(root(i)) for i in range(len(ids))]


def texts(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ñandú", "ß"]
    out = []
    for _ in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randrange(1, 40))]
        out.append(rng.choice([" ", "\n", "\t"]).join(words))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "CHANGED"
            out.append("  ".join(words).upper())
    return [*out, None, "", " \x0b ", "one", "One two", "x y z a b", "long " * 9000]


@pytest.mark.parametrize("small", [64, 2])
def test_same_as_brute_force(spark, small):
    rows = [(i, t, "x") for i, t in enumerate(texts(120, 5))] + [(None, "one", "y"), (3, "one", "y"), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(df, small=small).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    prints = [brute_print(t) for _, t, _ in rows]
    comp = brute_components(prints, [r[0] for r in rows])
    assert got == sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, comp)), key=str)


def test_masks_cover_every_pair_of_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


@pytest.mark.parametrize("small", [64, 1])
def test_links_of_close_fingerprints(spark, small):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(150):
        x = rng.choice(sorted(prints))
        for _ in range(rng.choice([1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [simhash._signed(p) for p in prints]
    found = dict(map(tuple, connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), small=small)).collect()))
    want = brute_components(prints, signed)
    assert [found.get(p, p) for p in signed] == want


def test_keep_one_keeps_columns_and_clean_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", 1), (2, "a b c d", 2), (5, "q r s t", 3)], "doc_id long, text string, keep_id int")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == [(1, "a b c d", 1), (5, "q r s t", 3)]
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (2, "A b c d"), (2, "q r s t"), (3, "q r s t"), (None, "u v w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Null ids stay together: one of them is alone with its text.
    assert sorted(map(tuple, simhash.keep_one(df).collect()), key=str) == sorted([r for r in rows if r[0] != 3], key=str)
    only = df.where("doc_id is null")
    assert simhash.keep_one(only).count() == 2
