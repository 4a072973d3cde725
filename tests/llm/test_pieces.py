"""Sampling without replacement against all segmentations of short texts; exact round trips."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from orrery.llm import pieces


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary()


def all_segmentations(vocab, text):
    """{ids: probability} by enumeration of the lattice of the whole text."""
    whole = f" {text}" if text else ""
    arcs = vocab.arcs(whole)
    found = {}

    def walk(i, ids, w):
        if i == len(whole):
            found[tuple(ids)] = math.exp(w)
            return
        for piece, weight, j in arcs[i]:
            spelt = [piece] if piece < pieces.BYTES else [vocab.first_byte + b for b in chr(piece - pieces.BYTES).encode()]
            walk(j, [*ids, *spelt], w + weight)

    walk(0, [], 0.0)
    total = sum(found.values())
    return {ids: p / total for ids, p in found.items()}


def test_matches_sampling_without_replacement(vocab):
    text, k, n = "the on", 3, 12_000
    probs = all_segmentations(vocab, text)
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(3)
    got = pieces.top_k(vocab, [text] * n, keys, k)
    seen = Counter()
    for rows in got:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == k == len(ids)
        assert all(abs(math.exp(r[1]) - probs[i]) < 1e-9 for i, r in zip(ids, rows, strict=True))
        assert rows[0][2] >= rows[1][2] >= rows[2][2] and all(0 < r[3] <= 1 for r in rows)
        seen[tuple(ids)] += 1
    top = sorted(probs, key=probs.get, reverse=True)[:5]
    for order in itertools.permutations(top, 2):
        want = probs[order[0]] * probs[order[1]] / (1 - probs[order[0]])
        have = sum(c for ids, c in seen.items() if ids[:2] == order) / n
        assert abs(want - have) < 4 * math.sqrt(want / n) + 1e-3
    # The inclusion scores estimate sums without bias: each segmentation's 1 / score times its presence has mean 1.
    for s in top[:2]:
        weight = [next((1 / r[3] for r in rows if tuple(r[0].tolist()) == s), 0.0) for rows in got]
        assert abs(np.mean(weight) - 1) < 5 * np.std(weight) / math.sqrt(n)


def test_all_segmentations_are_emitted_once(vocab):
    probs = all_segmentations(vocab, "tin")
    rows = pieces.top_k(vocab, ["tin"], np.array([5], dtype=np.uint64), 1000)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(probs) and len(rows) == len(probs)
    assert all(r[3] == 1.0 for r in rows)


TEXTS = ["", " ", "   a  b ", "▁x ▁", "été 你好 🎉\n\tq", "x" * 500, "a\u0000b", "words " * 4000, "é" * 40 + " " * 70 + "z"]


def test_round_trip(vocab):
    texts = TEXTS + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    keys = np.arange(len(texts), dtype=np.uint64)
    for text, rows in zip(texts, pieces.top_k(vocab, texts, keys, 3), strict=True):
        assert rows and all(vocab.decode(r[0].tolist()) == text for r in rows)
        assert len({tuple(r[0].tolist()) for r in rows}) == len(rows)


def test_batches_do_not_matter(vocab):
    texts, keys = TEXTS[2:], np.arange(len(TEXTS) - 2, dtype=np.uint64)
    together = pieces.top_k(vocab, texts, keys, 2)
    for i, t in enumerate(texts):
        alone = pieces.top_k(vocab, [t], keys[i : i + 1], 2)[0]
        assert [(a[0].tolist(), round(a[2], 9)) for a in alone] == [(b[0].tolist(), round(b[2], 9)) for b in together[i]]


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (None, "hello world", 6), (1, "hello world", 5)], "doc_id long, text string, rank int")
    coded = pieces.encode(df)
    assert coded.columns == ["doc_id", "rank", "ids", "log_prob", "perturbed", "inclusion"]
    rows = pieces.decode(coded).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == {(1, "hello world"): 4, (2, ""): 1, (None, "hello world"): 2}
    assert pieces.encode(df.where("false")).count() == 0


def unbroken(n):
    rng = np.random.default_rng(n)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    base64 = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/="), n))
    mixed = "".join(rng.choice(list("数据模型the一été"), n))
    return [letters, "x" * n, base64, mixed]


@pytest.mark.parametrize("k", [1, 2, 8])
def test_long_unbroken_texts(vocab, k):
    from sentencepiece import SentencePieceProcessor

    import public_tokenizers

    library = SentencePieceProcessor(model_file=public_tokenizers.path(pieces.TOKENIZER))
    texts = unbroken(20_000)
    for text, rows in zip(texts, pieces.top_k(vocab, texts, np.arange(len(texts), dtype=np.uint64), k), strict=True):
        assert len(rows) == k == len({tuple(r[0].tolist()) for r in rows})
        assert all(a[2] >= b[2] for a, b in zip(rows, rows[1:], strict=False))
        for r in rows:
            assert vocab.decode(r[0].tolist()) == text
            assert library.decode(r[0].tolist()) == text


def test_a_million_characters_without_a_space(vocab):
    text = unbroken(1_000_000)[0]
    rows = pieces.top_k(vocab, [text], np.array([7], dtype=np.uint64), 2)[0]
    assert len(rows) == 2 and all(vocab.decode(r[0].tolist()) == text for r in rows)


def test_both_ways_of_building_lattices_agree(vocab):
    units = [" internationalisation", "mississippi", " x", "的数据"]
    vocab.reset()
    vocab.add_all(units)
    states = [vocab.start[u] for u in units]
    short = [vocab.logp[int(vocab.first[s]) : int(vocab.first[s + len(u)])].copy() for s, u in zip(states, units, strict=True)]
    vocab.reset()
    vocab.add_all([*units, "q" * 40])  # one long unit makes all of them go state by state
    for u, want in zip(units, short, strict=True):
        s = vocab.start[u]
        assert np.allclose(vocab.logp[int(vocab.first[s]) : int(vocab.first[s + len(u)])], want)
        arcs = vocab.arcs(u)
        assert [len(a) for a in arcs] == np.diff(vocab.first[s : s + len(u) + 1]).tolist()
    vocab.reset()


def test_masses_of_what_is_left(vocab):
    """Against all segmentations: what is left when some paths are taken out, and draws from it."""
    unit = " internat"
    vocab.reset()
    vocab.add_all([unit])
    state = vocab.start[unit]
    paths = []

    def walk(at, path, p):
        if at < 0:
            paths.append((path, p))
            return
        for a in range(int(vocab.first[at]), int(vocab.first[at + 1])):
            walk(int(vocab.next[a]), [*path, a], p * math.exp(vocab.logp[a]))

    walk(state, [], 1.0)
    out = [paths[i] for i in (0, 3, len(paths) // 2, len(paths) - 1)]
    excluded = pieces._Excluded(vocab, state, [np.array(p) for p, _ in [*out, out[0]]])
    assert abs(excluded.left[0] - (1 - sum(p for _, p in out))) < 1e-12
    gone = {tuple(p) for p, _ in out}
    drawn = [tuple(vocab.sample_one(state, excluded, pieces._Random(k, 0, 0))) for k in range(300)]
    assert not gone & set(drawn) and len(set(drawn)) > 3


def test_repeated_rows_and_long_texts_in_spark(spark):
    rows = [(1, "hello big world"), (1, "hello big world"), (2, "x" * 5000), (3, unbroken(3000)[2]), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pieces.encode(df, k=5, verify=True).collect()
    assert all(r.round_trip for r in out)
    by = Counter((r.doc_id, tuple(r.ids)) for r in out if r.doc_id == 1)
    assert len(by) == 5 and set(by.values()) == {2}


def test_unknown_ids_decode_to_nothing(spark, vocab):
    ids = vocab.id_of["the"]
    rows = [(1, [ids, 10**6, -5, None, ids]), (2, None), (3, []), (4, [vocab.first_byte + 0xFF])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(df).collect()} == {1: "thethe", 2: "", 3: "", 4: "�"}


def test_a_worker_keeps_no_lattices_after_its_task(spark):
    df = spark.createDataFrame([(i, f"some words of row {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    assert pieces.encode(df).count() == 80

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pieces.vocabulary(pieces.TOKENIZER, pieces.ALPHA).n_states], pa.int64())], names=["n"])

    assert {r.n for r in spark.range(8).repartition(4).mapInArrow(held, "n long").collect()} == {0}


def test_few_arcs_one_by_one_are_as_arrays(vocab, monkeypatch):
    """Single random numbers against blocks of them, short excluded paths against arrays, slots of hashes against plain arcs."""
    for step in (0, 5, 1 << 18):
        assert pieces._uniform_of((1 << 64) - 3, 2, 9, step) == pieces._uniform(np.array([(1 << 64) - 3], dtype=np.uint64), 2, np.array([9]), step)[0]
    unit = " internat"
    vocab.reset()
    vocab.add_all([unit])
    state = vocab.start[unit]
    paths = [np.array(vocab.sample_one(state, None, pieces._Random(k, 0, 0))) for k in range(6)]
    short = pieces._Excluded(vocab, state, paths)
    monkeypatch.setattr(pieces, "FEW", 0)
    whole = pieces._Excluded(vocab, state, paths)
    assert np.allclose(short.left, whole.left, rtol=1e-12) and short.arcs == whole.arcs.tolist() and short.forks == whole.forks
    words = [f" {w}" for w in list(vocab.id_of)[:3000] if " " not in w and len(w) < 30]
    vocab.add_all(words)
    for w in words:
        first = vocab.first[vocab.start[w] : vocab.start[w] + len(w) + 1]
        assert vocab.piece[first[0] : first[-1]].tolist() == [p for arcs in vocab.arcs(w) for p, _, _ in sorted(arcs, key=lambda a: a[2])]
    vocab.reset()
