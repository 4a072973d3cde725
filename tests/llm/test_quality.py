"""Held-out quality of the classifier, and its defined cases."""

import zlib

import numpy as np

from orrery.llm import quality
from orrery.session import table

DIR = "/root/testdata/sf0.01"


def test_held_out(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out for k in held) and sum(r.held_out for r in got.values()) < len(got) / 3
    right = np.mean([got[k].predicted == truth[k] for k in held])
    assert right > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (4, "w " * 70_000, "a"), (4, "w " * 70_000, "a")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 5
    some = spark.createDataFrame([(1, None, 0), (2, 1, 0), (None, 1, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, some).collect()
    assert len(rows) == 5 and len({round(r.score, 9) for r in rows}) == 1
    assert quality.classify(docs.where("false"), some).count() == 0
    assert quality.keep_good(docs, none).columns == ["doc_id", "text", "score"]


def test_no_label_of_the_held_out_fold_is_used(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality")
    a, b = (sorted(map(tuple, quality.classify(docs, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def plain_model(texts):
    """Context sums and pooling word by word."""
    index = quality.index_vectors().astype(np.int64)
    buckets = quality.Buckets()
    table_ = np.zeros((quality.BUCKETS, quality.WIDTH), dtype=np.int64)
    coded = []
    for text in texts:
        words, out = (text or "").split(), []
        for i, w in enumerate(words):
            low, kind = divmod(buckets[w], quality.BUCKETS)
            same = i and divmod(buckets[words[i - 1]], quality.BUCKETS)[0] == low
            out.append((low, quality.SAME if same else kind))
        coded.append(out)
        for i in range(len(out)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(out):
                    for a in out[i]:
                        for b in out[j]:
                            table_[a] += index[b]
    return index, table_, coded


def test_context_sums_and_pooling_against_plain_loops(monkeypatch):
    texts = ["The cat cat sat on THE mat 12", "", None, "a", "é ß 你好 a-b a-b", "x " * 300]
    index, want, coded = plain_model(texts)
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert (quality.contexts(iter(texts), quality.index_vectors()) == want).all()
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    got = quality.pooled(texts, vectors, quality.Buckets())
    for row, out in zip(got, coded, strict=True):
        if not out:
            assert not row.any()
            continue
        both = [np.mean([vectors[c[k]].astype(np.float64) for c in out], axis=0) for k in (0, 1)]
        assert np.allclose(row, [*both[0], *both[1], np.log1p(len(out)) / 10], atol=1e-5)


def test_network_and_temperature_against_plain_loops():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 2 * quality.WIDTH + 1))
    y = (x[:, 0] + 0.2 * rng.normal(size=4000) > 0).astype(float)
    hold = np.arange(4000) % 4 == 0
    model = quality.fit_network(x, y, hold, np.zeros((1, 1)))
    z = model.logits(x)
    for i in (0, 7, 3999):
        h = [np.tanh(sum((x[i, a] - model.mean[a]) / model.scale[a] * model.w1[a, b] for a in range(x.shape[1])) + model.b1[b]) for b in range(quality.HIDDEN)]
        assert abs(sum(p * q for p, q in zip(h, model.w2, strict=True)) + model.b2 - z[i]) < 1e-9
    loss = lambda t: np.mean([np.log1p(np.exp(-abs(v))) + max(v, 0) - v * w for v, w in zip(z[hold] / t, y[hold], strict=True)])
    assert all(loss(model.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 121)))
    assert np.mean((z[hold] > 0) == y[hold]) > 0.8


def test_calibration_on_the_held_out_fold(spark):
    docs, labels = table(spark, DIR, "documents"), table(spark, DIR, "labels")
    scores = {r.doc_id: r.score for r in quality.classify(docs, labels).where("held_out").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in scores}
    brier = np.mean([(scores[k] - v) ** 2 for k, v in truth.items()])
    assert brier < 0.06


def test_sample_is_the_least_hashes(spark):
    from pyspark.sql import functions as F

    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    docs = labels.select("doc_id", F.lit("x").alias("text"))
    got = {r.id for r in quality.labelled_sample(docs, labels, sample=100).collect()}
    rows = labels.where(quality.fold("doc_id") != 0).select("doc_id", F.xxhash64(F.lit(quality.SEED), "doc_id").alias("h")).collect()
    assert got == {r.doc_id for r in sorted(rows, key=lambda r: r.h)[:100]}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, "x", True)], "doc_id long, text string, held_out int, predicted int, hold string, y boolean")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.classify(docs, labels).columns == ["doc_id", "held_out", "score", "predicted"]
    assert quality.keep_good(docs, labels).columns == docs.columns
