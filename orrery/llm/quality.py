r"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every word has two buckets: of its lower-case form, and of its shape (case, digits and symbols, runs collapsed; a word
that repeats the one before it has a shape of its own). A bucket has a sparse ternary index vector; its word vector
is that plus the sum of the index vectors of the words that stood beside it in the training texts, each of length 1.
A document is the mean over its words of both kinds, with the log of its length. The network's logits are divided by
a temperature fitted on rows that it was not trained on, so scores are probabilities.

Labels come only from rows of the training folds: crc32(id as text) mod FOLDS is not 0. At most SAMPLE labelled rows
are used, those with the least keyed hash of the id: a bounded, documented sample. Labels, language, source and id are
never inputs of a score. All documents are scored over their whole texts in one pass without a shuffle.

Defined results: a null text counts as empty; an empty text has a score like any other (from its zero vector); a null
id is not held out and has no label; rows without a label, or with more than one value of it, do not train; with
labels of one class only, or none, every score is the smoothed share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import lean, text_of, unique_name
from orrery.session import cut

FOLDS, SAMPLE, THRESHOLD, SEED = 5, 20_000, 0.3, 5
WORD_BUCKETS, SHAPE_BUCKETS, WIDTH, NONZERO, HIDDEN = 3072, 1024, 64, 8, 32
BUCKETS, SAME, CACHED = WORD_BUCKETS + SHAPE_BUCKETS, WORD_BUCKETS + SHAPE_BUCKETS - 1, 400_000
#: Tasks that gather word contexts from the sample; each sends one table of BUCKETS x WIDTH whole numbers (1 MB).
GATHER = 8
#: Words pooled at once.
CHUNK = 1 << 16


def fold(id_col: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def shape(word: str) -> str:
    out = []
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:12])


class Buckets(dict):
    """word -> (word bucket) * BUCKETS + (shape bucket); forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        low = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        kind = WORD_BUCKETS + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % (SHAPE_BUCKETS - 1)
        got = self[word] = low * BUCKETS + kind
        return got


def index_vectors(seed: int = SEED) -> np.ndarray:
    """Sparse ternary vectors, NONZERO entries of 1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, WIDTH), dtype=np.int8)
    for row in out:
        row[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def _codes(text: str | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    words = (text or "").split()
    both = np.fromiter(map(buckets.__getitem__, words), dtype=np.int64, count=len(words))
    word, kind = both // BUCKETS, both % BUCKETS
    kind[1:][word[1:] == word[:-1]] = SAME
    return word, kind


def contexts(texts: Iterator[str | None], index: np.ndarray) -> np.ndarray:
    """For each bucket, the sum of the index vectors (of word and shape) of the words beside it, in whole numbers.

    Neighbours are counted by pairs of buckets first (a square table), so a pair's vector is added once, not each time.
    """
    beside, buckets = np.zeros(BUCKETS * BUCKETS, dtype=np.int32), Buckets()
    for text in texts:
        word, kind = _codes(text, buckets)
        for start in range(0, len(word) - 1, CHUNK):
            both = [x[start : start + CHUNK + 1] for x in (word, kind)]
            pairs = np.concatenate([a[:-1] * BUCKETS + b[1:] for a in both for b in both])
            found, count = np.unique(pairs, return_counts=True)
            beside[found] += count.astype(np.int32)
    beside = beside.reshape(BUCKETS, BUCKETS)
    out, wide = np.zeros((BUCKETS, WIDTH)), index.astype(np.float64)
    for start in range(0, BUCKETS, 512):
        rows = slice(start, start + 512)
        out[rows] = beside[rows] @ wide + beside[:, rows].T @ wide
    return out.astype(np.int32)


def pooled(texts: list[str | None], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """A row for each text: mean word vector, mean shape vector, log length."""
    out = np.zeros((len(texts), 2 * WIDTH + 1), dtype=np.float64)
    for i, text in enumerate(texts):
        word, kind = _codes(text, buckets)
        if not len(word):
            continue
        for start in range(0, len(word), CHUNK):
            out[i, :WIDTH] += vectors[word[start : start + CHUNK]].sum(axis=0)
            out[i, WIDTH : 2 * WIDTH] += vectors[kind[start : start + CHUNK]].sum(axis=0)
        out[i, : 2 * WIDTH] /= len(word)
        out[i, 2 * WIDTH] = np.log1p(len(word)) / 10
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str | None], buckets: Buckets) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.logits(pooled(texts, self.vectors, buckets)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, hold: np.ndarray, vectors: np.ndarray, seed: int = SEED, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """Adam on the cross-entropy of the rows not in ``hold``; the temperature from those in it."""
    constant = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    zero = np.zeros(x.shape[1])
    if len(set(y[~hold].tolist())) < 2:
        return Model(vectors, zero, zero + 1, np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0, float(constant))
    rng = np.random.default_rng(seed)
    mean, scale = x[~hold].mean(axis=0), x[~hold].std(axis=0) + 1e-3
    xs, ys = (x[~hold] - mean) / scale, y[~hold]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(xs))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            h = np.tanh(xs[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - ys[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [xs[rows].T @ dh + decay * p[0], dh.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if hold.any():
        z = model.logits(x[hold])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 121))
        model.temperature = float(min(grid, key=lambda t: _loss(z / t, y[hold])))
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(text, y, hold) of at most ``sample`` labelled training documents, cut to the shared folder.

    The ids are chosen from the labels alone, so they are few enough to filter the documents map-side. An id that
    several documents have gives one row.
    """
    one = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(id_col) != 0))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("other"))
        .where("y = other")
        .select("id", "y")
    )
    # Keyed hashes below a threshold hold the least ``sample`` of them but for a chance of one in a billion, in which
    # case all are sorted; so about ``sample`` rows are sent to the last task, however many partitions there are.
    one = cut(one.withColumn("turn", F.xxhash64(F.lit(seed), F.col("id"))))
    share = min(1.0, (sample + 6 * sample**0.5) / max(1, one.count()))
    low = one.where(F.col("turn") <= F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))))
    low = cut(low if share < 1 else one)
    if share < 1 and low.count() < sample:
        low = one
    chosen = cut(low.orderBy("turn", "id").limit(sample).drop("turn"))
    narrow = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found = narrow.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
    return cut(found.select("id", "text", "y", (fold("id") == 1).alias("hold")))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> Model:
    """Fit word vectors and network. The driver gets GATHER tables of word contexts and one row of features a text."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, sample, seed)
    index = index_vectors(seed)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t.as_py() for b in batches for t in b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([contexts(texts, index).tobytes()], pa.binary())], names=["table"])

    context = np.zeros((BUCKETS, WIDTH))
    # Sums of whole numbers: the same however the sample is dealt out.
    for part in rows.select("text").coalesce(GATHER).mapInArrow(lean(gather), "table binary").collect():
        context += np.frombuffer(part["table"], dtype=np.int32).reshape(BUCKETS, WIDTH)
    # A common sum that all words share says nothing about any of them.
    context -= context.sum(axis=0) / max(1.0, np.abs(context).sum()) * np.abs(context).sum(axis=1, keepdims=True)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = (index / np.sqrt(NONZERO) + np.where(length > 0, context / np.maximum(length, 1e-9), 0)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            x = pooled(b.column(0).to_pylist(), shared.value, buckets).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1), b.column(2), b.column(3)], names=["x", "y", "hold", "id"])

    got = rows.select("text", F.col("y").cast("double"), "hold", F.col("id").cast("string")).mapInArrow(lean(features), "x binary, y double, hold boolean, id string").collect()
    got.sort(key=lambda r: r["id"])
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in got], dtype=np.float64).reshape(len(got), 2 * WIDTH + 1)
    return fit_network(x, np.array([r["y"] for r in got]), np.array([r["hold"] for r in got], dtype=bool), vectors, seed)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of the whole text in column ``out`` (a column of that name gives way)."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() == out.lower()])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = unique_name("text", kept.columns)
    last = kept.withColumn(text, F.col(f"`{text_col}`").cast("string")) if text != text_col else kept
    at, n, names = last.columns.index(text), len(kept.columns), [*kept.columns, out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), f"`{out}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for b in batches:
            scores = shared.value.scores(b.column(at).to_pylist(), buckets)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores, pa.float64())], names=names)

    return last.mapInArrow(lean(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **params) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, **params)
    narrow = docs.select(F.col(id_col), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    scored = score(narrow, model, "text")
    return scored.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **params) -> DataFrame:
    """docs that the classifier does not reject; columns as they were."""
    model = train(docs, labels, id_col, text_col, **params)
    name = unique_name("score", docs.columns)
    return score(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)
