"""The stages of the corpus pipeline against brute-force versions of each."""

import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline as cp
import pyarrow as pa
from orrery.llm import mixing, near_copies, pieces, quality
from orrery.session import cut, table
from tests.llm.test_mixing import brute_targets
from tests.llm.test_near_copies import brute_kept

DIR = "/root/testdata/sf0.001"


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, stages = docs.columns, dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_filter", "exact_copies", "near_copies", "mixture", "piece_samples"]

    good = cut(stages["quality_filter"](spark, docs, DIR))
    scores = {r.doc_id: r.predicted for r in quality.classify(docs, table(spark, DIR, "labels")).collect()}
    assert good.columns == columns and ids(good) == Counter(i for i, p in scores.items() if p)

    rows = {r.doc_id: r for r in good.collect()}
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    last = {}
    for i, r in rows.items():
        last[low(r.text)] = max(i, last.get(low(r.text), i))
    single = cut(stages["exact_copies"](spark, good, DIR))
    assert single.columns == columns and ids(single) == Counter(last.values())

    left = sorted(last.values())
    near = cut(stages["near_copies"](spark, single, DIR))
    # Stages on word shingles take five words and a similarity of 0.8.
    assert near.columns == columns and sorted(ids(near).elements()) == brute_kept([(i, rows[i].text) for i in left])

    mixed = cut(stages["mixture"](spark, near, DIR))
    size = {i: len(rows[i].text.split()) for i in ids(near)}
    by_source = defaultdict(int)
    for i, n in size.items():
        by_source[rows[i].source] += n
    order = sorted(by_source)
    goal = dict(zip(order, brute_targets([by_source[s] for s in order]), strict=True))
    taken, most = Counter(), Counter()
    for i, n in ids(mixed).items():
        assert n <= 2
        taken[rows[i].source] += n * size[i]
    for i in size:
        most[rows[i].source] = max(most[rows[i].source], size[i])
    assert mixed.columns == columns and all(abs(taken[s] - goal[s]) <= most[s] / 2 + 1 for s in order)
    assert ids(mixed) == Counter({r.doc_id: len(r.draws) for r in mixing.mix_plan(near).collect() if r.draws})

    out = cut(stages["piece_samples"](spark, mixed, DIR))
    back = pieces.decode(out).collect()
    assert all(r.text == rows[r.doc_id].text for r in back)
    assert Counter(r.doc_id for r in back if r["rank"] == 0) == ids(mixed)


def test_run_is_the_stages(spark):
    a, b = cp.run(spark, DIR), cp.run(spark, DIR)
    rows = lambda d: sorted((r.doc_id, r["rank"], r.ids) for r in d.collect())
    got = rows(a)
    assert got and got == rows(b)
    assert cp.ORACLE_SQL is None


def test_empty_documents(spark):
    docs = table(spark, DIR, "documents").where("false")
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, DIR))
        assert docs.count() == 0


def test_a_worker_gives_memory_back_after_its_task(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = near_copies.signatures(df, "doc_id", "text")

    def batches():
        for _ in range(3):
            texts = [f"{i} " + "x" * 8_000 for i in range(10_000)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

    def held():
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    pa.default_memory_pool().release_unused()
    before = held()
    assert sum(b.num_rows for b in run(batches())) == 30_000
    assert held() - before < 40
