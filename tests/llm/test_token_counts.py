"""Every prefix against the library."""

import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from orrery.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tc.TOKENIZER))


CASES = [
    "", " ", "  ", "a", "we're they'll I've it's 'rest 'l 'll'll '", "a   b\n\n  c\t", "x" * 300, "    x", "été ñandú 你好 世界 🎉🎉",
    "<|endoftext|>", "a<|endoftext|>b", "!!<|endoftext|> <|endoftext|><|endof", "  <|endoftext|>  x", "12345 67,890.12", "thhaed" * 30, "\r\n\r\n a", "x  <|endoftext|>",
]


@pytest.mark.parametrize("text", CASES)
def test_every_prefix(library, text):
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert tc.counter().prefix_counts(text).tolist() == want


def test_random_prefixes(library):
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "'", "'re", "the", "Thing", "é", "你", "12", "--", "<|", "<|endoftext|>", "x", " ", "ing", "'ll"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert tc.counter().prefix_counts(text).tolist() == want, repr(text)


def test_documents_in_whole(library):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [int(c[-1]) for c in tc.counter().all_prefix_counts(texts)] == want
    assert [int(tc.counter().prefix_counts(t)[-1]) for t in texts[:20]] == want[:20]


def test_operator(spark, library):
    long = "word " * 3000
    df = spark.createDataFrame([(1, "hello world", "k"), (2, None, None), (3, "", "k"), (4, long, "k"), (4, long, "k")], "doc_id long, text string, n_tokens string")
    rows = {r.doc_id: r for r in tc.token_counts(df, tables=True).collect()}
    assert [rows[i].n_tokens for i in (1, 2, 3, 4)] == [2, 0, 0, len(library.encode(long).ids)]
    assert rows[2].fits == [0] and rows[2].n_bytes == 0
    cut = rows[4].fits[0]
    assert len(library.encode(long[:cut]).ids) <= 1024 < len(library.encode(long[: cut + 1]).ids)
    assert len(rows[4].prefix_tokens) == len(long) + 1
    assert tc.token_counts(df.where("false")).count() == 0
