r"""Token counts by prefix dynamic programming over byte-level BPE.

For a piece (what the tokenizer's pattern splits off) the encoding of each prefix ends in one token, and what stands
before that token is the encoding of a shorter prefix. So with last[i] the last token of the prefix of i bytes,
count[i] = count[i - len(last[i])] + 1, and last[i] is the one token that ends at i and may follow the last token of
the prefix before it (two tokens may stand side by side if encoding their joined bytes gives just the two). One pass
gives the exact count of every prefix, in time linear in the length, for pieces of any length. Tables of short
pieces are kept and extended from those of their own prefixes.

Over a text, the counts of its pieces add up. A prefix that ends inside a piece has the piece's own prefix count,
but where the pattern would split a shorter text otherwise: inside a run of white space, which is one piece at the
end of a text; inside an apostrophe suffix ('re, 've, 'll); and inside the string of a special token, which is
ordinary text until it is complete. ``PrefixCounter.prefix_counts`` holds for every prefix, by code points, what the
library counts for it, so truncation and budget questions are look-ups.

Defined results: a null text counts as empty; an empty text has no tokens. No truncation, no padding; special strings
inside a text are one token, as is the library's default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import unique_name

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024
#: Fixed value: how byte-level BPE splits a text into pieces (public pattern of that tokenizer family).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tables of pieces up to so many code points are kept; when so many are held, all are dropped.
SHORT, HELD = 48, 500_000
#: Texts whose new pieces are looked at together.
TOGETHER = 256


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


_MULT = 0x9E3779B97F4A7C15


def _hash(raw: bytes) -> int:
    h = 0
    for c in raw:
        h = ((h ^ c) * _MULT ^ h >> 29) & ((1 << 64) - 1)
    return h


class PrefixCounter:
    """Prefix counts for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normaliser or prefix space is needed")
        self.model = Tokenizer.from_file(path).model
        self.alphabet = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        # A token that its own string is not encoded to ends no prefix.
        self.vocab = {v for v in spec["model"]["vocab"] if [t.value for t in self.model.tokenize(v)] == [v]}
        self.longest = max(map(len, self.vocab))
        self.pattern = regex.compile(PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.beside: dict[tuple[str, str], bool] = {}
        self.tables: dict[str, bytes] = {}
        # Tried pairs of tokens, sorted, and those tried since.
        self.pairs, self.pair_fits, self.fresh = np.array([-1], dtype=np.int64), np.array([False]), {}
        self._index()

    def _may_follow(self, a: str, b: str) -> bool:
        got = self.beside.get((a, b))
        if got is None:
            if len(self.beside) > HELD:
                self.beside.clear()
            got = self.beside[a, b] = [t.value for t in self.model.tokenize(a + b)] == [a, b]
        return got

    def _extend(self, mapped: str, last: list[str], count: list[int]) -> None:
        """Carry last and count, which cover the first len(last) - 1 bytes, on to the end of mapped."""
        vocab, longest = self.vocab, self.longest
        for end in range(len(last), len(mapped) + 1):
            for start in range(max(0, end - longest), end):
                token = mapped[start:end]
                if token in vocab and (not start or self._may_follow(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("a byte without a token")

    def _mapped(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)

    def _index(self) -> None:
        """For each length in bytes, hashes of the tokens and of the starts of longer tokens, sorted, with numbers."""
        back = {ord(c): chr(b) for b, c in enumerate(byte_alphabet())}
        self.names = sorted(self.vocab)
        raw = [v.translate(back).encode("latin-1") for v in self.names]
        self.tokens_by, self.starts_by = [], []
        for n in range(1, 1 + max(map(len, raw))):
            own = sorted((_hash(r), i) for i, r in enumerate(raw) if len(r) == n)
            hashes = np.array([h for h, _ in own], dtype=np.uint64)
            if len(set(hashes.tolist())) != len(hashes):
                raise ValueError("two tokens with one hash")
            spelt = np.frombuffer(b"".join(raw[i] for _, i in own), dtype=np.uint8).reshape(len(own), n)
            self.tokens_by.append((hashes, np.array([i for _, i in own], dtype=np.int64), spelt.astype(np.uint64)))
            self.starts_by.append(np.array(sorted({_hash(r[:n]) for r in raw if len(r) > n}), dtype=np.uint64))

    def _tokens_in(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens inside joined pieces: (start, length, number). end: of the piece that each byte is in."""
        at, h, found = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64), []
        for n, ((hashes, numbers, spelt), starts) in enumerate(zip(self.tokens_by, self.starts_by, strict=True), 1):
            inside = at + n <= end[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                h = (h ^ codes[at + n - 1]) * np.uint64(_MULT) ^ (h >> np.uint64(29))
            if len(hashes):
                k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[k] == h)
                place, k = at[hit], k[hit]
                # A hash only proposes; the bytes decide.
                same = (codes[place[:, None] + np.arange(n)] == spelt[k]).all(axis=1)
                if not same.all():
                    place, k = place[same], k[same]
                found.append((place, np.full(len(place), n), numbers[k]))
            if not len(starts):
                break
            on = starts[np.minimum(np.searchsorted(starts, h), len(starts) - 1)] == h
            at, h = at[on], h[on]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token may follow the one before it."""
        pair = before * len(self.names) + token
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        out = self.pair_fits[k]
        unknown = np.flatnonzero(self.pairs[k] != pair)
        if len(unknown):
            new, which = np.unique(pair[unknown], return_inverse=True)
            fits = []
            for p in new.tolist():
                got = self.fresh.get(p)
                if got is None:
                    a, b = divmod(p, len(self.names))
                    got = self.fresh[p] = self._may_follow(self.names[a], self.names[b])
                fits.append(got)
            out[unknown] = np.array(fits)[which]
        return out

    def _settle(self) -> None:
        """Sort the newly tried pairs in among the known ones."""
        if not self.fresh:
            return
        pairs = np.concatenate([self.pairs, np.array(list(self.fresh), dtype=np.int64)])
        fits = np.concatenate([self.pair_fits, np.array(list(self.fresh.values()), dtype=bool)])
        order = np.argsort(pairs)
        self.pairs, self.pair_fits, self.fresh = pairs[order], fits[order], {}

    def build(self, pieces: list[str]) -> None:
        """Prefix tables of new short pieces, all together: the recurrence runs over the bytes of all of them at once."""
        if len(self.tables) > HELD:
            self.tables.clear()
        pieces = [p for p in dict.fromkeys(pieces) if p not in self.tables]
        if not pieces:
            return
        if len(self.pairs) > 4 * HELD:
            self.pairs, self.pair_fits = self.pairs[:1], self.pair_fits[:1]
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        ends = np.cumsum(size)
        begin, end = np.repeat(ends - size, size), np.repeat(ends, size)
        codes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        start, length, token = self._tokens_in(codes.astype(np.uint64), end)
        # Candidates for the last token of each prefix, the longest first. A prefix is named by its last byte.
        order = np.lexsort((-length, start + length))
        start, length, token = start[order], length[order], token[order]
        head = np.searchsorted(start + length - 1, np.arange(len(codes)))
        last, count = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=np.int64)
        offset = np.arange(len(codes)) - begin
        by_offset = np.argsort(offset, kind="stable")
        edges = np.searchsorted(offset[by_offset], np.arange(int(size.max()) + 1))
        for o in range(int(size.max())):
            open_ = by_offset[edges[o] : edges[o + 1]]
            arc = head[open_]
            while len(open_):
                if (start[arc] + length[arc] - 1 != open_).any():
                    raise ValueError("a byte without a token")
                whole = start[arc] == begin[open_]
                ok = whole.copy()
                rest = np.flatnonzero(~whole)
                if len(rest):
                    ok[rest] = self._fits(last[start[arc[rest]] - 1], token[arc[rest]])
                done = open_[ok]
                last[done] = token[arc[ok]]
                count[done] = 1 + np.where(whole[ok], 0, count[start[arc[ok]] - 1])
                open_, arc = open_[~ok], arc[~ok] + 1
        self._settle()
        # Prefixes by code points end before a byte that starts a character.
        ends_char = np.concatenate([codes[1:] & 0xC0 != 0x80, [True]])
        flat = count[ends_char].astype(np.uint8).tobytes()
        at = 0
        for p in pieces:
            self.tables[p] = flat[at : at + len(p)]
            at += len(p)

    def piece_counts(self, piece: str) -> np.ndarray:
        """Counts of the prefixes of 1..n code points of a piece."""
        if len(piece) <= SHORT:
            if piece not in self.tables:
                self.build([piece])
            return np.frombuffer(self.tables[piece], dtype=np.uint8).astype(np.int64)
        mapped = self._mapped(piece)
        last, count = [""], [0]
        self._extend(mapped, last, count)
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
        return np.array(count)[ends]

    def _ordinary(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """Counts of all prefixes (0..n code points) of a text without special tokens."""
        pieces = self.pattern.findall(text) if pieces is None else pieces
        if not pieces:
            return np.zeros(1, dtype=np.int64)
        known = self.tables.get
        tables = list(map(known, pieces))
        if None in tables:
            self.build([p for p in pieces if len(p) <= SHORT])
            tables = list(map(known, pieces))
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        if sizes.max() <= SHORT:
            inner = np.frombuffer(b"".join(tables), dtype=np.uint8).astype(np.int64)
        else:
            inner = np.concatenate([self.piece_counts(p) for p in pieces])
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], np.cumsum(inner[ends - 1])])[:-1]
        out = np.concatenate([[0], inner + np.repeat(before, sizes)])
        # Where a shorter text is split otherwise. Runs of white space that more than one piece or a longer piece holds:
        for m in regex.finditer(r"\s+(?=\S)", text) if regex.search(r"\s\s", text) else ():
            if m.end() - m.start() > 1:
                out[m.start() + 1 : m.end() + 1] = out[m.start()] + self.piece_counts(m[0])
        # Apostrophe suffixes of two letters, cut after the first: apostrophe and letter are two pieces then.
        start = 0
        if "'" in text:
            for p, size, base in zip(pieces, sizes.tolist(), before.tolist(), strict=True):
                if size == 3 and p[0] == "'" and p in ("'re", "'ve", "'ll"):
                    out[start + 2] = base + self.piece_counts("'")[-1] + self.piece_counts(p[1])[-1]
                start += size
        return out

    def all_prefix_counts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """``prefix_counts`` of each text; what their pieces need is built for TOGETHER texts at once."""
        for s in range(0, len(texts), TOGETHER):
            group = [t or "" for t in texts[s : s + TOGETHER]]
            plain = [not (self.special and self.special.search(t)) for t in group]
            split = [self.pattern.findall(t) if p else None for t, p in zip(group, plain, strict=True)]
            self.build([p for pieces in split if pieces for p in pieces if p not in self.tables and len(p) <= SHORT])
            for t, pieces in zip(group, split, strict=True):
                yield self.prefix_counts(t) if pieces is None else self._ordinary(t, pieces)

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of text[:k] for k = 0..len(text)."""
        text = text or ""
        found = list(self.special.finditer(text)) if self.special else []
        if not found:
            return self._ordinary(text)
        parts, at, base = [np.zeros(1, dtype=np.int64)], 0, 0
        for m in found:
            # The special string is ordinary text until it is complete.
            own = self._ordinary(text[at : m.end() - 1])
            parts.append(base + own[1:])
            base += int(own[m.start() - at]) if m.start() - at < len(own) else 0
            base += 1
            parts.append(np.array([base], dtype=np.int64))
            at = m.end()
        parts.append(base + self._ordinary(text[at:])[1:])
        return np.concatenate(parts)


@lru_cache(maxsize=4)
def counter(tokenizer: str = TOKENIZER) -> PrefixCounter:
    """One counter a process. ``tokenizer`` is a name among the public tokenizers, or a path."""
    import os

    if os.path.sep not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return PrefixCounter(tokenizer)


def truncation_point(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix with at most ``limit`` tokens (counts need not be monotone)."""
    return int(np.flatnonzero(counts <= limit)[-1])


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, limits: tuple[int, ...] = (LIMIT,), keep: list[str] | None = None, tables: bool = False) -> DataFrame:
    """The columns ``keep`` (all but the text, if not given) with the text's measures.

    n_bytes (UTF-8), n_tokens, fits (for each of ``limits``, the code points of the longest prefix within it) and, if
    ``tables``, prefix_tokens (tokens of each prefix of 0..n code points). Columns of docs with these names give way.
    """
    own = {"n_bytes": "long", "n_tokens": "long", "fits": "array<long>"} | ({"prefix_tokens": "array<int>"} if tables else {})
    kept = [c for c in (docs.columns if keep is None else keep) if c != text_col and c.lower() not in own]
    text = unique_name("text", kept)
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(text))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{n} {t}" for n, t in own.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = counter(tokenizer)
        for batch in batches:
            n_bytes, n_tokens, fits, whole = [], [], [], []
            texts = batch.column(len(kept)).to_pylist()
            for s, counts in zip(texts, dp.all_prefix_counts(texts), strict=True):
                n_bytes.append(len((s or "").encode("utf-8", "surrogatepass")))
                n_tokens.append(int(counts[-1]))
                fits.append([truncation_point(counts, limit) for limit in limits])
                if tables:
                    whole.append(counts.astype(np.int32))
            columns = [*batch.columns[: len(kept)], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.list_(pa.int64()))]
            if tables:
                columns.append(pa.array(whole, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *own])

    return narrow.mapInArrow(run, schema)
