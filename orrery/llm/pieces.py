r"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The lattice of a text has an arc for every vocabulary piece that stands somewhere in it, and one of byte pieces for a
character that no piece covers. No piece reaches from text into the white space after it (checked when the vocabulary is
read), so the lattice narrows to a single point before every run of spaces; the units between these points are
independent. An arc's weight is its piece's, the weight of a segmentation is the product over its arcs, and dividing
by the sum over all segmentations (one backward pass a unit) makes them a distribution.

Perturbed A* search: the whole space has the Gumbel-perturbed maximum of a standard Gumbel. The search pops the
subset with the largest perturbed maximum, samples the segmentation that attains it (exactly, by the backward sums,
which are the search's heuristic and are exact), emits it, and splits the rest of the subset by the first unit in
which a segmentation differs from it; each part gets a Gumbel of its own mass, truncated at the popped value. So the
k emitted segmentations are distinct and distributed as k draws without replacement. Inside the unit where a subset
begins to differ, earlier choices are excluded by walking the lattice along the excluded paths, without rejection.

The inclusion score of an emitted segmentation with log-probability l is 1 - exp(-exp(l - t)), t being the k+1st
perturbed value: its probability to be among the k given t (1 if there are no more segmentations).

All random numbers are hashes of (row key, sample, unit, step), so results do not depend on batches or partitions.

A BPE vocabulary has merge ranks, not probabilities: the log-weight of a piece is -alpha * log(2 + rank), of a byte
piece -alpha * log(2 + vocabulary size).

Defined results: a null text counts as empty; an empty text has the one empty segmentation; fewer than k
segmentations give fewer rows; a literal U+2581 in a text is coded in bytes, so decoding gives back exactly the text;
equal keys and texts give equal samples; a text without spaces is one unit of any length (its lattice takes memory in
proportion to it); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import lean, text_of, unique_name

TOKENIZER, K, ALPHA, SEED = "piece_bpe_32k.model", 2, 1.0, 23
#: Fixed value: the character that stands for a space in pieces.
SPACE = "▁"
#: Units up to so many characters are sampled together; their lattices are kept, so many states at most.
SHORT, STATES = 32, 1_500_000
#: States that the tables have room for, and a quarter of the arcs.
ROOM = STATES + (1 << 20)
#: Units sampled at once, whole texts at least.
AT_ONCE = 30_000
#: Excluded arcs that are gone through one by one.
FEW = 64
BYTES = 1 << 21  # ids from here on stand for the byte pieces of the character id - BYTES

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _uniform(key: np.ndarray, sample: int, unit: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), one for each (key, unit), or for each step of one unit."""
    with np.errstate(over="ignore"):
        x = key ^ (unit.astype(np.uint64) * _M1) ^ (np.asarray(sample * 1_000_003 + step + 1).astype(np.uint64) * _M3)
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        x = (x ^ (x >> np.uint64(31))) * _M1
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def _uniform_of(key: int, sample: int, unit: int, step: int) -> float:
    """The number that ``_uniform`` gives for one key, unit and step."""
    m1, m2, m3, low = int(_M1), int(_M2), int(_M3), (1 << 64) - 1
    x = key ^ (unit * m1 & low) ^ ((sample * 1_000_003 + step + 1) * m3 & low)
    x = (x ^ x >> 30) * m2 & low
    x = (x ^ x >> 27) * m3 & low
    x = (x ^ x >> 31) * m1 & low
    return ((x >> 12) + 0.5) / (1 << 52)


class _Random:
    """A stream of numbers in (0, 1) for scalar steps: the first ones singly, then in growing blocks."""

    def __init__(self, key: int, sample: int, unit: int):
        self.of, self.step, self.size, self.block = (key, sample, unit), 1 << 18, 8, iter(())

    def __call__(self) -> float:
        if self.step < (1 << 18) + 8:
            self.step += 1
            self.size = 32
            return _uniform_of(*self.of, self.step)
        u = next(self.block, None)
        if u is None:
            key, sample, unit = self.of
            steps = np.arange(self.step + 1, self.step + 1 + self.size)
            self.step += self.size
            self.size = min(4 * self.size, 8192)
            self.block = iter(_uniform(np.array([key], dtype=np.uint64), sample, np.array([unit]), steps).tolist())
            u = next(self.block)
        return u


class Vocabulary:
    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        byte = [i for i in range(size) if model.is_byte(i)]
        if len(byte) != 256:
            raise ValueError("a vocabulary with byte pieces is needed")
        self.first_byte = byte[0]
        normal = [i for i in range(size) if i not in special and not model.is_byte(i)]
        self.id_of = {model.id_to_piece(i).replace(SPACE, " "): i for i in normal}
        if any(re.search("[^ ] ", p) for p in self.id_of):
            raise ValueError("a piece reaches over the start of a run of spaces")
        self.longest = max(map(len, self.id_of))
        base = min(normal, default=0)
        self.weight = {p: -alpha * math.log(2 + i - base) for p, i in self.id_of.items()}
        self.byte_weight = -alpha * math.log(2 + size)
        # A character that stands in no piece of two or more is a unit of its own: no arc reaches over its ends.
        joined = sorted({c for p in self.id_of if len(p) > 1 for c in p if c != " "})
        self.unit = re.compile(f" *[{re.escape(''.join(joined))}]+| +|[^ ]")
        self._index()
        self.bytes_of = [b""] * (size + 1)  # the last stands for ids that are unknown
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.encode()
        for k, i in enumerate(byte):
            self.bytes_of[i] = bytes([k])
        self.byte_size = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.reset()

    def reset(self) -> None:
        """Forget all lattices and give back their memory. The tables are laid out anew at their full size, of which only
        what is written takes memory."""
        self.start: dict[str, int] = {}
        self.n_states = self.n_arcs = 0
        self.first = self.upto = self.next = self.piece = self.logp = None
        self.first = np.zeros(ROOM, dtype=np.int32)  # of a state's arcs
        # Of each arc: probability up to and with it among its state's, state after it (-1: none), id, log-probability.
        self.upto, self.next, self.piece, self.logp = (np.zeros(4 * ROOM, dtype=t) for t in (np.float32, np.int32, np.int32, np.float64))

    def arcs(self, unit: str) -> list[list[tuple[int, float, int]]]:
        """For each position, (id, log-weight, position after it): the plain form of ``_lookup``, which tests hold to it."""
        weight, id_of, longest, n, out = self.weight, self.id_of, self.longest, len(unit), []
        for i in range(n):
            here = []
            for j in range(i + 1, min(n, i + longest) + 1):
                w = weight.get(p := unit[i:j])
                if w is not None:
                    here.append((id_of[p], w, j))
            if not here or here[0][2] != i + 1:
                here.append((BYTES + ord(unit[i]), self.byte_weight * len(unit[i].encode("utf-8", "surrogatepass")), i + 1))
            out.append(here)
        return out

    def _index(self) -> None:
        """For each length, hashes of the pieces and of the starts of longer pieces, sorted, with the pieces' ids."""
        self.pieces_by, self.starts_by, piece_of = [], [], {i: p for p, i in self.id_of.items()}
        for n in range(1, self.longest + 1):
            own = sorted((self._hash(p), i, self.weight[p]) for p, i in self.id_of.items() if len(p) == n)
            longer = sorted({self._hash(p[:n]) for p in self.id_of if len(p) > n})
            hashes = np.array([h for h, _, _ in own], dtype=np.uint64)
            if len(set(hashes.tolist())) != len(hashes):
                raise ValueError("two pieces with one hash")
            ids = np.array([i for _, i, _ in own], dtype=np.int64)
            spelt = np.array([[ord(c) for c in piece_of[i]] for i in ids.tolist()], dtype=np.uint64).reshape(len(own), n)
            self.pieces_by.append((hashes, ids, np.array([w for _, _, w in own]), spelt))
            # Tables of hash ends: the first piece with that end (-1: none), so no piece is searched for, and whether
            # longer ones begin so. Pieces with one end follow each other, ``most`` at most.
            ends = (hashes >> np.uint64(46)).astype(np.int64)
            slots, starts = np.full(1 << 18, -1, dtype=np.int16 if len(own) < 1 << 15 else np.int32), np.zeros(1 << 18, dtype=bool)
            slots[ends[::-1]] = np.arange(len(own))[::-1]
            most = int(np.bincount(ends).max()) if len(own) else 0
            starts[(np.array(longer, dtype=np.uint64) >> np.uint64(46)).astype(np.int64)] = True
            self.starts_by.append((slots, most, starts if longer else None))

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15 ^ h >> 29) & ((1 << 64) - 1)
        return h

    def units_of(self, text: str | None) -> list[str]:
        return self.unit.findall(f" {text}") if text else []

    def _lookup(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All arcs over joined units: (position, length, id, weight), by position. end: of each position's unit."""
        at, h, room = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64), end - np.arange(len(codes))
        found, single = [], np.zeros(len(codes), dtype=bool)
        mult = np.uint64(0x9E3779B97F4A7C15)
        for n in range(1, self.longest + 1):
            if not len(at):
                break
            with np.errstate(over="ignore"):
                h = (h ^ codes[at + (n - 1)]) * mult ^ (h >> np.uint64(29))
            hashes, ids, weights, spelt = self.pieces_by[n - 1]
            slots, most, starts = self.starts_by[n - 1]
            ends = (h >> np.uint64(46)).astype(np.int32)
            if len(hashes):
                k = slots[ends]
                likely = np.flatnonzero(k >= 0)
                k, mine = k[likely].astype(np.int64), h[likely]
                miss = np.flatnonzero(hashes[k] != mine)
                for _ in range(1, most):
                    k[miss] = np.minimum(k[miss] + 1, len(hashes) - 1)
                    miss = miss[hashes[k[miss]] != mine[miss]]
                k[miss] = -1
                hit = np.flatnonzero(k >= 0)
                places, k = at[likely[hit]], k[hit]
                # A hash only proposes; the characters decide.
                same = (codes[places[:, None] + np.arange(n)] == spelt[k]).all(axis=1)
                if not same.all():
                    places, k = places[same], k[same]
                found.append((places, n, ids[k], weights[k]))
                if n == 1:
                    single[places] = True
            if starts is None:
                break
            on = np.flatnonzero(starts[ends] & (room > n))
            at, h, room = at[on], h[on], room[on]
        bare = np.flatnonzero(~single)
        c = codes[bare].astype(np.int64)
        n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        found.append((bare, 1, BYTES + c, self.byte_weight * n_bytes))
        # Each part has a position once at most, so counting puts the arcs in order without sorting.
        count, rank = np.zeros(len(codes), dtype=np.int64), []
        for places, *_ in found:
            rank.append(count[places])
            count[places] += 1
        first, total = np.cumsum(count) - count, int(count.sum())
        length, piece, weight = np.empty(total, dtype=np.int64), np.empty(total, dtype=np.int64), np.empty(total)
        for (places, n, ids, weights), turn in zip(found, rank, strict=True):
            to = first[places] + turn
            length[to], piece[to], weight[to] = n, ids, weights
        return np.repeat(np.arange(len(codes)), count), length, piece, weight

    def add_all(self, units: list[str]) -> None:
        """Build the lattices of new units, all short or all long, together. States of a unit follow its positions."""
        if not units:
            return
        size = np.array([len(u) for u in units], dtype=np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ends = np.cumsum(size)
        end = np.repeat(ends, size)
        src, length, piece, weight = self._lookup(codes, end)
        n = len(codes)
        first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        dst = src + length
        final = dst == end[src]
        back = self._back_from_each_distance(first, dst, weight, final, end) if size.max() <= SHORT else self._back_one_by_one(first, dst, weight, final)
        logp = weight + np.where(final, 0.0, back[dst]) - back[src]
        total = np.cumsum(np.exp(logp))
        inner = total - np.concatenate([[0.0], total])[first[src]]
        self._room(n, len(src))
        base, at = self.n_states, self.n_arcs
        own = slice(at, at + len(src))
        self.upto[own] = inner
        self.upto[at + first[1:] - 1] = 2.0
        self.next[own] = np.where(final, -1, base + dst)
        self.piece[own], self.logp[own] = piece, logp
        self.first[base : base + n + 1] = at + first
        self.n_states, self.n_arcs = base + n, at + len(src)
        self.start.update(zip(units, (base + ends - size).tolist(), strict=True))

    @staticmethod
    def _back_from_each_distance(first: np.ndarray, dst: np.ndarray, weight: np.ndarray, final: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-sums over the segmentations from each state on: all states at one distance from their ends at a time."""
        n = len(end)
        back = np.zeros(n + 1)
        to_go = end - np.arange(n)
        by_distance = np.argsort(to_go, kind="stable")
        farthest = int(to_go.max())
        edges = np.searchsorted(to_go[by_distance], np.arange(1, farthest + 2))
        for d in range(farthest):
            states = by_distance[edges[d] : edges[d + 1]]
            counts = first[states + 1] - first[states]
            heads = np.cumsum(counts) - counts
            arcs = np.repeat(first[states] - heads, counts) + np.arange(int(counts.sum()))
            score = weight[arcs] + np.where(final[arcs], 0.0, back[dst[arcs]])
            top = np.maximum.reduceat(score, heads)
            back[states] = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, counts)), heads))
        return back

    @staticmethod
    def _back_one_by_one(first: np.ndarray, dst: np.ndarray, weight: np.ndarray, final: np.ndarray) -> np.ndarray:
        """The same for units of any length, state by state."""
        n = len(first) - 1
        back, to, w = [0.0] * (n + 1), np.where(final, n, dst).tolist(), weight.tolist()
        edges = first.tolist()
        for i in range(n - 1, -1, -1):
            low, high = edges[i], edges[i + 1]
            if high - low == 1:
                back[i] = w[low] + back[to[low]]
                continue
            scores = [w[a] + back[to[a]] for a in range(low, high)]
            top = max(scores)
            back[i] = top + math.log(sum([math.exp(s - top) for s in scores]))
        return np.array(back)

    def states_of(self, units: list[str]) -> np.ndarray:
        """First states of the units' lattices, all kept."""
        if self.n_states > STATES:
            self.reset()
        got = np.fromiter(map(self.start.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        missing = np.flatnonzero(got < 0)
        if len(missing):
            wanted = [units[i] for i in missing.tolist()]
            new = list(dict.fromkeys(wanted))
            self.add_all([u for u in new if len(u) <= SHORT])
            self.add_all([u for u in new if len(u) > SHORT])
            got[missing] = np.fromiter(map(self.start.__getitem__, wanted), dtype=np.int64, count=len(wanted))
        return got

    def _room(self, states: int, arcs: int) -> None:
        """Larger tables for a unit that does not fit; they go with the next reset."""
        for names, wanted in ((("first",), self.n_states + states + 1), (("upto", "next", "piece", "logp"), self.n_arcs + arcs)):
            if wanted > len(getattr(self, names[0])):
                for name in names:
                    old = getattr(self, name)
                    new = np.zeros(wanted + wanted // 4, dtype=old.dtype)
                    new[: len(old)] = old
                    setattr(self, name, new)

    def sample(self, states: np.ndarray, key: np.ndarray, number: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(units, steps) arcs of a segmentation of each unit, -1 after the last, and its log-probability."""
        columns, active, at = [], np.arange(len(states)), states
        total = np.zeros(len(states))
        while len(active):
            u = _uniform(key[active], number, unit[active], len(columns)).astype(np.float32)
            arc = self.first[at]
            far = np.flatnonzero(self.upto[arc] <= u)
            while len(far):
                arc[far] += 1
                far = far[self.upto[arc[far]] <= u[far]]
            column = np.full(len(states), -1, dtype=np.int32)
            column[active] = arc
            columns.append(column)
            total[active] += self.logp[arc]
            at = self.next[arc]
            on = at >= 0
            active, at = active[on], at[on]
        return np.stack(columns, axis=1) if columns else np.full((len(states), 1), -1, dtype=np.int32), total

    def sample_one(self, state: int, excluded: _Excluded | None, random: _Random) -> list[int]:
        """Arcs of one segmentation that is not among the excluded paths, of which some must be left."""
        out, node = [], 0
        while excluded is not None and state >= 0 and node >= 0:
            first, last = int(self.first[state]), int(self.first[state + 1])
            children = excluded.children(node)
            left = [p * (excluded.left[children[a]] if children[a] >= 0 else 0.0) if a in children else p for a, p in zip(range(first, last), np.exp(self.logp[first:last]).tolist(), strict=True)]
            u, chosen = random() * sum(left), -1
            for a, p in zip(range(first, last), left, strict=True):
                if p > 0:
                    chosen = a
                    u -= p
                    if u < 0:
                        break
            out.append(chosen)
            # Off the excluded paths nothing is excluded any more.
            node, state = children.get(chosen, -1), int(self.next[chosen])
        while state >= 0:
            first, last = int(self.first[state]), int(self.first[state + 1])
            # The last arc's running probability is above 1.
            chosen = first + int(self.upto[first:last].searchsorted(random(), side="right")) if last - first > 1 else first
            out.append(chosen)
            state = int(self.next[chosen])
        return out

    def ids(self, arcs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids along arcs, byte pieces spelt out, and what ``ends`` (of texts, among the arcs) become."""
        ids = self.piece[arcs]
        spelt = np.flatnonzero(ids >= BYTES)
        if not len(spelt):
            return ids.astype(np.int32), ends
        chars, which = np.unique(ids[spelt] - BYTES, return_inverse=True)
        coded = [[self.first_byte + b for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars.tolist()]
        counts = np.ones(len(ids), dtype=np.int64)
        counts[spelt] = np.array([len(c) for c in coded])[which]
        stop = np.concatenate([[0], np.cumsum(counts)])
        out = np.repeat(ids, counts)
        for k in range(4):
            long = np.array([len(c) > k for c in coded])[which]
            out[stop[spelt[long]] + k] = np.array([c[k] if len(c) > k else 0 for c in coded])[which[long]]
        return out.astype(np.int32), stop[ends]

    def decode(self, ids: list[int]) -> str:
        out, _ = self.decode_all(np.asarray(ids, dtype=np.int64), np.array([len(ids)]))
        return out.tobytes().decode("utf-8", "surrogatepass")

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of the texts whose ids end at ``ends``, one after the other, and where each text ends in it.

        The space that encoding puts in front goes. Ids that the vocabulary does not have stand for nothing.
        """
        unknown = len(self.bytes_of) - 1
        ids = np.where((ids >= 0) & (ids < unknown), ids, unknown)
        size = self.byte_size[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(self.byte_start[ids] - stop[:-1], size) + np.arange(int(stop[-1]))
        raw = self.byte_pool[source]
        text_ends = stop[ends]
        starts = np.concatenate([[0], text_ends[:-1]]).astype(np.int64)
        full = np.flatnonzero(text_ends > starts)
        spaces = full[raw[starts[full]] == 32]
        keep = np.ones(len(raw), dtype=bool)
        keep[starts[spaces]] = False
        gone = np.zeros(len(ends), dtype=np.int64)
        gone[spaces] = 1
        return raw[keep], text_ends - np.cumsum(gone)


class _Excluded:
    """A trie of distinct paths from one state on, and the probability of what is left when they are taken out.

    Paths share nodes as far as they agree. A path's further nodes have consecutive numbers, so a node's first child is
    the next number, and only forks are kept apart; every child has a larger number than its node, so one pass from the
    last node to the first gives all masses, however long the paths are.
    """

    def __init__(self, vocab: Vocabulary, state: int, paths: list[np.ndarray]):
        if sum(map(len, paths)) <= FEW:
            self._node_by_node(vocab, state, paths)
            return
        self.states, self.arcs, self.last, self.forks = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=bool), {}
        for path in paths:
            path = np.asarray(path, dtype=np.int64)
            self._insert(vocab, state, path)
        first = vocab.first[self.states].astype(np.int64)
        counts = vocab.first[self.states + 1] - first
        heads = np.cumsum(counts) - counts
        mass = np.exp(vocab.logp[np.repeat(first - heads, counts) + np.arange(int(counts.sum()))])
        own = heads + self.arcs - first
        taken = mass[own].tolist()
        mass[own] = 0.0
        forked = {}
        for node, others in self.forks.items():
            for arc, child in others.items():
                at = int(heads[node] + arc - first[node])
                forked.setdefault(node, []).append((float(mass[at]), child))
                mass[at] = 0.0
        # A sum of what remains, not one less what is gone: tiny masses keep their digits.
        left, ends = np.add.reduceat(mass, heads).tolist(), self.last.tolist()
        for node in range(len(left) - 1, -1, -1):
            if not ends[node]:
                left[node] += taken[node] * left[node + 1]
            for p, child in forked.get(node, ()):
                if child >= 0:
                    left[node] += p * left[child]
        self.left = left

    def _node_by_node(self, vocab: Vocabulary, state: int, paths: list[np.ndarray]) -> None:
        """The same for a few arcs, of which arrays are more work than the arcs themselves."""
        states, self.arcs, self.last, self.forks = [], [], [], {}
        for path in paths:
            node, at, end = 0, state, len(path) - 1
            for k, arc in enumerate(np.asarray(path).tolist()):
                if node == len(self.arcs):
                    states.append(at)
                    self.arcs.append(arc)
                    self.last.append(k == end)
                if self.arcs[node] == arc:
                    node += 1
                else:
                    node = self.forks.setdefault(node, {}).setdefault(arc, -1 if k == end else len(self.arcs))
                at = int(vocab.next[arc])
        self.left = [0.0] * len(states)
        for node in range(len(states) - 1, -1, -1):
            low, high = int(vocab.first[states[node]]), int(vocab.first[states[node] + 1])
            children = self.children(node)
            for arc, log in zip(range(low, high), vocab.logp[low:high].tolist(), strict=True):
                child = children.get(arc)
                if child is None:
                    self.left[node] += math.exp(log)
                elif child >= 0:
                    self.left[node] += math.exp(log) * self.left[child]

    def _insert(self, vocab: Vocabulary, state: int, path: np.ndarray) -> None:
        node, k = 0, 0
        while len(self.arcs) and k < len(path):
            length = min(len(path) - k, len(self.arcs) - node)
            differs = (self.arcs[node : node + length] != path[k : k + length]) | self.last[node : node + length]
            step = int(np.argmax(differs)) if differs.any() else length
            node, k = node + step, k + step
            if k >= len(path) or self.arcs[node] == path[k]:
                return  # the path is there already
            others = self.forks.setdefault(node, {})
            arc = int(path[k])
            k += 1
            if arc in others:
                node = others[arc]
                continue
            others[arc] = len(self.arcs) if k < len(path) else -1
            state = int(vocab.next[arc])
            break
        rest = path[k:]
        if not len(rest):
            return
        self.states = np.concatenate([self.states, [state], vocab.next[rest[:-1]]]).astype(np.int64)
        self.arcs = np.concatenate([self.arcs, rest])
        self.last = np.concatenate([self.last, np.zeros(len(rest) - 1, dtype=bool), [True]])

    def children(self, node: int) -> dict[int, int]:
        """Excluded arcs of a node, with their nodes; -1 where a path ends."""
        return {int(self.arcs[node]): -1 if self.last[node] else node + 1} | self.forks.get(node, {})


@lru_cache(maxsize=4)
def vocabulary(tokenizer: str = TOKENIZER, alpha: float = ALPHA) -> Vocabulary:
    import os

    if os.path.sep not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    return Vocabulary(tokenizer, alpha)


def _truncated(mu: np.ndarray, bound: float | np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of location mu, given that they are at most bound."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = -np.logaddexp(-bound, -mu + np.log(-np.log(u)))
    return np.where(np.isneginf(mu), -np.inf, out)


class _Paths:
    """One segmentation of every unit of some texts."""

    def __init__(self, arcs: np.ndarray, logp: np.ndarray, long: dict[int, np.ndarray] | None = None):
        self.arcs, self.logp, self.long = arcs, logp, long or {}

    def widen(self, width: int) -> None:
        if width > self.arcs.shape[1]:
            self.arcs = np.pad(self.arcs, ((0, 0), (0, width - self.arcs.shape[1])), constant_values=-1)

    def of(self, u: int) -> np.ndarray:
        got = self.long.get(u)
        if got is None:
            row = self.arcs[u]
            got = row[row >= 0]
        return got

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of all units, one after the other, and where each unit ends among them."""
        some = self.arcs >= 0
        counts = some.sum(axis=1)
        for u, row in self.long.items():
            counts[u] = len(row)
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        if self.long:
            some[list(self.long)] = False
            inner = np.ones(len(out), dtype=bool)
            for u, row in self.long.items():
                inner[ends[u] - len(row) : ends[u]] = False
                out[ends[u] - len(row) : ends[u]] = row
            out[inner] = self.arcs[some]
        else:
            out[:] = self.arcs[some]
        return out, ends


def top_k(vocab: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int = K) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k of (ids, log-probability, perturbed value, inclusion score), in order of emission."""
    split = [vocab.units_of(t) for t in texts]
    count = np.array([len(s) for s in split], dtype=np.int64)
    ends = np.cumsum(count)
    starts = ends - count
    flat = [u for s in split for u in s]
    state = vocab.states_of(flat)
    size = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    owner = np.repeat(np.arange(len(texts)), count)
    key = keys[owner]
    place = np.arange(len(flat)) - starts[owner]
    is_short = size <= SHORT

    def draw(number: int, wanted: np.ndarray) -> _Paths:
        """A segmentation of each unit that is wanted."""
        short = np.flatnonzero(wanted & is_short)
        some, weight = vocab.sample(state[short], key[short], number, place[short])
        arcs, logp = np.full((len(flat), some.shape[1]), -1, dtype=np.int32), np.zeros(len(flat))
        arcs[short], logp[short] = some, weight
        kept = {}
        for u in np.flatnonzero(wanted & ~is_short).tolist():
            kept[u] = np.array(vocab.sample_one(int(state[u]), None, _Random(int(key[u]), number, int(place[u]))), dtype=np.int64)
            logp[u] = vocab.logp[kept[u]].sum()
        return _Paths(arcs, logp, kept)

    n = len(texts)
    zero = np.zeros(n, dtype=np.int64)
    root = -np.log(-np.log(_uniform(keys, 0, zero, 1 << 17)))
    # A subset: (-perturbed maximum, order, first free unit, paths excluded in it, the segmentation it shares units with).
    queue: list[list] = [[(-root[d], 0, int(starts[d]), [], None)] for d in range(n)]
    out: list[list] = [[] for _ in range(n)]
    made: list[_Paths] = []
    for number in range(k):
        popped = [heapq.heappop(queue[d]) if queue[d] else None for d in range(n)]
        # What a subset shares with its parent, and the unit in which it differs, are not drawn here.
        wanted = np.ones(len(flat), dtype=bool)
        for d, item in enumerate(popped):
            if item is None:
                wanted[starts[d] : ends[d]] = False
            elif item[4] is not None:
                wanted[starts[d] : item[2] + 1] = False
        paths = draw(number, wanted)
        for d, item in enumerate(popped):
            if item is None or item[4] is None:
                continue
            _, _, j, excluded, parent = item
            low = int(starts[d])
            width = made[parent].arcs.shape[1]
            paths.widen(width)
            paths.arcs[low:j] = -1
            paths.arcs[low:j, :width], paths.logp[low:j] = made[parent].arcs[low:j], made[parent].logp[low:j]
            paths.long |= {u: p for u, p in made[parent].long.items() if low <= u < j}
            row = vocab.sample_one(int(state[j]), _Excluded(vocab, int(state[j]), excluded), _Random(int(keys[d]), number, j - low))
            if not is_short[j]:
                paths.long[j] = np.array(row, dtype=np.int64)
            else:
                paths.widen(len(row))
                paths.arcs[j] = -1
                paths.arcs[j, : len(row)] = row
            paths.logp[j] = vocab.logp[row].sum()
        made.append(paths)
        # Mass and truncated Gumbel of each part of what is left of the popped subsets.
        total = np.concatenate([[0.0], np.cumsum(paths.logp)])
        before = total[:-1] - total[starts[owner]]
        with np.errstate(divide="ignore"):
            other = np.log(-np.expm1(np.minimum(paths.logp, 0.0)))
        free = np.ones(len(flat), dtype=bool)
        bound = np.zeros(n)
        for d, item in enumerate(popped):
            if item is None:
                free[starts[d] : ends[d]] = False
                continue
            bound[d] = -item[0]
            j, excluded = item[2], item[3]
            free[starts[d] : j] = False
            if excluded:
                mass = _Excluded(vocab, int(state[j]), [paths.of(j), *excluded]).left[0]
                other[j] = math.log(mass) if mass > 0 else -np.inf
        mu = np.where(free, before + other, -np.inf)
        value = _truncated(mu, bound[owner], _uniform(key, number, place, (1 << 17) + 1))
        arcs, unit_ends = paths.joined()
        text_ends = np.where(count > 0, unit_ends[np.maximum(ends - 1, 0)], 0) if len(flat) else zero
        text_ends = np.maximum.accumulate(text_ends)
        ids, text_ends = vocab.ids(arcs, text_ends)
        text_starts = np.concatenate([[0], text_ends[:-1]])
        for d, item in enumerate(popped):
            if item is None:
                continue
            low, high = int(starts[d]), int(ends[d])
            out[d].append((ids[text_starts[d] : text_ends[d]], float(total[high] - total[low]), -float(item[0])))
            mine = value[low:high]
            want = min(k - number, len(mine))
            best = np.argpartition(-mine, want - 1)[:want] if want and want < len(mine) else np.arange(len(mine))
            for b in best.tolist():
                if mine[b] > -np.inf:
                    u = low + b
                    excluded = [paths.of(u)] + (item[3] if u == item[2] else [])
                    heapq.heappush(queue[d], (-float(mine[b]), number * (1 << 40) + b, u, excluded, number))
    for d in range(n):
        threshold = -queue[d][0][0] if queue[d] else -math.inf
        out[d] = [(ids, lp, g, 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(lp - threshold, 50.0)))) for ids, lp, g in out[d]]
    return out


def _groups(texts: list[str | None]) -> Iterator[slice]:
    """Slices of whole texts with about AT_ONCE units each."""
    first = units = 0
    for i, t in enumerate(texts):
        units += (t or "").count(" ") + 1
        if units >= AT_ONCE:
            yield slice(first, i + 1)
            first, units = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


OUT = {"rank": "int", "ids": "array<int>", "log_prob": "double", "perturbed": "double", "inclusion": "double"}


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, alpha: float = ALPHA, seed: int = SEED, tokenizer: str = TOKENIZER, keep: list[str] | None = None, verify: bool = False) -> DataFrame:
    """A row for each of up to k distinct segmentations of each document: the columns ``keep`` (all but the text, if
    not given) and rank, ids, log_prob, perturbed, inclusion; with ``verify`` also round_trip: whether the ids decode
    to exactly the text. Columns of docs with these names give way."""
    made = OUT | ({"round_trip": "boolean"} if verify else {})
    kept = [c for c in (docs.columns if keep is None else keep) if c != text_col and c.lower() not in made]
    key, text = unique_name("row_key", kept), unique_name("text", kept)
    narrow = docs.select(*[F.col(f"`{c}`") for c in kept], text_of(text_col).alias(text), F.xxhash64(F.lit(seed), F.col(id_col)).alias(key))
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{c} {t}" for c, t in made.items())])
    n, names = len(kept), [*kept, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer, alpha)
        try:
            for batch in batches:
                texts = batch.column(n).to_pylist()
                keys = batch.column(n + 1).to_numpy(zero_copy_only=False).view(np.uint64)
                for part in _groups(texts):
                    got = top_k(vocab, texts[part], keys[part], k)
                    rows = np.repeat(np.arange(part.start, part.stop), [len(g) for g in got])
                    flat = [x for g in got for x in g]
                    columns = [c.take(pa.array(rows)) for c in batch.columns[:n]]
                    ends = np.cumsum([len(x[0]) for x in flat])
                    values = np.concatenate([np.zeros(0, dtype=np.int32), *[x[0] for x in flat]])
                    columns += [
                        pa.array([r for g in got for r in range(len(g))], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, pa.int32())),
                        *(pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)),
                    ]
                    if verify:
                        raw, stops = vocab.decode_all(values, ends)
                        raw = raw.tobytes()
                        starts = [0, *stops[:-1].tolist()]
                        columns.append(pa.array([raw[a:b] == texts[i].encode("utf-8", "surrogatepass") for a, b, i in zip(starts, stops.tolist(), rows.tolist(), strict=True)], pa.bool_()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            # The worker goes on to other tasks, of other stages too; what it kept would be on top of theirs.
            vocab.reset()

    return narrow.mapInArrow(lean(run), schema)


def decode(coded: DataFrame, ids_col: str = "ids", out: str = "text", tokenizer: str = TOKENIZER, drop_ids: bool = False) -> DataFrame:
    """coded with the decoded text in ``out`` (a column of that name gives way). Null ids decode to an empty text, null or
    unknown ids among others to nothing, and bytes that are no UTF-8 to U+FFFD."""
    kept = [c for c in coded.columns if c.lower() != out.lower() and not (drop_ids and c == ids_col)]
    narrow = coded.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias(unique_name("ids_in", kept)))
    schema = ", ".join([*(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` string"])
    n, names, rows = len(kept), [*kept, out], 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            for s in range(0, batch.num_rows, rows):
                part = batch.slice(s, rows)
                ids = part.column(n)
                raw, ends = vocab.decode_all(ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)))
                raw, ends = raw.tobytes(), ends.tolist()
                # Ids that encoding did not make may spell bytes that are no UTF-8.
                texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends, strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], texts], names=names)

    return narrow.mapInArrow(lean(run), schema)
