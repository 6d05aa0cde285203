"""Segmentation lattices over a fixed public piece vocabulary.

A unit is a string of any length. Its lattice has one node before each code point and one at the
end; every vocabulary piece that matches is an arc, and a code point that is no piece itself is
an arc of the vocabulary's byte pieces. A node that no arc spans is a cut: all paths pass it, so
what lies between two cuts (a stretch) is summed and sampled by itself. All stretches of a call are held
as flat numpy arrays, and the forward pass steps through all of them together, one position at
a time; its steps are as many as the longest stretch has code points.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import sentencepiece

#: Stands between units; no code point.
BREAK = (1 << 21) - 1
SLOTS = 19


class Trie:
    """Prefixes of all pieces as states, and the state that a code point leads to, in a hash table of 2 ** SLOTS places."""

    def __init__(self, texts: dict[str, int]):
        states: dict[str, int] = {"": 0}
        for text in texts:
            for n in range(1, len(text) + 1):
                states.setdefault(text[:n], len(states))
        self.piece = np.full(len(states), -1, np.int32)  # of a state that is a piece
        self.key, self.next = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int32)
        prefixes = list(states)[1:]
        keys = np.array([states[p[:-1]] << 21 | ord(p[-1]) for p in prefixes], np.int64)
        for text, i in texts.items():
            self.piece[states[text]] = i
        if 2 * len(keys) > 1 << SLOTS:
            raise ValueError("the vocabulary has too many prefixes")
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # one key of each free place goes in, the others try the next
            free = self.key[slot] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.key[slot[put]], self.next[slot[put]] = keys[todo[put]], todo[put] + 1
            todo, slot = todo[~put], (slot[~put] + 1) & ((1 << SLOTS) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def step(self, states: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        keys = states.astype(np.int64) << 21 | points
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.next[slot], 0)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot = (slot[open_] if len(slot) == len(keys) else slot) + 1 & ((1 << SLOTS) - 1)
            there = self.key[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.next[slot[hit]]
            on = ~hit & (there >= 0)
            open_, slot = open_[on], slot[on]
        return out


class Pieces:
    """The pieces of a sentencepiece model. Ids from ``size`` on stand for single code points spelt in bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        self.bytes: list[bytes] = [b""] * self.size
        self.lengths = np.zeros(self.size, np.int64)  # in code points; 0: never an arc
        texts: dict[str, int] = {}
        for i in range(self.size):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes[i] = bytes([value])
            else:
                text = piece.replace("▁", " ")
                self.bytes[i] = text.encode()
                self.lengths[i] = len(text)
                texts[text] = i
        self.trie = Trie(texts)
        self.usable = np.array([bool(b) for b in self.bytes])

    def spelt(self, code_point: int) -> np.ndarray:
        """The byte pieces of a code point."""
        return self.byte_ids[list(chr(code_point).encode("utf-8", "surrogatepass"))]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """One copy in each Python process."""
    return Pieces(path)


@dataclass
class Lattice:
    """Arcs sorted by (position of their end in the stretch, end node)."""

    source: np.ndarray  # node
    target: np.ndarray  # node
    piece: np.ndarray
    step: np.ndarray  # position of the end in its stretch, from 1
    first: np.ndarray  # first node of each unit
    cut: np.ndarray  # by node: whether all paths pass it; first and last nodes are cuts


def build(vocabulary: Pieces, units: list[str]) -> Lattice:
    """The lattices of non-empty units. A node has the number of its code point in the units, each with a break behind it."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    first = np.cumsum(lengths + 1) - lengths - 1
    points = np.frombuffer(("\0".join(units) + "\0" * bool(units)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[first + lengths] = BREAK
    nodes = len(points)
    at, state, size = np.arange(nodes), np.zeros(nodes, np.int32), 0
    sources, pieces, sizes = [], [], []
    spelt = points != BREAK  # code points that are no piece
    while len(at):
        state = vocabulary.trie.step(state, points[at + size])
        size += 1
        on = np.flatnonzero(state)
        at, state = at[on], state[on]
        piece = vocabulary.trie.piece[state]
        some = np.flatnonzero(piece >= 0)
        sources.append(at[some])
        pieces.append(piece[some])
        sizes.append(np.full(len(some), size))
        if size == 1:
            spelt[at[some]] = False
    missing = np.flatnonzero(spelt)
    source = np.concatenate([*sources, missing])
    piece = np.concatenate([*pieces, vocabulary.size + points[missing]]).astype(np.int32)
    size = np.concatenate([*sizes, np.ones(len(missing), np.int64)])
    target = source + size
    spanned = np.bincount(source + 1, minlength=nodes + 1) - np.bincount(target, minlength=nodes + 1)
    cut = np.cumsum(spanned)[:nodes] == 0
    before = np.maximum.accumulate(np.where(cut, np.arange(nodes), 0)) if nodes else np.zeros(0, np.int64)  # the last cut up to each node
    step = target - before[target - 1]
    order = np.argsort(step << 37 | target << 6 | size)  # pieces have under 64 code points
    return Lattice(source[order], target[order], piece[order], step[order], first, cut)


def arc_scores(vocabulary: Pieces, lattice: Lattice, log_p: np.ndarray) -> np.ndarray:
    """Log probabilities of the arcs: rows of log_p, or the sum over the byte pieces of a code point."""
    plain = lattice.piece < vocabulary.size
    if plain.all():
        return log_p[lattice.piece]
    out = log_p[np.where(plain, lattice.piece, 0)]
    points, where = np.unique(lattice.piece[~plain] - vocabulary.size, return_inverse=True)
    out[~plain] = np.stack([log_p[vocabulary.spelt(int(c))].sum(0) for c in points])[where]
    return out


def _steps(lattice: Lattice):
    bounds = np.flatnonzero(np.diff(lattice.step)) + 1
    for a, b in zip([0, *bounds], [*bounds, len(lattice.step)]):
        if b > a:
            yield int(a), int(b)


def forward(lattice: Lattice, scores: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all paths to each node from the last cut before it."""
    alpha = np.full((len(lattice.cut), *scores.shape[1:]), -np.inf)
    alpha[lattice.first] = 0.0
    opens = lattice.cut[lattice.source]
    for a, b in _steps(lattice):
        target, source = lattice.target[a:b], alpha[lattice.source[a:b]]
        source[opens[a:b]] = 0.0
        heads = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1])
        alpha[target[heads]] = np.logaddexp.reduceat(source + scores[a:b], heads, axis=0)
    return alpha


def totals(lattice: Lattice, alpha: np.ndarray) -> np.ndarray:
    """Log of the summed probability of all segmentations of each unit: the sum over its stretches."""
    if not len(lattice.first):
        return alpha[:0]
    ends = alpha.copy()
    ends[~lattice.cut] = 0.0
    return np.add.reduceat(ends, lattice.first, axis=0)


def expected_counts(vocabulary: Pieces, lattice: Lattice, scores: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of all units, each unit counted ``weights`` times."""
    alpha = forward(lattice, scores)
    beta = np.full(len(lattice.cut), -np.inf)
    closes = lattice.cut[lattice.target]
    for a, b in reversed(list(_steps(lattice))):  # by end position: all arcs out of these targets are done
        value = np.where(closes[a:b], 0.0, beta[lattice.target[a:b]]) + scores[a:b]
        np.logaddexp.at(beta, lattice.source[a:b], value)
    cuts = np.flatnonzero(lattice.cut)
    whole = alpha[cuts[np.searchsorted(cuts, lattice.target)]]
    unit = np.searchsorted(lattice.first, lattice.target, side="right") - 1
    into = np.where(lattice.cut[lattice.source], 0.0, alpha[lattice.source])
    out = np.where(closes, 0.0, beta[lattice.target])
    share = np.exp(into + scores + out - whole) * weights[unit]
    plain = lattice.piece < vocabulary.size
    counts = np.bincount(lattice.piece[plain], share[plain], vocabulary.size)
    points, where = np.unique(lattice.piece[~plain] - vocabulary.size, return_inverse=True)
    for point, amount in zip(points, np.bincount(where, share[~plain], len(points))):
        np.add.at(counts, vocabulary.spelt(int(point)), amount)
    return counts
