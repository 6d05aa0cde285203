"""Suffix arrays of shards of short byte strings: Larsson-Sadakane refinement and Kasai's common prefixes, in numpy.

A shard lays its strings side by side, each followed by one terminator of its own; terminators
sort before all bytes, in the order of the strings.
"""

from __future__ import annotations

import numpy as np

#: Ranks take so many bits in a sort key of three; a shard must have fewer places.
RANK_BITS = 21
#: Bytes of the first sort's key; its last byte tells how many of them there were.
FIRST = 7


class Shard:
    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.data = np.frombuffer(b"\0".join(strings) + b"\0" * 9, np.uint8)
        self.n = int(self.sizes.sum()) + len(strings)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), self.sizes + 1)
        self.end = np.repeat((self.starts + self.sizes).astype(np.int32), self.sizes + 1)  # place of the terminator
        words = np.zeros(self.n, np.uint64)
        for j in range(8):
            words = words << np.uint64(8) | self.data[j : j + self.n]
        self.words = words  # of eight bytes, whatever they belong to

    def suffix_array(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in suffix order, and the rank of each place; terminators come first.

        The first sort is by FIRST bytes. Then every group of equal prefixes of h bytes is
        refined by the ranks of what follows h and 2 h bytes on, which triples h; places that
        stand alone leave. Terminators are unique, so in the end every place stands alone.
        """
        place = np.arange(self.n, dtype=np.int32)
        rank = np.empty(self.n, np.int32)
        ends = place == self.end
        rank[ends] = np.arange(int(ends.sum()))
        todo = place[~ends]
        left = np.minimum(self.end[todo] - todo, FIRST)
        key = (self.words[todo] >> np.uint64(8 * (8 - FIRST)) << np.uint64(8)).astype(np.uint64)
        blank = ((FIRST - left + 1) * 8).astype(np.uint64)  # bytes past the terminator don't count
        key = (key >> blank << blank) | left.astype(np.uint64)
        old = np.full(len(todo), int(ends.sum()), np.int32)
        h = FIRST
        while len(todo):
            order = np.argsort(key)
            todo, old, key = todo[order], old[order], key[order]
            at = np.arange(len(todo), dtype=np.int32)
            group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(fresh, at, 0))
            rank[todo] = old + head - group
            alone = fresh & np.concatenate([fresh[1:], [True]])
            todo = todo[~alone]
            old = rank[todo]
            key = old.astype(np.int64)
            for k in (1, 2):
                key = key << RANK_BITS | rank[np.minimum(todo + np.int64(k * h), self.end[todo])]
            h *= 3
        order = np.empty(self.n, np.int32)
        order[rank] = place
        return order, rank

    def repeated(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Whether the string of ``length`` bytes at a place also starts at another place of the shard.

        starts: how many places of each string are asked about, from its first on. Kasai's
        pass: the prefix that a suffix shares with its predecessor is at least the one of the
        suffix a byte earlier less one. All strings take their steps together; prefixes are
        followed up to ``length`` bytes and to words of eight.
        """
        order, rank = self.suffix_array()
        found = np.zeros(self.n, bool)
        by_size = np.argsort(-starts, kind="stable")
        base, counts = self.starts[by_size], starts[by_size]
        shared = np.zeros(len(base), np.int64)
        for step in range(int(counts.max(initial=0))):
            live = int(np.searchsorted(-counts, -step, side="left"))  # strings with more places than step
            p = base[:live] + step
            shared = np.maximum(shared[:live] - 1, 0)
            other = order[np.maximum(rank[p] - 1, 0)]
            fits = np.flatnonzero((self.end[p] - p >= length) & (self.end[other] - other >= length) & (rank[p] > 0))
            while len(fits):
                at = np.minimum(shared[fits], length - 8)
                fits, at = (x[self.words[p[fits] + at] == self.words[other[fits] + at]] for x in (fits, at))
                shared[fits] = at + 8
                more = shared[fits] < length
                found[p[fits[~more]]] = True
                found[other[fits[~more]]] = True
                fits = fits[more]
        return found
