"""Sampled SentencePiece segmentations, and their lossless decoding.

A text is cut into units (spaces with the word after them, runs of line ends; no piece spans
two units), whose lattices hold all segmentations into pieces of a fixed public vocabulary.
Forward filtering gives every lattice node the total weight of the paths that reach it; backward
sampling walks back from each cut of a lattice to the one before and draws each piece in
proportion to the weight of the paths through it. The draw at a place of a text depends on the
row's key, the seed and that place alone, so partitions, retries and row order change nothing.

The vocabulary file holds ranks rather than probabilities; a piece of rank r weighs
(r + RANK_SHIFT) ** -1 (Zipf's law) to the power ``sharpness``. A code point without a piece is
spelt in byte pieces, U+2581 (the vocabulary's mark of a space) included, and nothing is
normalised: decoding returns the very text.

Cases: null and empty texts have no pieces and decode to the empty text. Repeated rows get the
same pieces. A null key counts as a key of its own. Texts, words and runs of blanks may have any
length. Columns called piece_ids, lossless or decoded are replaced; others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, lattice

UNIT = re.compile(r" *+[^ \n]++|\n++| ++")
RANK_SHIFT = 2.7
#: Bytes of text, and pieces to decode, in hand at once.
CHUNK, PIECES = 1 << 18, 1 << 16
#: Arcs of lattices that a Python worker remembers.
MEMORY = 2_000_000


def piece_scores(vocabulary: lattice.Pieces, sharpness: float) -> np.ndarray:
    """Log weights by rank; the file lists byte pieces first and then the pieces by rank."""
    rank = np.zeros(vocabulary.size)
    plain = vocabulary.lengths > 0
    rank[plain] = np.arange(plain.sum())
    rank[~plain] = vocabulary.size
    return np.where(vocabulary.usable, -sharpness * np.log(rank + RANK_SHIFT), -np.inf)


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(size, self.data.dtype)])
        self.data[self.size : size] = values
        self.size = size


class Sampler:
    """Lattices of the units met so far, filtered forward and ready to sample from."""

    def __init__(self, vocabulary: lattice.Pieces, scores: np.ndarray):
        self.vocabulary, self.scores = vocabulary, scores
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.source, self.piece, self.edge = Grown(np.int32), Grown(np.int32), Grown(np.float64)  # by arc; arcs into a node lie together
        self.head = Grown(np.int32)  # by node: its first arc
        self.bottom, self.top = Grown(np.int32), Grown(np.int32)  # by stretch: its nodes
        self.at = Grown(np.int32)  # by stretch: its place in the unit
        self.stretch, self.stretches, self.length = Grown(np.int32), Grown(np.int32), Grown(np.int32)  # by unit

    def learn(self, units: list[str]) -> None:
        net = lattice.build(self.vocabulary, units)
        arcs = lattice.arc_scores(self.vocabulary, net, self.scores)
        alpha = lattice.forward(net, arcs)
        order = np.argsort(net.target, kind="stable")
        source, target = net.source[order], net.target[order]
        share = np.exp(np.where(net.cut[source], 0.0, alpha[source]) + arcs[order] - alpha[target])
        # the arcs into a node share out (0, 1], one behind the other
        total = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        sizes = np.diff(np.append(heads, len(target)))
        within = total - np.repeat(total[heads] - share[heads], sizes)
        edge = within / np.repeat(within[heads + sizes - 1], sizes)
        edge[heads + sizes - 1] = 1.0
        head = np.zeros(len(net.cut), np.int32)
        head[target[heads]] = heads + self.edge.size
        cuts = np.flatnonzero(net.cut)
        inner = np.ones(len(cuts), bool)
        inner[np.searchsorted(cuts, net.first)] = False  # a unit's first node ends no stretch
        top = cuts[inner]
        bottom = cuts[np.flatnonzero(inner) - 1]
        unit = np.searchsorted(net.first, top, side="right") - 1
        known, nodes = len(self.index), self.head.size
        self.index.update(zip(units, range(known, known + len(units))))
        self.stretch.extend(np.searchsorted(unit, np.arange(len(units))) + self.top.size)
        self.stretches.extend(np.bincount(unit, minlength=len(units)))
        self.length.extend(np.diff(np.append(net.first, len(net.cut))) - 1)
        self.at.extend(bottom - net.first[unit])
        self.bottom.extend(bottom + nodes)
        self.top.extend(top + nodes)
        self.source.extend(source + nodes)
        self.piece.extend(net.piece[order])
        self.edge.extend(edge)
        self.head.extend(head)

    def units_of(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all units, learned where they are new."""
        fresh = set().union(*texts).difference(self.index)
        if fresh and self.edge.size > MEMORY:
            self.clear()
            fresh = set().union(*texts)
        if fresh:
            self.learn(sorted(fresh))
        return np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def draw(self, unit: np.ndarray, start: np.ndarray, seed: np.ndarray, total: int) -> np.ndarray:
        """Pieces of unit occurrences that start at code points ``start``; -1 where no piece starts. seed: by occurrence and place."""
        out = np.full(total, -1, np.int32)
        times = self.stretches.data[unit]
        own = np.repeat(np.arange(len(unit), dtype=np.int32), times)
        each = np.arange(len(own)) - np.repeat(np.cumsum(times) - times - self.stretch.data[unit], times)
        node, base = self.top.data[each], self.bottom.data[each]
        shift = start[own] + self.at.data[each] - base  # from a node to its code point
        live_seed = seed[own]
        head, edge, piece, sources = self.head.data, self.edge.data, self.piece.data, self.source.data
        while len(node):
            u = (common.mix64(live_seed + (shift + node).astype(np.uint64) * STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            arc = head[node]
            beyond = np.flatnonzero(edge[arc] <= u)
            while len(beyond):  # a node has few arcs
                arc[beyond] += 1
                beyond = beyond[edge[arc[beyond]] <= u[beyond]]
            node = sources[arc]
            out[shift + node] = piece[arc]
            on = np.flatnonzero(node > base)
            if len(on) < len(node):
                node, base, shift, live_seed = node[on], base[on], shift[on], live_seed[on]
        return out


STEP = np.uint64(0x9E3779B97F4A7C15)


def encode_chunk(sampler: Sampler, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, flat, and n + 1 offsets. keys: a uint64 for each text."""
    vocabulary = sampler.vocabulary
    found = [UNIT.findall(t) for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    if not counts.any():
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    unit = sampler.units_of(found)
    size = sampler.length.data[unit].astype(np.int64)
    start = np.cumsum(size) - size
    text_start = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    owner = np.repeat(np.arange(len(texts)), counts)
    # the place counts from the start of the text, not of the chunk
    seed = (common.mix64(keys) - text_start[:-1].astype(np.uint64) * STEP)[owner]
    ids = sampler.draw(unit, start, seed, int(text_start[-1]))
    at = np.flatnonzero(ids >= 0)
    ids = ids[at]
    offsets = np.searchsorted(at, text_start)
    spelt = ids >= vocabulary.size
    if spelt.any():
        points, where = np.unique(ids[spelt] - vocabulary.size, return_inverse=True)
        bytes_of = [vocabulary.spelt(int(p)) for p in points]
        width = np.ones(len(ids), np.int64)
        width[spelt] = np.array([len(b) for b in bytes_of])[where]
        ends = np.concatenate([[0], np.cumsum(width)])
        wide = np.repeat(ids, width)
        for k in range(4):
            part = np.array([b[k] if len(b) > k else 0 for b in bytes_of])
            some = np.flatnonzero(spelt)[width[spelt] > k]
            wide[ends[some] + k] = part[where[width[spelt] > k]]
        ids, offsets = wide, ends[offsets]
    return ids, offsets


class Decoder:
    """The bytes of all pieces as one array."""

    def __init__(self, vocabulary: lattice.Pieces):
        self.data = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.size = np.array([len(b) for b in vocabulary.bytes], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of the texts that the ids spell, flat, and their offsets."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1], dtype=np.int32)
        place += np.repeat(self.start[ids] - ends[:-1].astype(np.int32), size)
        return self.data[place], ends[offsets]


def _sampling(path: str, kept: list[str], sharpness: float):
    """Batches of the columns kept and of `` key`` to batches with piece_ids and lossless."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = lattice.pieces(path)
        sampler, decoder = Sampler(vocabulary, piece_scores(vocabulary, sharpness)), Decoder(vocabulary)
        for batch in batches:
            text = common.column(batch, "text")
            keys = common.column(batch, " key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            raw, raw_offsets = common.utf8(text)
            for a, b in common.row_chunks(raw_offsets, CHUNK):
                ids, offsets = encode_chunk(sampler, common.texts_of(text, a, b), keys[a:b])
                spelt, ends = decoder(ids, offsets)
                want = raw_offsets[a : b + 1] - raw_offsets[a]
                if np.array_equal(ends, want) and np.array_equal(spelt, raw[raw_offsets[a] : raw_offsets[b]]):
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([np.array_equal(spelt[x:y], raw[p:q]) for x, y, p, q in zip(ends, ends[1:], raw_offsets[a:], raw_offsets[a + 1 :])][: b - a], bool)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(common.column(batch, c).slice(a, b - a) for c in kept), lists, pa.array(same)], [*kept, "piece_ids", "lossless"])

    return sample


def _spelling(path: str, kept: list[str]):
    """Batches of the columns kept to batches with decoded."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lattice.pieces(path))
        for batch in batches:
            sizes = pc.list_value_length(common.column(batch, "piece_ids")).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in common.row_chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), PIECES):
                part = batch.slice(a, b - a)
                offsets = np.concatenate([[0], np.cumsum(sizes[a:b], dtype=np.int64)])
                data, ends = decoder(common.column(part, "piece_ids").flatten().to_numpy(zero_copy_only=False), offsets)
                whole = data.tobytes().decode("utf-8", "surrogatepass")
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends].tolist()  # code points before each text
                yield pa.RecordBatch.from_arrays([*(common.column(part, c) for c in kept), pa.array([whole[x:y] for x, y in zip(points, points[1:])], pa.string())], [*kept, "decoded"])

    return spell


def _nullable(df: DataFrame):
    schema = df.schema
    for field in schema:
        field.nullable = True
    return schema


def _prepared(spark: SparkSession, docs: DataFrame, key: str, seed: int) -> tuple[DataFrame, list[str]]:
    common.importable(spark)
    kept = [c for c in docs.columns if c not in ("piece_ids", "lossless", "decoded")]
    return docs.select(*kept, F.xxhash64(F.lit(seed), F.col(key)).alias(" key")), kept


def encode(spark: SparkSession, docs: DataFrame, key: str = "doc_id", model_path: str | None = None, seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """docs with piece_ids array<int> and lossless, whether decoding them gave the text's very bytes."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    plain, kept = _prepared(spark, docs, key, seed)
    schema = _nullable(plain.drop(" key").withColumns({"piece_ids": F.array(F.lit(0)), "lossless": F.lit(True)}))
    return plain.mapInArrow(common.tidied(_sampling(path, kept, sharpness)), schema)


def decode(spark: SparkSession, encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """encoded with decoded, the text that piece_ids spell; null ids decode to the empty text."""
    common.importable(spark)
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    plain = encoded.select(*(c for c in encoded.columns if c != "decoded"))
    return plain.mapInArrow(common.tidied(_spelling(path, plain.columns)), _nullable(plain.withColumn("decoded", F.lit(""))))


def round_trip(spark: SparkSession, docs: DataFrame, key: str = "doc_id", model_path: str | None = None, seed: int = 0, sharpness: float = 1.0) -> DataFrame:
    """decode(encode(docs)) in one Python step, so that texts and pieces cross to Python once."""
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    plain, kept = _prepared(spark, docs, key, seed)
    sample, spell = _sampling(path, kept, sharpness), _spelling(path, [*kept, "piece_ids", "lossless"])
    schema = _nullable(plain.drop(" key").withColumns({"piece_ids": F.array(F.lit(0)), "lossless": F.lit(True), "decoded": F.lit("")}))
    return plain.mapInArrow(common.tidied(common.chained(sample, spell)), schema)
