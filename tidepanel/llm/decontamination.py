"""Benchmark decontamination by SimHash fingerprints of item-sized windows.

Every benchmark item is a bag of five-word shingles weighted by their number. A window of a
document has as many words as the item. Its 64-bit SimHash adds the shingles' bits with their
weights. Fingerprints are looked up in a multi-index: cut in BLOCKS blocks, two fingerprints
within RADIUS bits agree in some block up to RADIUS // BLOCKS bits, so looking up all block
values that near finds every item within the radius. Candidates are then verified by the exact
weighted similarity, sum of minima over sum of maxima of the shingle weights.

Windows that cannot reach the similarity are left out beforehand by an exact bound: at
similarity s a window has at least s times the item's shingle weight of shingles that occur in
the benchmark at all.

The benchmark goes to the workers in blocks of at most BLOCK_ITEMS items; more items mean more
passes over the documents, not larger broadcasts.

Cases: null or empty texts and items have no window. An item or window of fewer than five words
is one shingle. Repeated documents are reported one by one, an item that occurs several times in
a document once, with its best window (ties: the first). Rows of the benchmark that repeat are
one item, and item_id keeps its type. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 8, 19
#: Items, and bytes of their texts, that the workers get at once.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 1 << 23
CHUNK = 1 << 20
#: Words outside the benchmark that a worker remembers.
MEMORY = 150_000
#: ASCII punctuation and digits' neighbours count as white space; letters are lower-cased.
PUNCTUATION = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
TABLE = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(TABLE).split()


def word_hashes(words) -> np.ndarray:
    """A hash of each word's own bytes, the same in every block of the benchmark."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words, given by their hashes, that start at each place."""
    n = max(len(words) - k + 1, 0)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = common.mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    return total


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(common.mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


@dataclass
class Index:
    """Items of one block of the benchmark, ready for the workers."""

    item_ids: list
    words: dict[bytes, int]  # numbers of all words of the block
    word_hashes: np.ndarray
    sizes: np.ndarray  # words of each item
    weights: list[dict[int, int]]  # shingle hash -> number
    prints: np.ndarray
    known: np.ndarray  # sorted shingle hashes of all items
    buckets: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # by item size, for each block: items by block value, offsets


@functools.lru_cache(4)
def near_values(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits with at most radius ones."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.int64)


def build_index(items: list[tuple[object, str]]) -> Index:
    known_words: dict[bytes, int] = {}
    ids, sizes, weights, prints = [], [], [], []
    for item_id, text in items:
        words = words_of(text)
        if not words:
            continue
        for w in words:
            known_words.setdefault(w, len(known_words))
        hashes = shingles(word_hashes(words), min(SHINGLE, len(words)))
        value, number = np.unique(hashes, return_counts=True)
        ids.append(item_id)
        sizes.append(len(words))
        weights.append(dict(zip(value.tolist(), number.tolist())))
        prints.append(pack((signs(value) * number[:, None]).sum(0)[None, :])[0])
    prints = np.array(prints, np.uint64)
    sizes_ = np.array(sizes, np.int64)
    buckets = {}
    for size in np.unique(sizes_).tolist():
        at = np.flatnonzero(sizes_ == size)
        buckets[size] = []
        for block in range(BLOCKS):
            own = block_value(prints[at], block)
            counts = np.bincount(own, minlength=1 << BITS // BLOCKS)
            buckets[size].append((at[np.argsort(own, kind="stable")], np.concatenate([[0], np.cumsum(counts)])))
    known = np.unique(np.fromiter((h for w in weights for h in w), np.uint64))
    return Index(ids, known_words, word_hashes(known_words), sizes_, weights, prints, known, buckets)


def block_value(prints: np.ndarray, block: int) -> np.ndarray:
    width = BITS // BLOCKS
    return (prints >> np.uint64(block * width) & np.uint64((1 << width) - 1)).astype(np.int64)


def within_radius(index: Index, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in prints, item) of all pairs with items of ``size`` words within RADIUS bits, by the multi-index."""
    at, item = [], []
    near = near_values(BITS // BLOCKS, RADIUS // BLOCKS)
    for block, (items, offsets) in enumerate(index.buckets[size]):
        value = (block_value(prints, block)[:, None] ^ near[None, :]).ravel()
        count = offsets[value + 1] - offsets[value]
        some = np.flatnonzero(count)
        value, count = value[some], count[some]
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at.append(np.repeat(some // len(near), count))
        item.append(items[np.repeat(offsets[value], count) + within])
    at, item = np.concatenate(at), np.concatenate(item)
    close = np.bitwise_count(prints[at] ^ index.prints[item]) <= RADIUS
    pair = np.unique(at[close] * len(index.prints) + item[close])
    return pair // max(1, len(index.prints)), pair % max(1, len(index.prints))


def similarity(window: np.ndarray, weights: dict[int, int]) -> float:
    """Sum of minima over sum of maxima of the shingle weights."""
    value, number = np.unique(window, return_counts=True)
    both = sum(min(n, weights.get(v, 0)) for v, n in zip(value.tolist(), number.tolist()))
    return both / (len(window) + sum(weights.values()) - both)


def known_at(index: Index, words: np.ndarray, k: int, places: np.ndarray) -> np.ndarray:
    """Those of the places at which k words start that are a shingle of the benchmark."""
    total = np.full(len(places), k, np.uint64)
    for j in range(k):
        total = common.mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[places + j])
    at = np.minimum(np.searchsorted(index.known, total), len(index.known) - 1)
    return places[index.known[at] == total]


def find(index: Index, words: np.ndarray, theta: float) -> list[tuple[int, int, int, float, int]]:
    """(item, start, words, similarity, bits apart) of the best window of each item in one document; words: their hashes."""
    best: dict[int, tuple] = {}
    hashed: dict[int, tuple] = {}
    for size in np.unique(index.sizes):
        size = int(size)
        k = min(SHINGLE, size)
        if len(words) < size:
            continue
        if k not in hashed:
            values = shingles(words, k)
            place = np.minimum(np.searchsorted(index.known, values), len(index.known) - 1)
            hashed[k] = values, np.concatenate([[0], np.cumsum(index.known[place] == values)])
        hashes, total = hashed[k]
        span = size - k + 1  # shingles of a window
        enough = np.flatnonzero(total[span:] - total[:-span] >= theta * span)
        for a in range(0, len(enough), 256):
            starts = enough[a : a + 256]
            inside = hashes[starts[:, None] + np.arange(span)]
            prints = pack(signs(inside.ravel()).reshape(len(starts), span, BITS).sum(1)) if span * len(starts) <= 1 << 18 else np.concatenate([pack(signs(row).sum(0)[None, :]) for row in inside])
            for w, item in zip(*within_radius(index, prints, size)):
                value = similarity(inside[w], index.weights[item])
                if value >= theta and (item not in best or value > best[item][3]):
                    best[item] = (int(item), int(starts[w]), size, value, int(np.bitwise_count(prints[w] ^ index.prints[item])))
    return [best[k] for k in sorted(best)]


def _scan(shared, theta: float, kind: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        lengths = np.unique(np.minimum(index.sizes, SHINGLE)).tolist()
        numbers, hashes = dict(index.words), index.word_hashes  # the block's words, then others met so far
        for batch in batches:
            text, doc_id = common.column(batch, "text"), common.column(batch, "doc_id")
            rows, found = [], []
            for a, b in common.row_chunks(common.utf8(text)[1], CHUNK):
                docs = [words_of(t) for t in text.slice(a, b - a).to_pylist()]
                sizes = np.fromiter(map(len, docs), np.int64, len(docs))
                fresh = set().union(*docs).difference(numbers)
                if len(numbers) - len(index.words) + len(fresh) > MEMORY:
                    numbers, hashes = dict(index.words), index.word_hashes
                    fresh = set().union(*docs).difference(numbers)
                numbers.update(zip(fresh, range(len(numbers), len(numbers) + len(fresh))))
                hashes = np.concatenate([hashes, word_hashes(fresh)])
                ids = np.fromiter((numbers[w] for ws in docs for w in ws), np.int64, int(sizes.sum()))
                flat = hashes[ids]
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                ahead = np.zeros(len(flat) + 1, np.int64)  # known words in a row from each place
                ahead[:-1] = ids < len(index.words)
                places = np.flatnonzero(ahead)
                hits = []
                for k in range(1, SHINGLE + 1):
                    if k in lengths:
                        hits.append(known_at(index, flat, k, places))
                    places = places[(ahead[np.minimum(places + k, len(flat))] > 0)]
                # a document without a shingle of the benchmark holds no window; shingles across documents only cost a look
                for i in np.unique(np.searchsorted(bounds, np.concatenate(hits), side="right") - 1):
                    for hit in find(index, flat[bounds[i] : bounds[i + 1]], theta):
                        rows.append(a + int(i))
                        found.append((index.item_ids[hit[0]], *hit[1:]))
            if rows:
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.float64(), pa.int64())))],
                    ["doc_id", "item_id", "first_word", "n_words", "similarity", "bits_apart"],
                )

    return scan


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, theta: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity and bits_apart of every item in every document that holds it."""
    common.importable(spark)
    kind, item_kind = (df.schema[c].dataType for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, first_word long, n_words long, similarity double, bits_apart long"
    items = benchmark.select("item_id", "text").filter(F.length("text") > 0).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["bytes"] // BLOCK_BYTES))
    parts = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        block = own.orderBy("item_id", "text").collect()  # about block_items rows and BLOCK_BYTES bytes
        if block:
            shared = spark.sparkContext.broadcast(build_index([(r["item_id"], r["text"]) for r in block]))
            parts.append(docs.select("doc_id", "text").mapInArrow(common.tidied(_scan(shared, theta, to_arrow_type(item_kind))), schema))
    if not parts:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)
