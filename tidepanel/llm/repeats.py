"""Exact removal of repeated strings: every byte covered by a SPAN-byte string that starts anywhere else too.

Every SPAN-byte string (window) holds an anchor, its GRAM-byte string of the least hash, the
first of equals. Windows that follow each other and have the same anchor are one context: their
number, their bytes, the place of the anchor. Equal windows have equal anchors at equal places,
so only contexts of one anchor have to be compared, and the contexts of a text tile its windows.

1. Contexts that are alike are one, with the number of their copies; anchors with one copy of
   one context are done with, and if an anchor has one context with copies, all of its windows repeat.
2. The different contexts of an anchor go to one shard. A shard's suffix array is built by
   Larsson-Sadakane refinement; neighbours with a common prefix of SPAN bytes, by Kasai's
   method, are repeats.
3. An anchor with more than HOT contexts is spread over many shards. Their windows are merged
   by digests: of what a block of CORE neighbouring windows shares; then, for blocks whose core
   occurs in two contexts or more (found by binary search in the context's sorted list of such
   cores), of all that the block covers; blocks of which only the core occurs twice are judged
   again by their parts of PART windows, and only in parts of which only the core occurs twice
   each window is. Of words' codes only windows that begin with a word are needed there.

Membership bits are bit sets (one hash) that spare the shuffle most of the rows
that a following join drops anyway; what they let through in vain the join still drops.

Passages of a number of words go the same way: a text is coded, eight bytes of hash for each word,
and SPAN is eight times that number. A repeated string of the code that starts within a word
brings along the word before or after it only if that is equal too, but for hashes that collide;
only words of which all eight bytes are marked are cut out.

Cases: null counts as empty; texts under SPAN bytes keep all. Repeated rows are copies of each
other. A null doc_id is an id as any other. Extra columns stay, none is read but doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common
from .suffix_array import Shard

SPAN, GRAM = 400, 64
#: Contexts of one anchor that stay together in a shard.
HOT = 256
#: Windows of a block, and of a part of it.
CORE, PART = 32, 8
#: Bytes of a shard; with one anchor's contexts more it stays under 2 ** 21.
SHARD_BYTES = 1 << 18
CHUNK = 1 << 17
#: Bits of a bit set for each of its numbers, and the exponent of the most bits.
ROOM, MOST_BITS = 8, 30
_FACTOR = 0x9E3779B97F4A7C15 | 1
#: A 64-bit number for each byte value.
TABLE = common.mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
PLACE = np.uint64((1 << 31) - 1)
#: Bytes of a word's code, and words whose codes a Python worker remembers.
CODE, MEMORY = 8, 150_000
#: Words as bytes.split() finds them.
WORD = re.compile(rb"\S+")


class Length(NamedTuple):
    """Bytes of a repeated string, and whether they are those of the texts or of their words' codes."""

    span: int = SPAN
    words: bool = False


def _of(step: Callable, length: Length):
    return lambda batches: step(batches, length)


def word_codes(texts: list[bytes], memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words, and n + 1 offsets."""
    words = [t.split() for t in texts]
    fresh = set().union(*words).difference(memo)
    if len(memo) + len(fresh) > MEMORY:
        memo.clear()
        fresh = set().union(*words)
    memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((memo[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    return flat.view(np.uint8), np.concatenate([[0], np.cumsum(sizes * CODE)])


class Rolling:
    """Hashes of all substrings of a byte array by prefix sums modulo 2 ** 64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        inverse = pow(_FACTOR, -1, 1 << 64)
        self.inverse = np.multiply.accumulate(np.full(n + 1, inverse, np.uint64)) * np.uint64(_FACTOR)
        power = np.multiply.accumulate(np.full(n, _FACTOR, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[data] * power, dtype=np.uint64)])

    def all(self, size: int) -> np.ndarray:
        count = max(len(self.sums) - size, 0)
        return common.mix64((self.sums[size:] - self.sums[:count]) * self.inverse[:count])

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return common.mix64((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values, by minima from both ends of blocks."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """start, windows, anchor place (from the start) and anchor hash of all contexts of texts that lie side by side."""
    found = []
    n = len(data)
    for a in range(0, max(n - span + 1, 0), 2 * CHUNK):  # a very long text goes in pieces; that cuts a context, no window
        part = data[a : a + 2 * CHUNK + span - 1]
        grams = Rolling(part).all(GRAM)
        least = sliding_least(grams >> np.uint64(31) << np.uint64(31) | np.arange(len(grams), dtype=np.uint64), span - GRAM + 1)
        anchor = (least & PLACE).astype(np.int64)
        start = np.arange(len(anchor)) + a
        doc = np.searchsorted(offsets, start, side="right") - 1 if len(offsets) > 2 else np.zeros(len(start), np.int64)
        inside = start + span <= offsets[doc + 1]
        cut = np.ones(len(start), bool)
        cut[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        heads = np.flatnonzero(cut & inside)
        tails = np.flatnonzero(inside & np.concatenate([cut[1:] | ~inside[1:], [True]]))
        found.append((start[heads], tails - heads + 1, anchor[heads] + a - start[heads], grams[anchor[heads]].view(np.int64)))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else [()] * 4))


def keys_of(ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each row's id and text."""
    digest = b"".join(xxhash.xxh3_128_digest(repr(i).encode() + b":" + t) for i, t in zip(ids, texts))
    both = np.frombuffer(digest, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _rows(batch: pa.RecordBatch) -> tuple[list, list[bytes]]:
    return common.column(batch, "doc_id").to_pylist(), [t or b"" for t in common.column(batch, "text").cast(pa.binary()).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most 2 * CHUNK bytes of text, so that few copies of texts are alive at once."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        for a, b in common.row_chunks(common.utf8(common.column(batch, "text"))[1], 2 * CHUNK):
            yield batch.slice(a, b - a)


def _scan(batches: Iterator[pa.RecordBatch], length: Length) -> Iterator[pa.RecordBatch]:
    """One row for each text with windows: its keys and lists of its contexts, neighbours that are alike as one with their number."""
    memo: dict[bytes, int] = {}
    for batch in batches:
        for a, b in common.row_chunks(common.utf8(common.column(batch, "text"))[1], CHUNK):
            part = batch.slice(a, b - a)
            data, offsets = word_codes(_rows(part)[1], memo) if length.words else common.utf8(common.column(part, "text"))
            start, windows, anchor_at, anchor = contexts(data, offsets, length.span)
            if not len(start):
                continue
            view = memoryview(data)
            ctx = np.array([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(start.tolist(), (start + windows + length.span - 1).tolist())], np.uint64).view(np.int64)
            doc = np.searchsorted(offsets, start, side="right") - 1
            new = np.ones(len(start), bool)
            new[1:] = (ctx[1:] != ctx[:-1]) | (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1]) | (doc[1:] != doc[:-1])
            heads = np.flatnonzero(new)
            times = np.diff(np.append(heads, len(start)))
            doc = doc[heads]
            owners, first = np.unique(doc, return_index=True)
            cuts = pa.array(np.append(first, len(doc)), pa.int32())
            kept = part.take(pa.array(owners))
            k1, k2 = keys_of(*_rows(kept))
            lists = [(anchor[heads], pa.int64()), (ctx[heads], pa.int64()), ((start - offsets[np.searchsorted(offsets, start, side="right") - 1])[heads], pa.int32()), (windows[heads], pa.int16()), (anchor_at[heads], pa.int16()), (times, pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), *(pa.ListArray.from_arrays(cuts, pa.array(v, t)) for v, t in lists)], ["k1", "k2", "anchor", "ctx", "start", "windows", "anchor_at", "times"])


class Bits:
    """A bit set of 64-bit numbers, sized by their count, for tests of membership that may be wrong only by a yes."""

    def __init__(self, scratch: common.Scratch, numbers: DataFrame, column: str):
        numbers = scratch.save(numbers.select(F.col(column).alias("number")), f"bits-{column}")
        bits = min(MOST_BITS, max(16, (ROOM * numbers.count()).bit_length()))
        place = F.shiftrightunsigned("number", 64 - bits) + 1
        rows = numbers.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("place"))
        got = rows.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")).toLocalIterator()  # 2 ** MOST_BITS bits at most
        data = np.zeros(1 << bits - 3, np.uint8)
        for r in got:
            data[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
        self.shared = scratch.spark.sparkContext.broadcast(data)
        scratch.drop(f"bits-{column}")

    @staticmethod
    def have(data: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        place = (np.ascontiguousarray(numbers).view(np.uint64) >> np.uint64(64 - (len(data).bit_length() + 2))).astype(np.int64)
        return data[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def _candidates(shared):
    """Contexts, one a row, whose anchors may occur elsewhere."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "ctx", "start", "windows", "anchor_at", "times"]
        for batch in batches:
            lists = [common.column(batch, c) for c in names]
            flat = [x.flatten() for x in lists]
            sizes = np.diff(lists[0].offsets.to_numpy())
            at = pa.array(np.flatnonzero(Bits.have(shared.value, flat[0].to_numpy())))
            own = pa.array(np.repeat(np.arange(len(sizes)), sizes)).take(at)
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c).take(own) for c in ("k1", "k2")), *(x.take(at) for x in flat)], ["k1", "k2", *names])

    return pick


def _keyed(shared, wanted: bool | None, names: list[str]):
    """Rows whose first key may be (or surely is not) in the bit set, with their keys."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            k1, k2 = keys_of(*_rows(batch)) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            at = pa.array(np.flatnonzero(Bits.have(shared.value, k1) == wanted))
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c).take(at) for c in names), pa.array(k1).take(at), pa.array(k2).take(at)], [*names, " k1", " k2"])

    return pick


def _fetch(batches: Iterator[pa.RecordBatch], length: Length) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a text was asked for; another row under the same key has others, and is passed over."""
    memo: dict[bytes, int] = {}
    for batch in _parts(batches):
        texts = _rows(batch)[1]
        if length.words:
            data, offsets = word_codes(texts, memo)
            texts = [data[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
        asked = common.column(batch, "asked")
        values = asked.flatten()
        names = ["anchor", "ctx", "copies", "start", "windows", "anchor_at", "n_contexts"]
        cols = {c: values.field(c).to_numpy() for c in names}
        names[names.index("start")] = "phase"
        cols["phase"] = (cols["start"] % CODE).astype(np.int16)
        own = np.repeat(np.arange(len(texts)), np.diff(asked.offsets.to_numpy()))
        for a in range(0, len(own), 20_000):
            some = slice(a, a + 20_000)
            found = [texts[i][s : s + w + length.span - 1] for i, s, w in zip(own[some].tolist(), cols["start"][some].tolist(), cols["windows"][some].tolist())]
            same = np.array([xxhash.xxh3_64_intdigest(x) for x in found], np.uint64).view(np.int64) == cols["ctx"][some]
            out = pa.RecordBatch.from_arrays([*(pa.array(cols[c][some]) for c in names), pa.array(found, pa.binary())], [*names, "bytes"])
            yield out.filter(pa.array(same))


def _runs(flags: np.ndarray) -> list[int]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.tolist()


MARKS = "anchor long, ctx long, runs array<int>"


def _marks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int32()))], ["anchor", "ctx", "runs"])


def _shards(batches: Iterator[pa.RecordBatch], length: Length) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; a shard ends between two anchors."""
    held: list[tuple] = []
    size = 0

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        shard = Shard([r[4] for r in rows])
        found = shard.repeated(np.array([r[3] for r in rows], np.int64), length.span)
        out = []
        for (anchor, ctx, copies, windows, _), at in zip(rows, shard.starts.tolist()):
            runs = [0, windows] if copies > 1 else _runs(found[at : at + windows])
            if runs:
                out.append((anchor, ctx, runs))
        return _marks(out)

    for batch in _slices(batches):
        for row in zip(*(common.column(batch, c).to_pylist() for c in ("anchor", "ctx", "copies", "windows", "bytes"))):
            if size > SHARD_BYTES and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4]) + 1
    if held:
        yield solve(held)


def _blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """For the contexts of a batch: rolling hashes, first byte, anchors, windows, anchor places."""
    data, offsets = common.utf8(common.column(batch, "bytes").cast(pa.binary()))
    cols = [common.column(batch, c).to_numpy().astype(np.int64) for c in ("anchor", "windows", "anchor_at")]
    return Rolling(data), offsets[:-1], *cols


def _digest(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    return common.mix64(hashes + more.astype(np.uint64) * np.uint64(_FACTOR)).view(np.int64)


def _core_digests(batch: pa.RecordBatch, span: int, size: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """context, block and digest of all blocks: windows whose distance to the anchor has the same quotient by size share span - size + 1 bytes."""
    rolling, first, _, windows, anchor_at = _blocks(batch)
    low, high = (anchor_at - windows + 1) // size, anchor_at // size
    count = high - low + 1
    own = np.repeat(np.arange(len(first)), count)
    block = np.arange(len(own)) - np.repeat(np.cumsum(count) - count - low, count)
    return own, block, _digest(rolling.at(first[own] + anchor_at[own] - size * block, span - size + 1), block)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4000):
            yield batch.slice(a, 4000)


def _cores(batches: Iterator[pa.RecordBatch], length: Length) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        own, _, digest = _core_digests(batch, length.span)
        cuts = np.searchsorted(own, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([common.column(batch, "anchor"), common.column(batch, "ctx"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(digest))], ["anchor", "ctx", "cores"])


def _listed(batch: pa.RecordBatch, own: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Places of the blocks whose core is in their context's column ``repeated``."""
    cuts = np.searchsorted(own, np.arange(batch.num_rows + 1))
    found = []
    for i, listed in enumerate(common.column(batch, "repeated")):
        listed, mine = np.sort(listed.as_py()), digest[cuts[i] : cuts[i + 1]]
        at = np.minimum(np.searchsorted(listed, mine), len(listed) - 1)
        found.append(np.flatnonzero(listed[at] == mine) + cuts[i])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _bounds(own: np.ndarray, block: np.ndarray, windows: np.ndarray, anchor_at: np.ndarray, size: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each block in its context."""
    last = anchor_at[own] - size * block
    return np.maximum(last - size + 1, 0), np.minimum(last, windows[own] - 1)


BLOCKS = "anchor long, ctx long, core long, whole long, low int, high int"


def _wholes(batches: Iterator[pa.RecordBatch], length: Length, parts: bool = False) -> Iterator[pa.RecordBatch]:
    """For the blocks whose cores are repeated, or for their parts, digests of the core and of all that their windows cover."""
    for batch in _slices(batches):
        rolling, first, anchor, windows, anchor_at = _blocks(batch)
        own, block, digest = _core_digests(batch, length.span)
        at = _listed(batch, own, digest)
        own, block, digest = own[at], block[at], digest[at]
        if parts:
            many = CORE // PART
            own, block = np.repeat(own, many), (block[:, None] * many + np.arange(many)).ravel()
            low, high = _bounds(own, block, windows, anchor_at, PART)
            inside = low <= high  # a block at an end of its context lacks parts
            own, block, low, high = (x[inside] for x in (own, block, low, high))
            digest = _digest(rolling.at(first[own] + anchor_at[own] - PART * block, length.span - PART + 1), block)
        else:
            low, high = _bounds(own, block, windows, anchor_at)
        value = np.zeros(len(own), np.int64)
        for size in np.unique(high - low):  # CORE sizes at most
            some = high - low == size
            value[some] = _digest(rolling.at(first[own[some]] + low[some], length.span + int(size)), (anchor_at[own[some]] - low[some]) * CORE + size)
        take = pa.array(own)
        yield pa.RecordBatch.from_arrays([common.column(batch, "anchor").take(take), common.column(batch, "ctx").take(take), pa.array(digest), pa.array(value), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32) + 1)], ["anchor", "ctx", "core", "whole", "low", "high"])


def _windows(batches: Iterator[pa.RecordBatch], length: Length) -> Iterator[pa.RecordBatch]:
    """Digests of the windows in those parts (of words' codes: those at words' beginnings in those blocks) whose cores are in the column ``repeated``."""
    size = CORE if length.words else PART
    for batch in _slices(batches):
        rolling, first, anchor, windows, anchor_at = _blocks(batch)
        own, block, digest = _core_digests(batch, length.span, size)
        at = _listed(batch, own, digest)
        own, block = own[at], block[at]
        low, high = _bounds(own, block, windows, anchor_at, size)
        count = high - low + 1
        start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - low, count)
        own = np.repeat(own, count)
        if length.words:
            whole = (common.column(batch, "phase").to_numpy()[own] + start) % CODE == 0
            own, start = own[whole], start[whole]
        value = _digest(rolling.at(first[own] + start, length.span), anchor_at[own] - start)
        cuts = pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([common.column(batch, "anchor"), common.column(batch, "ctx"), pa.ListArray.from_arrays(cuts, pa.array(start, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(value))], ["anchor", "ctx", "start", "digest"])


def _judged(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of the blocks that are repeated as a whole, and for each context the cores of the blocks to be looked into."""
    twice = blocks.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("ctx", "core")).alias("one")).filter("n > 1")
    full = blocks.join(twice, ["anchor", "whole"], "left_semi").select("anchor", "ctx", "low", "high")
    rest = blocks.join(twice, ["anchor", "whole"], "left_anti").select("anchor", "ctx", "core")
    # one block of each repeated whole stands for all of them, as windows of other blocks may equal its windows
    return full, rest.unionByName(twice.select("anchor", "one.ctx", "one.core")).groupBy("anchor", "ctx").agg(F.collect_set("core").alias("repeated"))


def _hot_marks(scratch: common.Scratch, hot: DataFrame, length: Length) -> DataFrame:
    """Marks of contexts whose anchors are spread over many shards."""
    cores = scratch.save(hot.mapInArrow(common.tidied(_of(_cores, length)), "anchor long, ctx long, cores array<long>"), "cores")
    each = cores.select("anchor", "ctx", F.explode("cores").alias("core"))
    twice = each.groupBy("anchor", "core").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "core")
    asked = each.join(twice, ["anchor", "core"], "left_semi").groupBy("anchor", "ctx").agg(F.collect_list("core").alias("repeated"))  # a context has few blocks
    blocks = scratch.save(hot.join(asked, ["anchor", "ctx"]).mapInArrow(common.tidied(_of(_wholes, length)), BLOCKS), "blocks")
    full, asked = _judged(blocks)
    if not length.words:  # where a block has a few windows only
        parts = scratch.save(hot.join(asked, ["anchor", "ctx"]).mapInArrow(common.tidied(lambda batches: _wholes(batches, length, True)), BLOCKS), "parts")
        twice = parts.groupBy("anchor", "core").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "core")
        more, asked = _judged(scratch.save(parts.join(twice, ["anchor", "core"], "left_semi"), "live-parts"))
        full = full.unionByName(more)
    found = scratch.save(hot.join(asked, ["anchor", "ctx"]).mapInArrow(common.tidied(_of(_windows, length)), "anchor long, ctx long, start array<int>, digest array<long>"), "windows")
    each = found.select("anchor", "ctx", F.explode(F.arrays_zip("start", "digest")).alias("w")).select("anchor", "ctx", F.col("w.start").alias("low"), F.col("w.digest").alias("digest"))
    twice = each.groupBy("anchor", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "digest")
    single = each.join(twice, ["anchor", "digest"], "left_semi").select("anchor", "ctx", "low", (F.col("low") + 1).alias("high"))
    runs = full.unionByName(single).groupBy("anchor", "ctx").agg(F.flatten(F.collect_list(F.array("low", "high"))).alias("runs"))  # SPAN at most
    copied = hot.filter("copies > 1").select("anchor", "ctx", F.array(F.lit(0), F.col("windows").cast("int")).alias("runs"))
    return runs.join(copied.select("anchor", "ctx"), ["anchor", "ctx"], "left_anti").unionByName(copied)


def _spans(batches: Iterator[pa.RecordBatch], length: Length) -> Iterator[pa.RecordBatch]:
    """The maximal removed runs of each text from the repeated windows of its contexts."""
    for batch in batches:
        out = []
        for marks in common.column(batch, "marks").to_pylist():
            edges = []
            for m in marks:
                runs = np.array(m["runs"], np.int64).reshape(-1, 2)
                base = m["start"] + m["windows"] * np.arange(m["times"])
                edges.append((base[:, None, None] + runs[None]).reshape(-1, 2))
            edges = np.concatenate(edges)
            edges = edges[np.argsort(edges[:, 0], kind="stable")]
            reach = np.maximum.accumulate(edges[:, 1] + length.span - 1)
            new = np.concatenate([[True], edges[1:, 0] > reach[:-1]])
            heads = np.flatnonzero(new)
            out.append(np.stack([edges[heads, 0], reach[np.append(heads[1:], len(edges)) - 1]], 1).ravel().astype(np.int32).tolist())
        yield pa.RecordBatch.from_arrays([common.column(batch, "k1"), common.column(batch, "k2"), pa.array(out, pa.list_(pa.int32()))], ["k1", "k2", "spans"])


#: What is told of each text.
FOUND = ("n_bytes", "n_removed", "n_spans", "kept_bytes")


def _united(text: bytes, spans: list[int] | None, word_spans: list[int] | None) -> list[int]:
    """Byte offsets of what lies in either: spans of bytes, and spans of the words' codes."""
    if not word_spans:
        return spans or []
    words = [m.span() for m in WORD.finditer(text)]
    pairs = list(zip(spans[::2], spans[1::2])) if spans else []
    for x, y in zip(word_spans[::2], word_spans[1::2]):
        pairs.append((words[-(-x // CODE)][0], words[y // CODE - 1][1]))
    out: list[int] = []
    for x, y in sorted(pairs):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += x, y
    return out


def _cut(names: list[str], prefix: str):
    """The texts without their spans (columns `` spans`` and `` word_spans``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            spans, word_spans = (common.column(batch, c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in (" spans", " word_spans"))
            kept, numbers = [], []
            for t, s, w in zip(_rows(batch)[1], spans, word_spans):
                s = _united(t, s, w)
                pairs = list(zip(s[::2], s[1::2]))
                edges = [0, *s, len(t)]
                kept.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2])))
                numbers.append((len(t), sum(y - x for x, y in pairs), len(pairs)))
            cols = list(zip(*numbers)) if numbers else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in names), *(pa.array(c, pa.int64()) for c in cols), pa.array(kept, pa.binary())], [*names, *(prefix + c for c in FOUND)])

    return cut


def repeated_spans(scratch: common.Scratch, docs: DataFrame, length: Length = Length()) -> DataFrame:
    """k1, k2 and spans (byte offsets: from, to, from, to ...) of all texts that hold a repeated string; offsets of the code where ``length`` is words."""
    texts = docs.select("doc_id", "text")
    least = 2 * (length.span // CODE) - 1 if length.words else length.span  # bytes of a text that has a window
    rows = scratch.save(texts.filter(F.octet_length("text") >= least).mapInArrow(common.tidied(_of(_scan, length)), "k1 long, k2 long, anchor array<long>, ctx array<long>, start array<int>, windows array<short>, anchor_at array<short>, times array<int>"), "rows")
    anchors = rows.select(F.explode(F.arrays_zip("anchor", "times")).alias("a")).groupBy(F.col("a.anchor").alias("anchor")).agg(F.sum("a.times").alias("n"))
    bits = Bits(scratch, anchors.filter("n > 1"), "anchor")
    cand = scratch.save(rows.mapInArrow(common.tidied(_candidates(bits.shared)), "k1 long, k2 long, anchor long, ctx long, start int, windows short, anchor_at short, times int"), "cand")
    scratch.drop("rows")
    distinct = scratch.save(
        cand.groupBy("anchor", "ctx").agg(F.sum("times").alias("copies"), F.min(F.struct("k1", "start", "windows", "anchor_at")).alias("at")), "distinct"
    )
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("n_contexts"), F.sum("copies").alias("total")).filter("total > 1").drop("total")
    live = scratch.save(distinct.join(sizes, "anchor").select("anchor", "ctx", "copies", "n_contexts", "at.*"), "live")
    alone = live.filter("n_contexts = 1").select("anchor", "ctx", F.array(F.lit(0), F.col("windows").cast("int")).alias("runs"))
    asked = live.filter("n_contexts > 1").groupBy("k1").agg(F.collect_list(F.struct("anchor", "ctx", "copies", "start", "windows", "anchor_at", "n_contexts")).alias("asked"))  # of one text
    bits = Bits(scratch, live.filter("n_contexts > 1").select("k1").distinct(), "k1")
    kind = docs.schema["doc_id"].dataType.simpleString()
    owners = texts.mapInArrow(common.tidied(_keyed(bits.shared, True, ["doc_id", "text"])), f"doc_id {kind}, text string, ` k1` long, ` k2` long").dropDuplicates([" k1", " k2"])
    fetched = owners.select("doc_id", "text", F.col(" k1").alias("k1")).join(asked, "k1").mapInArrow(common.tidied(_of(_fetch, length)), "anchor long, ctx long, copies long, phase short, windows short, anchor_at short, n_contexts long, bytes binary")
    fetched = scratch.save(fetched, "fetched")
    scratch.drop("distinct")
    cold = fetched.filter(F.col("n_contexts") <= HOT).drop("phase", "anchor_at", "n_contexts").repartition("anchor").sortWithinPartitions("anchor", "ctx")
    sharded = scratch.save(cold.mapInArrow(common.tidied(_of(_shards, length)), MARKS), "sharded")
    hot = _hot_marks(scratch, fetched.filter(F.col("n_contexts") > HOT).drop("n_contexts"), length)
    marks = alone.unionByName(sharded).unionByName(hot)
    marked = cand.join(marks, ["anchor", "ctx"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "windows", "times", "runs")).alias("marks"))  # of one text
    found = scratch.save(marked.mapInArrow(common.tidied(_of(_spans, length)), "k1 long, k2 long, spans array<int>"), "spans")
    scratch.keep("spans")
    return found


def decoded(kept: bytes) -> str:
    """The text of kept bytes; a character that was cut in two goes."""
    return kept.decode("utf-8", "ignore")


def without_repeats(spark: SparkSession, docs: DataFrame, words: int | None = None) -> DataFrame:
    """docs with the repeated strings (and passages of so many words) cut out of text, and n_chars, where there is such a column, brought up to date."""

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            same = common.column(batch, " n_removed").to_pylist()
            old, kept = common.column(batch, "text").to_pylist(), common.column(batch, " kept_bytes").to_pylist()
            new = pa.array([decoded(k) if n else t for t, k, n in zip(old, kept, same)], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == "text" else common.column(batch, c) for c in names], names)

    names = docs.columns
    schema = docs.schema
    for field in schema:
        field.nullable = True
    out = _removed(spark, docs, words, " ", text, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def remove_repeats(spark: SparkSession, docs: DataFrame, words: int | None = None) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes, the bytes that stay; columns of these names are replaced.

    words: also removes every passage of so many words that occurs elsewhere too, whatever white space is between them.
    """
    return _removed(spark, docs.select(*(c for c in docs.columns if c not in FOUND)), words, "")


def _removed(spark: SparkSession, docs: DataFrame, words: int | None, prefix: str, last: Callable = iter, schema: StructType | None = None) -> DataFrame:
    """docs with prefixed columns of FOUND; last: a step over their batches, and its schema."""
    if words is not None and words * CODE < 2 * GRAM:
        raise ValueError(f"a passage has {2 * GRAM // CODE} words at least")
    scratch = common.Scratch(spark)
    spans = repeated_spans(scratch, docs).withColumnRenamed("spans", " spans")
    if words:
        more = common.Scratch(spark)
        found = repeated_spans(more, docs, Length(words * CODE, True)).withColumnRenamed("spans", " word_spans")
        spans = scratch.save(spans.join(found, ["k1", "k2"], "full"), "united")
        more.keep()
        scratch.keep("united")
    names = docs.columns
    keyed = docs.selectExpr("*", "0L ` k1`", "0L ` k2`").schema
    out = docs.withColumns({prefix + c: F.lit(b"" if c == "kept_bytes" else 0).cast("binary" if c == "kept_bytes" else "long") for c in FOUND}).schema
    for field in [*keyed, *out]:
        field.nullable = True
    bits = Bits(scratch, spans, "k1")
    cut = common.chained(_cut(names, prefix), last)
    whole = docs.mapInArrow(common.tidied(common.chained(_keyed(bits.shared, False, names), cut)), schema or out)
    parts = docs.mapInArrow(common.tidied(_keyed(bits.shared, True, names)), keyed)
    found = spans.withColumnsRenamed({"k1": " k1", "k2": " k2"})
    return parts.join(found, [" k1", " k2"], "left").mapInArrow(common.tidied(cut), schema or out).unionByName(whole)
