"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A document's set holds its distinct five-word shingles as 64-bit hashes (whole sequence when
shorter). Documents with equal sets become one node. A node's sketch places its elements into
T bins in rounds: in round i every element goes to one hashed bin with the value (i, hash) and
each bin keeps its minimum; from round T on, round T + j sends all elements to bin j, so every
bin fills. Most sets fill in two or three rounds, and the share of equal bins estimates the
similarity with the concentration of T independent samples. Bands of ROWS bins make buckets.

Pairs of a bucket are not listed. Each bucket's most central node is compared on full sets with
the others (a star); links are contracted into components, and a bucket whose nodes have come
to one component is finished. Further stars take a few nodes of each component. What then still
shares a bucket without being of one component is compared pair by pair, but only pairs that
pass an exact bound become rows: every node carries the parities of its elements by WIDTH hash
values; two sets differ in at least as many elements as parities, which bounds their
intersection from above. So no link is given up.

Cases: no words or null text give an empty set, linked with nothing. Rows with null doc_id get
a component only from others' ids (null when alone) and kept = null-safe equality. Rows that
repeat a doc_id count as documents of their own with the same id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
BINS, ROWS = 125, 5  # 25 bands: at similarity 0.85 a pair shares no bucket with probability 4e-7
CHUNK = 1 << 19
MEMORY = 150_000
#: Odd multipliers of a shingle's five words.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rounds of stars before the rest is compared pair by pair, and nodes a component sends to each after the first.
STARS, PICKS = 3, 4
#: Bits of parities of a set; a multiple of 64.
WIDTH = 1024
PARITIES = [f"p{i}" for i in range(WIDTH // 64)]


def shingle_hashes(texts: list[bytes], memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it: flat array and n + 1 offsets."""
    words = [t.lower().split() for t in texts]  # bytes: lower() is A-Z only, split() is at space and \t to \r only
    fresh = set().union(*words).difference(memo)
    if len(memo) + len(fresh) > MEMORY:
        memo.clear()
        fresh = set().union(*words)
    memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in fresh)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((memo[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(words)), sizes)
    left = ends[doc] - np.arange(len(flat))  # words from here to the end of the document
    total = np.zeros(len(flat), np.uint64)
    padded = np.concatenate([flat, np.zeros(SHINGLE, np.uint64)])
    for j in range(SHINGLE):
        total += np.where(left > j, common.mix64(padded[j : j + len(flat)] + FACTORS[j]), np.uint64(j + 1)) * FACTORS[j]
    at = (left >= SHINGLE) | (left == sizes[doc])  # a short text's only shingle starts at its first word
    value, doc = common.mix64(total[at]), doc[at]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(words)))])


def sketches(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fast similarity sketches, one row of BINS values for each set; an empty set's row is all ones."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.full(n * BINS, FULL)
    live = np.repeat(np.arange(n), sizes)
    for turn in range(2 * BINS):
        if not len(values):
            break
        h = common.mix64(values ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        if turn < BINS:
            bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(h), turn - BINS)
        np.minimum.at(out, live * BINS + bins, (h & np.uint64((1 << 56) - 1)) | np.uint64(turn << 56))
        open_ = (out.reshape(n, BINS) == FULL).any(1)
        if turn < 3 or turn % 8 == 0:
            stay = open_[live]
            values, live = values[stay], live[stay]
    return out.reshape(n, BINS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    bands = sketch.reshape(len(sketch), BINS // ROWS, ROWS)
    keys = np.zeros(bands.shape[:2], np.uint64)
    for j in range(ROWS):
        keys = common.mix64(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
    return common.mix64(keys + np.arange(1, keys.shape[1] + 1, dtype=np.uint64))


def parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, whether an odd number of its elements has each of WIDTH hash values, as int64 words."""
    n = len(offsets) - 1
    out = np.zeros((n, len(PARITIES)), np.int64)
    place = (common.mix64(values + np.uint64(0x5851F42D4C957F2D)) % np.uint64(WIDTH)).astype(np.int64)
    own = np.repeat(np.arange(n), np.diff(offsets))
    for a in range(0, n, 4096):
        b = min(a + 4096, n)
        some = slice(int(offsets[a]), int(offsets[b]))
        odd = np.bincount((own[some] - a) * WIDTH + place[some], minlength=(b - a) * WIDTH).reshape(b - a, WIDTH) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
    return out


def _texts(array: pa.Array, a: int, b: int) -> list[bytes]:
    return [t or b"" for t in array.slice(a, b - a).cast(pa.binary()).to_pylist()]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        text, row, ids = (common.column(batch, c) for c in ("text", "row", "doc_id"))
        for a, b in common.row_chunks(common.utf8(text)[1], CHUNK):
            values, offsets = shingle_hashes(_texts(text, a, b), memo)
            sids = [xxhash.xxh3_128_digest(values[x:y].tobytes()) if y > x else None for x, y in zip(offsets, offsets[1:])]
            keys = band_keys(sketches(values, offsets)).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([row.slice(a, b - a), ids.slice(a, b - a), pa.array(sids, pa.binary()), pa.array(np.diff(offsets)), bands], ["row", "doc_id", "sid", "n_shingles", "bands"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        text, nid = common.column(batch, "text"), common.column(batch, "nid")
        for a, b in common.row_chunks(common.utf8(text)[1], CHUNK):
            values, offsets = shingle_hashes(_texts(text, a, b), memo)
            sets = [values[x:y].tobytes() for x, y in zip(offsets, offsets[1:])]
            words = parities(values, offsets)
            yield pa.RecordBatch.from_arrays([nid.slice(a, b - a), pa.array(sets, pa.binary()), *(pa.array(words[:, i]) for i in range(len(PARITIES)))], ["nid", "elements", *PARITIES])


def _verifier(threshold: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (common.column(batch, c).to_pylist() for c in ("set_a", "set_b"))
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([common.column(batch, c) for c in ("a", "b")] + [pa.array(keep)], ["a", "b", "linked"])

    return verify


def near_duplicates(spark: SparkSession, docs: DataFrame, threshold: int = 85, key: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Documents whose sets have 100 * intersection >= threshold * union are linked; component_id
    is the smallest doc_id reachable by links. key: a column of docs that is a number of its own
    in every row, however often docs are read; without one the rows are numbered and written.
    """
    scratch = common.Scratch(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.col(key).alias("row"), "doc_id", "text") if key else scratch.save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "texts")
    rows = scratch.save(texts.mapInArrow(common.tidied(_sketch_rows), f"row long, doc_id {kind}, sid binary, n_shingles long, bands array<long>"), "rows")
    nodes = scratch.save(
        rows.filter("sid is not null")
        .groupBy("sid")
        .agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.min("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("nid"), "*"),
        "nodes",
    )
    # buckets of two nodes or more, and how central a node is: the sum of its buckets' sizes
    entries = nodes.select("nid", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = scratch.save(entries.join(sizes, "bucket"), "shared")
    central = shared.groupBy("nid").agg(F.sum("size").alias("centrality"))
    members = scratch.save(shared.drop("size").join(central, "nid").join(nodes.select("nid", "n"), "nid"), "members")
    scratch.drop("shared")
    # full sets of the nodes that share a bucket
    wanted = nodes.select("nid", "row").join(members.select("nid").distinct(), "nid", "left_semi")
    sets = scratch.save(texts.join(wanted, "row").select("nid", "text").mapInArrow(common.tidied(_set_rows), "nid long, elements binary, " + ", ".join(f"{p} long" for p in PARITIES)), "sets")
    scratch.keep("rows", "nodes", "members", "sets")
    labels, tested = None, None
    for turn in range(STARS + 1):
        left = members.withColumn("comp", F.col("nid")) if labels is None else members.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        open_ = left.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("bucket")
        left = left.join(open_, "bucket", "left_semi")
        if turn:
            left = scratch.save(left, f"open-{turn}")
        me = F.struct("n", "nid", "comp")
        if turn == 0:  # every node against the most central node of each of its buckets
            centres = left.groupBy("bucket").agg(F.max(F.struct("centrality", "n", "nid", "comp")).alias("c"))
            others = left
        elif turn < STARS:  # of every component PICKS nodes against a node drawn from a bucket
            draw = F.xxhash64("nid", "bucket", F.lit(turn))
            centres = left.groupBy("bucket").agg(F.max(F.struct(draw.alias("draw"), "n", "nid", "comp")).alias("c"))
            pick = F.struct(F.xxhash64("bucket", "nid", F.lit(-turn)).alias("draw"), "bucket", "n", "nid")
            others = left.groupBy("comp", F.pmod(F.xxhash64("bucket", F.lit(turn)), F.lit(PICKS)).alias("k")).agg(F.min(pick).alias("p")).select("comp", "p.bucket", "p.n", "p.nid")
        else:  # what still shares a bucket without being of one component
            others = left.join(sets.select("nid", *PARITIES), "nid")
            centres = others.select("bucket", F.struct("n", "nid", "comp", *PARITIES).alias("c"))
        near = (F.col("c.comp") != F.col("comp")) & (F.col("c.n") * 100 >= F.col("n") * threshold) & (F.col("n") * 100 >= F.col("c.n") * threshold)
        if turn == STARS:
            both = F.col("n") + F.col("c.n")
            apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"c.{p}"))) for p in PARITIES), F.lit(0))
            near = near & (F.col("c.nid") < F.col("nid")) & ((both - apart) * (100 + threshold) >= both * (2 * threshold))
        pairs = others.join(centres, "bucket").filter(near)
        pairs = pairs.select(F.least("c.nid", "nid").alias("a"), F.greatest("c.nid", "nid").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        with_sets = pairs.join(sets.select(F.col("nid").alias("a"), F.col("elements").alias("set_a")), "a").join(sets.select(F.col("nid").alias("b"), F.col("elements").alias("set_b")), "b")
        seen = scratch.save(with_sets.mapInArrow(common.tidied(_verifier(threshold)), "a long, b long, linked boolean"), f"tested-{turn}")
        tested = seen if tested is None else tested.unionByName(seen)
        if not seen.filter("linked").isEmpty():
            labels = components(scratch, tested.filter("linked"), f"turn-{turn}")
    if labels is None:
        owner = nodes.select("sid", F.col("doc_id").alias("component_id"))
    else:
        placed = nodes.select("nid", "sid", "doc_id").join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        owner = placed.join(least, "comp").select("sid", "component_id")
    out = rows.select("doc_id", "sid", "n_shingles").join(owner, "sid", "left")
    out = out.withColumn("component_id", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    found = scratch.save(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "found")
    scratch.keep("found")
    return found
