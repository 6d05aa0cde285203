"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Rows are written once with a digest of their normalised text, in blocks of the task that wrote
them (at most BLOCK rows), bucketed by block, so that later joins by block move no text. Every
block sends its distinct fingerprints, sorted and cut at the owners' ranges, as Golomb codes of
their gaps. An owner marks the fingerprints that more than one block sent and answers every
message with a bitmap; a block adds what repeats within itself. A fingerprint has SPARE bits
more than are needed to number the rows, so one row in 2 ** SPARE is suspected wrongly. Only
suspects' texts are shuffled then, and grouped as bytes.

A text that a third of all rows share is sent once by each block, grouped within tasks before
its shuffle, and its rows find their group by a broadcast of the groups of more than N / HOT
rows, of which there are fewer than HOT.

Cases: null texts are empty and equal to empty ones. Of equal texts the row of the largest
doc_id stays, of equal doc_ids one row; a null doc_id is the smallest. Every row has one row in
the result, repeated rows too. Without rows there is no result. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import string
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Binary logarithm of the rows of a block, at most.
BLOCK = 20
#: Bits of a fingerprint beyond the logarithm of the rows.
SPARE = 8
#: Rows for which one owner stands, at most and at least (fewer rows have one owner).
OWNED, FEW = 1 << 22, 1 << 16
#: A group of more than N / HOT rows is broadcast: there are fewer than HOT of them.
HOT = 1000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def golomb(gaps: np.ndarray, k: int) -> bytes:
    """Golomb codes of non-negative numbers by the divisor 2 ** k: all quotients in unary, then all remainders."""
    gaps = gaps.astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, np.uint8)
    unary[ends - 1] = 0
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8)).tobytes()


def golomb_read(code: bytes, n: int, k: int) -> np.ndarray:
    """The n numbers that golomb coded."""
    rest = -(-n * k // 8)
    raw = np.frombuffer(code, np.uint8)
    unary = np.unpackbits(raw[: len(raw) - rest])
    quotients = np.diff(np.flatnonzero(unary == 0)[:n], prepend=-1) - 1
    bits = np.unpackbits(raw[len(raw) - rest :])[: n * k].reshape(n, k).astype(np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(k)) | (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def coded(values: np.ndarray) -> tuple[int, bytes]:
    """k and the code of sorted distinct numbers; k is near the best for their mean gap."""
    gaps = np.diff(values, prepend=np.uint64(0))
    gaps[1:] -= np.uint64(1)
    k = max(0, int(math.log2(max(1.0, 0.69 * float(values[-1]) / len(values)))))
    return k, golomb(gaps, k)


def decoded(code: bytes, n: int, k: int) -> np.ndarray:
    gaps = golomb_read(code, n, k)
    gaps[1:] += np.uint64(1)
    return np.cumsum(gaps, dtype=np.uint64)


def _distinct(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    prints = block.column("print").to_numpy().astype(np.uint64)
    return np.unique(prints, return_inverse=True, return_counts=True)


def _sender(bits: int, owners: int):
    """Of one block, its messages to the owners of its fingerprints."""

    def send(block: pa.Table) -> pa.Table:
        values = _distinct(block)[0]
        cuts = np.searchsorted(values, [_base(o, bits, owners) for o in range(owners + 1)])
        out = []
        for o in np.flatnonzero(np.diff(cuts)):
            own = values[cuts[o] : cuts[o + 1]] - np.uint64(_base(int(o), bits, owners))
            k, code = coded(own)
            out.append((block.column("block")[0].as_py(), int(o), len(own), k, code))
        return pa.Table.from_pylist([dict(zip(MESSAGE.names, m)) for m in out], MESSAGE)

    return send


def _base(owner: int, bits: int, owners: int) -> int:
    """The smallest fingerprint of an owner's range."""
    return -(-(owner << bits) // owners)


MESSAGE = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("k", pa.int32()), ("code", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("owner", pa.int64()), ("n", pa.int32()), ("marks", pa.binary())])
WORDS = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.int64()))])


def _answer(messages: pa.Table) -> pa.Table:
    """Of one owner, a bitmap for each message: which of its fingerprints another message has too."""
    sent = messages.to_pylist()
    values = np.concatenate([decoded(m["code"], m["n"], m["k"]) for m in sent])
    order = np.argsort(values, kind="stable")
    alike = np.zeros(len(values) + 1, bool)
    alike[1:-1] = values[order[1:]] == values[order[:-1]]
    marks = np.empty(len(values), bool)
    marks[order] = alike[1:] | alike[:-1]
    ends = np.cumsum([m["n"] for m in sent])
    bitmaps = [np.packbits(part).tobytes() for part in np.split(marks, ends[:-1])]
    return messages.select(["block", "owner", "n"]).append_column("marks", pa.array(bitmaps, pa.binary()))


def _receive(block: pa.Table, answers: pa.Table) -> pa.Table:
    """Of one block, a bitmap over its rows: whose fingerprint occurs again, here or elsewhere."""
    values, inverse, counts = _distinct(block)
    got = sorted(answers.to_pylist(), key=lambda a: a["owner"])  # owners' ranges ascend as the fingerprints do
    elsewhere = np.concatenate([np.unpackbits(np.frombuffer(a["marks"], np.uint8))[: a["n"]] for a in got])
    hit = ((counts > 1) | elsewhere.astype(bool))[inverse.ravel()]
    place = block.column("place").to_numpy()
    bits = np.zeros((int(place.max()) // 64 + 1) * 64, np.uint8)
    bits[place[hit]] = 1
    words = np.packbits(bits, bitorder="little").view("<i8")
    return pa.table({"block": block.column("block")[:1], "words": pa.array([words.tolist()], WORDS.field("words").type)}, WORDS)


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs."""
    scratch = common.Scratch(spark)
    number, name = F.monotonically_increasing_id(), f"exact_dedup_{uuid.uuid4().hex}"
    rows = docs.select(number.alias("id"), F.shiftright(number, BLOCK).alias("block"), F.col("doc_id"), normalised(F.col("text")).alias("body"))
    rows = rows.withColumn("text_sha256", F.sha2("body", 256))
    buckets = min(max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism), 50_000)
    rows.write.bucketBy(buckets, "block").option("path", f"{scratch.root}/rows").saveAsTable(name)
    written = spark.table(name)
    n = written.count()
    if not n:
        return written.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    bits = max(1, (n - 1).bit_length()) + SPARE
    owners = max(-(-n // OWNED), min(-(-n // FEW), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = F.col("id").bitwiseAND(F.lit((1 << BLOCK) - 1))
    first = F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long")  # 60 bits
    prints = written.select("block", place.alias("place"), F.shiftright(first, 60 - bits).alias("print"))
    messages = prints.groupBy("block").applyInArrow(_sender(bits, owners), "block long, owner long, n int, k int, code binary")
    answers = messages.groupBy("owner").applyInArrow(_answer, "block long, owner long, n int, marks binary")
    words = prints.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_receive, "block long, words array<long>")
    words = scratch.save(words, "words")
    bit = F.getbit(F.get("words", F.shiftright(place, 6).cast("int")), F.col("id").bitwiseAND(F.lit(63)).cast("int")) == 1
    known = written.join(words.hint("shuffle_hash"), "block").withColumn("suspect", bit).drop("words")
    # bytes decide: texts are compared whole, equal ones meet in their tasks before the shuffle
    alike = known.filter("suspect").groupBy("text_sha256", "body").agg(F.max("doc_id").alias("keep_id"), F.max_by("id", "doc_id").alias("last"), F.min("id").alias("first"), F.count("*").alias("group_size"))
    groups = alike.groupBy("text_sha256").agg(*(F.max(c).alias(c) for c in ("keep_id", "last", "first", "group_size")), F.count("*").alias("texts"))
    one = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts have one SHA-256 digest"))).otherwise(F.col("group_size"))
    groups = scratch.save(groups.select("text_sha256", "keep_id", F.coalesce("last", "first").alias("keeper"), one.alias("group_size")).filter("group_size > 1"), "groups")
    marks = scratch.save(known.select("id", "doc_id", "text_sha256", "suspect"), "marks")
    spark.sql(f"DROP TABLE {name}")
    scratch.drop("rows", "words")
    hot = F.broadcast(groups.filter(F.col("group_size") > n / HOT))
    cold = groups.filter(F.col("group_size") <= n / HOT)
    suspects = marks.filter("suspect").drop("suspect")
    shown = lambda keep, size, kept: ("doc_id", keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256")
    alone = (F.col("doc_id"), F.lit(1).cast("long"), F.lit(True))
    grouped = (F.col("keep_id"), F.col("group_size"), F.col("id") == F.col("keeper"))
    found = [F.when(F.col("keeper").isNull(), a).otherwise(g) for a, g in zip(alone, grouped)]
    parts = [
        marks.filter("NOT suspect").select(*shown(*alone)),
        suspects.join(hot, "text_sha256").select(*shown(*grouped)),
        suspects.join(hot, "text_sha256", "left_anti").join(cold, "text_sha256", "left").select(*shown(*found)),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SQL = """
WITH plain AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
  grouped AS (SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) AS place FROM plain)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM grouped
"""
