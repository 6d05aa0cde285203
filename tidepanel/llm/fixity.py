"""WARC records of web pages and a Merkle fixity audit of their replicas.

Records are laid out in files: a page's file comes from a digest of the page, its offset from the
lengths of the records before it. A replica's records are hashed into leaves; the leaves whose
offsets lie in one range of RANGE bytes make a node, FANOUT neighbouring ranges a node above,
and so on up to one root for each file. The audit compares the roots of two replicas, follows
the children of unequal nodes only, level by level, and so ends at the damaged records.

Records are hashed where they are read; only their lengths and digests are laid out, shuffled
and written, a few dozen bytes a record whatever the pages' sizes.

Rows that are alike in all three columns are one leaf with their number, ``copies``; the leaf's
hash covers that number, so one lost copy shows.

Cases: null columns are written as empty; a record keeps no difference between null and empty.
Without pages there are no files. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Records of a file, about; bytes of offsets under a node of the lowest level; children of a node.
RECORDS, RANGE, FANOUT = 1000, 1 << 16, 16
#: The lines of a WARC record's head.
HEAD = ("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ", "\r\nWARC-Record-ID: <urn:page:", ">\r\nContent-Type: text/html\r\nContent-Length: ")
BLANK = "\r\n\r\n"


def records(pages: DataFrame) -> DataFrame:
    """page_id and record (text) of every row of pages."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record = F.concat(F.lit(HEAD[0]), url, F.lit(HEAD[1]), name, F.lit(HEAD[2]), F.octet_length(html).cast("string"), F.lit(BLANK), html, F.lit(BLANK))
    return pages.select("page_id", record.alias("record"))


def damaged(records: DataFrame, one_in: int = 100) -> DataFrame:
    """records with held: what a damaged replica holds of the record, by the record's digest: nothing, a changed byte, a cut end, in equal parts."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("damage"), "record")), 1, 8), 16, 10).cast("long")
    hit, kind = draw % one_in == 0, F.floor(draw / one_in) % 3
    lost = F.when(hit & (kind == 0), F.lit(None).cast("string"))
    held = lost.when(hit & (kind == 1), F.concat(F.lit("x"), F.expr("substring(record, 2)"))).when(hit & (kind == 2), F.expr("substring(record, 1, length(record) - 5)")).otherwise(F.col("record"))
    return records.withColumn("held", held)


def laid_out(records: DataFrame, replicas: dict[str, str], records_a_file: int = RECORDS) -> DataFrame:
    """file, offset, length (of one copy), copies, page_id, and for each replica the digest of what it holds of a record, null for nothing.

    replicas: the digests' names, and the columns of records with what the replicas hold.
    """
    digests = [F.sha2(F.col(held), 256).alias(name) for name, held in replicas.items()]
    plain = records.select("page_id", F.md5("record").alias("mark"), F.octet_length("record").cast("long").alias("length"), *digests)
    alike = plain.groupBy("mark").agg(F.min("page_id").alias("page_id"), F.min("length").alias("length"), F.count("*").alias("copies"), *(F.min(c).alias(c) for c in replicas))
    files = F.greatest(F.lit(1), F.ceil(F.lit(records.count()) / records_a_file))
    number = F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % files
    before = Window.partitionBy("file").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long")
    return alike.withColumn("file", number).withColumn("offset", offset).select("file", "offset", "length", "copies", "page_id", *replicas)


def leaves(laid: DataFrame, digest: str) -> DataFrame:
    """file, offset and hash of every record that a replica holds."""
    return laid.filter(F.col(digest).isNotNull()).select("file", "offset", F.sha2(F.concat_ws(":", "length", "copies", digest), 256).alias("hash"))


def _above(nodes: DataFrame, width: int) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("place", "hash")))  # FANOUT children, or the records of one range
    up = nodes.groupBy("side", "file", F.floor(F.col("place") / width).alias("up")).agg(ordered.alias("kids"))
    return up.select("side", "file", F.col("up").alias("place"), F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws("=", k.place, k.hash)), ","), 256).alias("hash"))


def trees(scratch: common.Scratch, replicas: dict[str, DataFrame], range_bytes: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (side, file, place, hash) from the records up to the roots of all replicas, of one height; written, so that an audit reads only what it needs.

    replicas: by side, rows (file, offset, hash).
    """
    sides = [df.select(F.lit(side).alias("side"), "file", F.col("offset").alias("place"), "hash") for side, df in replicas.items()]
    found = [scratch.save(reduce(DataFrame.unionByName, sides), "level-0")]
    span, width = found[0].agg(F.max("place")).first()[0] or 0, range_bytes
    while len(found) < 2 or span:
        found.append(scratch.save(_above(found[-1], width), f"level-{len(found)}"))
        span, width = span // width, fanout
    return found


def audit(spark: SparkSession, leaves_a: DataFrame, leaves_b: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """file, offset, hash_a and hash_b of the records in which two replicas (file, offset, hash) differ; a hash is null where a replica has no such record."""
    scratch = common.Scratch(spark)
    levels = trees(scratch, {"a": leaves_a, "b": leaves_b}, range_bytes, fanout)
    open_ = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        if open_ is not None:
            up = F.floor(F.col("place") / (range_bytes if k == 0 else fanout))
            nodes = nodes.withColumn("up", up).join(open_, ["file", "up"], "left_semi")
        both = nodes.groupBy("file", "place").agg(*(F.max(F.when(F.col("side") == s, F.col("hash"))).alias(f"hash_{s}") for s in "ab"))
        differ = both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if k == 0:
            return differ.select("file", F.col("place").alias("offset"), "hash_a", "hash_b")
        open_ = scratch.save(differ.select("file", F.col("place").alias("up")), f"open-{k}")
    raise AssertionError("a tree has at least two levels")


HEAD_SQL = [h.replace("\r\n", "' || chr(13) || chr(10) || '") for h in HEAD]
BLANK_SQL = "chr(13) || chr(10) || chr(13) || chr(10)"
SQL = f"""
WITH plain AS (
  SELECT page_id, '{HEAD_SQL[0]}' || coalesce(url, '') || '{HEAD_SQL[1]}' || coalesce(CAST(page_id AS VARCHAR), '') || '{HEAD_SQL[2]}'
    || CAST(strlen(coalesce(html, '')) AS VARCHAR) || {BLANK_SQL} || coalesce(html, '') || {BLANK_SQL} AS record FROM pages
), alike AS (
  SELECT md5(record) AS mark, min(page_id) AS page_id, min(record) AS record, count(*) AS copies FROM plain GROUP BY 1
), placed AS (
  SELECT *, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM pages) / {RECORDS}.0) AS BIGINT)) AS file, strlen(record) AS length FROM alike
), laid AS (
  SELECT *, CAST(coalesce(sum(length * copies) OVER (PARTITION BY file ORDER BY mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CAST('0x' || substr(md5('damage' || record), 1, 8) AS BIGINT) AS draw FROM placed
), harmed AS (
  SELECT *, (draw // 100) % 3 AS kind FROM laid WHERE draw % 100 = 0
)
SELECT file, "offset", page_id, CAST(length AS BIGINT) AS length, copies,
  sha256(CAST(length AS VARCHAR) || ':' || CAST(copies AS VARCHAR) || ':' || sha256(record)) AS hash_a,
  CASE WHEN kind > 0 THEN sha256(CAST(length AS VARCHAR) || ':' || CAST(copies AS VARCHAR) || ':' ||
    sha256(CASE WHEN kind = 1 THEN 'x' || substr(record, 2) ELSE substr(record, 1, length(record) - 5) END)) END AS hash_b
FROM harmed
"""
