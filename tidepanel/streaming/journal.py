"""Write-once records in a chained journal: a replayed record adds nothing, a changed one is refused, a broken chain is found.

An append is a batch. Its new records are dealt into parts by a digest of their keys, about PART records each; in a part they are
chained in order of their keys, each link a digest of the one before and of the record. A part starts from the journal's last
head, and the batch's head is a digest of that head and of its parts' ends. Only batches whose head is written count, so an append that was cut off is
written again; heads are one row a batch.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import importable

PART = 10_000
#: The head of an empty journal.
EMPTY = hashlib.sha256(b"").hexdigest()
ENTRY = "batch long, part long, key string, payload string, digest string, link string"
HEAD = "batch long, parts long, n long, head string"


def digest(key: Column, payload: Column) -> Column:
    """Of the key, its length before it, and of the payload; null is no payload and differs from an empty one."""
    return F.sha2(F.concat(F.octet_length(key).cast("string"), F.lit(":"), key, F.coalesce(F.concat(F.lit("="), payload), F.lit(""))), 256)


def part_of(key: Column, parts: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % parts


def chained(start: str, digests: list[str]) -> list[str]:
    links = []
    for d in digests:
        start = hashlib.sha256((start + d).encode()).hexdigest()
        links.append(start)
    return links


def _linked(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("key")
    links = chained(rows.column("start")[0].as_py(), rows.column("digest").to_pylist())
    return rows.drop_columns(["start"]).append_column("link", pa.array(links, pa.string()))


def _with_start(entries: DataFrame, head: Column) -> DataFrame:
    return entries.withColumn("start", F.sha2(F.concat(head, F.lit(":"), F.col("part").cast("string")), 256))


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD).parquet(f"{path}/heads") if _exists(spark, f"{path}/heads") else spark.createDataFrame([], HEAD)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all batches that are whole."""
    if not _exists(spark, f"{path}/entries"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/entries").join(heads(spark, path).select("batch"), "batch", "left_semi").select(*(c.split()[0] for c in ENTRY.split(", ")))


def append(path: str, records: DataFrame) -> int:
    """Adds the records (key, payload, both strings) that the journal lacks, as one batch; returns how many these are.

    Rows that repeat count once. A null key, a key with two payloads, or a key whose payload is not the journal's, is an error and nothing is added.
    """
    spark = records.sparkSession
    importable(spark)
    key = F.coalesce("key", F.raise_error(F.lit("a record has no key")))
    own = records.select(key.alias("key"), "payload").withColumn("digest", digest(F.col("key"), F.col("payload")))
    own = own.groupBy("key").agg(F.first("payload").alias("payload"), F.min("digest").alias("digest"), F.max("digest").alias("other"))
    known = entries(spark, path).select("key", F.col("digest").alias("known"))
    joined = own.join(known, "key", "left")
    changed = (F.col("digest") != F.col("other")) | F.coalesce(F.col("known") != F.col("digest"), F.lit(False))
    refused = F.raise_error(F.concat(F.lit("another payload for record "), F.col("key"))).cast("boolean")
    new = joined.filter(F.when(changed, refused).otherwise(F.col("known").isNull())).select("key", "payload", "digest")
    last = heads(spark, path).agg(F.max(F.struct("batch", "head")).alias("h")).first()["h"]
    batch, head = (last["batch"] + 1, last["head"]) if last else (0, EMPTY)
    staged = f"{path}/entries/batch={batch}"
    new.write.mode("overwrite").parquet(f"{path}/staged")  # what is refused is refused before anything is linked
    new = spark.read.schema("key string, payload string, digest string").parquet(f"{path}/staged")
    n = new.count()
    if n:
        parts = -(-n // PART)
        dealt = _with_start(new.withColumn("part", part_of(F.col("key"), parts)), F.lit(head))
        linked = dealt.groupBy("part").applyInArrow(_linked, "key string, payload string, digest string, part long, link string")
        linked.select("part", "key", "payload", "digest", "link").write.mode("overwrite").parquet(staged)
        written = spark.read.schema("part long, key string, link string").parquet(staged)
        ends = _ends(written.withColumn("batch", F.lit(batch).cast("long")))
        ends.select("batch", F.lit(parts).cast("long").alias("parts"), "n", _head(F.lit(head)).alias("head")).coalesce(1).write.mode("append").parquet(f"{path}/heads")
    return n


def _ends(linked: DataFrame) -> DataFrame:
    """batch, n and the parts' last links of linked entries."""
    ends = linked.groupBy("batch", "part").agg(F.count("*").alias("n"), F.max_by("link", "key").alias("end"))
    return ends.groupBy("batch").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("part", "end"))).alias("ends"))  # a part for each PART entries


def _head(before: Column) -> Column:
    return F.sha2(F.concat(before, F.array_join(F.col("ends.end"), "")), 256)


def broken(spark: SparkSession, path: str) -> DataFrame:
    """batch, part, key and what of everything that does not follow from what is before it: digests, links, and heads (of a batch; part and key are null)."""
    importable(spark)
    order = [(r["batch"], r["parts"], r["n"], r["head"]) for r in heads(spark, path).orderBy("batch").collect()]  # a row for each batch
    before = spark.createDataFrame([(b, p, n, h, order[k - 1][3] if k else EMPTY) for k, (b, p, n, h) in enumerate(order)], f"{HEAD}, before string")
    kept = entries(spark, path)
    known = kept.join(before.select("batch", "before", "parts"), "batch").withColumn("own", digest(F.col("key"), F.col("payload")))
    again = _with_start(known.select("batch", "part", "key", F.col("own").alias("digest"), "before"), F.col("before")).drop("before")
    links = again.groupBy("batch", "part").applyInArrow(_linked, "batch long, part long, key string, digest string, link string").withColumnRenamed("link", "right")
    placed = known.join(links.select("batch", "part", "key", "right"), ["batch", "part", "key"])
    what = F.when(F.col("digest") != F.col("own"), "digest").when(F.col("link") != F.col("right"), "link").when(F.col("part") != part_of(F.col("key"), F.col("parts")), "part")
    lines = placed.withColumn("what", what).filter("what is not null").select("batch", "part", "key", "what")
    tops = before.join(_ends(kept).withColumnRenamed("n", "found"), "batch", "left").withColumn("right", _head(F.col("before")))
    wrong = tops.filter(~F.col("head").eqNullSafe(F.col("right")) | ~F.col("n").eqNullSafe(F.col("found")))
    return lines.unionByName(wrong.select("batch", F.lit(None).cast("long").alias("part"), F.lit(None).cast("string").alias("key"), F.lit("head").alias("what")))


def kept_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends a stream's records (key, payload) until it has drained; a batch that runs again adds nothing."""
    stream.writeStream.foreachBatch(lambda batch, number: (append(path, batch), None)[1]).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
