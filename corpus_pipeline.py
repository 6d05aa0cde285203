"""A training corpus from raw documents: five stages, each by one operator of tidepanel.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import common, decontamination, language_id, near_dups, repeats, sampled_pieces

#: A language must be at least so likely among all, and a code point's log probability in it at most so far below that of
#: its training texts, or the document goes.
LEAST_SCORE, LEAST_FIT = 0.5, -2.0
#: Words of the shortest repeated passage that is cut out, whatever its bytes.
PASSAGE = 51
#: A number of its own for every row, as ids can be null or repeat.
ROW = " row"


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with ROW, written, so that a row has the same number whenever it is read."""
    return common.Scratch(spark).save(docs.select(F.monotonically_increasing_id().alias(ROW), "*"), "numbered")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty ones too) and those of which no language is likely.

    Learns from the labels of docs; without any every document goes. Repeated rows have one outcome, extra columns stay.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~language_id.held_out())
    model = language_id.train(labelled.select("doc_id", "text", "lang"), path)
    found = language_id.predict(docs, model, path, (" lang", " score", " fit"))
    return found.filter((F.col(" lang") != "und") & (F.col(" score") >= LEAST_SCORE) & (F.col(" fit") >= LEAST_FIT)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates (five words, similarity 0.8), one row of it.

    A null id is the largest. Documents without words are nobody's duplicates. Extra columns stay.
    """
    rows = numbered(spark, docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))  # no two rows have the same, null ids come last
    found = near_dups.near_duplicates(spark, rows.select(ROW, order.alias("doc_id"), "text"), threshold=80, key=ROW)
    gone = found.filter(~F.col("kept")).select(F.col("doc_id.row").alias(" gone"))
    return rows.join(gone, F.col(ROW) == F.col(" gone"), "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words and strings of 400 bytes that occur twice out of the texts.

    Every document stays, empty where nothing is left of it; null texts stay null. Extra columns stay, n_chars is brought up to date.
    """
    return repeats.without_repeats(spark, docs, words=PASSAGE)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, and no others of their ids; an empty benchmark drops none. Extra columns stay."""
    rows = numbered(spark, docs)
    leaks = decontamination.contaminated(spark, rows.select(F.col(ROW).alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(" leak")).distinct()
    return rows.join(leaks, F.col(ROW) == F.col(" leak"), "left_anti").select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the sampled pieces, the text they decode to, and whether that is the document's text; null texts have no pieces."""
    back = sampled_pieces.round_trip(spark, docs.select("doc_id", "text"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return back.select("doc_id", "piece_ids", F.size("piece_ids").cast("long").alias("n_pieces"), F.col("decoded").alias("text"), same.alias("lossless"))


STAGES = [
    ("language id", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", decontaminate),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = common.Scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs


#: Sketches, suffix arrays and sampled lattices are not SQL; the tests hold run() against brute force.
ORACLE_SQL = None
