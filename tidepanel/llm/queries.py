"""Queries and SQL of the thirteen operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, cover_tree, exact_dedup, fixity, manifest, spelling
from .class_lm import class_lm_scores
from .common import Scratch, table
from .decontamination import contaminated
from .language_id import language_id
from .near_dups import near_duplicates
from .repeats import remove_repeats
from .sampled_pieces import round_trip
from .token_counts import token_counts


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return back.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("lossless"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm_scores(spark, table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digest of what stays of each text, and what stays itself: half a character, where a cut goes through one, is U+FFFD there."""
    out = remove_repeats(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept_bytes").cast("string")).alias("kept_text"))


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_windows.with_odd_conversation(spark, table(spark, sf_dir, "conversations"))
    return chat_windows.digests(chat_windows.windows(turns))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.exact_topk(spark, table(spark, sf_dir, "embeddings"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records against a replica with planted damage: every damaged record, found from the roots."""
    pages = fixity.damaged(fixity.records(table(spark, sf_dir, "pages")))
    laid = Scratch(spark).save(fixity.laid_out(pages, {"whole": "record", "harmed": "held"}), "laid")
    found = fixity.audit(spark, fixity.leaves(laid, "whole"), fixity.leaves(laid, "harmed"))
    return found.join(laid.drop("whole", "harmed"), ["file", "offset"]).select("file", "offset", "page_id", "length", "copies", "hash_a", "hash_b")


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(spark, table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents whose id has a crc32 that 7 divides, the root is recomputed from a leaf with one more character."""
    return manifest.manifest(spark, table(spark, sf_dir, "documents"), manifest.seventh(F.col("doc_id")), {"n_chars": F.col("n_chars") + 1})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_warc_fixity, op3_language_id, op4_token_counts, op5_near_duplicates, op7_sampled_pieces, op6_exact_topk, op8_class_lm, op9_suffix_dedup, op10_chat_windows, op11_spelling_forms, op12_exact_dedup, op13_merkle_manifest)
}
SQL: dict[str, str] = {"op2_warc_fixity": fixity.SQL, "op6_exact_topk": cover_tree.SQL, "op10_chat_windows": chat_windows.SQL, "op11_spelling_forms": spelling.SQL, "op12_exact_dedup": exact_dedup.SQL, "op13_merkle_manifest": manifest.SQL}
