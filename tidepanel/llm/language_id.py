"""Language identification by segmentation-marginalised unigrams.

Every language gets a probability for each piece of a fixed public vocabulary. A word's
probability in a language is the sum over all of its segmentations into pieces (forward
algorithm), a text's is the product over its words, and the language of the highest
probability wins. The piece probabilities come from expectation maximisation on words of a
bounded sample of labelled documents.

Cases: a null text, or one without a letter, is ``und`` with score 0. A null or unlabelled
``lang`` is never learned from. Repeated rows are predicted one by one, ties between
languages go to the first in alphabetical order, and without any labelled row every
document is ``und``. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, lattice

LETTER = regex.compile(r"\p{L}")
#: Expected number of labelled documents sampled for each language.
TRAIN_DOCS = 1000
ROUNDS = 3
#: Added to each piece's expected count.
FLOOR = 0.01
#: Words, and code points of words, remembered by a Python worker before it starts afresh.
MEMORY, POINTS = 150_000, 1 << 22
CHUNK = 1 << 18


def words_of(text: str) -> list[str]:
    return text.lower().split()


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(common.column(batch, "lang").to_pylist(), common.column(batch, "text").to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


@dataclass
class Model:
    langs: list[str]  # in alphabetical order
    log_p: np.ndarray  # log piece probabilities, of shape (pieces, languages)
    typical: np.ndarray  # by language: log probability a code point of what was learned from


def train(docs: DataFrame, model_path: str, train_docs: int = TRAIN_DOCS) -> Model:
    """The piece probabilities of all languages.

    docs: labelled rows (text, lang, doc_id), neither text nor lang null. About ``train_docs``
    documents a language are learned from, drawn by a hash of their ids.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark)
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    vocabulary = lattice.pieces(model_path)
    if not langs:
        return Model([], np.zeros((vocabulary.size, 0)), np.zeros(0))
    scale = 1_000_000
    limit = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(min(1.0, train_docs / sizes[k]) * scale))) for k in langs))
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(scale)) < limit[F.col("lang")])
    words = scratch.save(
        drawn.select("lang", "text").mapInArrow(common.tidied(_count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words"
    )
    place = {k: i for i, k in enumerate(langs)}
    usable = vocabulary.usable
    log_p = np.full((vocabulary.size, len(langs)), -np.inf)
    log_p[usable] = -np.log(usable.sum())
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sums = lattice.pieces(model_path), {}
            for batch in batches:
                lang = np.array([place[k] for k in common.column(batch, "lang").to_pylist()], np.int64)
                word = np.array(common.column(batch, "word").to_pylist(), object)
                n = common.column(batch, "n").to_numpy()
                for k in np.unique(lang):
                    at = lang == k
                    net = lattice.build(own, [" " + w for w in word[at]])
                    scores = lattice.arc_scores(own, net, shared.value[:, k])
                    total = (n[at] * lattice.totals(net, lattice.forward(net, scores))).sum()
                    points = (n[at] * np.diff(np.append(net.first, len(net.cut)))).sum()
                    # behind the pieces stand the log probability and the code points of all words
                    sums[int(k)] = sums.get(int(k), 0) + np.append(lattice.expected_counts(own, net, scores, n[at]), [-total, points])
            for k, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(counts[at])], ["k", "piece", "n"])

        got = words.mapInArrow(common.tidied(expect), "k long, piece long, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()  # pieces x languages at most
        counts = np.zeros((vocabulary.size + 2, len(langs)))
        counts[got["piece"], got["k"]] = got["n"]
        typical = -counts[-2] / np.maximum(counts[-1], 1)
        counts = np.where(usable[:, None], counts[:-2] + FLOOR, 0.0)
        with np.errstate(divide="ignore"):
            log_p = np.log(counts / counts.sum(0))
        shared.unpersist()
    scratch.drop("words")
    return Model(langs, log_p, typical)


def predict(docs: DataFrame, model: Model, model_path: str, names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """docs (text and any other columns) with the predicted language, its share of the probability of all languages, and its fit.

    fit: the log probability a code point in that language, less what the language's training texts have; far below
    zero where no language is likely, null for ``und``. names: of the three columns; columns of these names are replaced.
    """
    spark = docs.sparkSession
    common.importable(spark)
    langs, typical = model.langs, model.typical
    shared = spark.sparkContext.broadcast(model.log_p)
    kept = [c for c in docs.columns if c not in names]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice.pieces(model_path)
        index: dict[str, int] = {}
        held = 0
        values = np.zeros((0, len(langs)))
        for batch in batches:
            text = common.column(batch, "text")
            offsets = common.utf8(text)[1]
            found: list[str] = []
            scores, fit = np.zeros(batch.num_rows), np.full(batch.num_rows, np.nan)
            for a, b in common.row_chunks(offsets, CHUNK):
                some = common.texts_of(text, a, b)
                words = [words_of(t) if langs and LETTER.search(t) else [] for t in some]
                fresh = set().union(*words).difference(index)
                if len(index) + len(fresh) > MEMORY or held > POINTS:
                    index, values, held = {}, values[:0], 0
                    fresh = set().union(*words)
                if fresh:
                    new = sorted(fresh)
                    held += sum(map(len, new))
                    index.update(zip(new, range(len(index), len(index) + len(new))))
                    net = lattice.build(own, [" " + w for w in new])
                    values = np.concatenate([values, lattice.totals(net, lattice.forward(net, lattice.arc_scores(own, net, shared.value)))])
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                ids = np.fromiter(map(index.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
                full = np.flatnonzero(sizes)
                best = [None] * len(words)
                if len(full):
                    ends = np.cumsum(sizes)
                    total = np.add.reduceat(values[ids], (ends - sizes)[full], axis=0)
                    top = total.argmax(1)
                    with np.errstate(under="ignore"):
                        scores[a + full] = 1.0 / np.exp(total - total.max(1)[:, None]).sum(1)
                    points = np.fromiter((sum(map(len, words[i])) + len(words[i]) for i in full), np.int64, len(full))
                    fit[a + full] = total.max(1) / points - typical[top]
                    for i, k in zip(full, top):
                        best[i] = langs[k]
                found += [k or "und" for k in best]
            arrays = [common.column(batch, c) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.string()), pa.array(scores), pa.array(fit, from_pandas=True)], [*kept, *names])

    plain = docs.select(*kept)
    schema = plain.withColumns(dict(zip(names, (F.lit("").cast("string"), F.lit(0.0), F.lit(0.0))))).schema
    for field in schema:
        field.nullable = True
    return plain.mapInArrow(common.tidied(label), schema)


def language_id(spark: SparkSession, docs: DataFrame, model_path: str | None = None, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Predict every document's language; learned from labelled documents that are not held out."""
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    model = train(labelled, model_path, train_docs)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model, model_path).drop("text")
