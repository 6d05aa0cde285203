"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array of symbols. In each round every sequence
applies the lowest-ranked pair it still holds, all sequences and all places of the pair at
once; sequences without a mergeable pair leave, and their surviving symbols are counted.

Cases: a null text counts as empty (0 tokens). A special token's string inside a text is one
token, as in the library. Repeated rows are counted one by one; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The pre-token pattern of byte-level BPE vocabularies, as published with them.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
#: Pre-tokens remembered by a Python worker before it starts afresh.
MEMORY = 400_000
CHUNK = 1 << 20


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable Latin-1, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """Symbol ids of the bytes, and the ranked pairs as a sorted array."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = [t["content"] for t in model["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left in each non-empty pre-token."""
        n = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.ones(len(tokens), np.int64)
        symbol = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), n)
        while len(owner):
            rank = np.full(len(owner), NONE)  # of the pair that starts here
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(owner)))
            lowest = np.minimum.reduceat(rank, heads)
            done = lowest == NONE
            out[owner[heads[done]]] = sizes[done]
            hit = (rank == np.repeat(lowest, sizes)) & (rank < NONE)
            at = np.flatnonzero(hit)
            # of overlapping places (as in "aaa") every second one from the left
            run = np.concatenate([[True], np.diff(at) > 1])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stay = np.repeat(~done, sizes)
            stay[at + 1] = False
            symbol, owner = symbol[stay], owner[stay]
        return out


@functools.lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary_path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs (doc_id, text)."""
    common.importable(spark)
    path = vocabulary_path or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pattern = merges(path), regex.compile(PRE_TOKEN)
        special = regex.compile("|".join(map(regex.escape, sorted(model.special, key=len, reverse=True)))) if model.special else None
        known: dict[str, int] = {}
        for batch in batches:
            text = common.column(batch, "text")
            offsets = common.utf8(text)[1]
            total = np.zeros(batch.num_rows, np.int64)
            for a, b in common.row_chunks(offsets, CHUNK):
                found = []
                for i, t in enumerate(common.texts_of(text, a, b), a):
                    parts = special.split(t) if special else [t]
                    total[i] = len(parts) - 1
                    found.append(pattern.findall(parts[0]) if len(parts) == 1 else list(chain.from_iterable(map(pattern.findall, parts))))
                fresh = set().union(*found).difference(known)
                if len(known) + len(fresh) > MEMORY:
                    known = {}
                    fresh = set().union(*found)
                if fresh:
                    new = list(fresh)
                    known.update(zip(new, model.counts([t.encode() for t in new]).tolist()))
                for i, tokens in enumerate(found, a):
                    total[i] += sum(map(known.__getitem__, tokens))
            yield pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(np.diff(offsets)), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(common.tidied(count), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
