"""Brown class-based bigram language model: exchange clustering, class transitions, word emissions.

Words are counted over the whole training corpus. The HEAD most frequent ones are known to every
worker with their counts; the others' counts stay in a table and are joined. The CLUSTERED most
frequent words are put into CLASSES classes by the exchange algorithm, which moves one word at a
time to the class that raises the likelihood of the class bigrams most. The other head words then
move in rounds of the same exchange over the whole corpus: the tokens are written as numbers once, their
neighbours' classes are counted and summed in Spark, and every word takes the class of the greatest gain with the others
held in place. As words move at once and some into each other's way, a round is two such passes, the second puts right what the first did too much of. It is taken back unless it raises both the likelihood of the
class bigrams of all training texts and the score of every WITHHELD-th of them, whose bigrams the round has not seen; the next round
then moves only words of more occurrences. Words outside the head keep one of TAIL classes by their last two bytes, where the
head's words start; the end of a text is a class of its own. Then

    P(w | v) = P(class w | class v) * (count w + 0.1) / weight of class w

with transitions smoothed by the classes' overall shares, and one unknown word a tail class.

Bigrams of (clustered word or class) symbols are counted over the whole corpus too; their table
has at most (CLUSTERED + TAIL + 1) ** 2 rows whatever the corpus, the classes of the head HEAD.

Cases: null text counts as empty (one token, its end). Repeated rows count and are scored one by
one, a null doc_id is training text, and with nothing to learn from every token is unknown.
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HEAD, CLUSTERED, CLASSES, TAIL = 200_000, 1000, 48, 48
SWEEPS = 6
#: Rounds that are kept at most, passes of a round, and the least occurrences of the words that move: the first number, and the next one after each round taken back.
ROUNDS, PASSES, LEAST = 1, 2, (1, 16, 128)
#: One training text in so many judges a round.
WITHHELD = 8
#: Tokens, and counts of neighbours, that a worker holds.
HELD, SUMMED = 1 << 20, 1 << 21
ADD = 0.1
#: Weight of a class's overall share in its transitions, in bigrams.
SMOOTH = 20.0
CHUNK = 1 << 20
MEMORY = 400_000
#: The end of a text; no word holds white space.
END = b"\n"


def key_of(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >= 1 << 63 else h


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only; space and \t to \r only


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tail_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-2:]) % TAIL


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        words = list(counts)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)  # as key_of and tail_class, all at once
        tails = (np.fromiter(map(xxhash.xxh32_intdigest, [w[-2:] for w in words]), np.uint64, len(words)) % np.uint64(TAIL)).astype(np.int32)
        if END in counts:
            tails[words.index(END)] = -1
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(tails), pa.array(counts.values(), pa.int64())], ["word", "tail", "n"])

    for batch in batches:
        text = common.column(batch, "text")
        for a, b in common.row_chunks(common.utf8(text)[1], CHUNK):
            for t in text.slice(a, b - a).cast(pa.binary()).to_pylist():
                counts.update(words_of(t or b""))
            counts[END] += b - a
            if len(counts) > MEMORY:
                yield rows()
                counts.clear()
    yield rows()


class Symbols:
    """Maps words to what a worker knows of them: numbers from 0 for head words, then END, then the tail words met so far."""

    def __init__(self, head: np.ndarray):
        self.head = {int(k): i for i, k in enumerate(head)}
        self.size = len(head)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {END: self.size}
        self.keys: list[int] = []
        self.classes: list[int] = []

    def ids(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, ends included, and the offsets of the texts."""
        fresh = set().union(*docs).difference(self.known)
        if len(self.known) + len(fresh) > MEMORY:
            self.clear()
            fresh = set().union(*docs)
        for w in fresh:
            k = key_of(w)
            i = self.head.get(k)
            if i is None:
                i = self.size + 1 + len(self.keys)
                self.keys.append(k)
                self.classes.append(tail_class(w))
            self.known[w] = i
        for words in docs:
            words.append(END)
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        known = self.known
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
        return flat, np.concatenate([[0], np.cumsum(sizes)])


def _chunks(batches: Iterator[pa.RecordBatch], symbols: Symbols):
    for batch in batches:
        text = common.column(batch, "text")
        for a, b in common.row_chunks(common.utf8(text)[1], CHUNK):
            docs = [words_of(t or b"") for t in text.slice(a, b - a).cast(pa.binary()).to_pylist()]
            yield batch, a, b, *symbols.ids(docs)


def _numbers(shared):
    """judge, and the tokens of each text, ends included, as numbers: head words from 0, the end, then the TAIL classes of all other words."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = Symbols(shared.value)
        for batch, a, b, ids, offsets in _chunks(batches, symbols):
            of = np.concatenate([np.arange(symbols.size + 1), np.array(symbols.classes, np.int64) + symbols.size + 1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([common.column(batch, "judge").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(of[ids]))], ["judge", "ids"])

    return number


def _tokens(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of tokens side by side, of those before them, and whether their text is a judge; an end also stands before a text."""
    for batch in batches:
        lists = common.column(batch, "ids")
        ids = lists.flatten().to_numpy()
        judge = np.repeat(common.column(batch, "judge").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
        for a in range(0, len(ids), HELD):  # the token before a slice is known, and so no bigram is lost
            part = ids[a : a + HELD]
            yield part, np.concatenate([[ids[a - 1] if a else end], part[:-1]]), judge[a : a + HELD]


def _bigrams(shared, end: int, width: int):
    """Counts of neighbouring symbols, those of judges behind the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        table = np.zeros(2 * width * width, np.int64)
        for ids, before, judge in _tokens(batches, end):
            table += np.bincount((judge * width + of[before]) * width + of[ids], minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["pair", "n"])

    return count


def bigrams(numbers: DataFrame, of: np.ndarray, end: int, width: int) -> np.ndarray:
    """Counts of neighbouring symbols, the first before the second, of the other training texts and of the judges; of: the symbol of each number."""
    shared = numbers.sparkSession.sparkContext.broadcast(of)
    got = numbers.mapInArrow(common.tidied(_bigrams(shared, end, width)), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # 2 * width ** 2 rows at most
    pairs = np.zeros(2 * width * width)
    pairs[got["pair"]] = got["n"]
    return pairs.reshape(2, width, width)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, clustered: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of all symbols: exchange clustering of the first ``clustered`` ones, each other symbol its own class behind them.

    pairs: bigram counts of the symbols. A move is judged by the likelihood of the class bigrams,
    sum n(c, d) log n(c, d) - sum n(c) log n(c) - sum n(d) log n(d), ties to the lower class.
    """
    width = len(pairs)
    classes = min(classes, clustered)
    of = np.concatenate([np.arange(clustered) % max(classes, 1), classes + np.arange(width - clustered)])
    total = classes + width - clustered
    member = np.zeros((width, total))
    member[np.arange(width), of] = 1
    out = pairs @ member  # word -> class
    into = (member.T @ pairs).T  # class -> word, by word
    table = member.T @ out
    for _ in range(sweeps):
        moved = 0
        for w in range(clustered):
            was, own = of[w], pairs[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[was] -= own
            i[was] -= own
            table[was] -= o
            table[:, was] -= i
            table[was, was] -= own
            # the gain of joining each class c: its row and column grow by o and i, its diagonal by own too
            rows, columns = table[:classes], table[:, :classes].T
            new_r, new_c = rows + o, columns + i
            c = np.arange(classes)
            diagonal = table[c, c]
            gain = (xlogx(new_r) - xlogx(rows)).sum(1) + (xlogx(new_c) - xlogx(columns)).sum(1)
            gain -= xlogx(diagonal + o[c]) - xlogx(diagonal) + xlogx(diagonal + i[c]) - xlogx(diagonal)
            gain += xlogx(diagonal + o[c] + i[c] + own) - xlogx(diagonal)
            for side, amount in ((rows.sum(1) + i[c], o.sum() + own), (columns.sum(1) + o[c], i.sum() + own)):
                gain -= xlogx(side + amount) - xlogx(side)
            best = int(gain.argmax())
            if gain[best] <= gain[was] + 1e-9:
                best = was
            table[best] += o
            table[:, best] += i
            table[best, best] += own
            if best != was:
                moved += 1
                of[w] = best
                out[:, was] -= pairs[:, w]
                out[:, best] += pairs[:, w]
                into[:, was] -= pairs[w]
                into[:, best] += pairs[w]
        if not moved:
            break
    return of


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[heads], np.add.reduceat(n, heads)


def _neighbours(shared, fixed: int, last: int, end: int, total: int):
    """A row for each head word from ``fixed`` up to ``last``: counts of the classes beside it. A slot is the class behind a word, or ``total`` and the class before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        keys, counts, size = [], [], 0

        def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            word = (key // (2 * total)).astype(np.int32)  # in order
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            cuts = pa.array(np.append(heads, len(word)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((key % (2 * total)).astype(np.int32), n.astype(np.int64))]
            return pa.RecordBatch.from_arrays([pa.array(word[heads]), *lists], ["word", "slots", "counts"])

        for ids, before, _ in _tokens(batches, end):
            moving = [np.flatnonzero((x >= fixed) & (x < last)) for x in (before, ids)]
            behind = before[moving[0]].astype(np.int64) * (2 * total) + of[ids[moving[0]]]
            ahead = ids[moving[1]].astype(np.int64) * (2 * total) + total + of[before[moving[1]]]
            key, n = np.unique(np.concatenate([behind, ahead]), return_counts=True)
            keys.append(key)
            counts.append(n)
            size += len(key)
            if size > SUMMED:
                key, n = _summed(keys, counts)
                if len(key) > SUMMED // 2:
                    yield rows(key, n)
                    key, n = key[:0], n[:0]
                keys, counts, size = [key], [n], len(key)
        if size:
            yield rows(*_summed(keys, counts))

    return count


def best_classes(cuts: np.ndarray, slot: np.ndarray, n: np.ndarray, was: np.ndarray, table: np.ndarray, open_to: np.ndarray) -> np.ndarray:
    """The class (one of ``open_to``) of the greatest exchange gain for each word, given its neighbours' classes and the bigrams of all classes.

    cuts: where each word's slots begin, and the end of the last one's. The word is taken out of the row and column of its
    class first; ties go to its class, then to the lower one.
    """
    total = len(table)
    n = n.astype(float)
    own = np.repeat(np.arange(len(was)), np.diff(cuts))
    lines = np.concatenate([table.T, table])  # a line for each slot: its counts with every class
    without = lines[slot]
    without[np.arange(len(slot)), was[own]] -= n
    gain = np.add.reduceat(xlogx(without + n[:, None]) - xlogx(without), cuts[:-1], axis=0)
    behind = slot < total
    for side, amount in ((table.sum(1), np.bincount(own[behind], n[behind], len(was))), (table.sum(0), np.bincount(own[~behind], n[~behind], len(was)))):
        rest = np.repeat(side[None], len(was), 0)
        rest[np.arange(len(was)), was] -= amount
        gain -= xlogx(rest + amount[:, None]) - xlogx(rest)
    best = open_to[gain[:, open_to].argmax(1)]
    rows = np.arange(len(was))
    return np.where(gain[rows, best] > gain[rows, was] + 1e-9, best, was)


def _beside(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[tuple[np.ndarray, ...]]:
    """word, cuts, slot and n of about 100 words at a time, of rows that come in order of their words; a word's rows are summed."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def told(key: np.ndarray, n: np.ndarray):
        word = key // slots
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        return word[heads], np.append(heads, len(key)), key % slots, n

    for batch in batches:
        for a in range(0, batch.num_rows, 1000):
            part = batch.slice(a, 1000)
            lists = common.column(part, "slots")
            word = np.repeat(common.column(part, "word").to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()))
            held.append((word * slots + lists.flatten().to_numpy(), common.column(part, "counts").flatten().to_numpy()))
            key, n = _summed(*map(list, zip(*held)))
            words = key // slots
            starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            edges = [*starts[:-1:100].tolist(), int(starts[-1])]  # the last word may go on
            for x, y in zip(edges, edges[1:]):
                yield told(key[x:y], n[x:y])
            held = [(key[edges[-1] :], n[edges[-1] :])]
    if held:
        yield told(*held[0])


def _moves(shared, end_class: int):
    """Words that change their class, with the new one; the end's class takes no words."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head_class, table = shared.value
        open_to = np.delete(np.arange(len(table)), end_class)
        for word, cuts, slot, n in _beside(batches, 2 * len(table)):
            found = best_classes(cuts, slot, n, head_class[word], table, open_to)
            new = np.flatnonzero(found != head_class[word])
            yield pa.RecordBatch.from_arrays([pa.array(word[new], pa.int32()), pa.array(found[new], pa.int32())], ["word", "class"])

    return move


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of the class bigrams, without what words add whatever their classes: what exchange raises."""
    return float(xlogx(table).sum() - xlogx(table.sum(0)).sum() - xlogx(table.sum(1)).sum())


def judged(tables: np.ndarray, sizes: np.ndarray) -> float:
    """What the judges' score owes to the classes: their bigrams by transitions and weights of the other texts; sizes: words of each class."""
    seen, judges = tables
    weight = seen.sum(0) + ADD * (sizes + 1)
    transition = (seen + SMOOTH * weight / weight.sum()) / (seen.sum(1, keepdims=True) + SMOOTH)
    return float((judges * (np.log10(transition) - np.log10(weight))).sum())


def exchanged(numbers: DataFrame, head_class: np.ndarray, head_counts: np.ndarray, fixed: int, tail_classes: np.ndarray, end_class: int, rounds: int = ROUNDS, history: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all head words after rounds in which all but the first ``fixed`` ones may move, and the bigrams of the classes.

    history, if given, gets (likelihood, judges' score) of the start and of every round that is kept.
    """
    context, total, end = numbers.sparkSession.sparkContext, end_class + 1, len(head_class)
    of = np.concatenate([head_class, [end_class], tail_classes])
    tables = bigrams(numbers, of, end, total)
    score = lambda of, tables: (likelihood(tables.sum(0)), judged(tables, np.bincount(of[:end], minlength=total)))
    best, kept, level = score(of, tables), 0, 0
    history = history if history is not None else []
    history.append(best)
    others = numbers.filter("NOT judge")
    while kept < rounds and level < len(LEAST):
        last = int(np.searchsorted(-head_counts, -LEAST[level], side="right"))  # the head is in order of its counts
        if last <= fixed:
            break
        new, then = of, tables
        for _ in range(PASSES):
            shared, now = context.broadcast(new), context.broadcast((new[:end], then[0]))
            # tasks have summed theirs: a row for each task and word, of 2 * total slots at most
            counted = others.mapInArrow(common.tidied(_neighbours(shared, fixed, last, end, total)), "word int, slots array<int>, counts array<long>")
            words = counted.repartition("word").sortWithinPartitions("word")
            moved = words.mapInArrow(common.tidied(_moves(now, end_class)), "word int, class int").toPandas()  # a row for each head word at most
            new = new.copy()
            new[moved["word"]] = moved["class"]
            then = bigrams(numbers, new, end, total)
        found = score(new, then)
        if found[0] > best[0] and found[1] > best[1]:
            of, tables, best, kept = new, then, found, kept + 1
            history.append(best)
        else:
            level += 1
    return of[:end], tables.sum(0)


@dataclass
class Model:
    head: np.ndarray  # keys of the most frequent words
    head_class: np.ndarray
    head_counts: np.ndarray
    tail_classes: np.ndarray  # class of each tail class
    end_class: int
    end_count: int
    log_transition: np.ndarray  # log10
    log_weight: np.ndarray  # log10 of each class's emission weight
    train_tokens: int
    types: int


def head_words(counts: DataFrame, size: int) -> DataFrame:
    """At most about ``size`` of the most frequent words: whole classes of counts from the top, and a hashed share of the next.

    A histogram of the counts' logarithms gives the cut, so no task sends more than its words of the head.
    """
    level = F.floor(F.log2("n") * 8)
    share = 1 << 20
    total, cut, part = 0, 0, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):  # 8 * 64 rows at most
        if total + row["count"] > size:
            cut, part = row["level"] + 1, int((size - total) / row["count"] * share)
            break
        total, cut = total + row["count"], row["level"]
    return counts.filter((level >= cut) | ((level == cut - 1) & (F.pmod("word", F.lit(share)) < part)))


def fit(scratch: common.Scratch, texts: DataFrame, head_size: int = HEAD, clustered: int = CLUSTERED) -> tuple[Model, DataFrame]:
    """The model learned from texts (text), and the table (word, tail, n) of all their words' counts."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(common.tidied(_count), "word long, tail int, n long").groupBy("word").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))
    counts = scratch.save(counted, "counts")
    by_tail = {r["tail"]: r for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()}  # TAIL + 1 rows
    end = by_tail[-1]["n"] if -1 in by_tail else 0
    top = head_words(counts.filter("tail >= 0"), head_size).toPandas().sort_values(["n", "word"], ascending=[False, True])
    head, head_tail, head_counts = (top[c].to_numpy(np.int64) for c in ("word", "tail", "n"))
    clustered = min(clustered, len(head))
    width = clustered + TAIL + 1
    shared = spark.sparkContext.broadcast(head)
    judge = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(WITHHELD)) == 0  # copies of a text are on one side
    numbers = scratch.save(texts.select("text", judge.alias("judge")).mapInArrow(common.tidied(_numbers(shared)), "judge boolean, ids array<int>"), "numbers")
    symbol = np.concatenate([head_tail + clustered, [width - 1], np.arange(TAIL) + clustered])
    symbol[:clustered] = np.arange(clustered)
    pairs = bigrams(numbers, symbol, len(head), width).sum(0)
    of = exchange(pairs, clustered, CLASSES)
    total = int(of.max()) + 1
    tail_classes, end_class = of[clustered : clustered + TAIL], int(of[-1])
    head_class = tail_classes[head_tail]
    head_class[:clustered] = of[:clustered]
    head_class, table = exchanged(numbers, head_class, head_counts, clustered, tail_classes, end_class)
    scratch.drop("numbers")
    # emission weights: count + ADD of each word of the class, and ADD for one unknown word in a tail class
    weight = np.bincount(head_class, head_counts + ADD, total).astype(float)
    weight[end_class] += end + ADD
    own = np.bincount(head_tail, head_counts + ADD, TAIL).astype(float)
    for tail, row in by_tail.items():
        if tail >= 0:
            weight[tail_classes[tail]] += row["n"] + ADD * row["types"] - own[tail]
    weight[tail_classes] += ADD
    share = weight / weight.sum()
    transition = (table + SMOOTH * share) / (table.sum(1, keepdims=True) + SMOOTH)
    train_tokens, types = sum(r["n"] for r in by_tail.values()), sum(r["types"] for r in by_tail.values())
    with np.errstate(divide="ignore"):
        model = Model(head, head_class, head_counts, tail_classes, end_class, int(end), np.log10(transition), np.log10(weight), train_tokens, types)
    return model, counts


def _score(shared):
    """For each text: its tokens, the sum of log10(count + ADD) over head words and ends, the class part of its score, and its tail words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        symbols = Symbols(model.head)
        head_log = np.log10(np.append(model.head_counts, model.end_count) + ADD)
        for batch, a, b, ids, offsets in _chunks(batches, symbols):
            of = np.concatenate([model.head_class, [model.end_class], model.tail_classes[np.array(symbols.classes, np.int64)]])
            log = np.concatenate([head_log, np.zeros(len(symbols.keys))])
            kind = of[ids]
            before = np.empty_like(kind)
            before[1:] = kind[:-1]
            before[offsets[:-1]] = model.end_class  # what stands before a text
            part = model.log_transition[before, kind] - model.log_weight[kind]
            n = np.diff(offsets)
            own = np.repeat(np.arange(b - a), n)
            tail = np.flatnonzero(ids > symbols.size)
            pair, times = np.unique(own[tail] * np.int64(1 << 32) + (ids[tail] - symbols.size - 1), return_counts=True)
            keys = np.array(symbols.keys, np.int64)[pair & np.int64((1 << 32) - 1)] if len(pair) else np.zeros(0, np.int64)
            cuts = np.searchsorted(pair >> np.int64(32), np.arange(b - a + 1))
            unseen = np.bincount(own[ids == symbols.size], minlength=b - a) if not model.end_count else np.zeros(b - a, np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int64())) for x in (keys, times)]
            sums = [np.add.reduceat(x, offsets[:-1]) for x in (log[ids], part)]
            rows = [common.column(batch, c).slice(a, b - a) for c in ("row_id", "doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(n), pa.array(unseen.astype(np.int64)), *map(pa.array, sums), *lists], ["row_id", "doc_id", "held_out", "n_tokens", "unseen", "log_counts", "class_part", "tail_keys", "tail_times"])

    return score


def class_lm_scores(spark: SparkSession, docs: DataFrame, head_size: int = HEAD, clustered: int = CLUSTERED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of docs (doc_id, text)."""
    scratch = common.Scratch(spark)
    model, counts = fit(scratch, docs.filter(~held_out()).select("text"), head_size, clustered)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, unseen long, log_counts double, class_part double, tail_keys array<long>, tail_times array<long>"
    plain = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", held_out().alias("held_out"), "text")
    rows = scratch.save(plain.mapInArrow(common.tidied(_score(shared)), schema), "rows")
    tails = rows.select("row_id", F.explode(F.arrays_zip("tail_keys", "tail_times")).alias("t")).select("row_id", F.col("t.tail_keys").alias("word"), F.col("t.tail_times").alias("times"))
    c = F.coalesce("n", F.lit(0))
    tail_sums = (
        tails.join(counts.select("word", "n"), "word", "left")
        .groupBy("row_id")
        .agg(F.sum(F.col("times") * F.log10(c + F.lit(ADD))).alias("tail_log"), F.sum(F.when(c == 0, F.col("times")).otherwise(0)).alias("tail_unseen"))
    )
    joined = rows.drop("tail_keys", "tail_times").join(tail_sums, "row_id", "left").fillna(0, ["tail_log", "tail_unseen"])
    log_counts = F.col("log_counts") + F.col("tail_log")
    score = log_counts + F.col("class_part")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("unseen") - F.col("tail_unseen")).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * float(np.log10(model.train_tokens + ADD * (model.types + 1)))).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
