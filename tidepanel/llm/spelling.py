"""Spelling variants grouped by forms: near words found in forward and backward minimal acyclic automata.

A word is cut in two halves. One error leaves one of them whole: the first half is matched exactly
in an automaton of the words, the second in one of the reversed words, and the other half is
completed with one error. Every automaton numbers its words in order (each transition knows how
many words come before it), so a match is a place in the list of counts. What both directions
find is counted by the forward one.

The words are ranked in order and cut into shards of SHARD words, each with its own automaton, once
forwards and once reversed. A word asks the shards whose range its exact half reaches into, mostly
its own alone. A shard answers each word with one row (how many are near, and the best of them), so
pairs are never written out.

Cases: null and empty texts have no words; a null doc_id counts as an empty string. Repeated rows
count as often as they stand there. Ties in a form's count go to the first in code-point order.
Words are of any length: searches leave states whose words are too short or too long. Other columns
are ignored.
"""

from __future__ import annotations

import string
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .manifest import crc_sql, CRC_TABLE_SQL
from .ordering import ranked

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LEAST, OFTEN, TIMES = 7, 2, 10
#: Words of one automaton.
SHARD = 1 << 15
#: The letters of a word, as a class of regular expressions.
LETTERS = "[A-Za-zÀ-ÿ]"
#: One in so many runs is counted with a code point missing.
SLIPS = 31


class Automaton:
    """A minimal acyclic automaton over sorted distinct words, with their numbers in order.

    edges[state] maps a code point to its target and the number of words that come before in state;
    reach[state] holds the fewest and most code points that are left to an end.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.reach: list[tuple[int, int]] = []
        self.size: list[int] = []
        known: dict = {}
        open_: list[list] = [[False, []]]  # of each state on the last word's way: whether it ends a word, its finished edges
        last = ""
        for word in words:
            shared = 0
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
            self._close(open_, last, shared, known)
            open_ += [[False, []] for _ in word[shared:]]
            open_[-1][0], last = True, word
        self._close(open_, last, 0, known)
        self.root = self._state(open_[0], known)

    def _close(self, open_: list[list], last: str, down_to: int, known: dict) -> None:
        while len(open_) - 1 > down_to:
            state = self._state(open_.pop(), known)
            open_[-1][1].append((last[len(open_) - 1], state))

    def _state(self, node: list, known: dict) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(self.edges)
            edges, count = {}, int(node[0])
            low, high = (0, 0) if node[0] else (1 << 60, 0)
            for letter, state in node[1]:
                edges[letter] = (state, count)
                count += self.size[state]
                low, high = min(low, self.reach[state][0] + 1), max(high, self.reach[state][1] + 1)
            self.edges.append(edges)
            self.final.append(node[0])
            self.size.append(count)
            self.reach.append((low, high))
        return known[key]

    def walk(self, state: int, number: int, word: str, start: int, end: int) -> tuple[int, int] | None:
        """State and number after word[start:end]."""
        for k in range(start, end):
            edge = self.edges[state].get(word[k])
            if edge is None:
                return None
            state, number = edge[0], number + edge[1]
        return state, number

    def ends(self, state: int, number: int, word: str, start: int) -> int | None:
        """The number of the word that goes on from state with word[start:]."""
        low, high = self.reach[state]
        if not low <= len(word) - start <= high:
            return None
        at = self.walk(state, number, word, start, len(word))
        return at[1] if at is not None and self.final[at[0]] else None

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin as word does for exact code points and differ from it by one error after them."""
        found: set[int | None] = set()
        at = self.walk(self.root, 0, word, 0, exact)
        for k in range(exact, len(word) + 1):
            if at is None:
                break
            state, number = at
            before = word[k - 1] if k > exact else None
            if k < len(word) and word[k] != before:  # of equal neighbours the first stands for all
                found.add(self.ends(state, number, word, k + 1))
            for letter, (to, skipped) in self.edges[state].items():
                if letter != before:
                    found.add(self.ends(to, number + skipped, word, k))
                if k < len(word) and letter != word[k]:
                    found.add(self.ends(to, number + skipped, word, k + 1))
            at = self.walk(state, number, word, k, k + 1) if k < len(word) else None
        found.discard(None)
        return found


def counted(docs: DataFrame) -> DataFrame:
    """word and n of all words of docs."""
    runs = F.explode(F.regexp_extract_all(F.col("text"), F.lit(LETTERS + "{%d,}" % LEAST), F.lit(0)))
    low = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    mark = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"))
    place = (F.col("mark") % F.length("run")).cast("int")
    word = F.when(F.col("mark") % SLIPS == 0, F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))).otherwise(F.col("run"))
    words = docs.select("doc_id", runs.alias("run")).withColumn("run", low).withColumn("mark", mark).select(word.alias("word"))
    return words.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)


def half(word: str) -> int:
    return len(word) // 2


def _routed(batches: Iterator[pa.RecordBatch], bounds: list[str], backward: bool) -> Iterator[pa.RecordBatch]:
    """Each word with the shards that it asks; home is the one whose automaton holds it."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for word, n in zip(common.column(batch, "word").to_pylist(), common.column(batch, "n").to_pylist()):
            exact = word[: len(word) - half(word) if backward else half(word)]
            home = bisect_right(bounds, word) - 1
            for shard in range(max(0, bisect_right(bounds, exact) - 1), bisect_right(bounds, exact + "\U0010ffff")):
                for column, value in zip(out, (shard, word, n, shard == home)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.bool_()))], names=["shard", "word", "n", "home"])


def _searcher(backward: bool):
    def search(rows: pa.Table) -> pa.Table:
        own = rows.filter(rows.column("home")).sort_by("word")
        words, counts = own.column("word").to_pylist(), own.column("n").to_pylist()
        automaton = Automaton(words)
        out = []
        for word, n in zip(rows.column("word").to_pylist(), rows.column("n").to_pylist()):
            if backward:
                first = word[len(word) - half(word) :]  # reversed: the word's first half
                near = [k for k in automaton.one_error(word, len(word) - half(word)) if words[k][len(words[k]) - half(word) :] != first]
            else:
                near = list(automaton.one_error(word, half(word)))
            spelt = (lambda w: w[::-1]) if backward else (lambda w: w)
            best = min(((-counts[k], spelt(words[k])) for k in near), default=(None, None))
            out.append((spelt(word), n, len(near), best[0], best[1]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n", "near", "less", "best"])

    return search


def near_words(scratch: common.Scratch, words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, n_near and best (less, word) of the near word of the largest count: less is the negative count."""
    sides = []
    for backward in (False, True):
        name = "backward" if backward else "forward"
        spelt = words.select(F.lit("").alias("all"), (F.reverse("word") if backward else F.col("word")).alias("word"), "n")
        order = scratch.save(ranked(scratch, spelt, "all", ["word"], f"{name}-ordered"), name)
        bounds = [r["word"] for r in order.filter(F.col("rank") % shard == 0).orderBy("rank").select("word").collect()]  # one word a shard
        asked = order.select("word", "n").mapInArrow(lambda batches, b=bounds, w=backward: _routed(batches, b, w), "shard long, word string, n long, home boolean")
        sides.append(asked.groupBy("shard").applyInArrow(_searcher(backward), "word string, n long, near long, less long, best string"))
    best = F.min(F.when(F.col("less").isNotNull(), F.struct("less", "best")))
    return sides[0].unionByName(sides[1]).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))


def roots(scratch: common.Scratch, forms: DataFrame) -> DataFrame:
    """word and root of forms (word, form): forms are followed to the last, twice as far in each round."""
    found, turn = scratch.save(forms.select("word", F.coalesce("form", "word").alias("root")), "roots-0"), 0
    while True:
        turn += 1
        further = found.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = scratch.save(found.join(further, "root").select("word", F.col("root").alias("was"), F.col("far").alias("root")), f"roots-{turn}")
        scratch.drop(f"roots-{turn - 1}")
        found = after.select("word", "root")
        if after.filter("was <> root").isEmpty():
            return found


def spelling_forms(spark: SparkSession, docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs."""
    scratch = common.Scratch(spark)
    words = scratch.save(counted(docs), "words")
    near = near_words(scratch, words, shard)
    takes = -F.col("best.less") >= TIMES * F.col("n")
    forms = near.select("word", F.when(takes, F.col("best.best")).alias("form"), "n", "n_near", F.when(takes, -F.col("best.less")).alias("form_n"))
    forms = scratch.save(forms, "forms")
    scratch.keep("forms")
    return forms.join(roots(scratch, forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


OCTETS_SQL = "flatten(list_transform(str_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)]::BIGINT[] END))"
SQL = f"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE_SQL} AS t),
  runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}{{{LEAST},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
  alike AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
  marked AS (SELECT run, n, {crc_sql(OCTETS_SQL, "crc.t")} AS mark FROM alike, crc),
  typed AS (SELECT CASE WHEN mark % {SLIPS} = 0 THEN substr(run, 1, mark % length(run)) || substr(run, mark % length(run) + 2) ELSE run END AS word, n FROM marked),
  words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OFTEN}),
  places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
  cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
  pairs AS (
    SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word),
  forms AS (
    SELECT w.word, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
  ways AS (
    SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms
    UNION ALL SELECT y.word, coalesce(f.form, f.word), f.form IS NULL FROM ways y JOIN forms f ON f.word = y.root WHERE NOT y.done)
SELECT f.word, form, root, f.n, n_near, form_n FROM forms f JOIN (SELECT word, root FROM ways WHERE done) y ON y.word = f.word
"""
