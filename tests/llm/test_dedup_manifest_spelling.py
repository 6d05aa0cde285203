"""Exact duplicates, the manifest and spelling forms against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import exact_dedup, manifest, ordering, spelling
from tidepanel.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, rank string"  # the last two clash with names the operators use
RANDOM = random.Random(11)
WORDS = ["".join(RANDOM.choice("abcé") for _ in range(RANDOM.randint(5, 10))) for _ in range(60)]
TEXTS = [None, "", "  ", "Zürich MÜNCHEN", "zürich mÜnchen", "ZÜRICH MÜNCHEN", "a" * 3000, "A" * 3000, "a" * 2999 + " " + "a" * 2999]
TEXTS += [" ".join(RANDOM.choice(WORDS[: 3 + i]) for _ in range(40)) for i in range(50)] + ["same text"] * 30 + ["straßen×weise", "STRAßEN×weise"] * 4


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, [None, "en", "de", "é"][i % 4] if i > 20 else "en", None if i % 5 == 0 else "web", None if i % 6 == 0 else i, "x", "y") for i, t in enumerate(TEXTS)]
    out += [out[10], out[60], out[60]]  # repeated rows
    out += [(None, "same text", "en", None, 3, "x", "y"), (None, None, None, None, None, None, None), (-5, "nobody else", "fr", "s", 1, "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_golomb_codes_read_back():
    own = np.random.default_rng(3)
    for n, top in ((1, 1), (1, 1 << 40), (5, 9), (1000, 1 << 50), (300, 300)):
        values = np.unique(own.integers(0, top, n).astype(np.uint64))
        k, code = exact_dedup.coded(values)
        assert (exact_dedup.decoded(code, len(values), k) == values).all()
        assert len(code) * 8 <= len(values) * (k + 4) + 16


@pytest.mark.parametrize("owned", [1 << 16, 8])
def test_equal_texts_are_those_of_one_lower_cased_text(spark, docs, rows, empty, owned, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FEW", owned)
    monkeypatch.setattr(exact_dedup, "HOT", 1000 if owned > 8 else 4)
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is not None, i), reverse=True)
        for place, i in enumerate(order):
            want[i, order[0], len(ids), place == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    got = exact_dedup.exact_duplicates(spark, docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert exact_dedup.exact_duplicates(spark, empty).count() == 0


def test_bytes_decide_where_fingerprints_meet(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SPARE", -6)  # few fingerprints, so most rows are suspects
    got = exact_dedup.exact_duplicates(spark, docs)
    assert got.filter("kept").count() == len({lower(r[1]) for r in rows}) and got.count() == len(rows)


def h(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def one(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, more=0):
    i, text, lang, source, n = r[:5]
    return h("".join(map(one, (i, source, lang, n if n is None else n + more, text))))


def tree(nodes):
    """The root, and for each node the runs on its way: (nodes before it, itself's place, nodes after)."""
    ways, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for w, k in zip(ways, at):
            run = level[k // 2 * 2 : k // 2 * 2 + 2]
            w.append((run[: k % 2], run[k % 2 + 1 :]))
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], ways


@pytest.mark.parametrize("height", [10, 2, 1])
def test_proofs_lead_from_leaves_to_the_root(spark, docs, rows, empty, height):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    found, roots = [], []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, ways = tree([leaf(r) for r in own])
        roots.append(sub)
        found.append((sub, own, ways))
    root, tops = tree(roots)
    want = Counter()
    for (sub, own, ways), top in zip(found, tops):
        for r, way in zip(own, ways):
            start = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            node = start
            for before, after in way + top:
                node = h(*before, node, *after)
            proof = h(*(x for before, after in way + top for x in before + after))
            want[r[0], leaf(r), sub, root, proof, node, node == root] += 1
    tampered, changes = manifest.seventh(F.col("doc_id")), {"n_chars": F.col("n_chars") + 1}
    got = manifest.manifest(spark, docs, tampered, changes, height).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(map(tuple, got.collect())) == want
    assert manifest.manifest(spark, empty, tampered, changes).count() == 0


def test_a_manifest_of_one_row_is_its_leaf(spark, docs):
    row = manifest.manifest(spark, docs.filter("doc_id = -5")).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == h("")


def test_ranks_follow_the_order_of_each_group(spark):
    rows = [(str(k % 3), k // 6) for k in range(300)]
    got = ordering.ranked(Scratch(spark), spark.createDataFrame(rows, "g string, v long").repartition(7), "g", ["v"], "ranked").collect()
    for g in "012":
        own = sorted((r["rank"], r["v"], r["total"]) for r in got if r["g"] == g)
        assert [r[0] for r in own] == list(range(100)) and all(r[2] == 100 for r in own) and [r[1] for r in own] == sorted(r[1] for r in own)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def forms_of(counts):
    out = {}
    for w in counts:
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= 10 * counts[w] else None, len(close))
    return out


def spelt(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            x = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if x % 31 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    want = set()
    for w, (form, close) in (forms := forms_of(counts)).items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        want.add((w, form, root, counts[w], close, counts.get(form)))
    return want


@pytest.mark.parametrize("shard", [1 << 15, 7, 1])
def test_forms_are_those_of_all_pairs(spark, docs, rows, empty, shard):
    chains = [(900 + k, " ".join(["abcdefgh"] * 400 + ["abcdefg"] * 40 + ["abcdefgx"] * 30 + ["abcdeffg"] * 3 + ["bcdefgh"] * 4 + ["abcdegx"] * 3), "en", None, 1, "x", "y") for k in range(3)]
    more = docs.unionByName(spark.createDataFrame(chains, SCHEMA))
    got = {tuple(r) for r in spelling.spelling_forms(spark, more, shard).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = spelt(rows + chains)
    assert got == want and any(w[1] != w[2] and w[1] for w in want)
    assert spelling.spelling_forms(spark, empty).count() == 0


def test_automata_number_their_words_and_find_one_error():
    words = sorted({"".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)} - {"ab", "bab"}) + ["c" * 50]
    found = spelling.Automaton(words)
    assert [found.ends(found.root, 0, w, 0) for w in words] == list(range(len(words)))
    assert len(found.edges) < 80  # equal ends are shared
    for w in words:
        for exact in (0, len(w) // 2):
            assert found.one_error(w, exact) == {k for k, x in enumerate(words) if near(w, x) and x[:exact] == w[:exact]}
