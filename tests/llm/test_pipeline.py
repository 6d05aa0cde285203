"""run() against brute force: languages, near duplicates of 0.8 and more, repeated strings, benchmark items."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from tidepanel.llm import repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"aa": "aklt", "bb": "wurzf"}
RANDOM = random.Random(11)
WORDS = {lang: ["".join(RANDOM.choice(some) for _ in range(RANDOM.randint(5, 9))) for _ in range(400)] for lang, some in LETTERS.items()}


def prose(n, lang="aa"):
    return " ".join(RANDOM.choice(WORDS[lang]) for _ in range(n))


def with_word(text, *places):
    words = text.split()
    for k in places:
        words[k] = RANDOM.choice(WORDS["aa"]) + "x"
    return " ".join(words)


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def near_kept(rows):
    """One row of each component: the one of the smallest id, null last."""
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if similar(rows[a][1], rows[b][1]) >= 0.8:
                group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for k, (i, _) in enumerate(rows):
        best[group[k]] = min(best.get(group[k], (True, 0, k)), (i is None, i or 0, k))
    return [rows[k] for _, _, k in sorted(best.values(), key=lambda b: b[2])]


def cut(texts):
    """Texts without what lies in a string of SPAN bytes or in a passage of 51 words that occurs twice."""
    span = repeats.SPAN
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    words = [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]
    passages = [[tuple(t[x:y] for x, y in w[i : i + 51]) for i in range(len(w) - 50)] for t, w in zip(texts, words)]
    often = Counter(p for found in passages for p in found)
    out = []
    for t, w, found in zip(texts, words, passages):
        gone = {c for i, p in enumerate(found) if often[p] > 1 for c in range(w[i][0], w[i + 50][1])}
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                gone.update(range(i, i + span))
        out.append("".join(c for i, c in enumerate(t) if i not in gone))
    return out


def wanted(rows, items):
    kept = near_kept([r for r in rows if any(c.isalpha() for c in r[1] or "")])
    texts = cut([t for _, t in kept])
    return Counter((i, t) for (i, _), t in zip(kept, texts) if not any(f" {item} " in f" {t} " for item in items))


@pytest.fixture
def outcome(spark, tmp_path):
    def run(rows, items=()):
        full = [(i, t, "bb" if set(t or "") & set("wurzf") else "aa", "s", len(t or "")) for i, t in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert all(r["lossless"] for r in got)
        return Counter((r["doc_id"], r["text"]) for r in got)

    return run


def test_run_is_brute_force(outcome):
    base, passage, item = prose(100), prose(80), prose(30)
    rows = [(1, base), (2, with_word(base, 30, 70)), (3, prose(30) + " " + passage + " " + prose(20)), (4, prose(20) + " " + passage + " " + prose(25))]
    rows += [(5, prose(40) + " " + item + " " + prose(9)), (6, None), (7, "12 !"), *((10 + k, prose(60, "ab"[k % 2] * 2)) for k in range(20))]
    short = " ".join(sorted(WORDS["aa"], key=len)[:55])  # over 50 words, under 400 bytes
    rows += [(30, prose(70) + " " + short + " " + prose(30)), (31, prose(80) + "\n" + short + "\t" + prose(60))]
    assert 0.8 <= similar(rows[0][1], rows[1][1]) < 0.85 and len(short) < 400
    got = outcome(rows, [item])
    assert got == wanted(rows, [item])
    assert 2 not in {i for i, _ in got} and 5 not in {i for i, _ in got}
    assert not any(short in t for _, t in got)


def test_run_keeps_one_row_of_a_text_and_drops_only_rows_that_leak(outcome):
    base, item, other, unnamed = prose(100), prose(30), prose(90), prose(80)
    rows = [(1, base), (1, base), (1, prose(50)), (None, base), (None, prose(60)), (None, other), (2, other), (None, unnamed), (None, unnamed)]
    rows += [(None, prose(20) + " " + item + " " + prose(20)), (3, prose(9) + " " + item + " " + prose(30)), (3, prose(55)), *((10 + k, prose(60, "ab"[k % 2] * 2)) for k in range(10))]
    got = outcome(rows, [item])
    assert got == wanted(rows, [item])
    assert {(1, base): 1, (2, other): 1, (None, unnamed): 1, rows[2]: 1, rows[4]: 1, rows[11]: 1}.items() <= got.items()


def test_every_stage_minds_odd_rows_and_clashing_columns(spark, tmp_path):
    item = prose(30)
    extra = {c: "clash" for c in ("gone", "leak", "score", "lang_pred", "fit", "spans", "word_spans", "n_removed", "kept_bytes", "component_id", "item_id", "decoded", "lossless", "piece_ids", "row", "k1")}
    spark.createDataFrame([("a", item), ("b", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = prose(4000)
    full = [(i, t, "aa", "s", len(t or "")) for i, t in enumerate([None, "", "  ", prose(40), prose(40), long, item, "x" * 3000])] + [(None, prose(50), None, None, None), (3, "12", "aa", "s", 2)]
    docs = spark.createDataFrame([*full, full[5]], SCHEMA)
    from pyspark.sql import functions as F

    docs = docs.withColumns({c: F.lit(v) for c, v in extra.items()}).cache()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name != "pieces":
            assert got.columns == docs.columns == none.columns
            assert all(r[c] == "clash" for r in got.collect() for c in extra)
        kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
        rows = Counter((r[0], r[1] or "" if name == "pieces" else r[1]) for r in [*full, full[5]])
        if name == "near duplicates":
            assert kept == Counter(set(rows))
        elif name == "decontamination":
            assert rows - kept == Counter([(6, item)])
        elif name == "pieces":
            assert kept == rows
        elif name == "repeats":
            assert kept[5, ""] == 2 and kept[7, ""] == 1 and sum(kept.values()) == len(full) + 1
        else:
            assert {i for i, _ in kept} >= {3, 4, 5, 6, None} and not {i for i, t in kept if not any(c.isalpha() for c in t or "")}
