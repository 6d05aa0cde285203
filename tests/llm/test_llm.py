"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import chat_windows, class_lm, common, cover_tree, decontamination, fixity, language_id, lattice, near_dups, queries, repeats, sampled_pieces, token_counts
from tidepanel.llm.suffix_array import Shard

SCHEMA = "doc_id long, text string, lang string, item_id string"  # item_id clashes with a name the operators use
RANDOM = random.Random(7)
WORDS = ["".join(RANDOM.choice("abcdefgé") for _ in range(RANDOM.randint(2, 9))) for _ in range(150)]


def prose(n):
    return " ".join(RANDOM.choice(WORDS) for _ in range(n))


def changed(text, n):
    words = text.split()
    for _ in range(n):
        words[RANDOM.randrange(len(words))] = RANDOM.choice(WORDS)
    return " ".join(words)


BASE, PASSAGE = prose(150), prose(90)
TEXTS = [None, "", "   ", "one", "Two words", "!!! 123", "naïve ünï 漢字 \U0001f600", "a" * 1500, prose(6000), BASE, BASE, BASE.upper()]
TEXTS += [changed(BASE, k) for k in (1, 2, 3, 4, 8, 8, 30)] + [prose(40) + " " + PASSAGE + " " + prose(30) for _ in range(6)] + [prose(60) for _ in range(8)]
TEXTS += ["<|endoftext|> in a text", "\\### Assistant: </turn> ok", "x\r\n\ty▁z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else ("xx" if i % 2 else "yy"), "clash") for i, t in enumerate(TEXTS)]
    rows.append(rows[14])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def all_rows():
    return [*enumerate(TEXTS), (14, TEXTS[14])]


def test_token_counts_are_the_librarys(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(spark, docs).collect())
    want = Counter()
    for i, t in all_rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert token_counts.token_counts(spark, empty).count() == 0


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def test_near_duplicates_are_the_components_of_all_pairs(spark, docs, empty):
    sets = []
    for i, t in all_rows():
        w = words_of(t)
        sets.append((i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    want = Counter((i, len(s), low[find(k)], i == low[find(k)]) for k, (i, s) in enumerate(sets))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(spark, docs).collect())
    assert got == want
    assert near_dups.near_duplicates(spark, empty).count() == 0


def test_parities_never_hide_a_link():
    import numpy as np

    values = np.arange(1, 4001, dtype=np.uint64)
    offsets = np.array([0, 1000, 2000, 3000, 4000])
    words = near_dups.parities(values, offsets)
    for a in range(4):
        for b in range(4):
            apart = int(np.bitwise_count(words[a] ^ words[b]).sum())
            assert apart <= (0 if a == b else 2000)


def brute_repeats(texts, span):
    seen = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if seen[t[i : i + span]] > 1:
                mark[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), spans, hashlib.sha256(bytes(b for b, m in zip(t, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 256])
def test_repeats_are_those_of_all_windows(spark, docs, empty, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = all_rows()
    want = Counter((i, *b) for (i, _), b in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], repeats.SPAN)))
    got = repeats.remove_repeats(spark, docs).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in got) == want
    assert repeats.remove_repeats(spark, empty).count() == 0


def test_what_stays_of_a_text_can_be_read(spark, tmp_path):
    passage = " ".join(str(n * n) for n in range(100, 170))
    texts = [f"one {passage} end", f"{passage}", None, "", f"é{passage}é", f"ü{passage}©", "é alone \ufffd"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(passage) > repeats.SPAN
    assert [got[i]["kept_text"] for i in range(7)] == ["one  end", "", "", "", "éé", "ü©", texts[6]]
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.values())
    halves = [f"{passage}é{passage[::-1]}", f"{passage[::-1]} ©{passage}", f"©{passage[::-1]}"]  # é and © end with one byte
    spark.createDataFrame(list(enumerate(halves)), "doc_id long, text string").write.parquet(f"{tmp_path}/halves/documents.parquet")
    got = {r["doc_id"]: r["kept_text"] for r in queries.op9_suffix_dedup(spark, f"{tmp_path}/halves").collect()}
    assert got == {0: "\ufffd", 1: " ©", 2: "\ufffd"}


def test_suffix_arrays_are_sorted():
    strings = [b"banana", b"ananas", b"", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"banana", bytes(20), b"\xff" * 9]
    shard = Shard(strings)
    order, rank = shard.suffix_array()
    text = b"\0".join(strings) + b"\0"
    suffixes = [(text[p : shard.end[p]], int(shard.owner[p])) for p in order]
    assert suffixes == sorted(suffixes) and all(order[rank] == range(shard.n))


def test_benchmark_items_are_found_and_clean_documents_left(spark, empty):
    item, short = prose(40), "just three words"
    near = item.split()
    near[20] = "other"
    rows = [(0, prose(50) + " " + item + " " + prose(9)), (1, prose(80)), (2, None), (3, ""), (4, item.upper().replace(" ", ", ")), (5, " ".join(near)), (6, "Just three WORDS."), (7, " ".join(item.split()[:20])), (0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["similarity"] == 1.0) for r in decontamination.contaminated(spark, docs, bench).collect()}
    assert {(0, 1, True), (4, 1, True), (6, 2, True)} <= got and {d for d, _, _ in got} <= {0, 4, 5, 6}
    assert decontamination.contaminated(spark, docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(spark, empty, bench).count() == 0
    assert {r["doc_id"] for r in decontamination.contaminated(spark, docs, bench, block_items=1).collect()} == {d for d, _, _ in got}


def test_language_is_learned_and_odd_texts_are_und(spark, empty):
    tongues = {"aa": ["kala", "kata", "laka", "tala"], "bb": ["wust", "zurf", "wurz", "fuzt"]}
    rows = [(i, " ".join(RANDOM.choice(tongues["ab"[i % 2] * 2]) for _ in range(30)), "ab"[i % 2] * 2) for i in range(80)]
    rows += [(100, None, "aa"), (101, "12 !", "bb"), (102, "kala tala laka kata", None), (102, "kala tala laka kata", None)]
    got = [(r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in language_id.language_id(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert len(got) == len(rows)
    by_id = {g[0]: g for g in got}
    assert all(by_id[i][2] == lang for i, _, lang in rows[:80]) and by_id[100][2] == by_id[101][2] == "und" and by_id[102][2] == "aa"
    assert all(g[1] == (zlib.crc32(str(g[0]).encode()) % 5 == 0) and 0 <= g[3] <= 1 for g in got)
    assert language_id.language_id(spark, empty).count() == 0


def test_pieces_decode_to_the_text_and_repeat(spark, docs, empty):
    first = {(r["doc_id"], r["text"], tuple(r["piece_ids"]), r["decoded"]) for r in sampled_pieces.decode(spark, sampled_pieces.encode(spark, docs)).collect()}
    again = {(r["doc_id"], r["text"], tuple(r["piece_ids"]), r["decoded"]) for r in sampled_pieces.decode(spark, sampled_pieces.encode(spark, docs.repartition(5))).collect()}
    other = {(r["doc_id"], tuple(r["piece_ids"])) for r in sampled_pieces.encode(spark, docs, seed=1).collect()}
    assert first == again and all(d == (t or "") for _, t, _, d in first)
    assert other != {(i, p) for i, _, p, _ in first}
    assert {(r["doc_id"], r["text"], tuple(r["piece_ids"]), r["decoded"]) for r in sampled_pieces.round_trip(spark, docs).collect()} == first
    assert sampled_pieces.encode(spark, empty).count() == 0


def paths(vocabulary, text):
    """All segmentations of a short text as tuples of arcs (piece, or a code point from size on)."""
    if not text:
        return [()]
    arcs = [(n, i) for n in range(1, len(text) + 1) for i in range(vocabulary.size) if vocabulary.lengths[i] == n and vocabulary.bytes[i] == text[:n].encode()]
    if not any(n == 1 for n, _ in arcs):
        arcs.append((1, vocabulary.size + ord(text[0])))
    return [(i, *rest) for n, i in arcs for rest in paths(vocabulary, text[n:])]


UNITS = [" the", "tion", "  in\r", "ñandú漢", "aaaaaa", "\n\n", "qzx7", " \u2581a"]


def test_forward_sums_are_those_of_all_segmentations():
    import numpy as np

    vocabulary = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    scores = np.where(vocabulary.usable, np.log(np.random.default_rng(2).random(vocabulary.size)), -np.inf)
    one = lambda arc: scores[arc] if arc < vocabulary.size else scores[vocabulary.spelt(arc - vocabulary.size)].sum()
    net = lattice.build(vocabulary, UNITS)
    arcs = lattice.arc_scores(vocabulary, net, scores)
    got = lattice.totals(net, lattice.forward(net, arcs))
    weights = np.arange(1.0, len(UNITS) + 1)
    uses = np.zeros(vocabulary.size)
    for k, unit in enumerate(UNITS):
        found = paths(vocabulary, unit)
        values = np.array([sum(map(one, p)) for p in found])
        assert abs(got[k] - np.logaddexp.reduce(values)) < 1e-9
        for p, v in zip(found, np.exp(values - got[k])):
            for arc in p:
                np.add.at(uses, arc if arc < vocabulary.size else vocabulary.spelt(arc - vocabulary.size), v * weights[k])
    assert np.allclose(lattice.expected_counts(vocabulary, net, arcs, weights), uses)
    assert net.cut.sum() > 2 * len(UNITS)  # some stretches are shorter than their units


def test_shares_of_samples_are_the_weights_of_paths(monkeypatch):
    import numpy as np

    vocabulary = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    scores = sampled_pieces.piece_scores(vocabulary, 0.5)
    one = lambda arc: scores[arc] if arc < vocabulary.size else scores[vocabulary.spelt(arc - vocabulary.size)].sum()
    spelt = lambda arc: (arc,) if arc < vocabulary.size else tuple(vocabulary.spelt(arc - vocabulary.size).tolist())
    n = 20_000
    monkeypatch.setattr(sampled_pieces, "MEMORY", 10)  # forgets in between
    sampler = sampled_pieces.Sampler(vocabulary, scores)
    for unit in (" the", "tion", "ñandú漢"):
        weight = {sum(map(spelt, p), ()): math.exp(sum(map(one, p))) for p in paths(vocabulary, unit)}
        ids, offsets = sampled_pieces.encode_chunk(sampler, [unit] * n, np.arange(n, dtype=np.uint64))
        seen = Counter(tuple(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:]))
        assert set(seen) <= set(weight)
        for p, w in weight.items():
            share = w / sum(weight.values())
            assert abs(seen[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-9


def test_long_words_and_blanks_are_not_cut(spark):
    own = random.Random(4)
    texts = ["".join(own.choice("abcdefg漢+/") for _ in range(5000)), " " * 300 + "end", "\n" * 400 + " x", "a" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in sampled_pieces.round_trip(spark, docs, sharpness=3.0).collect()}
    assert all(got[i]["decoded"] == t and got[i]["lossless"] for i, t in enumerate(texts))
    vocabulary = lattice.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    net = lattice.build(vocabulary, [" " + texts[0]])
    assert len(net.cut) == 5002 and net.step.max() < 5001


def test_class_model_sums_to_one_and_base_is_the_formula(spark, docs, empty):
    tokens = [(i, words_of(t) + [b"\n"]) for i, t in all_rows()]
    seen = Counter(w for i, ws in tokens if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(seen.values()), len(seen)
    got = class_lm.class_lm_scores(spark, docs, head_size=40, clustered=20).collect()
    assert len(got) == len(tokens)
    by_id = {r["doc_id"]: r for r in got}
    for i, ws in tokens:
        r = by_id[i]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert abs(r["base_score"] - base) < 1e-6 * (1 + abs(base)) and r["n_tokens"] == len(ws) and r["n_known"] == sum(seen[w] > 0 for w in ws) and r["train_tokens"] == n
    assert class_lm.class_lm_scores(spark, empty).count() == 0
    model, counts = class_lm.fit(common.Scratch(spark), docs.filter(~class_lm.held_out()).select("text"), head_size=40, clustered=20)
    head = {int(k): int(c) for k, c in zip(model.head, model.head_class)}
    end = class_lm.key_of(class_lm.END)

    def kind(w):
        return model.end_class if w == class_lm.END else head.get(class_lm.key_of(w), int(model.tail_classes[class_lm.tail_class(w)]))

    for i, ws in tokens:
        score = 0.0
        for v, w in zip([class_lm.END, *ws], ws):
            score += model.log_transition[kind(v), kind(w)] + math.log10(seen[w] + 0.1) - model.log_weight[kind(w)]
        assert abs(by_id[i]["score"] - score) < 1e-6 * (1 + abs(score))
    # after every class, all words known and one unknown word of each tail class have probability 1 together
    mass = np.zeros(len(model.log_weight))
    for r in counts.collect():
        mass[model.end_class if r["word"] == end else head.get(r["word"], int(model.tail_classes[r["tail"]]))] += r["n"] + 0.1
    mass[model.tail_classes] += 0.1
    mass[model.end_class] += 0 if model.end_count else 0.1
    assert np.allclose((10**model.log_transition * (mass / 10**model.log_weight)).sum(1), 1, atol=1e-9)


def test_rounds_never_lower_the_likelihood_nor_what_they_have_not_seen(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    rows = common.table(spark, folder, "documents").select("doc_id", "text")
    kept = class_lm.exchanged
    histories = []

    def watched(rounds):
        def run(*arguments):
            history = []
            found = kept(*arguments, rounds=rounds, history=history)
            histories.append(history)
            return found

        return run

    totals = []
    for rounds in (0, 3):
        monkeypatch.setattr(class_lm, "exchanged", watched(rounds))
        scored = class_lm.class_lm_scores(spark, rows, clustered=150).groupBy("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).collect()
        totals.append({r["held_out"]: (r["s"], r["b"]) for r in scored})
    assert len(histories[0]) == 1
    for before, after in zip(histories[1], histories[1][1:]):
        assert after[0] > before[0] and after[1] > before[1]
    assert totals[1][True][0] >= totals[0][True][0] - 1e-6 and all(t[k][0] > t[k][1] for t in totals for k in (True, False))


@pytest.mark.parametrize("doc_id", ["null", "7"])
def test_null_ids_are_training_text(spark, doc_id):
    rows = spark.sql(f"SELECT CAST({doc_id} AS long) AS doc_id, text FROM VALUES ('a b a'), (NULL), ('c') AS t(text)")
    got = class_lm.class_lm_scores(spark, rows).collect()
    assert len(got) == 3 and all(r["train_tokens"] == 7 and not r["held_out"] and r["n_known"] == r["n_tokens"] for r in got)
    assert sampled_pieces.round_trip(spark, rows).count() == 3


def test_neighbours_are_a_row_for_each_word_and_sum_up_over_rows():
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    own = random.Random(4)
    end, total, fixed = 300, 5, 3
    of = np.array([own.randrange(4) for _ in range(end)] + [4])
    want, rows = Counter(), []
    for _ in range(3):  # three tasks
        texts = [[own.randrange(end) for _ in range(own.randrange(400))] + [end] for _ in range(5)]
        for before, word in ((a, b) for t in texts for a, b in zip([end, *t], t)):
            if fixed <= before < end:
                want[before, int(of[word])] += 1
            if fixed <= word < end:
                want[word, total + int(of[before])] += 1
        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, texts)]), pa.int32()), pa.array(sum(texts, []), pa.int32()))
        batch = pa.RecordBatch.from_arrays([pa.array([False] * 5), ids], ["judge", "ids"])
        (got,) = class_lm._neighbours(SimpleNamespace(value=of), fixed, end, end, total)(iter([batch]))
        assert got.num_rows == len({w for t in texts for w in t if fixed <= w < end})
        rows += got.to_pylist()
    rows.sort(key=lambda r: r["word"])
    for cut in (1, 7, len(rows)):  # batches that end within a word
        parts = [pa.RecordBatch.from_pylist(rows[i : i + cut], got.schema) for i in range(0, len(rows), cut)]
        told = list(class_lm._beside(iter(parts), 2 * total))
        words = [w for word, *_ in told for w in word.tolist()]
        found = {(w, int(x)): int(n) for word, cuts, slot, count in told for k, w in enumerate(word.tolist()) for x, n in zip(slot[cuts[k] : cuts[k + 1]], count[cuts[k] : cuts[k + 1]])}
        assert len(words) == len(set(words)) and max(len(word) for word, *_ in told) <= 100 and found == want
    assert not list(class_lm._beside(iter([]), 2 * total))


def test_best_classes_are_those_of_the_greatest_likelihood():
    rng = np.random.default_rng(5)
    words, total = 200, 20
    pairs = rng.integers(1, 5, (words, words)) * (rng.random((words, words)) < 0.012)
    of = rng.integers(0, total, words)
    member = np.eye(total)[of]
    table = member.T @ pairs @ member
    behind, before = pairs @ member, pairs.T @ member

    def likelihood(table):
        return class_lm.xlogx(table).sum() - class_lm.xlogx(table.sum(0)).sum() - class_lm.xlogx(table.sum(1)).sum()

    # the gain is exact where no class stands on both sides of the word and its own on neither
    some = [w for w in range(words) if behind[w].sum() + before[w].sum() and not (behind[w] * before[w]).any() and not behind[w, of[w]] + before[w, of[w]]]
    beside = np.concatenate([behind[some], before[some]], axis=1)
    own, slot = np.nonzero(beside)
    got = class_lm.best_classes(np.searchsorted(own, np.arange(len(some) + 1)), slot, beside[own, slot], of[some], table, np.arange(total))
    assert len(some) > 50 and (got != of[some]).any()
    for w, c in zip(some, got):
        values = []
        for to in range(total):
            moved = table.copy()
            for sign, at in ((-1, of[w]), (1, to)):
                moved[at] += sign * behind[w]
                moved[:, at] += sign * before[w]
            values.append(likelihood(moved))
        assert values[c] >= max(values) - 1e-6


def test_exchange_rounds_put_words_of_like_contexts_together(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    monkeypatch.setattr(class_lm, "HELD", 500)
    monkeypatch.setattr(class_lm, "SUMMED", 500)
    rng = random.Random(3)
    kinds = [[f"{k}{i:02d}{k * (i % 7)}" for i in range(40)] for k in "ab"]
    rows = [(i, " ".join(w for _ in range(60) for w in ("the", rng.choice(kinds[0]), "of", rng.choice(kinds[1])))) for i in range(80)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").select("text")
    model, _ = class_lm.fit(common.Scratch(spark), texts, head_size=200, clustered=4)
    classes = {int(k): int(c) for k, c in zip(model.head, model.head_class)}
    found = [Counter(classes[class_lm.key_of(w.encode())] for w in kind) for kind in kinds]
    assert all(f.most_common(1)[0][1] >= 30 for f in found) and found[0].most_common(1)[0][0] != found[1].most_common(1)[0][0]


def test_exchange_ends_where_no_move_helps():
    import numpy as np

    generator = np.random.default_rng(3)
    pairs = generator.integers(0, 20, (13, 13)).astype(float)
    pairs[:6, 6:12] += 40

    def likelihood(of):
        member = np.eye(int(max(of)) + 1)[of]
        table = member.T @ pairs @ member
        return class_lm.xlogx(table).sum() - class_lm.xlogx(table.sum(0)).sum() - class_lm.xlogx(table.sum(1)).sum()

    of = class_lm.exchange(pairs, 12, 3, sweeps=50)
    assert likelihood(of) > likelihood(np.array([i % 3 for i in range(12)] + [3]))
    for w in range(12):
        for c in range(3):
            moved = of.copy()
            moved[w] = c
            assert likelihood(moved) <= likelihood(of) + 1e-6


def test_topk_is_exact(spark):
    rows = [(i, [RANDOM.choice([-0.5, 0.25, 0.1, 0.7]) + (i % 5) * 0.1 for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.3] * 6) for i in range(60)] + [(2000, None), (2001, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (2002, [float("nan")] * 6), (None, [1.0] * 6), (2050, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cover_tree.exact_topk(spark, vectors, batch_rows=90).collect())
    c = duckdb.connect()
    import pandas as pd

    c.register("embeddings", pd.DataFrame({"vec_id": pd.array([i for i, _ in rows[:460]], "Int64"), "embedding": [[float(x) for x in __import__("numpy").float32(v)] for _, v in rows[:460]]}))
    assert got == sorted(c.sql(cover_tree.SQL).fetchall())
    assert cover_tree.exact_topk(spark, vectors.limit(0)).count() == 0
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cover_tree.exact_topk(spark, vectors, query_block=3).collect()) == got


def test_cover_trees_cover_separate_and_skip(spark):
    import numpy as np

    own = np.random.default_rng(1)
    points = np.floor(np.concatenate([own.normal(c, 1.0, (150, 12)) for c in own.normal(0, 60, (12, 12))]))
    own.shuffle(points)
    data, queries = cover_tree.build(points), cover_tree.build(points[::7])
    assert sorted(data.order.tolist()) == list(range(len(points))) and len(data.children) > 12
    for n, kids in enumerate(data.children):
        inside = data.points[data.low[n] : data.high[n]]
        away = np.sqrt(((inside - data.points[data.centre[n]]) ** 2).sum(1))
        assert away.max() <= data.radius[n] + 1e-6
        if kids:
            half = 2.0 ** (np.ceil(np.log2(data.radius[n])) - 1)
            covers = [k for k in kids if data.radius[k] <= half]
            assert sum(int(data.high[k] - data.low[k]) for k in kids) == len(inside) and len(covers) >= len(kids) - 1
            for i in covers:
                for j in covers:
                    if i < j and data.centre[i] != data.centre[j]:
                        assert np.sqrt(((data.points[data.centre[i]] - data.points[data.centre[j]]) ** 2).sum()) > half
    best = cover_tree.Best(np.arange(len(queries.points)) + 10**6, 5)
    skipped = cover_tree.search(queries, data, data.order, best)
    assert skipped > 0.7 * len(points) * len(queries.points)
    want = np.sort(queries.points @ data.points.T, axis=1)[:, :-6:-1]
    assert np.array_equal(best.score, want)


def test_products_that_doubles_cannot_hold_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1e18, 0.0]), (1, [1e18, 1.0]), (2, None)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="not exact in doubles"):
        cover_tree.exact_topk(spark, rows).collect()


def test_a_system_turn_over_the_budget_is_not_repeated_for_every_turn(spark):
    rows = [(None, 0, "system", "s" * 9000)] + [(None, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(1, 201)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat_windows.windows(turns).collect()
    tokens = 200 * (2 + 4)
    assert 1 < len(shown) <= 2 + 2 * tokens // chat_windows.BUDGET and all(r["over_budget"] and r["conv_id"] is None for r in shown)
    read = chat_windows.digests(chat_windows.windows(turns)).first()
    assert read["n_turns"] == 201 and read["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()


def test_windows_keep_the_budget_where_turns_fit(spark):
    rows = [(1, 0, "system", "s", 604), *((1, i, "user", f"t{i}", 254) for i in range(1, 9)), (2, 0, "user", "u", 5000)]
    rows += [(3, i, "assistant", f"a{i}", RANDOM.randint(1, 1024)) for i in range(1500)] + [(4, 0, "system", "x", 2000), (4, 1, "user", "y", 3), (4, 2, "user", "z", 4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    found = chat_windows.windows(turns, count="n").collect()
    assert {(w["conv_id"], w["over_budget"]) for w in found} == {(1, False), (2, True), (3, False), (4, True)}
    mine = [w for w in found if w["conv_id"] == 1]
    assert len(mine) == 8 or len(mine) == 9
    third = [w for w in found if w["conv_id"] == 3]
    assert sum(w["n_turns"] - w["n_repeated"] for w in third) == 1500 and any(w["n_repeated"] for w in third)
    assert all(w["n_tokens"] <= 1024 for w in third) and sum(w["n_tokens"] for w in third) / len(third) > 512


def test_chat_windows_read_back(spark):
    odd = chat_windows.ODD
    rows = [(1, 0, "system", "be < kind", 1), (1, 1, "user", "hello " * 500, 1), (1, 2, "assistant", "a#b:c\\d " * 200, 1), (1, 3, "user", None, 1), (1, 4, "assistant", odd, 1), (2, 0, "assistant", "", 1), (3, None, None, "x", 1), (3, 0, "assistant", "é\n</turn>\n", 1), (3, 0, "assistant", "é\n</turn>\n", 1), (None, 0, "user", "n", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    made = chat_windows.windows(chat_windows.with_odd_conversation(spark, turns))
    got = {r["conv_id"]: r for r in chat_windows.digests(made).collect()}
    every = [r[:4] for r in rows] + [(-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    assert set(got) == {r[0] for r in every}
    for conv in got:
        mine = sorted((r for r in every if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        g = got[conv]
        assert (g["n_turns"], g["turns_sha256"]) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    windows = made.filter("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 1 and all(w["formatted"].startswith("### system: be \\l kind</turn>") for w in windows)
    assert chat_windows.digests(chat_windows.windows(turns.limit(0))).count() == 0


def test_audit_finds_the_damage_and_nothing_else(spark):
    rows = [(i, f"http://h/{i % 3}", "<p>" + prose(RANDOM.randint(0, 400)), "clash") for i in range(300)] + [(7, None, None, "x"), (None, "u", "", "x"), *[(9, "same", "page", "x")] * 40]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    laid = fixity.laid_out(fixity.damaged(fixity.records(pages), 20), {"whole": "record", "harmed": "held"}, 100).cache()
    a, b = (fixity.leaves(laid, c).cache() for c in ("whole", "harmed"))
    assert laid.agg(F.sum("copies")).first()[0] == len(rows)
    for file in {r["file"] for r in laid.collect()}:  # records lie one behind the other
        at = 0
        for r in sorted(laid.filter(F.col("file") == file).collect(), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"] * r["copies"]
    harmed = {(r["file"], r["offset"]) for r in laid.collect() if r["whole"] != r["harmed"]}
    found = fixity.audit(spark, a, b, 2048, 4).collect()
    assert {(r["file"], r["offset"]) for r in found} == harmed and {r["hash_b"] is None for r in found} == {True, False}
    assert fixity.audit(spark, a, a).count() == 0
    assert fixity.audit(spark, a.limit(0), a.limit(0)).count() == 0
    assert fixity.audit(spark, a, a.limit(0), 2048, 4).count() == a.count()
    assert fixity.laid_out(fixity.damaged(fixity.records(pages.limit(0))), {"whole": "record"}).count() == 0


def test_a_document_without_an_id_links_its_neighbours(spark):
    own = random.Random(5)
    words = [own.choice(WORDS) + str(i) for i in range(200)]
    bridge = ["x", *words[1:]]
    last = [*bridge[:100], "y", *bridge[101:150], "z", *bridge[151:]]
    first = [*words[:50], "v", *words[51:]]  # linked with the bridge only
    sets = [{tuple(t[i : i + 5]) for i in range(196)} for t in (first, bridge, last)]
    near = [100 * len(a & b) >= 90 * len(a | b) for a, b in ((sets[0], sets[1]), (sets[1], sets[2]), (sets[0], sets[2]))]
    rows = [(1, " ".join(first)), (None, " ".join(bridge)), (2, " ".join(last)), (None, "alone"), (None, None)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dups.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), threshold=90).collect())
    assert near == [True, True, False]
    assert got == Counter({(1, 1, True): 1, (None, 1, False): 1, (2, 1, False): 1, (None, None, True): 2})


@pytest.mark.parametrize("words", [None, 51])
def test_few_windows_of_a_common_passage_are_told_one_by_one(spark, words, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 1)
    own = random.Random(9)
    passage = [f"{own.randrange(16**3 if words else 10**6):x}" for _ in range(90)]  # where words count, of less than SPAN bytes
    rows = []
    for i in range(60):  # each takes its own piece of the passage, and has other words around it
        a, b = own.randrange(15), 90 - own.randrange(15)
        rows.append((i, " ".join([f"{own.randrange(10**9):x}" for _ in range(9)] + passage[a:b] + [f"{own.randrange(10**9):x}" for _ in range(9)])))
    told, save = {}, repeats.common.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name == "windows":
            told[self.root] = sum(len(r["start"]) for r in out.collect())
        return out

    monkeypatch.setattr(repeats.common.Scratch, "save", counted)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()}
    if words is None:
        want = brute_repeats([t.encode() for _, t in rows], repeats.SPAN)
        assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], hashlib.sha256(got[i]["kept_bytes"]).hexdigest()) for i in range(60)] == want
    else:
        seen = Counter(tuple(w[i : i + 51]) for _, t in rows for w in [t.split()] for i in range(len(w) - 50))
        for k, t in rows:
            w = t.split()
            gone = {j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
            assert gone and bytes(got[k]["kept_bytes"]).decode().split() == [x for j, x in enumerate(w) if j not in gone]
    assert 0 < sum(told.values()) < (900 if words else 1500)  # 3556 and 2956 where every window of a block is told


@pytest.mark.parametrize("hot", [1, 256])
def test_passages_of_words_are_cut_under_the_span_too(spark, empty, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    own = random.Random(3)
    words = lambda n: [f"{own.randrange(10**5):x}" for _ in range(n)]
    passage, less = words(51), words(50)
    texts = [words(9) + passage + words(9), passage, words(3) + less + words(3), words(2) + less, ["a", "bb", "c"] * 40, words(51)]
    rows = [(i, own.choice([" ", "\n\t"]).join(t)) for i, t in enumerate(texts)] + [(6, None), (7, "é" * 500), (8, "é" * 450 + " x")]
    seen = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    want = {}
    for k, t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(i, i + 51)}
        want[k] = [x for j, x in enumerate(w) if j not in gone] if k < 7 else ["x"] if k == 8 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: bytes(r["kept_bytes"]).decode().split() for r in repeats.remove_repeats(spark, docs, words=51).collect()}
    assert len(" ".join(passage)) < repeats.SPAN and got == want and want[0] != texts[0] and want[2] == texts[2]
    assert repeats.remove_repeats(spark, empty, words=51).count() == 0


def test_long_items_with_a_run_of_foreign_words_are_found(spark):
    own = random.Random(9)
    items = [[f"w{own.randrange(5000)}" for _ in range(n)] for n in (60, 100, 150, 200, 300) for _ in range(4)]

    def similarity(a, b):
        x, y = (Counter(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in (a, b))
        return (x & y).total() / (x | y).total()

    rows, want = [], set()
    for k, item in enumerate(items):
        for more in (0, 1):  # the longest foreign run that stays at 0.8, and one word more
            n = max(n for n in range(len(item)) if similarity(item, item[: len(item) - n] + [f"x{i}" for i in range(n)]) >= 0.8) + more
            copy = item[: len(item) - n] + [f"x{own.randrange(9**9)}" for _ in range(n)]
            rows.append((len(rows), " ".join(copy)))
            if similarity(item, copy) >= 0.8:
                want.add((rows[-1][0], k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    whole, blocks = (Counter((r["doc_id"], r["item_id"], r["similarity"], r["bits_apart"]) for r in decontamination.contaminated(spark, docs, bench, block_items=b).collect()) for b in (10_000, 3))
    assert {(d, i) for d, i, _, _ in whole} == want and len(want) == len(items)
    assert whole == blocks
