"""Figures that random data give: every window against every item, and language identification on real labels."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tidepanel.llm import common, decontamination, language_id


def shingles(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def likeness(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_items_are_found_wherever_a_window_is_alike_enough(spark):
    """All windows by brute force: what is found is right, and of what is there at least 99 in 100 are found (fingerprints miss about one in a thousand)."""
    own = random.Random(12)
    words = [f"w{own.randrange(3000)}" for _ in range(40_000)]
    take = lambda n: [own.choice(words) for _ in range(n)]
    items = [(k, take(own.randint(8, 160))) for k in range(40)]
    docs = []
    for i in range(400):
        item = list(own.choice(items)[1])
        edits = own.choice([0, 1, 1, 2, 2, 3])
        for at in own.sample(range(len(item)), min(edits, len(item))):  # scattered foreign words
            item[at] = f"x{own.randrange(99)}"
        docs.append((i, take(own.randint(0, 80)) + item + take(own.randint(0, 80))))
    docs += [(None, docs[0][1]), (1000, docs[1][1]), (1000, docs[1][1]), (1001, take(3000) + items[0][1])]  # a null id, repeated rows, a long text
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string")
    got = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in decontamination.contaminated(spark, frame(docs, "doc_id").repartition(4), frame(items, "item_id")).collect())
    want, bags = Counter(), {k: shingles(w) for k, w in items}
    for doc, text in docs:
        for k, item in items:
            inside = set(text)
            if len(text) >= len(item) and sum(w in inside for w in item) * 10 >= 7 * len(item):  # fewer common words cannot reach 0.8
                best = max(likeness(shingles(text[a : a + len(item)]), bags[k]) for a in range(len(text) - len(item) + 1))
                if best >= 0.8:
                    want[doc, k, round(best, 9)] += 1
    assert sum(want.values()) > 200
    assert not got - want  # nothing that is not there, and always the best window
    assert sum((got & want).values()) >= 0.99 * sum(want.values())


def test_languages_of_held_out_documents_are_their_labels(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    found = language_id.language_id(spark, docs.select("doc_id", "text", "lang"))
    assert found.count() == docs.count()
    held = found.filter("held_out").join(docs.select("doc_id", "lang").filter("lang is not null"), "doc_id")
    right, n = held.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert n >= 20 and right >= 0.95 * n
    assert found.filter("score < 0 or score > 1 or score is null").count() == 0
