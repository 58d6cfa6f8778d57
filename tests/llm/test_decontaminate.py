"""Benchmark overlaps against a search of every diagonal and every run."""

import math
import random

import pytest

from zonestudy.llm import components, decontaminate

ITEMS, DOCS = "item_id long, text string, n_items int", "doc_id long, text string, item_id long, row int, id int, text_hash int, many int"


def overlaps(spark, docs, items):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], DOCS)
    return decontaminate.find_overlaps(docs, spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)).collect()


def every_run(doc, item, min_words=12, min_identity=0.75):
    """The most equal words of any run on any diagonal that meets both limits; 0 if none does."""
    best, need = 0, min(min_words, math.ceil(0.75 * len(item)))
    for shift in range(-len(item) + 1, len(doc)):
        same = [doc[shift + i] == w for i, w in enumerate(item) if 0 <= shift + i < len(doc)]
        if sum(same) < need:
            continue
        for s in range(len(same)):
            for e in range(s + 1, len(same) + 1):
                if need <= sum(same[s:e]) >= min_identity * (e - s):
                    best = max(best, sum(same[s:e]))
    return best


def test_substitutions_spans_nulls_and_equal_items(spark):
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**6)}" for _ in range(30)]
    changed = [w if i % 6 else "other" for i, w in enumerate(item)]
    noise = [f"n{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(noise[:50] + item + noise[50:]), " ".join(noise[:9] + changed), " ".join(noise), " ".join(item[:8] + noise), "", None]
    rows = [*enumerate(texts), (None, texts[1]), (1, texts[1]), (9, "so six words that are all here now"), (10, " ".join(["pad"] * 60_000 + item))]
    items = [(5, " ".join(item)), (4, "; ".join(item).upper()), (None, " ".join(item)), (6, "four words are few"), (7, None), (8, "six words that are all here")]
    found = sorted(((-1 if r.doc_id is None else r.doc_id, r.item_id, r.n_items, r.equal_words) for r in overlaps(spark, rows, items)))
    assert found == [(-1, 4, 3, 25), (0, 4, 3, 30), (1, 4, 3, 25), (1, 4, 3, 25), (9, 8, 1, 6), (10, 4, 3, 30)]
    own = next(r for r in overlaps(spark, rows, items) if r.doc_id == 0)
    assert texts[0].encode()[own.start_byte : own.end_byte].decode() == " ".join(item)


def test_copied_parts_between_changed_words(spark):
    item = [f"w{i}" for i in range(50)]
    doc = [w if i % 19 < 12 else f"x{i}" for i, w in enumerate(item)]
    found = overlaps(spark, [(1, " ".join(doc))], [(1, " ".join(item))])
    assert [r.equal_words for r in found] == [every_run(doc, item)] == [24]


def test_short_items_against_every_diagonal(spark):
    rng = random.Random(6)
    items = [[f"i{k}w{j}" for j in range(5 + k % 5)] for k in range(25)]
    docs = []
    for w in items * 12:
        copy = [x if rng.random() < 0.8 else f"c{rng.randrange(99)}" for x in w]
        docs.append([f"n{rng.randrange(99)}" for _ in range(rng.randrange(4))] + copy[rng.randrange(3) :] + [f"n{rng.randrange(99)}" for _ in range(rng.randrange(4))])
    rows = overlaps(spark, [(r, " ".join(d)) for r, d in enumerate(docs)], [(k, " ".join(w)) for k, w in enumerate(items)])
    want = {(r, r % 25): every_run(d, items[r % 25]) for r, d in enumerate(docs)}
    assert {(r.doc_id, r.item_id): r.equal_words for r in rows} == {k: n for k, n in want.items() if n} and len(rows) > 100


@pytest.mark.parametrize(("changed", "least"), [(0.08, 0.99), (0.2, 0.9)])
def test_recall_of_random_substitutions(spark, changed, least):
    rng = random.Random(7)
    items = [[f"i{k}w{j}" for j in range(rng.randrange(14, 31))] for k in range(60)]
    docs = []
    for w in items * 4:
        copy = [x if rng.random() >= changed else f"c{rng.randrange(99)}" for x in w]
        docs.append([f"n{rng.randrange(999)}" for _ in range(rng.randrange(9))] + copy + [f"n{rng.randrange(999)}" for _ in range(9)])
    found = {(r.doc_id, r.item_id) for r in overlaps(spark, [(r, " ".join(d)) for r, d in enumerate(docs)], [(k, " ".join(w)) for k, w in enumerate(items)])}
    want = {(r, r % 60) for r, d in enumerate(docs) if every_run(d, items[r % 60])}
    assert found <= want and len(found) >= least * len(want) > 100


def test_a_phrase_in_every_document_is_salted(spark, monkeypatch):
    rng = random.Random(12)
    phrase = "as all of us know well by now it is so".split()
    items = [[*phrase, *(f"i{k}w{j}" for j in range(20))] for k in range(6)]
    docs = [[*phrase, *(f"n{rng.randrange(9999)}" for _ in range(15)), *(items[r % 6][2:] if r % 5 == 0 else []), *phrase] for r in range(150)]
    rows, asked = [(r, " ".join(d)) for r, d in enumerate(docs)], [(k, " ".join(w)) for k, w in enumerate(items)]
    plain = sorted(overlaps(spark, rows, asked))
    assert {(r.doc_id, r.item_id) for r in plain} == {(r, r % 6) for r in range(150) if r % 5 == 0}
    monkeypatch.setattr(components, "HOT", 20)
    assert sorted(overlaps(spark, rows, asked)) == plain


def test_salted_join_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 8)
    left = spark.createDataFrame([(k, i) for k in (1, 2, 3, None) for i in range(100 if k == 1 else 5)] * 2, "k long, x long")
    right = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 9), (4, 1), (None, 3)], "k long, y long")
    monkeypatch.setattr(components, "BROADCAST", 1)
    want = sorted(left.join(right, "k").collect())
    got = components.salted_join(left, right, left.count(), "k")
    assert sorted(got.collect()) == want and got.columns == ["k", "x", "y"]
    assert components.salted_join(left.limit(0), right, 0, "k").count() == components.salted_join(left, right.limit(0), left.count(), "k").count() == 0
