"""Decontamination: planted passages, and the alignment against the textbook recurrence."""

import random

import numpy as np

from leafmill.llm import decontaminate as dc


def textbook(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return int(h.max())


def test_alignment_scores():
    rng = random.Random(3)
    for _ in range(150):
        a = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 12))])
        b = np.array([rng.randint(0, 4) for _ in range(rng.randint(0, 18))])
        score, s, e = dc.align(a, b)
        assert score == textbook(a, b)
        assert textbook(a, b[s:e]) == score


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randint(8, 50)))) for i in range(25)] + [(90, None), (91, ""), (92, "two words"), (93, "..."), (3, "other text of item three with enough words to seed")]
    docs, want = [], set()
    for d in range(200):
        w = words(rng, rng.randint(0, 150))
        if d % 8 == 0:
            item, text = items[d % 25]
            p = text.split()
            if d % 16 == 0:  # edited: every eighth word differs, one is lost
                p = [x if k % 8 else x[::-1] + "q" for k, x in enumerate(p)][:-1]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," if d % 24 == 0 else x for x in p]
            want.add((d, item))
        docs.append((d, " ".join(w) if d != 1 else None))
    docs.append((777, "lead " * 9000 + items[4][1]))
    want.add((777, 4))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = dc.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    assert found.where("doc_id = 777").head()["start_word"] == 9000


def test_against_brute_force(spark):
    """All documents against all items by the textbook recurrence; a pair that counts has common seeds here."""
    rng = random.Random(21)
    items = [(i, words(rng, rng.randint(6, 30))) for i in range(8)]
    docs = []
    for d in range(40):
        w = words(rng, rng.randint(0, 30))
        if d % 2:
            p = list(items[d % 8][1])
            for _ in range(rng.randint(0, 12)):  # edits of all kinds, many pairs near the limit
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], words(rng, 1), [p[k], *words(rng, 1)]])
                p = p or words(rng, 1)
            w += p
        docs.append((d, w))
    code = {x: i for i, x in enumerate(sorted({x for _, w in items + docs for x in w}))}
    runs = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    want = {}
    for d, w in docs:
        for i, v in items:
            got = textbook([code[x] for x in v], [code[x] for x in w])
            if got >= dc.MIN_SCORE * dc.MATCH * len(v) and runs(v) & runs(w):
                want[d, i] = got / (dc.MATCH * len(v))
    found = dc.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()} == want and len(want) > 5


def test_long_items(spark):
    """20,000 words: linear tables, and 50 words copied from it are enough; short items keep short passages."""
    rng = random.Random(4)
    long = words(rng, 20_000)
    short = words(rng, 20)
    docs = [(1, " ".join(words(rng, 30) + long[700:750] + words(rng, 30))), (2, " ".join(words(rng, 60) + long[100:120])), (3, " ".join(words(rng, 4000) + short)), (4, " ".join(words(rng, 100)))]
    items = [(1, " ".join(long)), (2, " ".join(short))]
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["end_word"]) for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (30, 80), (3, 2): (4000, 4020)}


def test_item_of_common_seeds_keeps_them_all(spark):
    """Every seed of the item is common, and the copy holds only one that isn't among the rarest few."""
    base = "a b c d e f g h i j"
    docs = [(i, base) for i in range(50)] + [(90, "x " * 40)]
    found = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, base)], "item_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == set(range(50))


def test_a_phrase_of_many_items_brings_no_pairs(spark, monkeypatch):
    """40 items and 60 documents share six words: only the documents that hold more of an item are aligned with it."""
    rng = random.Random(12)
    phrase = "photosynthesis converts sunlight into chemical energy".split()
    items = [(i, words(rng, 12) + phrase + words(rng, 12)) for i in range(40)]
    docs = [(d, words(rng, 20) + (phrase if d < 60 else []) + words(rng, 20)) for d in range(100)]
    docs += [(200 + i, words(rng, 9) + items[i][1] + words(rng, 9)) for i in range(5)] + [(300 + k, items[7][1]) for k in range(200)]
    held, write = {}, dc.written
    monkeypatch.setattr(dc, "written", lambda df, name: held.setdefault(name, write(df, name)))
    found = dc.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(200 + i, i) for i in range(5)} | {(300 + k, 7) for k in range(200)}
    assert held["cases"].count() <= 2 * (len(items) + 5)  # not items x documents


def test_recall_against_all_pairs(spark):
    """Copies with every kind of edit, all pairs aligned, those without a common seed too."""
    rng = random.Random(31)
    items = [(i, words(rng, 24)) for i in range(12)]
    docs = []
    for d in range(120):
        p = list(items[d % 12][1])
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(len(p))
            p[k : k + 1] = rng.choice([[], words(rng, 1), [p[k], *words(rng, 1)]])
        docs.append((d, words(rng, 6) + p + words(rng, 6)))
    code = {x: i for i, x in enumerate(sorted({x for _, w in items + docs for x in w}))}
    want = {(d, i) for d, w in docs for i, v in items if textbook([code[x] for x in v], [code[x] for x in w]) >= dc.MIN_SCORE * dc.MATCH * len(v)}
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(v)) for i, v in items], "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 60


def test_edges(spark):
    d = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "some text", 0)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert dc.contaminated(d.where("doc_id is not null"), b).count() == 0
    assert dc.contaminated(d, b.limit(0)).count() == 0
    assert dc.contaminated(d.limit(0), b).count() == 0
