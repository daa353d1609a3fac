"""Source divergence: against plain Python over dense counts, merging tables, edges."""

import random
import re
from collections import Counter, defaultdict

import pytest

from leafmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int"
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=10, top=10, scale=10**9):
    docs = [(lang or "", source or "", Counter(w.translate({k: k + 32 for k in range(65, 91)}) for w in LETTERS.findall(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, c in mine for t in c)
        vocab = [t for t, n in seen.items() if n >= min_docs]
        by = defaultdict(Counter)
        for _, source, c in mine:
            by[source].update(c)
        share = lambda c: {t: 1 + scale * (c[t] + 2) // (sum(c[u] for u in vocab) + 2 * len(vocab)) for t in vocab}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole = share(sum(by.values(), Counter()))
        shares = {s: share(c) for s, c in by.items()}
        for s, p in shares.items():
            pairs = [(sum(gap(p[t], q[t]) for t in vocab), o) for o, q in shares.items() if o != s]
            terms = [(gap(p[t], whole[t]), t) for t in vocab if by[s][t] and p[t] > whole[t]]
            for part, found, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    common = ["The", "the", "of", "über", "naïve", "ÉTÉ", "été", "😀", "x", "a1b2"]
    out = []
    for k in range(260):
        source = "hot" if k % 3 == 0 else f"s{k % 5}"
        words = rng.choices(common, k=rng.randint(0, 60)) + [f"only{source}" + "abc"[k % 3]] * (k % 4)
        out.append((" ".join(words), ["en", "de", None][k % 3 if k % 7 else 0], source))
    out += [(None, "en", "silent"), ("", "en", "silent"), ("!!", None, None), ("rare words", "xx", "alone"), ("rare", "xx", "other"), ("the the", "en", "hot"), ("the the", "en", "hot")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "own", 1) for k, r in enumerate(rows)], SCHEMA).repartition(6)


def test_equals_plain_python(spark, rows):
    got = divergence.audit(frame(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert ("xx", "alone", "pair", "other", 0, 1) in want and any(r[:3] == ("en", "silent", "pair") for r in want)


def test_merging_tables_change_nothing(monkeypatch, rows):
    import pyarrow as pa

    batches = lambda: iter(pa.table({"lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows], "text": [r[0] or "" for r in rows]}).to_batches(9))

    def total(found):
        out = Counter()
        for b in found:
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]] += r["n"] * 1000 + r["docs"]
        return out

    want = total(divergence._count(batches()))
    monkeypatch.setattr(divergence, "HELD_ROWS", 7)
    pieces = list(divergence._count(batches()))
    assert len(pieces) > 5 and total(iter(pieces)) == want


def test_large_counts_stay_exact(spark):
    """N near 10^13: the product of scale and count leaves 64 bits."""
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(F.lit(9_000_000_000_000), F.lit(9_000_000_000_007), 10**9).alias("p"), divergence._gap(F.lit(10**9).cast("long"), F.lit(1).cast("long")).alias("f")).head()
    assert row["p"] == 1 + 10**9 * 9_000_000_000_002 // 9_000_000_000_007 and row["f"] == (10**9 - 1) ** 2 // (10**9 + 1)


def test_edges(spark):
    assert divergence.audit(frame(spark, []).limit(0)).count() == 0
    assert divergence.audit(frame(spark, [("one", "en", "a")])).count() == 0
    long = divergence.audit(frame(spark, [("word " * 300_000 + "x" * 100_000, "en", "a")] * 10 + [("word", "en", "b")])).collect()
    assert {(r["source"], r["item"]) for r in long if r["part"] == "pair"} == {("a", "b"), ("b", "a")}


def test_counts_go_to_their_shards_without_a_table_between(spark, monkeypatch):
    names = []
    for f in ("written", "released"):
        make = getattr(divergence, f)
        monkeypatch.setattr(divergence, f, lambda df, name, make=make: names.append(name) or make(df, name))
    kept, _ = divergence.term_counts(frame(spark, [("word other", "en", "a")] * 12))
    assert sorted(r["term"] for r in kept.collect()) == ["other", "word"] and sorted(names) == ["kept-terms", "sources"]
