"""Substring removal, Jaccard groups, components and near-duplicate vectors against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import common, embeddings, graph, jaccard, substrings


def removed(rows, window):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").encode().split()
        drop = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if seen.setdefault(k, (d, i)) < (d, i):
                drop[i : i + window] = [True] * window
        out[d] = (len(w), sum(drop), b" ".join(x for x, z in zip(w, drop) if not z).decode())
    return out


@pytest.mark.parametrize("window,anchor", [(5, 2), (4, 3), (20, 6)])
def test_substrings(spark, window, anchor):
    rng, rows = random.Random(window), []
    for i in range(70):
        w = [rng.choice("abc" if window < 20 else "abcdefghij") for _ in range(rng.randint(0, 60))]
        if i % 3 and rows:
            o = (rng.choice(rows)[1] or "").split()
            p = rng.randint(0, len(o))
            w = w[:10] + o[p : p + 40] + w[10:]
        rows.append((i * 7 % 71, " ".join(w) if i != 5 else None))
    rows.append((500, "long " * 30_000))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: (r[1], r[2], r[3]) for r in substrings.deduplicate(df, window=window, anchor=anchor).collect()}
    assert got == removed(rows, window)


def test_substring_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text, "x"), (1, text, "x"), (2, text, "y"), (3, None, "z"), (4, "", "z"), (5, "too few words", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    got = Counter(tuple(r) for r in substrings.deduplicate(df).select("doc_id", "n_words", "n_removed").collect())
    assert got == Counter({(1, 25, 0): 2, (2, 25, 25): 1, (3, 0, 0): 1, (4, 0, 0): 1, (5, 3, 0): 1})
    assert substrings.deduplicate(df.limit(0)).count() == 0


def test_a_common_phrase_is_dealt_by_its_contexts(spark, monkeypatch):
    """One anchor with 20,000 contexts spreads over all buckets, and the result stays exact."""
    rng = random.Random(3)
    phrase = " ".join(f"common{i}" for i in range(12))
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    rows = [(i, " ".join([*(word() for _ in range(12)), phrase, *(word() for _ in range(12))])) for i in range(20_000)]
    rows += [(20_000 + i, rows[i * 50][1]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sent, exchange = [], substrings.buckets.exchange
    monkeypatch.setattr(substrings.buckets, "exchange", lambda frame, n: sent.append(frame) or exchange(frame, n))
    got = {r[0]: (r[1], r[2], r[3]) for r in substrings.deduplicate(df).collect()}
    assert got == removed(rows, 20)
    for frame in sent:
        size = [r[1] for r in frame.where("kind = 1").selectExpr("bucket", "length(c0) AS n").groupBy("bucket").sum("n").collect()]
        assert max(size) < 2 * sum(size) / len(size) and len(size) >= 16


def linked_groups(rows):
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for d in sorted(sets):
        for y, k in Counter(y for g in sets[d] for y in held.get(g, ())).items():
            if 100 * k >= 80 * (len(sets[d]) + len(sets[y]) - k):
                a, b = find(d), find(y)
                root[max(a, b)] = min(a, b)
        for g in sets[d]:
            held.setdefault(g, []).append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_texts(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        if i % 4 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = f"x{rng.randint(0, 99)}"
        else:
            w = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 120))]
        rows.append((i * 7 % 503, " ".join(w) if i != 5 else None))
    return rows


@pytest.mark.parametrize("block", [1_000_000, 400])
def test_jaccard_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard, "HOT_DOCS", 2000 if block > 400 else 4)
    rows = near_texts(300, 3)
    rows += [(1000 + i, (t or "").upper() + " ") for i, t in rows[:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r[0]: (r[1], r[2]) for r in jaccard.groups(df).collect()} == linked_groups(rows)


def test_jaccard_of_a_large_group(spark, monkeypatch):
    """Near copies of one text and of one that shares half of it, beside sets that only share passages, in many small blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 20)
    monkeypatch.setattr(jaccard, "HOT_DOCS", 10)
    rng = random.Random(12)
    one = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    two = one[:60] + [f"v{rng.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(240):
        w = list(two if i % 3 == 0 else one)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [f"x{rng.randint(0, 9)}"], [w[k], "y"]])
        if i % 10 == 9:
            w = w[: rng.randint(20, 110)] + [f"u{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))]
        rows.append((i * 7 % 241, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = linked_groups(rows)
    assert {r[0]: (r[1], r[2]) for r in jaccard.groups(df).collect()} == want and len({c for _, c in want.values()}) > 5


def test_jaccard_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, "one two", 1), (5, "ONE  two", 1), (6, "one two three", 2), (4, "one two", 1), (7, "z " * 20_000, 3), (8, "z " * 90, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = {tuple(r) for r in jaccard.groups(df).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 7)}
    assert jaccard.groups(df.limit(0)).count() == 0


def test_divide_skip_finds_all_occurrences():
    rng = random.Random(2)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 30))), np.uint64) for _ in range(rng.randint(2, 12))]
        lists = jaccard.Lists(sets)
        for i, s in enumerate(sets):
            for need in (1, 5, 12):
                want = {j for j, t in enumerate(sets) if len(np.intersect1d(s, t)) >= need} - {i}
                assert set(lists.divide_skip(s, need)) - {i} == want
        q = np.array(sorted(rng.sample(range(40), 20)), np.uint64)  # a query that is none of the sets
        assert set(jaccard.Lists(sets, least=1).divide_skip(q, 5)) == {j for j, t in enumerate(sets) if len(np.intersect1d(q, t)) >= 5}


@pytest.mark.parametrize("last", [1_000_000, 20])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST_EDGES", last)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)] + [(0, i) for i in range(1, 50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in got} and set(root) - set(got) <= {x for x in root if find(x) == x}


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (1, 2, 3):
        base = rng.normal(size=(60, 16))
        near = base[:20] + rng.normal(size=(20, 16)) * 0.03
        many = base[0] + rng.normal(size=(70, 16)) * 0.05
        for v in (*base, *near, *many, *base[5:9], *base[5:9] * 2):
            rows.append((i, v.tolist(), label))
            i += 1
    return rows


def brute_links(rows, threshold=0.98):
    out = {}
    for i, v, label in rows:
        ok = lambda x, lab: lab is not None and x is not None and len(x) and all(c is not None and np.isfinite(c) for c in x) and any(x)
        out[i] = {j for j, w, m in rows if j != i and m == label and ok(v, label) and ok(w, m) and len(w) == len(v) and np.dot(v, w) >= threshold * np.linalg.norm(v) * np.linalg.norm(w)}
    return out


@pytest.mark.parametrize("shard", [1500, 40])
def test_vector_links(spark, monkeypatch, shard):
    monkeypatch.setattr(embeddings, "SHARD_ROWS", shard)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    want = brute_links(rows)
    total = sum(map(len, want.values()))
    assert all(got[i]["n_links"] <= len(want[i]) for i in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * total
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in got.values())
    assert embeddings.audit(df, spark.createDataFrame(list(got.values()))) >= 0.9


@pytest.mark.parametrize("shard", [1500, 150])
def test_vector_links_of_a_hot_cluster(spark, monkeypatch, shard):
    """A third of a label is one cluster of unequal vectors that all link, over which many centres are fitted."""
    monkeypatch.setattr(embeddings, "CLUSTER_ROWS", 20)
    monkeypatch.setattr(embeddings, "SHARD_ROWS", shard)
    rng = np.random.default_rng(4)
    hot = np.full(64, 0.125) + rng.normal(size=(300, 64)) * 0.09 / 8
    every = np.concatenate([hot, rng.normal(size=(600, 64))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert want.sum() == 300 * 299
    assert all(got[i]["n_links"] <= n for i, n in enumerate(want))
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * 300 * 299
    assert {got[i]["component_id"] for i in range(300)} == {0}


def test_vector_links_over_levels(spark, monkeypatch):
    """Shards are divided level by level; where they overlap too little, the audit has the overlap widened."""
    for name, value in (("SPLIT_ROWS", 150), ("SHARD_ROWS", 50), ("CLUSTER_ROWS", 200), ("FAN_OUT", 2), ("DEAL_ROWS", 100), ("LEVELS", 2), ("SPREAD", 2.5), ("FIT_ROWS", 100)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 64)) + 3 * np.tile(rng.normal(size=(4, 64)), (50, 1))
    every = np.concatenate([base, *(base + rng.normal(size=base.shape) * 0.3 for _ in range(2))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int").repartition(3)
    seen, divided = [], embeddings._divided
    monkeypatch.setattr(embeddings, "_divided", lambda *a: seen.append(1) or divided(*a))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, min_recall=0.9999).collect()}
    want = brute_links([(i, v, 1) for i, v in enumerate(every.tolist())])
    assert all(got[i]["n_links"] <= len(want[i]) for i in want) and len(seen) > 1
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(map(len, want.values())) > 300


def test_vector_tasks_go_in_waves(spark, monkeypatch, tmp_path):
    """The exchange of a wave is bounded, vectors take no more bytes than they came in, and their tables go."""
    for name, value in (("SHARD_ROWS", 40), ("SPLIT_ROWS", 100), ("LEVELS", 1), ("WAVE_ROWS", 100)):
        monkeypatch.setattr(embeddings, name, value)
    waves, released = [], embeddings.released
    monkeypatch.setattr(embeddings, "released", lambda df, name, path=None: waves.append(name == "") or released(df, name, path))
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = [(i, np.float32(v).tolist(), label) for i, v, label in vectors(7)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    want = brute_links(rows)
    assert all(got[i]["n_links"] <= len(want[i]) for i in want) and sum(r["n_links"] for r in got.values()) >= 0.97 * sum(map(len, want.values()))
    assert sum(waves) > 3 and not [p for p in tmp_path.rglob("*.parquet") if "leafmill-vectors" in str(p) or "vector-links" in str(p)]
    single, double = np.float32([0.1, -2.5, 0]).astype(float), np.array([0.1, 1e300, -0.25])
    packed = [embeddings._packed(single), embeddings._packed(double)]
    assert [len(b) for b in packed] == [12, 24] and (embeddings._unpacked(packed, 3) == [single, double]).all()


def test_linked_vectors_meet_in_a_shard():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(500, 8)), 1 + rng.normal(size=(700, 8)) * 0.3])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for centres in (embeddings.fit_centres(x, 60), embeddings.thinned(x, np.zeros(len(x)), embeddings.fit_centres(x, 60), 0.98, 50)):
        leaves = embeddings.shards_of(x, centres, 0.98)
        for i, j in np.argwhere(x @ x.T >= 0.98).tolist():
            assert leaves[j][0] in leaves[i]


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (2, [2.0, 0.0], 1), (12, [-0.0, 5.0], 1), (13, [0.0, 5.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 12: (1, 12), 13: (1, 12), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)}}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
