"""Vector codes: against plain Python, ties in the tree, edges, reconstruction."""

import hashlib

import numpy as np
import pytest

from leafmill.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int"


def plain(rows, parts=16, entries=64, rounds=2):
    """{vec_id: (code, error, label_error)} and the codebooks' hash, one number at a time."""
    kept = sorted((i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    w = len(kept[0][1]) // parts
    books = [[v[j * w : (j + 1) * w] for _, v, _ in kept[:entries]] for j in range(parts)]

    def find(j, p):
        return min((sum((a - b) ** 2 for a, b in zip(e, p)), k) for k, e in enumerate(books[j]))

    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, v, _ in kept:
            for j in range(parts):
                p = v[j * w : (j + 1) * w]
                held[j][find(j, p)[1]].append(p)
        books = [[[sum(c) // len(ps) for c in zip(*ps)] if ps else e for e, ps in zip(books[j], held[j])] for j in range(parts)]
    out = []
    for i, v, lab in kept:
        f = [find(j, v[j * w : (j + 1) * w]) for j in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), lab))
    total = {}
    for _, _, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, total[lab]) for i, c, e, lab in out), sha


def test_equals_plain_python(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 0.3, (40, 32)).astype(np.float32)
    rows = [(i, [float(np.float32(x)) for x in base[i % 40] + (rng.normal(0, 0.02, 32) if i % 3 else 0)], [None, 1, 2][i % 3] if i % 2 else 1) for i in range(300)]
    rows += [(900, None, 1), (901, [None] * 32, 1), (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, 2), (904, rows[7][1], 1), (904, rows[7][1], 1)]
    got = codes.compress(spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, sha = plain(rows)
    held = got.collect()
    assert sorted(tuple(r)[:4] for r in held) == want
    assert {r["codebooks_sha256"] for r in held} == {sha}


@pytest.mark.parametrize("width", [1, 3, 8])
def test_tree_finds_the_lowest_index_of_ties(width):
    rng = np.random.default_rng(width)
    for spread in (2, 5, 400):
        book = rng.integers(-spread, spread, (64, width))
        book[40:50] = book[:10]
        x = rng.integers(-2 * spread, 2 * spread, (500, width))
        index, far = codes.nearest(codes.kd_tree(book), book, x)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    same = np.zeros((64, width), np.int64)
    assert (codes.nearest(codes.kd_tree(same), same, x)[0] == 0).all()


def test_edges(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).count() == 0
    none = codes.compress(spark.createDataFrame([(1, None, 1, "", 0), (2, [], 1, "", 0), (3, [0.5] * 15, 1, "", 0)], SCHEMA))
    assert none.count() == 0
    few = codes.compress(spark.createDataFrame([(5, [0.5] * 16, None, "", 0), (4, [-0.001] * 16, None, "", 0), (None, [0.5] * 16, 3, "", 0), (6, [0.5] * 32, 1, "", 0)], SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["code"], r["error"]) for r in few) == [("4", "00" * 16, 0), ("5", "01" * 16, 0), ("None", "01" * 16, 0)]  # equal entries: the lower index
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 16, 1, "", 0)], SCHEMA)).collect()


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 0.2, 16)], 0, "", 0) for i in range(64)], SCHEMA)
    kept = codes.kept_rows(df)
    books = codes.fit(kept, rounds=0)
    back = {r["id"]: r["approx"] for r in codes.decode(codes.encode(kept, books), books).collect()}
    for r in df.collect():
        assert max(abs(a - b) for a, b in zip(r["embedding"], back[r["vec_id"]])) <= 0.5 / 256
