"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its hashed letter runs (ASCII case folded) and of their
first 4 to 7 bytes, which join the inflected forms of a word.  The machine
has a weight per term and a low-rank weight per pair of terms, so an insult next to
a group mention can count for more than the sum of both.  The terms it learns on
are those with the largest label contrast over the training rows.

Defined results: null and empty texts have no terms and get the model's base
score; without training rows of both labels the score is the share of label 1 (0
without rows).  Repeated rows get equal scores; an empty table stays empty.
Training may read a bounded sample: `max_train_rows` labelled rows in the order of a
hash of the id, whatever the layout of the files; the driver receives no more.  Terms
beyond the TERMS of the largest contrast have no weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches
from leafmill.llm.textkit import NOT_LETTER, buffers, pieces, prefix_hashes, words

MAX_TRAIN_ROWS = 40_000
HASH_BITS, TERMS, RANK, EPOCHS, BATCH = 20, 1024, 8, 40, 128
PREFIXES = (4, 5, 6, 7)


def term_sets(data: np.ndarray, offs: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) pairs, distinct and sorted; `slot` maps buckets to model terms, -1 to none."""
    s, e, first = words(data, offs, NOT_LETTER)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pairs = []
    for h in prefix_hashes(data, s, e, PREFIXES, lower=True):
        b = (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        if slot is None:
            pairs.append((doc << HASH_BITS) | b)
        else:
            b = slot[b]
            use = np.flatnonzero(b >= 0)
            pairs.append((doc[use] << HASH_BITS) | b[use])
    pair = np.unique(np.concatenate(pairs))
    return pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1)


class FactorizationMachine:
    """score(x) = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the present terms."""

    def __init__(self, buckets: np.ndarray, base: float = 0.0):
        self.slot = np.full(1 << HASH_BITS, -1, np.int32)
        self.slot[buckets] = np.arange(len(buckets))
        rng = np.random.default_rng(3)
        self.w0 = float(np.log(max(base, 1e-6) / max(1 - base, 1e-6)))
        self.w = np.zeros(len(buckets))
        self.v = rng.normal(0, 0.01, (len(buckets), RANK))

    def margin(self, doc: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[term]
        s = np.stack([np.bincount(doc, v[:, f], n) for f in range(RANK)], axis=1) if len(doc) else np.zeros((n, RANK))
        q = np.bincount(doc, (v * v).sum(axis=1), n) if len(doc) else np.zeros(n)
        linear = np.bincount(doc, self.w[term], n) if len(doc) else np.zeros(n)
        return self.w0 + linear + 0.5 * ((s * s).sum(axis=1) - q), s

    def fit(self, doc: np.ndarray, term: np.ndarray, y: np.ndarray, rate: float = 0.2, decay: float = 1e-5) -> None:
        """Adagrad on the logistic loss; rows in a fixed shuffled order."""
        rng = np.random.default_rng(4)
        first = np.searchsorted(doc, np.arange(len(y) + 1))
        g0, gw, gv = 1e-8, np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8)
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                rows = order[lo : lo + BATCH]
                n = first[rows + 1] - first[rows]
                d = np.repeat(np.arange(len(rows)), n)
                t = term[np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[rows], n)]
                m, s = self.margin(d, t, len(rows))
                err = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[rows]
                used, at = np.unique(t, return_inverse=True)
                dw = np.bincount(at, err[d], len(used)) / len(rows) + decay * self.w[used]
                pull = err[d][:, None] * (s[d] - self.v[t])
                dv = np.stack([np.bincount(at, pull[:, f], len(used)) for f in range(RANK)], axis=1) / len(rows) + decay * self.v[used]
                d0 = err.mean()
                g0 += d0 * d0
                gw[used] += dw * dw
                gv[used] += dv * dv
                self.w0 -= rate * d0 / np.sqrt(g0)
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= 0.2 * rate * dv / np.sqrt(gv[used])

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        m, _ = self.margin(*term_sets(data, offs, self.slot), n)
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS) -> FactorizationMachine:
    """A machine fitted to the labelled rows; several labels of one id count as their largest."""
    small_batches(docs.sparkSession)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(max_train_rows)
    # at most max_train_rows pairs of an id and a label: a bound that doesn't grow with the tables
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("y", "text", "id")

    def contrast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << HASH_BITS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                label = part.column(0).to_numpy(zero_copy_only=False)
                d, b = term_sets(*buffers(part.column(1)))
                for k in (0, 1):
                    seen[k] += np.bincount(b[label[d] == k], minlength=1 << HASH_BITS)
                    total[k] += int((label == k).sum())
        b = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *b.tolist()], pa.int32()), pa.array([total[0], *seen[0][b]]), pa.array([total[1], *seen[1][b]])], ["b", "n0", "n1"])

    sums = rows.mapInArrow(contrast, "b int, n0 long, n1 long").groupBy("b").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    held = sums.where("b < 0").collect()
    n0, n1 = (held[0]["n0"], held[0]["n1"]) if held else (0, 0)
    base = n1 / max(n0 + n1, 1)
    if not n0 or not n1:
        machine = FactorizationMachine(np.zeros(0, np.int64))
        machine.w0 = 30.0 if n1 else -30.0
        return machine
    a, b, c, d = F.col("n1"), F.col("n0"), F.lit(float(n1)) - F.col("n1"), F.lit(float(n0)) - F.col("n0")
    chi = F.pow(a * d - b * c, 2) / ((a + b) * (c + d) + 1)
    top = [r["b"] for r in sums.where("b >= 0").orderBy(chi.desc(), "b").limit(TERMS).collect()]
    machine = FactorizationMachine(np.array(sorted(top), np.int64), base)
    slot = machine.slot

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                d, t = term_sets(*buffers(part.column(1)), slot)
                offs = np.searchsorted(d, np.arange(part.num_rows + 1)).astype(np.int32)
                terms = pa.ListArray.from_arrays(pa.array(offs), pa.array(t.astype(np.int16)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), terms], ["y", "id", "terms"])

    # sorted, so that the fit doesn't depend on the layout; ids may repeat in docs, so the bound is set here
    each = rows.mapInArrow(design, f"y int, id {dict(rows.dtypes)['id']}, terms array<smallint>")
    got = each.orderBy(F.xxhash64("id", F.lit(7)), "id", "terms").limit(max_train_rows).select("y", "terms").toArrow()
    terms = got.column("terms").combine_chunks()
    n = np.diff(terms.offsets.to_numpy())
    machine.fit(np.repeat(np.arange(len(n)), n), terms.flatten().to_numpy().astype(np.int64), got.column("y").to_numpy().astype(float))
    return machine


def score(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", *extra: Column) -> DataFrame:
    """The `extra` columns and the score of each row; a map without shuffle."""
    small_batches(docs.sparkSession)
    given = docs.select(F.col(text_col), *extra)
    source = given.toDF(*(f"c{i}" for i in range(len(given.columns))))  # any names may be given, repeated ones too
    names = source.columns[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "c0"):
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(machine.score(*buffers(part.column(0))))], [*names, "score"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(run, ", ".join([*fields, "score double"])).toDF(*given.columns[1:], "score")
