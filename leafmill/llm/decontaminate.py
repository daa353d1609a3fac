"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. One scan counts, for each seed (n consecutive words of an item), the documents that
   hold it.  Rare seeds are judged against the item's own: those in at most `rarer`
   times as many documents (and one) as the lower quartile of its seeds.  So the rarest
   quarter of an item's seeds always counts, however often the item is copied, and a
   phrase that many items and documents share brings no pair that only it would.
2. One scan finds seed hits by bitmaps of the seeds' hashes, one for each power of
   two of the items' lengths, so that the passage cut out around a hit is as wide as
   items of that length need.  Bitmaps are of fixed size, whatever the benchmark's.
3. Seeds join passages to items.  Each distinct (passage, item) is aligned once by
   Smith-Waterman over words, however many documents hold the passage.

A pair counts if its score reaches `min_score` of the best possible score of the
item, or of `long_words` words of an item that is longer: part of a long item counts.
Words are compared with ASCII case folded and punctuation at their ends dropped.
An item shorter than a seed has one seed, all its words.

Defined results: null or empty texts and items match nothing; repeated items give a
row each under their own id; repeated documents share a row; rows with a null
document id share one as well; an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import narrow, small_batches, written
from leafmill.llm.textkit import NOT_LETTER, buffers, grams, pieces, starts_inside, word_hashes, words

SEED_WORDS = 4
MIN_SCORE = 0.6
#: How many times the documents of the item's lower quartile a rare seed may be in.
RARER = 10
#: Words of a longer item that are enough.
LONG_WORDS = 80
#: Pairs that a task aligns, about.
TASK_PAIRS = 2_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the seed bitmap: 2 MB, whatever the benchmark holds.
MAP_BITS = 24

# digits count as parts of words
_APART = NOT_LETTER.copy()
_APART[48:58] = False


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, first = words(data, offs, _APART)
    return s, e, first, word_hashes(data, s, e, lower=True)


def seed_rows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start word, document) of the runs of n words within one document."""
    g = grams(h, n)
    at, doc = starts_inside(first, n)
    return g[at], at, doc


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word sequences: score and the span it covers in b.

    Anti-diagonals are computed at once, and only three of them are kept.
    """
    n, m = len(a), len(b)
    best = (0, 0, 0)
    if not n or not m:
        return best
    s2, s1 = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    o2, o1 = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    o1[:] = 1 - np.arange(n + 1)  # cell (i, j) of diagonal d = i + j starts at j
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        diag = s2[i - 1] + np.where(a[i - 1] == b[j - 1], MATCH, MISMATCH)
        up, left = s1[i - 1] + GAP, s1[i] + GAP
        top = np.maximum(np.maximum(diag, up), np.maximum(left, 0))
        s0, o0 = np.zeros(n + 1, np.int32), d - np.arange(n + 1)
        s0[i] = top
        fresh = s2[i - 1] == 0
        start = np.where(fresh, j - 1, o2[i - 1])
        o0[i] = np.where(top == diag, start, np.where(top == up, o1[i - 1], o1[i]))
        k = int(top.argmax())
        if top[k] > best[0]:
            best = (int(top[k]), int(o0[i[k]]), int(j[k]))
        s2, s1, o2, o1 = s1, s0, o1, o0
    return best


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be one that the bitmap was made of."""
    k = _slots(h)
    return (bits[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & np.uint8(1) != 0


def _bitmaps(hashes: DataFrame) -> dict[int, np.ndarray]:
    """A bitmap of the `h` of each `kind`, of a fixed size: the driver receives slots, not hashes."""
    slot = F.shiftrightunsigned("h", 64 - MAP_BITS).cast("int")
    got = hashes.select("kind", slot.alias("slot")).distinct().toArrow()  # at most 2**MAP_BITS a kind
    kind, slot = got.column("kind").to_numpy(), got.column("slot").to_numpy()
    out = {}
    for k in np.unique(kind).tolist():
        flags = np.zeros(1 << MAP_BITS, bool)
        flags[slot[kind == k]] = True
        out[int(k)] = np.packbits(flags)
    return out


def _item_tables(bench: DataFrame, seed_words: int) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, words) per item with words, and (item, n, width, seed) per seed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, first, h = tokens(*buffers(batch.column(1)))
            kept = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), kept], ["item_id", "words"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("item", pa.int64()), ("n", pa.int32()), ("width", pa.int32()), ("seed", pa.int64())]
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(1)[i].values.to_numpy().view(np.uint64)
                n = min(seed_words, len(own))
                g = np.unique(grams(own, n))
                same = lambda x, t: pa.array(np.full(len(g), x), t)  # noqa: B023, E731
                width = max(5, int(len(own) - 1).bit_length())
                yield pa.RecordBatch.from_arrays([same(batch.column(0)[i].as_py(), pa.int64()), same(n, pa.int32()), same(width, pa.int32()), pa.array(g.view(np.int64))], schema=pa.schema(kinds))

    items = bench.mapInArrow(whole, "item_id long, words array<long>").where(F.size("words") > 0)
    items = written(items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words").distinct(), "items")
    return items, written(items.select("item", "words").mapInArrow(cut, "item long, n int, width int, seed long"), "seeds")


def _rare(source: DataFrame, seeds: DataFrame, rarer: int) -> DataFrame:
    """The seeds to look for: those that are rare among the seeds of their item."""
    bits = _bitmaps(seeds.select(F.col("n").alias("kind"), F.col("seed").alias("h")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                _, _, first, h = tokens(*buffers(part.column(0)))
                for n, known in bits.items():
                    g, _, doc = seed_rows(h, first, n)
                    k = np.flatnonzero(_maybe(known, g))
                    pairs = np.unique(np.stack([doc[k].astype(np.uint64), g[k]], axis=1), axis=0) if len(k) else np.zeros((0, 2), np.uint64)
                    seed, docs = np.unique(pairs[:, 1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seed), n, np.int32)), pa.array(seed.view(np.int64)), pa.array(docs)], ["n", "seed", "docs"])

    seen = source.select("text").mapInArrow(count, "n int, seed long, docs long").groupBy("n", "seed").agg(F.sum("docs").alias("docs"))
    # bitmaps let other n-grams pass: only seeds themselves are kept
    known = written(seen.join(seeds.select("n", "seed").distinct(), ["n", "seed"], "left_semi"), "seed-counts")
    counted = seeds.select("item", "n", "width", "seed").join(narrow(known), ["n", "seed"], "left").fillna(0, ["docs"])
    usual = counted.groupBy("item").agg(F.percentile("docs", F.lit(0.25)).alias("quartile"))
    kept = counted.join(usual, "item").where(F.col("docs") <= rarer * (F.col("quartile") + 1))
    return written(kept.select("item", "n", "width", "seed"), "rare-seeds")


def _passages(source: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, at, width, passage, same, seeds): what surrounds the hits of seeds of items up to 2**width words."""
    kinds = [(r["n"], r["width"]) for r in seeds.select("n", "width").distinct().collect()]  # at most seed_words x 27
    bits = _bitmaps(seeds.select((F.col("width") * 1000 + F.col("n")).alias("kind"), F.col("seed").alias("h")))
    many = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("width", pa.int32()), ("passage", many), ("seeds", many)])

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                _, _, first, h = tokens(*buffers(part.column(1)))
                ids, rows = part.column(0).to_pylist(), []
                of_length = {n: seed_rows(h, first, n) for n in {n for n, _ in kinds}}
                for width in sorted({w for _, w in kinds}):
                    found = []
                    for n in (n for n, w in kinds if w == width):
                        g, at, doc = of_length[n]
                        k = np.flatnonzero(_maybe(bits[width * 1000 + n], g))
                        found.append(np.stack([doc[k], at[k], g[k].view(np.int64)], axis=1))
                    found = np.concatenate(found)
                    found = found[np.lexsort((found[:, 1], found[:, 0]))]
                    reach, lo = int(1.5 * (1 << width)) + 8, 0
                    while lo < len(found):
                        d, hi = found[lo, 0], lo + 1
                        # hits whose surroundings touch share a passage
                        while hi < len(found) and found[hi, 0] == d and found[hi, 1] - found[hi - 1, 1] <= 2 * reach:
                            hi += 1
                        s = max(first[d], found[lo, 1] - reach)
                        e = min(first[d + 1], found[hi - 1, 1] + reach)
                        rows.append({"doc_id": ids[d], "at": int(s - first[d]), "width": width, "passage": h[s:e].view(np.int64), "seeds": np.unique(found[lo:hi, 2])})
                        lo = hi
                for lo in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 256], schema)

    found = source.mapInArrow(hits, "doc_id long, at long, width int, passage array<long>, seeds array<long>")
    return written(found.withColumn("same", F.xxhash64("passage")), "passages")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS, min_score: float = MIN_SCORE, rarer: int = RARER, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each item in each document, where it counts.

    `score` is the share of the best possible score (of long_words words of a longer item, 1 at most);
    words count from 0, the end is exclusive.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    table, seeds = _item_tables(bench, seed_words)
    if not table.head(1):
        return spark.createDataFrame([], schema)
    seeds = _rare(source, seeds, rarer)
    passages = _passages(source, seeds)

    # only ids meet by seed; hot passages and seeds are rows of ids, and each distinct case is aligned once
    by_seed = narrow(written(seeds.select("seed", "width", "item").distinct(), "by-seed"))
    links = passages.select("doc_id", "at", "same", "width", F.explode("seeds").alias("seed")).join(by_seed, ["seed", "width"]).select("doc_id", "at", "same", "item").distinct()
    links = written(links, "links")
    cases = written(links.select("same", "item").distinct(), "cases")
    texts = passages.groupBy("same").agg(F.first("passage").alias("passage"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cases.count() // TASK_PAIRS))
    # dealt by hashes in a stated number, so that small rows of much work aren't put together
    dealt = cases.join(texts, "same").join(table.select("item", "words"), "item").repartition(n, "same", "item")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("same", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("s", pa.int64()), ("e", pa.int64())])
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                b, a = (batch.column(k)[i].values.to_numpy() for k in (2, 3))
                best = MATCH * min(len(a), long_words)
                got, s, e = align(a, b)
                if got >= min_score * best:
                    rows.append({"same": batch.column(0)[i].as_py(), "item": batch.column(1)[i].as_py(), "score": min(1.0, got / best), "s": s, "e": e})
            yield pa.RecordBatch.from_pylist(rows, out)

    aligned = dealt.select("same", "item", "passage", "words").mapInArrow(score, "same long, item long, score double, s long, e long")
    aligned = narrow(written(aligned, "aligned"))
    found = links.join(aligned, ["same", "item"]).join(narrow(table.select("item", "item_id")), "item")
    found = found.select("doc_id", "item_id", "score", (F.col("at") + F.col("s")).alias("start_word"), (F.col("at") + F.col("e")).alias("end_word"))
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
