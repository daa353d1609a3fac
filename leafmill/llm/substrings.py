"""Exact removal of repeated word windows by seed and extend.

A window is `window` consecutive words of one document.  Each window has an anchor:
its k-gram with the smallest hash (the leftmost of equals), so equal windows have
equal anchors at equal offsets.  Neighbouring windows with the same anchor form its
context, the anchor extended both ways.

1. Contexts meet by anchor.  Every occurrence of a context but the first is a
   repeat: all its windows start earlier elsewhere.
2. Where an anchor has several contexts, each one's first occurrence may still share
   single windows with another.  There the match is cut out window by window, and
   these windows meet by their own hash.

An anchor with very many contexts (a common phrase in ever other surroundings) would
be one key that senders can't combine.  Such anchors are counted first; their contexts
meet by (anchor, context) instead and are all looked at window by window, as the
contexts of any anchor that has several are.

Senders drop what repeats within a block of documents, so that a passage in very
many documents reaches the receiving task once per block.  Windows are compared by
128 hash bits (anchor and context, or two hashes of the window).

Defined results: null or empty text has no words and an empty kept text; fewer words
than a window remove nothing.  Rows with one doc_id are one document: equal rows get
equal results, and none of them is earlier than the other.  An empty table stays so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import buckets
from leafmill.llm.common import small_batches, written
from leafmill.llm.textkit import buffers, grams, mix, pieces, slide_min_at, split_texts, starts_inside, word_hashes, words

WINDOW, ANCHOR = 20, 6
#: Contexts that a task combines before sending.
HELD = 500_000
#: Contexts of an anchor from which on they are dealt by themselves, and anchors so dealt, at most (8 bytes each, broadcast):
#: beyond that many, the first limit rises.
HOT_CONTEXTS, HOT_ANCHORS = 256, 1_000_000
_NO_ANCHORS = np.zeros(0, np.uint64)
_FLAG, _ROW = 0, 1
_KINDS = [[np.int64, np.int64, np.int64], [np.uint64, np.uint64, np.int64, np.int64]]
_SCHEMA = buckets.schema(4)


def contexts(h: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """anchor hash, context hash, document, first window's start and number of windows less 1, of all contexts."""
    at, doc = starts_inside(first, window)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    g = grams(h, k)
    low = slide_min_at(g, window - k + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    whole = grams(h, window, second=True)
    more = hi - lo
    # first and last window overlap, so they hold all words of the context
    ctx = mix(whole[at[lo]] * np.uint64(3) + mix(whole[at[hi]] + (more + 1).astype(np.uint64)))
    ctx = mix(ctx + (low[lo] - at[lo]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return g[low[lo]], ctx, doc[lo], at[lo] - first[doc[lo]], more


def repeats(key: np.ndarray, sub: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorting of the rows, which sorted rows repeat an earlier one, and which are firsts of their (key, sub)."""
    order = np.lexsort((at, doc, sub, key))
    key, sub, doc, at = key[order], sub[order], doc[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    same_place = (doc == doc[lead]) & (at == at[lead])
    return order, ~new & ~same_place, new


def _among(key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(key), bool)
    at = np.searchsorted(hot, key)
    at[at == len(hot)] = 0
    return hot[at] == key


def _send(n: int, hot: np.ndarray, key: np.ndarray, sub: np.ndarray, doc: np.ndarray, at: np.ndarray, span: np.ndarray) -> Iterator[pa.RecordBatch]:
    order, repeat, new = repeats(key, sub, doc, at)
    f = order[repeat]
    yield from _flags(n, doc[f], at[f], at[f] + span[f])
    k = order[new]
    meet = np.where(_among(key[k], hot), mix(key[k] ^ mix(sub[k])), key[k])
    yield from buckets.blocks(meet, n, _ROW, [key[k], sub[k], doc[k], at[k] * 4096 + span[k]])


def _flags(n: int, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Word spans [lo, hi) to remove; spans of a document that touch become one."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if len(doc):
        reach = _running_end(doc, hi)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
        s = np.flatnonzero(new)
        e = np.append(s[1:], len(doc)) - 1
        doc, lo, hi = doc[s], lo[s], reach[e]
        yield from buckets.blocks(mix(doc.view(np.uint64)), n, _FLAG, [doc, lo, hi], 4)


def _running_end(doc: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest end so far within the document."""
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) * (int(hi.max()) + 1)
    return np.maximum.accumulate(hi + group) - group


def _spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: int) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(doc), pa.array(lo), pa.array(hi)], ["kind", "doc_id", "lo", "hi"])


def _judge(batches: Iterator[pa.RecordBatch], window_level: bool, hot: np.ndarray = _NO_ANCHORS) -> Iterator[pa.RecordBatch]:
    """Per bucket: spans to remove (kind 0) and, by context, those to look at window by window (kind 1)."""
    for got in buckets.received(batches, _KINDS):
        if _FLAG in got:
            yield _spans(*got[_FLAG], 0)
        if _ROW not in got:
            continue
        key, sub, doc, packed = got[_ROW]
        at, span = packed // 4096, packed % 4096
        order, repeat, new = repeats(key, sub, doc, at)
        f = order[repeat]
        yield _spans(doc[f], at[f], at[f] + span[f], 0)
        if not window_level:
            lead = order[new]
            k = key[lead]
            several = _among(k, hot)
            several[1:] |= k[1:] == k[:-1]
            several[:-1] |= k[1:] == k[:-1]
            r = lead[several]
            yield _spans(doc[r], at[r], at[r] + span[r], 1)


def _hot_anchors(docs: DataFrame, rows: float, window: int, k: int) -> np.ndarray:
    """Anchors with many contexts, sorted; what a block of contexts has once isn't counted, so a key may have a row per block more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def several() -> pa.RecordBatch:
            key, sub = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((sub, key))
            key, sub = key[order], sub[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])
            key, n = np.unique(key[new], return_counts=True)
            key, n = key[n > 1], n[n > 1]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["anchor", "n"])

        for batch in batches:
            for part in pieces(batch, "text"):
                data, offs = buffers(part.column(0))
                s, e, first = words(data, offs)
                held.append(contexts(word_hashes(data, s, e), first, window, k)[:2])
                size += len(held[-1][0])
                if size >= HELD:
                    yield several()
                    held, size = [], 0
        if held:
            yield several()

    least = max(HOT_CONTEXTS, int(rows / HOT_ANCHORS))
    counts = docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).select("anchor").toArrow()
    return np.sort(found.column("anchor").to_numpy().astype(np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, lo, hi): word spans covered by windows that start earlier elsewhere; spans may overlap."""
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    rows = size / 6 * 2 / (window - anchor + 2)
    n = buckets.count_for(rows)
    source = docs.where("doc_id is not null")
    hot = _hot_anchors(source, rows, window, anchor)

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                data, offs = buffers(part.column(1))
                s, e, first = words(data, offs)
                key, ctx, doc, at, more = contexts(word_hashes(data, s, e), first, window, anchor)
                held.append((key, ctx, ids[doc], at, more + window))
                size += len(key)
                if size >= HELD:
                    yield from _send(n, hot, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from _send(n, hot, *map(np.concatenate, zip(*held)))

    spans = "kind int, doc_id long, lo long, hi long"
    first = buckets.exchange(source.mapInArrow(send_contexts, _SCHEMA), n).mapInArrow(lambda b: _judge(b, False, hot), spans)
    first = written(first, "spans")
    look = first.where("kind = 1").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("look"))

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                data, offs = buffers(part.column(1))
                s, e, first = words(data, offs)
                h = word_hashes(data, s, e)
                one, two = grams(h, window), grams(h, window, second=True)
                look = part.column(2)
                span = look.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.diff(look.offsets.to_numpy()))
                lo, hi = span.field(0).to_numpy(), span.field(1).to_numpy()
                # a document of another row with the same id may be shorter
                hi = np.minimum(hi, first[doc + 1] - first[doc])
                many = np.maximum(hi - lo - window + 1, 0)
                at = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                doc = np.repeat(doc, many)
                w = np.unique(first[doc] + at)
                doc = np.searchsorted(first, w, "right") - 1
                held.append((one[w], two[w], ids[doc], w - first[doc], np.full(len(w), window)))
                size += len(w)
                if size >= HELD:
                    yield from _send(n, _NO_ANCHORS, *map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from _send(n, _NO_ANCHORS, *map(np.concatenate, zip(*held)))

    wanted = source.join(look, "doc_id").select("doc_id", "text", "look")
    second = buckets.exchange(wanted.mapInArrow(send_windows, _SCHEMA), n).mapInArrow(lambda b: _judge(b, True), spans)
    return first.where("kind = 0").union(second).select("doc_id", "lo", "hi")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of every document."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = repeated_spans(source, window, anchor)
    gone = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n_words, n_removed, kept = [], [], []
                gone = part.column(2)
                offs = gone.offsets.to_numpy()
                span = gone.flatten()
                lo, hi = span.field(0).to_numpy().tolist(), span.field(1).to_numpy().tolist()
                base = int(offs[0])
                for text, a, b in zip(split_texts(part.column(1)), (offs[:-1] - base).tolist(), (offs[1:] - base).tolist()):
                    ws = text.split()
                    left, at = [], 0
                    for i in range(a, b):
                        left += ws[at : lo[i]]
                        at = max(at, hi[i])
                    left += ws[at:]
                    n_words.append(len(ws))
                    n_removed.append(len(ws) - len(left))
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    none = F.array().cast("array<struct<lo:long,hi:long>>")
    joined = source.join(gone, "doc_id", "left").select("doc_id", "text", F.coalesce("gone", none).alias("gone"))
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
