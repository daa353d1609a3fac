"""N-gram Jaccard join by T-occurrence search, and the groups of linked documents.

A document is its set of distinct word shingles.  Two documents link when
100 * |A and B| >= percent * |A or B|.  Equal sets are one class from the start.

1. Candidates.  Under a global order of shingles, linked sets share at least l of
   the shingles in their prefixes of length n - ceil(percent*n) + l.  The order puts
   shingles that are frequent in the corpus last (frequent in some block of
   documents, the counts added up over all of them), so prefixes hold rare ones.  A
   class that shares fewer prefix shingles than any partner would need is out.
   Senders hang the classes of their block that share a shingle on a hub and pass on
   one hub per shingle, so a frequent shingle costs at most a row per block.
   A second round, for the documents left, orders shingles by their exact counts;
   shingles of very many documents are counted ahead, so that none is gathered.
2. The candidate graph's components hold all links.  A small component is a task.
3. A large one is cut by the sets' sizes (linked sets are of the same class of sizes or
   of neighbouring ones) and by a hash.  Each block is compared with a few leaders of
   its own, in time linear in its sets; the blocks' leaders then meet.  Only the sets
   outside the component's largest group so linked are queries against all its blocks
   of their sizes, so a group of near copies is never compared pair by pair.
   Within a task, T-occurrence search: per query the longest inverted lists are set
   aside (DivideSkip), the short ones are merged through a heap, and candidates with
   enough occurrences are probed in the long lists by binary search; those that reach
   the overlap T are links.  Only connectivity is returned, so pairs that are already
   connected aren't probed.
4. The links' components give each document's smallest reachable id.

Defined results: null or blank text has an empty set and stays alone; fewer words
than a shingle make one shingle of all words; rows with one doc_id are one document;
an empty table stays empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import buckets
from leafmill.llm.common import narrow, small_batches, written
from leafmill.llm.graph import components
from leafmill.llm.textkit import buffers, give_back, grams, mix, pieces, starts_inside, word_hashes, words

SHINGLE, PERCENT = 5, 80
#: A shingle is frequent if a block of documents has it so often; so many of the most frequent are ranked, a bound
#: that doesn't grow with the corpus (the order changes the work only, never the result).
FREQUENT, RANKED = 3, 400_000
#: Prefix shingles that linked sets share at least, as a share of the set: in the first round, over all documents,
#: and in the second, over those that are left.
SHARED, SHARED_AGAIN = 0.05, 0.1
#: Shingles and sets of one block in the search.
BLOCK_SHINGLES, BLOCK_SETS = 200_000, 512
#: Leaders that a block passes on.
LEADERS = 8
#: Documents from which on a shingle is counted ahead in the second round, and shingles so counted, at most (16 bytes each,
#: broadcast): beyond that many, the first limit rises.
HOT_DOCS, HOT_SHINGLES = 2_000, 500_000
#: Prefix rows that a task combines before sending.
HELD = 800_000


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents and where each document's begin."""
    s, e, first = words(data, offs)
    h = word_hashes(data, s, e, lower=True)
    n_words = np.diff(first)
    at, doc = starts_inside(first, size)
    g = grams(h, size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    if len(short):
        alone = np.array([mix(grams(h[first[d] : first[d + 1]], int(n_words[d])) + np.uint64(n_words[d]))[0] for d in short], np.uint64)
        g, doc = np.concatenate([g, alone]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return g, np.searchsorted(doc, np.arange(len(offs)))


def signatures(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    out = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)):
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g ^ salt), dtype=np.uint64)])
        out.append(mix(acc[first[1:]] - acc[first[:-1]] + np.diff(first).astype(np.uint64) * salt))
    return out[0], out[1]


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares with any linked one at least."""
    return -(-n * percent // 100)


def least_shared(n: np.ndarray, share: float) -> np.ndarray:
    return np.maximum(1, np.floor(n * share + 1e-9).astype(np.int64))


def _facts(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: doc_id, n, s1, s2 per document; kind 1: shingles frequent in a block of documents (s1) and their counts (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["kind", "doc_id", "n", "s1", "s2"]

        def frequent() -> pa.RecordBatch:
            g, c = np.unique(np.concatenate(held), return_counts=True)
            k = c >= FREQUENT
            g, c = g[k], c[k]
            zero = np.zeros(len(g), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(g), np.int32)), pa.array(zero), pa.array(c.astype(np.int64)), pa.array(g.view(np.int64)), pa.array(zero)], names)

        for batch in batches:
            for part in pieces(batch, "text"):
                g, first = shingle_sets(*buffers(part.column(1)), size)
                s1, s2 = signatures(g, first)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.num_rows, np.int32)), part.column(0), pa.array(np.diff(first)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64))], names)
                held.append(g)
                if sum(map(len, held)) > 3_000_000:
                    yield frequent()
                    held.clear()
        if held:
            yield frequent()
        give_back()

    return written(docs.mapInArrow(run, "kind int, doc_id long, n long, s1 long, s2 long"), "sets")


def _prefixes(g: np.ndarray, first: np.ndarray, hot: np.ndarray, df: np.ndarray, percent: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Prefix shingles of each set under the global order, and the set of each."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank = np.zeros(len(g), np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        rank = np.where(hot[at] == g, df[at], 0)
        order = np.lexsort((g, rank, doc))
        g = g[order]
    n = np.diff(first)
    length = np.minimum(n, n - least_overlap(n, percent) + least_shared(n, share))
    place = np.arange(len(g)) - first[doc]
    use = place < length[doc]
    return g[use], doc[use]


def _combine(token: np.ndarray, node: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges (node, hub, own tokens, whether node is a hub) and one row per token left.

    The nodes that share a token hang on a hub named by a hash of these nodes, so
    tokens shared by the same nodes make one hub, and a hub connects only nodes that
    do share a token.
    """
    order = np.lexsort((node, token))
    token, node, hub = token[order], node[order], hub[order]
    once = np.ones(len(token), bool)  # equal sets of several blocks count as one
    once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node, hub = token[once], node[once], hub[once]
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(token)))
    name = np.add.reduceat(mix(node.view(np.uint64)), start) if len(start) else np.zeros(0, np.uint64)
    name = mix(name + size.astype(np.uint64)).view(np.int64)
    shared = size > 1
    e = np.flatnonzero(np.repeat(shared, size))
    a, b, h = node[e], np.repeat(name, size)[e], hub[e]
    order = np.lexsort((b, a))
    a, b, h = a[order], b[order], h[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    own = np.where(h[at], 0, np.diff(np.append(at, len(a))))
    return a[at], b[at], own, h[at], token[start], np.where(shared, name, node[start]), hub[start] | shared


_EDGE, _TOKEN = 0, 1
_COLUMNS = [[np.int64, np.int64, np.int64], [np.uint64, np.int64, np.int64]]


_EDGES = "a long, b long, c long, hub boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in buckets.received(batches, _COLUMNS):
        out = []
        if _EDGE in got:
            a, b, packed = got[_EDGE]
            out.append((a, b, packed // 2, (packed % 2).astype(bool)))
        if _TOKEN in got:
            token, node, is_hub = got[_TOKEN]
            out.append(_combine(token, node, is_hub.astype(bool))[:4])
        for a, b, c, hub in out:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(hub)], ["a", "b", "c", "hub"])


def _candidate_edges(docs: DataFrame, n_buckets: int, hot: np.ndarray, df: np.ndarray, size: int, percent: int, share: float) -> DataFrame:
    """(a, b, c, hub): class (or, if hub, hub) a hangs on hub b by c prefix shingles."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            token, node = (np.concatenate(x) for x in zip(*held))
            a, b, c, hub, token, node, is_hub = _combine(token, node, np.zeros(len(token), bool))
            yield from buckets.blocks(mix(a.view(np.uint64)), n_buckets, _EDGE, [a, b, c * 2 + hub])
            yield from buckets.blocks(token, n_buckets, _TOKEN, [token, node, is_hub.astype(np.int64)])

        for batch in batches:
            for part in pieces(batch, "text"):
                g, first = shingle_sets(*buffers(part.column(0)), size)
                s1 = signatures(g, first)[0].view(np.int64)
                t, d = _prefixes(g, first, hot, df, percent, share)
                fresh = np.array([x not in seen for x in s1.tolist()], bool)  # equal sets are sent once
                seen.update(s1.tolist())
                use = fresh[d] if len(d) else np.zeros(0, bool)
                held.append((t[use], s1[d[use]]))
                rows += int(use.sum())
                if rows >= HELD:
                    yield from flush()
                    held, rows, seen = [], 0, set()
        if rows:
            yield from flush()
        give_back()

    sent = docs.select("text").mapInArrow(send, buckets.schema(3))
    return written(buckets.exchange(sent, n_buckets).mapInArrow(_meet, _EDGES), "candidates")


_NODE, _HOT = 2, 3


def _exact_edges(docs: DataFrame, n_buckets: int, size: int, percent: int, share: float, hot: np.ndarray, df_hot: np.ndarray) -> DataFrame:
    """Edges as from _candidate_edges(), with the exact frequencies among these documents as the order.

    Rows go by shingle to be counted, by class to choose its rarest shingles, and by
    shingle again to meet, on hubs.  The rows of `hot` shingles go to their class at once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            token, node = (np.concatenate(x) for x in zip(*held))
            at = np.minimum(np.searchsorted(hot, token), max(len(hot) - 1, 0))
            known = hot[at] == token if len(hot) else np.zeros(len(token), bool)
            if known.any():
                yield from buckets.blocks(mix(node[known].view(np.uint64)), n_buckets, _HOT, [token[known], node[known], df_hot[at[known]]], 3)
            token, node = token[~known], node[~known]
            yield from buckets.blocks(token, n_buckets, _TOKEN, [token, node], 3)

        for batch in batches:
            for part in pieces(batch, "text"):
                g, first = shingle_sets(*buffers(part.column(0)), size)
                s1 = signatures(g, first)[0].view(np.int64)
                n = np.diff(first)
                yield from buckets.blocks(mix(s1.view(np.uint64)), n_buckets, _NODE, [s1, n], 3)
                held.append((g, np.repeat(s1, n)))
                rows += len(g)
                if rows >= HELD:
                    yield from flush()
                    held, rows = [], 0
        if rows:
            yield from flush()
        give_back()

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in buckets.received(batches, [[], [np.uint64, np.int64], [np.int64, np.int64], [np.uint64, np.int64, np.int64]]):
            if _HOT in got:
                yield from buckets.blocks(mix(got[_HOT][1].view(np.uint64)), n_buckets, _TOKEN, got[_HOT], 3)
            if _NODE in got:
                yield from buckets.blocks(mix(got[_NODE][0].view(np.uint64)), n_buckets, _NODE, got[_NODE], 3)
            if _TOKEN in got:
                token, node = got[_TOKEN]
                order = np.lexsort((node, token))
                token, node = token[order], node[order]
                once = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
                token, node = token[once], node[once]
                start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                df = np.diff(np.append(start, len(token)))
                df = np.repeat(df, df)
                k = df > 1  # a shingle of one class needs no exchange: the class knows how many it has
                yield from buckets.blocks(mix(node[k].view(np.uint64)), n_buckets, _TOKEN, [token[k], node[k], df[k]], 3)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in buckets.received(batches, [[], [np.uint64, np.int64, np.int64], [np.int64, np.int64]]):
            if _TOKEN not in got or _NODE not in got:
                continue
            token, node, df = got[_TOKEN]
            order = np.lexsort((token, df, node))
            token, node = token[order], node[order]
            once = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))  # rows of one id may repeat
            token, node = token[once], node[once]
            start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            have = np.diff(np.append(start, len(node)))
            known, at = np.unique(got[_NODE][0], return_index=True)
            n = got[_NODE][1][at][np.searchsorted(known, node[start])]
            length = np.minimum(n, n - least_overlap(n, percent) + least_shared(n, share)) - (n - have)
            use = np.arange(len(node)) - np.repeat(start, have) < np.repeat(length, have)
            a, b, c, hub, token, node, is_hub = _combine(token[use], node[use], np.zeros(int(use.sum()), bool))
            yield from buckets.blocks(mix(a.view(np.uint64)), n_buckets, _EDGE, [a, b, c * 2 + hub])
            yield from buckets.blocks(token, n_buckets, _TOKEN, [token, node, is_hub.astype(np.int64)])

    schema = buckets.schema(3)
    counted = buckets.exchange(docs.select("text").mapInArrow(count, schema), n_buckets).mapInArrow(regroup, schema)
    chosen = buckets.exchange(counted, n_buckets).mapInArrow(choose, schema)
    return written(buckets.exchange(chosen, n_buckets).mapInArrow(_meet, _EDGES), "candidates")


class Lists:
    """Inverted lists of a group of sets: for each shingle of `least` sets or more, the sets that hold it, ascending.

    Queries that are sets of the group need lists of two sets; others need all.
    """

    def __init__(self, sets: list[np.ndarray], least: int = 2):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        cut = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        size = np.diff(np.append(cut, len(flat)))
        keep = size >= least
        self.token, self.start, self.size, self.owner = flat[cut[keep]], cut[keep], size[keep], owner
        self.n = len(sets)
        # (list, set) as one number: ascending, so that a probe of any list is a binary search in this array
        inside = np.repeat(keep, size)
        self.pairs = np.repeat(np.arange(len(self.token), dtype=np.int64), self.size) * self.n + owner[inside]

    def of(self, query: np.ndarray) -> np.ndarray:
        """The query's lists, shortest first."""
        if not len(self.token):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.token, query)
        at[at == len(self.token)] = 0
        at = at[self.token[at] == query]
        return at[np.argsort(self.size[at], kind="stable")]

    def divide_skip(self, query: np.ndarray, need: int, known: Callable[[int], bool] = lambda c: False) -> Iterator[int]:
        """Sets that share `need` shingles or more with the query, and of which nothing is known yet.

        The longest lists are set aside; a candidate must occur need - len(long) times
        in the short ones, which are merged through a heap, and is then sought in the
        long ones by binary search.
        """
        at = self.of(query)
        if not len(at) or len(at) < need:
            return
        aside = min(need - 1, int(need / (0.0085 * np.log2(self.size[at[-1]] + 1) + 1)))
        short, long = at[: len(at) - aside], at[len(at) - aside :] * self.n
        lists = [self.owner[s : s + k].tolist() for s, k in zip(self.start[short].tolist(), self.size[short].tolist())]
        for candidate, same in groupby(heapq.merge(*lists)):
            count = sum(1 for _ in same)
            if count < need - aside or known(candidate):
                continue
            if count < need and aside:
                probe = long + candidate
                found = np.minimum(np.searchsorted(self.pairs, probe), len(self.pairs) - 1)
                count += int((self.pairs[found] == probe).sum())
            if count >= need:
                yield candidate


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def connect(sets: list[np.ndarray], percent: int, full: bool = True) -> tuple[np.ndarray, list[int]]:
    """Root index of each set under its links, sets in ascending order of size, and the busiest leaders.

    Not `full`: under links with leaders only.
    """
    n = len(sets)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = [len(s) for s in sets]

    def linked(i: int, j: int) -> bool:
        small, large = sorted((size[i], size[j]))
        return small * 100 >= percent * large and _linked(_overlap(sets[i], sets[j]), small, large, percent)

    # sets that link with a leader join it at once; what is left is searched in full
    followers: dict[int, int] = {}
    for i in range(n):
        busy = sorted(followers, key=lambda j: (-followers[j], -j))[:8]
        for j in busy + [j for j in list(followers)[-4:] if j not in busy]:
            if linked(i, j):
                root[i] = find(j)
                followers[j] += 1
                break
        else:
            followers[i] = 0
            if len(followers) > 64:  # the oldest leaders without followers go
                del followers[next((j for j in followers if not followers[j]), next(iter(followers)))]
    roots = np.array([find(i) for i in range(n)])
    busy = sorted(followers, key=lambda j: (-followers[j], j))[:LEADERS]
    if full and len(set(roots.tolist())) > 1:
        # a pair that isn't connected has a member outside the largest component
        largest = np.bincount(roots).argmax()
        lists = Lists(sets)
        for q in np.flatnonzero(roots != largest).tolist():
            # T grows with the candidate's size; the smallest possible one serves the merge
            small = -(-size[q] * percent // 100)
            need = -(-percent * (size[q] + small) // (100 + percent))
            for c in lists.divide_skip(sets[q], need, lambda c: find(c) == find(q)):  # noqa: B023
                if linked(q, c):
                    root[find(c)] = find(q)
        roots = np.array([find(i) for i in range(n)])
    return roots, busy


def probe(queries: list[np.ndarray], sets: list[np.ndarray], of_query: list[int], of_set: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (query, set) that connect different groups, one for each two groups that they connect."""
    lists, root = Lists(sets, least=1), {}

    def find(g: int) -> int:
        while root.get(g, g) != g:
            root[g] = root.get(root[g], root[g])
            g = root[g]
        return g

    out = []
    for i, q in enumerate(queries):
        small = -(-len(q) * percent // 100)
        need = -(-percent * (len(q) + small) // (100 + percent))
        for c in lists.divide_skip(q, need, lambda c: find(of_set[c]) == find(of_query[i])):  # noqa: B023
            if find(of_set[c]) != find(of_query[i]) and _linked(_overlap(q, sets[c]), len(q), len(sets[c]), percent):
                root[find(of_set[c])] = find(of_query[i])
                out.append((i, c))
    return out


#: Tasks: a whole component or the leaders of one; a block of a large one; queries against a block.
_WHOLE, _BLOCK, _PROBE = "whole", "block", "probe"
_LINK, _LEADER = 0, 1


def links(docs: DataFrame, places: DataFrame, size: int, percent: int) -> DataFrame:
    """(kind, a, b): connections a-b found in the tasks of `places` (doc_id, task, grp, query), and blocks' leaders a."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                g, first = shingle_sets(*buffers(part.column(1)), size)
                at = (first * 8).tolist()
                raw = g.tobytes()
                sets = pa.array([raw[i:j] for i, j in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["doc_id", "shingles"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def done() -> pa.RecordBatch:
            rows.sort(key=lambda r: (len(r[3]), r[0]))
            ids, groups, queries, sets = zip(*rows)
            own, leaders = np.array(ids), []
            if now.startswith(_PROBE):
                q = [i for i, x in enumerate(queries) if x]
                t = [i for i, x in enumerate(queries) if not x]
                found = probe([sets[i] for i in q], [sets[i] for i in t], [groups[i] for i in q], [groups[i] for i in t], percent) if t else []
                a, b = own[[q[i] for i, _ in found]], own[[t[j] for _, j in found]]
            else:
                roots, leaders = connect(list(sets), percent, now.startswith(_WHOLE))
                k = roots != np.arange(len(own))
                a, b = own[k], own[roots[k]]
                leaders = own[leaders] if now.startswith(_BLOCK) else []
            kind = np.repeat(np.array([_LINK, _LEADER], np.int32), [len(a), len(leaders)])
            return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.append(a, leaders).astype(np.int64)), pa.array(np.append(b, leaders).astype(np.int64))], ["kind", "a", "b"])

        for batch in batches:
            raw = batch.column(4)
            for i, (t, d, g, q) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
                if t != now and rows:
                    yield done()
                    rows = []
                now = t
                rows.append((d, g, q, np.frombuffer(raw[i].as_buffer(), np.uint64).copy()))
        if rows:
            yield done()
        give_back()

    places = written(places.select("doc_id", "task", "grp", "query"), "places")
    wanted = docs.join(narrow(written(places.select("doc_id").distinct(), "ids")), "doc_id", "left_semi")
    sets = written(wanted.select("doc_id", "text").mapInArrow(to_sets, "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "sets-left")
    # a stated number of partitions, so that few bytes of much work aren't put together
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-places.count() // BLOCK_SETS)))
    dealt = narrow(places).join(sets, "doc_id").select("task", "doc_id", "grp", "query", "shingles")
    return written(dealt.repartition(n, "task").sortWithinPartitions("task").mapInArrow(search, "kind int, a long, b long"), "links")


def _found(docs: DataFrame, placed: DataFrame, size: int, percent: int) -> DataFrame:
    """Connections a-b of all links between the candidates (rep, n, component)."""
    over = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    large = written(placed.groupBy("component").agg(over.alias("blocks")).where("blocks > 1").select("component"), "large")
    own = lambda task: (F.col("rep").alias("doc_id"), task.alias("task"), F.col("rep").alias("grp"), F.lit(False).alias("query"))
    whole = placed.join(narrow(large), "component", "left_anti").select(*own(F.concat_ws(":", F.lit(_WHOLE), "component")))
    # sets that link differ by a class of sizes at most: neighbouring classes are a factor of 100 / percent apart
    rank = F.floor(F.log("n") / float(np.log(100 / percent)) + 1e-9).cast("int") if 0 < percent < 100 else F.col("n").cast("int")
    sized = written(placed.join(narrow(large), "component", "left_semi").withColumn("z", rank), "large-sets")
    if not sized.head(1):
        return links(docs, whole, size, percent).where(F.col("kind") == _LINK).select("a", "b")

    def cut(rows: DataFrame, name: str) -> DataFrame:
        """The component's number of blocks in each class of sizes, as a map."""
        per = rows.groupBy("component", "z").agg(over.alias("blocks"))
        return per.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("z", "blocks"))).alias(name))

    blocks = written(cut(sized, "blocks"), "blocks")
    at = written(sized.join(narrow(blocks), "component").withColumn("i", F.pmod(F.xxhash64("rep"), F.col("blocks")[F.col("z")]).cast("int")), "large-blocks")
    first = links(docs, whole.union(at.select(*own(F.concat_ws(":", F.lit(_BLOCK), "component", "z", "i")))), size, percent)
    heads = at.join(first.where(F.col("kind") == _LEADER).select(F.col("a").alias("rep")).distinct(), "rep")
    several = heads.groupBy("component").agg(over.alias("parts"))
    heads = heads.join(several, "component").select(*own(F.concat_ws(":", F.lit(_WHOLE), F.lit("leaders"), "component", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")))))
    found = first.where(F.col("kind") == _LINK).select("a", "b").union(links(docs, heads, size, percent).where(F.col("kind") == _LINK).select("a", "b"))
    found = written(found, "links-by-leaders")

    groups_ = components(found)
    grouped = written(at.join(groups_, at.rep == groups_.node, "left").withColumn("grp", F.coalesce(groups_.component, "rep")).select(at.component, "rep", "n", "z", "i", "grp"), "grouped")
    counts = grouped.groupBy("component", "grp").agg(F.count("*").alias("k"))
    main = written(counts.groupBy("component").agg(F.max_by("grp", F.struct("k", "grp")).alias("main"), F.count("*").alias("groups")), "main")
    open_ = grouped.join(narrow(main.where("groups > 1")), "component")
    rest = written(open_.where("grp != main").drop("main", "groups"), "rest")
    rest_blocks = written(cut(rest, "rest_blocks"), "rest-blocks")
    near = "array(z - 1, z, z + 1)"
    numbers = "if(coalesce({m}[y], 0) > 0, sequence(0, {m}[y] - 1), cast(array() as array<int>))"
    queries = rest.join(narrow(rest_blocks), "component").join(narrow(blocks), "component").withColumn("r", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("rest_blocks")[F.col("z")]).cast("int"))
    asked = F.expr(f"flatten(transform({near}, y -> transform({numbers.format(m='blocks')}, j -> concat_ws(':', '{_PROBE}', component, z, r, y, j))))")
    asked = queries.select(F.col("rep").alias("doc_id"), F.explode(asked).alias("task"), "grp", F.lit(True).alias("query"))
    told = F.expr(f"flatten(transform({near}, y -> transform({numbers.format(m='rest_blocks')}, j -> concat_ws(':', '{_PROBE}', component, y, j, z, i))))")
    told = open_.join(narrow(rest_blocks), "component").select(F.col("rep").alias("doc_id"), F.explode(told).alias("task"), "grp", F.lit(False).alias("query"))
    last = links(docs, asked.unionByName(told), size, percent)
    return found.union(last.where(F.col("kind") == _LINK).select("a", "b"))


def _ranked(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts: at most RANKED."""
    return _sorted(facts.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("df")).where(F.col("df") > FREQUENT).orderBy(F.desc("df"), "s1").limit(RANKED).toArrow())


def _sorted(top: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    hot = top.column("s1").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], top.column("df").to_numpy().astype(np.int64)[order]


def _candidates(edges: DataFrame, classes: DataFrame, percent: int, share: float) -> DataFrame:
    """(s1, rep, n, component) of the classes that could link, components with one class left out."""
    shared = edges.groupBy(F.col("a").alias("s1")).agg(F.sum("c").alias("shared"))
    fewest = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * share + 1e-9))
    alive = written(classes.join(shared, "s1").where(F.col("shared") >= fewest).select("s1", "rep", "n"), "alive")
    kept = edges.join(alive.select(F.col("s1").alias("a"), F.lit(True).alias("ok")).distinct(), "a", "left").where("ok or hub").select("a", "b")
    parts = components(kept)
    placed = written(alive.join(parts, alive.s1 == parts.node).select("s1", "rep", "n", "component"), "placed")
    several = placed.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
    return written(placed.join(several, "component", "left_semi"), "placed")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document with an id."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    facts = _facts(source, shingle)
    own = facts.where("kind = 0")
    classes = written(own.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    total = classes.agg(F.sum("n")).head()[0] or 0
    edges = _candidate_edges(source, buckets.count_for(total * (1 - percent / 100 + SHARED)), *_ranked(facts), shingle, percent, SHARED)
    first = _candidates(edges, classes, percent, SHARED)
    # few documents are left: among them the exact frequencies are affordable
    left = written(source.join(narrow(written(first.select(F.col("rep").alias("doc_id")).distinct(), "ids")), "doc_id", "left_semi"), "left")
    total = first.agg(F.sum("n")).head()[0] or 0
    often = _facts(left, shingle).where("kind = 1").groupBy("s1").agg(F.sum("n").alias("df")).where(F.col("df") >= max(HOT_DOCS, total // HOT_SHINGLES))
    hot = _sorted(often.orderBy(F.desc("df"), "s1").limit(HOT_SHINGLES).toArrow())
    placed = _candidates(_exact_edges(left, buckets.count_for(total), shingle, percent, SHARED_AGAIN, *hot), first.select("s1", "rep", "n"), percent, SHARED_AGAIN)
    linked = components(_found(left, placed.select("rep", "n", "component"), shingle, percent))

    by_class = classes.join(linked, classes.rep == linked.node, "left").select("s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    out = own.join(by_class, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
