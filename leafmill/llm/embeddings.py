"""Near-duplicate vectors by a robust-pruned flat graph.

1. Equal vectors of one label form a class; only a representative goes on.
2. Cluster centres, fitted on a bounded sample, deal all representatives into
   overlapping shards: the nearest centre's and those of every other centre that a
   linked vector is likely to have as its nearest (see `_reach`).  Close centres are
   thinned as far as that makes the shards cheaper.  A shard of more than SPLIT_ROWS
   gets centres of its own, level by level, as long as that divides it; what a level
   can't divide (a cluster that all links) is split into blocks of SHARD_ROWS by a
   hash, and each pair of blocks is a task, so none is lost.
3. The tasks run in waves of about as many rows as there are vectors, so that the disk
   that their exchange takes doesn't grow with the overlap of the shards.
4. In each task a graph is built: every vector's nearest ones, thinned by robust
   pruning, and those whose lists it is in.  On it, each vector is searched in its
   nearest shard: a greedy beam from the medoid (and from the vector's own node), then a
   range expansion through everything near.  Candidates are verified by cosine in double
   precision.
5. A pair that only one task can find is counted there.  Pairs that several tasks may
   find are returned as matrices of bits over blocks of the shards, which are united
   before they are counted, so every pair that any search found counts, and once.
6. Recall is audited by brute force: up to AUDIT_QUERIES vectors whose id is divisible
   by 50, against all rows.  While it is under MIN_RECALL, the overlap of the shards is
   doubled and steps 2 to 5 run again, at last with the bound that no link can pass.

Defined results: a vector that is null, zero, empty, or holds a null or non-finite
component, or whose label is null, links with nothing; vectors of different lengths
don't link; rows with a null id are left out; rows with one id and one vector are
repeats and each gets the class's result; an empty table stays empty.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import forget, fresh_path, narrow, released, small_batches, written
from leafmill.llm.graph import components
from leafmill.llm.textkit import give_back

_log = logging.getLogger(__name__)
THRESHOLD = 0.98
#: Vectors that the centres are fitted on, at most; every row is indexed.
SAMPLE_ROWS = 20_000
SHARD_ROWS, CLUSTER_ROWS = 1500, 250
#: Rows from which on a shard gets centres of its own, the rows those are fitted on, centres of one level, levels, rows of a task.
SPLIT_ROWS, FIT_ROWS, FAN_OUT, LEVELS, DEAL_ROWS = 12_000, 2_000, 64, 4, 50_000
#: Work of building a row's lists, as a share of searching it.
BUILD_SHARE = 0.15
#: Rows of a wave of tasks, if there are no more vectors than that.
WAVE_ROWS = 500_000
#: Partitions that the tasks of a wave are dealt to, at most.
MOST_TASKS = 100_000
#: Standard deviations of a link's random direction that shards overlap by.
SPREAD = 4.0
#: Queries of the audit at most, and the recall below which the overlap is doubled.
AUDIT_QUERIES, MIN_RECALL = 500, 0.95
DEGREE, CANDIDATES, ALPHA, BEAM = 16, 48, 1.2, 12
#: Similarity down to which the range expansion passes through vectors.
SLACK = 0.03


def _packed(x: np.ndarray) -> bytes:
    """The components in single precision if that holds them exactly, else in double."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return (y if (y == x).all() else x).tobytes()


def _unpacked(v: list[bytes], dim: int) -> np.ndarray:
    """Vectors of _packed(), a row each, in double precision."""
    if all(len(b) == 4 * dim for b in v):
        return np.frombuffer(b"".join(v), np.float32).reshape(len(v), dim).astype(np.float64)
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in v])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dim, hashes and the packed components; dim 0 if the vector links with nothing."""
    for batch in batches:
        dims, h1, h2, raw = [], [], [], []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2)):
            x = None
            if label is not None and v.is_valid and len(v) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if not np.isfinite(x).all() or not 0 < float(x @ x) < np.inf:
                    x = None
            b = b"" if x is None else x.tobytes()
            dims.append(len(b) // 8)
            h1.append(xxhash.xxh64_intdigest(b, 1) - (1 << 63))
            h2.append(xxhash.xxh64_intdigest(b, 2) - (1 << 63))
            raw.append(b if x is None else _packed(x))
        cols = [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "dim", "h1", "h2", "v"])


def fit_centres(x: np.ndarray, k: int, steps: int = 6) -> np.ndarray:
    """k unit centres by spherical k-means."""
    rng = np.random.default_rng(1)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(steps):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def _reach(x: np.ndarray, centres: np.ndarray, threshold: float, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each unit vector, and whether a linked vector is likely to have each centre as its nearest.

    A linked vector nearer to c than to x's nearest centre b lies beyond their bisector,
    from which x is at most the link's angle away: x (b - c) <= sin(angle) |b - c|.  A
    link in a random direction of d dimensions moves x towards c by a normal share of
    that with deviation 1 / sqrt(d), so `spread` deviations are enough, if that is less.
    """
    s = x @ centres.T
    first = s.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (centres[first] @ centres.T), 0))
    sine = np.sqrt(1 - max(threshold, 0.0) ** 2) * min(1.0, spread / np.sqrt(x.shape[1]))
    return first, s.max(axis=1, keepdims=True) - s <= sine * gap + 1e-6


def thinned(x: np.ndarray, labels: np.ndarray, centres: np.ndarray, threshold: float, scale: float, spread: float = np.inf) -> np.ndarray:
    """The centres without close ones, as far apart as makes the shards of `scale` times x cheapest."""
    angle = np.arccos(np.clip(centres @ centres.T, -1, 1))
    names, code = np.unique(labels, return_inverse=True)
    best, least = centres[:1], np.inf
    for apart in np.arccos(threshold) * np.array([0, 1, 2, 3, 4, 6, 8, 16]):
        left, kept = np.ones(len(centres), bool), []
        while left.any():
            kept.append(int(left.argmax()))
            left &= angle[kept[-1]] > apart
            left[kept[-1]] = False
        some = centres[kept]
        rows, home = np.zeros((len(names), len(some))), np.zeros((len(names), len(some)))
        for i in range(0, len(x), 2048):
            first, within = _reach(x[i : i + 2048], some, threshold, spread)
            np.add.at(rows, code[i : i + 2048], within)
            np.add.at(home, (code[i : i + 2048], first), 1)
        # a row is built into the graph, and one at home searched, in as many tasks as its shard has blocks;
        # beyond SPLIT_ROWS a shard is divided again
        cost = ((BUILD_SHARE * rows + home) * np.ceil(np.minimum(scale * rows, SPLIT_ROWS) / SHARD_ROWS)).sum()
        if cost < least:
            best, least = some, cost
    return best


def shards_of(x: np.ndarray, centres: np.ndarray, threshold: float, spread: float = np.inf) -> list[list[int]]:
    """Per unit vector, its nearest centre first, then all others a linked vector is likely to have as nearest."""
    first, within = _reach(x, centres, threshold, spread)
    within[np.arange(len(x)), first] = False
    return [[f, *np.flatnonzero(w).tolist()] for f, w in zip(first.tolist(), within)]


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each unit vector: the nearest first, without those that a kept one is much nearer to."""
    n = len(x)
    m = min(CANDIDATES, n - 1)
    if m < 1:
        return [np.zeros(0, np.int64)] * n
    x = x.astype(np.float32)  # the lists only steer the search; links are verified in double precision
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = []
    for lo in range(0, n, 256):
        part = s[lo : lo + 256]
        row = np.arange(len(part))
        c = np.argpartition(-part, m - 1, axis=1)[:, :m]
        c = np.take_along_axis(c, np.argsort(-np.take_along_axis(part, c, 1), axis=1, kind="stable"), 1)
        away = np.maximum(2 - 2 * np.take_along_axis(part, c, 1), 0)  # squared distances
        alive = np.ones(c.shape, bool)
        kept = np.zeros(c.shape, bool)
        for _ in range(DEGREE):
            k = alive.argmax(axis=1)
            some = alive[row, k]
            if not some.any():
                break
            kept[row[some], k[some]] = True
            among = np.maximum(2 - 2 * s[c[row, k][:, None], c], 0)
            alive &= ~some[:, None] | (ALPHA * ALPHA * among > away)
            alive[row, k] = False
        out += [a[b] for a, b in zip(c, kept)]
    return out


def range_search(q: int, x: np.ndarray, near: list[np.ndarray], entry: int, threshold: float) -> np.ndarray:
    """Nodes visited around q: a greedy beam, then all that is reachable through near ones."""
    sim = np.full(len(x), -2.0)
    done = np.zeros(len(x), bool)
    start = np.array([entry, q] if entry != q else [q])
    sim[start] = x[start] @ x[q]
    seen = start.tolist()
    reach = threshold - SLACK
    while True:
        ids = np.array(seen)
        value = sim[ids]
        if len(ids) > BEAM:
            beam = ids[np.argpartition(-value, BEAM - 1)[:BEAM]]
            beam = np.union1d(beam, ids[value >= reach])
        else:
            beam = ids
        todo = beam[~done[beam]]
        if not len(todo):
            return ids
        done[todo] = True
        new = np.unique(np.concatenate([near[i] for i in todo.tolist()]))
        new = new[sim[new] < -1.5]
        if len(new):
            sim[new] = x[new] @ x[q]
            seen += new.tolist()


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Rows of each task; the rows arrive sorted by task."""
    now, held = None, []
    for batch in batches:
        names = batch.column(batch.schema.get_field_index("task")).to_pylist()
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for lo, hi in zip(cuts, cuts[1:]):
            if names[lo:hi] and names[lo] != now:
                if held:
                    yield now, pa.Table.from_batches(held).combine_chunks()
                now, held = names[lo], []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _matrix(v: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    raw = _unpacked(v, dim)
    norm = np.sqrt((raw * raw).sum(axis=1))
    return raw, raw / norm[:, None]


def two_way(near: list[np.ndarray]) -> list[np.ndarray]:
    """Each vector's list, with the vectors whose lists it is in."""
    n = len(near)
    a, b = np.repeat(np.arange(n), [len(k) for k in near]), np.concatenate(near)
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(edges % n, np.searchsorted(edges, np.arange(1, n) * n))


def _stars(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of each connected set of a symmetric matrix, roots aside: what connects it."""
    a, b = np.nonzero(np.triu(links))
    root = np.arange(len(links))
    for i, j in zip(a.tolist(), b.tolist()):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        root[max(i, j)] = min(i, j)
    e = np.flatnonzero(root != np.arange(len(links)))
    return e, root[e]


#: Rows of the search: counts and connections, or a matrix of pairs that other tasks may find too.
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("task", pa.string()), ("rows", pa.list_(pa.int64())), ("columns", pa.list_(pa.int64())), ("row_k", pa.list_(pa.int64())), ("column_k", pa.list_(pa.int64())), ("bits", pa.binary())])
_FOUND_DDL = "kind int, a long, b long, task string, rows array<long>, columns array<long>, row_k array<long>, column_k array<long>, bits binary"


def _counted(own: np.ndarray, count: np.ndarray, members: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    c = np.flatnonzero(count)
    n = len(c) + len(members)
    kind = np.concatenate([np.zeros(len(c), np.int32), np.ones(len(members), np.int32)])
    first = [pa.array(kind), pa.array(np.concatenate([own[c], own[members]])), pa.array(np.concatenate([count[c], own[roots]]))]
    return pa.RecordBatch.from_arrays([*first, *(pa.nulls(n, f.type) for f in list(_FOUND)[3:])], schema=_FOUND)


def _search(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(kind, a, b): kind 0: b links of a counted in this task; kind 1: a and b are connected; kind 2: pairs to be united.

    A vector is searched in all tasks of its nearest shard.  A pair that no other task can
    find is counted here.  One that another task may find as well (the other's nearest shard
    holds both, or several tasks hold both's block) goes to a matrix of bits over the two
    blocks that they are from; matrices of the same blocks are united before they are counted.
    """
    for task, rows in _tasks(batches):
        label, leaf, _, _ = task.rsplit("/", 3)
        leaves = [h.split(",") for h in rows.column("leaves").to_pylist()]
        nearest = [h[0] for h in leaves]
        if leaf not in nearest:
            continue
        raw, x = _matrix(rows.column("v").to_pylist(), int(label.rpartition("/")[2]))
        norm = np.sqrt((raw * raw).sum(axis=1))
        own, weight, block = rows.column("rep").to_numpy(), rows.column("k").to_numpy(), rows.column("block").to_numpy()
        home = np.array([f"{h}/{k}" for h, k in zip(nearest, rows.column("home_block").to_pylist())])
        many = rows.column("blocks")[0].as_py() > 2  # of two blocks, there is one task
        near = two_way(pruned_graph(x))
        entry = int((x @ x.mean(axis=0)).argmax())
        n = len(own)
        links, shared = np.zeros((n, n), bool), np.zeros((n, n), bool)
        for q in range(n):
            if nearest[q] != leaf:
                continue
            found = range_search(q, x, near, entry, threshold)
            found = found[(found != q) & (raw[found] @ raw[q] >= threshold * norm[found] * norm[q])]
            elsewhere = set(leaves[q])
            for y in found.tolist():
                to = shared if (many and block[q] == block[y]) or (nearest[y] != leaf and nearest[y] in elsewhere) else links
                to[q, y] = to[y, q] = True
        yield _counted(own, links @ weight, *_stars(links))
        names, at = np.unique(home, return_inverse=True)
        p, q = np.nonzero(shared)
        some = at[p] <= at[q]
        p, q = p[some], q[some]
        both, which = np.unique(at[p] * len(names) + at[q], return_inverse=True)
        order = np.argsort(which, kind="stable")
        for m, k in zip(both.tolist(), np.split(order, np.searchsorted(which[order], np.arange(1, len(both))))):
            if not len(k):
                continue
            (here, r), (there, c) = (np.unique(e[k], return_inverse=True) for e in (p, q))
            part = np.zeros((len(here), len(there)), bool)
            part[r, c] = True
            lists = [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (own[here], own[there], weight[here], weight[there])]
            ids = [pa.array([2], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([f"{label}|{names[m // len(names)]}|{names[m % len(names)]}"])]
            yield pa.RecordBatch.from_arrays([*ids, *lists, pa.array([np.packbits(part).tobytes()], pa.binary())], schema=_FOUND)
    give_back()


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and connections of the pairs in the matrices of each two blocks, each pair once."""
    for _, rows in _tasks(batches):
        ids, weights = (np.concatenate([rows.column(c).combine_chunks().flatten().to_numpy() for c in pair]) for pair in (("rows", "columns"), ("row_k", "column_k")))
        own, first = np.unique(ids, return_index=True)
        links = np.zeros((len(own), len(own)), bool)
        for r, c, bits in zip(*(rows.column(k) for k in ("rows", "columns", "bits"))):
            i, j = (np.searchsorted(own, v.values.to_numpy()) for v in (r, c))
            part = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(i) * len(j)).reshape(len(i), len(j)).astype(bool)
            links[np.ix_(i, j)] |= part
            links[np.ix_(j, i)] |= part.T
        yield _counted(own, links @ weights[first], *_stars(links))
    give_back()


def _dealt(reps: DataFrame, threshold: float, sample_rows: int, spread: float) -> DataFrame:
    """reps with their leaves, the shard that each is at home in first; they take the place of reps, which go."""
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("dim", "v", "label").toArrow()
    by_dim: dict[int, list[tuple[bytes, str]]] = {}
    for d, *row in zip(*(c.to_pylist() for c in sample.columns)):
        by_dim.setdefault(d, []).append(tuple(row))
    largest, total = reps.groupBy("label").count().agg(F.max("count"), F.sum("count")).head()
    centres = {}
    for d, rows in by_dim.items():
        x, labels = _matrix([v for v, _ in rows], d)[1], np.array([n for _, n in rows])
        fitted = fit_centres(x, max(1, min(len(x) // 8, -(-largest // CLUSTER_ROWS))))
        centres[d] = thinned(x, labels, fitted, threshold, total / len(sample), spread)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            raw = b.column(4).to_pylist()
            leaves: list[list[str]] = [["0"]] * len(raw)
            for d in set(dims.tolist()) & set(centres):
                k = np.flatnonzero(dims == d)
                for i, ls in zip(k.tolist(), shards_of(_matrix([raw[i] for i in k], d)[1], centres[d], threshold, spread)):
                    leaves[i] = [str(x) for x in ls]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.string()))], ["rep", "label", "dim", "k", "v", "leaves"])

    dealt = released(reps.mapInArrow(deal, "rep long, label string, dim int, k long, v binary, leaves array<string>"), "vectors-dealt")
    forget(reps)
    final = None  # shards that can't be divided
    for _ in range(LEVELS):
        before = dealt
        dealt, final = _divided(before, final, threshold, spread)
        if dealt is not before:
            forget(before)
        if final is None:
            break
    return dealt


_SHARD = ["label", "dim", "leaf"]


def _divided(dealt: DataFrame, final: DataFrame | None, threshold: float, spread: float) -> tuple[DataFrame, DataFrame | None]:
    """The rows with each shard of over SPLIT_ROWS replaced by its own shards, and the shards that stay; no shards when nothing was left to do."""
    sizes = dealt.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*_SHARD).agg(F.count("*").alias("size"))
    over = sizes.where(F.col("size") > SPLIT_ROWS)
    over = released(over if final is None else over.join(final, _SHARD, "left_anti"), "vector-shards")
    if not over.head(1):
        return dealt, None
    rows = dealt.select("rep", "label", "dim", "v", F.explode("leaves").alias("leaf")).join(narrow(over), _SHARD)

    def fit(part: pa.Table) -> pa.Table:
        x, size = _matrix(part.column("v").to_pylist(), part.column("dim")[0].as_py())[1], part.column("size")[0].as_py()
        fitted = fit_centres(x, max(1, min(len(x) // 8, FAN_OUT, -(-size // CLUSTER_ROWS))))
        kept = thinned(x, np.zeros(len(x)), fitted, threshold, size / len(x), spread)
        return pa.table({**{n: part.column(n)[:1] for n in _SHARD}, "size": pa.array([size]), "n": pa.array([len(kept)], pa.int32()), "centres": pa.array([kept.tobytes()], pa.binary())})

    some = rows.where(F.pmod(F.xxhash64("rep", F.lit(13)), F.col("size")) < FIT_ROWS).select(*_SHARD, "size", "v")
    fitted = released(some.groupBy(*_SHARD).applyInArrow(fit, "label string, dim int, leaf string, size long, n int, centres binary"), "vector-centres")
    split = fitted.where("n > 1")
    stay = over.join(split, _SHARD, "left_anti").select(*_SHARD)
    final = released(stay if final is None else stay.union(final), "vector-shards-whole")
    if not split.head(1):
        return dealt, None

    # a shard's rows go to several tasks, each of which reads the centres first
    tasks = F.ceil(F.col("size") / DEAL_ROWS).cast("int")
    heads = split.select(*_SHARD, F.explode(F.sequence(F.lit(0), tasks - 1)).alias("salt"), F.lit(-1).cast("long").alias("rep"), "centres", F.lit(0).alias("kind"))
    body = rows.join(narrow(split.select(*_SHARD)), _SHARD).select(*_SHARD, F.pmod(F.xxhash64("rep"), tasks).cast("int").alias("salt"), "rep", F.col("v").alias("centres"), F.lit(1).alias("kind"))
    both = heads.unionByName(body).repartition(*_SHARD, "salt").sortWithinPartitions(*_SHARD, "salt", "kind")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            kind = b.column(6).to_numpy()
            cuts = [0, *(np.flatnonzero(kind == 0)).tolist(), len(kind)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi and kind[lo] == 0:
                    now = np.frombuffer(b.column(5)[lo].as_buffer()).reshape(-1, b.column(1)[lo].as_py())
                    lo += 1
                if lo == hi:
                    continue
                leaf = b.column(2)[lo].as_py()
                found = shards_of(_matrix(b.column(5)[lo:hi].to_pylist(), b.column(1)[lo].as_py())[1], now, threshold, spread)
                names = pa.array([[f"{leaf}.{k}" for k in ls] for ls in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(4)[lo:hi], b.column(2)[lo:hi], names], ["label", "rep", "leaf", "own"])

    own = both.mapInArrow(deal, "label string, rep long, leaf string, own array<string>")
    each = dealt.select("rep", "label", F.posexplode("leaves").alias("place", "leaf")).join(own, ["rep", "label", "leaf"], "left")
    parts = F.array_sort(F.collect_list(F.struct("place", F.coalesce("own", F.array("leaf")).alias("own"))))
    leaves = each.groupBy("rep", "label").agg(F.flatten(F.transform(parts, lambda p: p["own"])).alias("leaves"))
    return released(dealt.drop("leaves").join(leaves, ["rep", "label"]).select(*dealt.columns), "vectors-dealt"), final


def _links(reps: DataFrame, threshold: float, sample_rows: int, spread: float) -> tuple[DataFrame, DataFrame]:
    """(kind, a, b): kind 0: a links with b other vectors (to be added up); kind 1: a and b are connected; and reps with their leaves."""
    spark = reps.sparkSession
    given = dealt = _dealt(reps, threshold, sample_rows, spread)
    sizes = dealt.select("label", "dim", F.explode("leaves").alias("leaf")).groupBy(*_SHARD).count().select(*_SHARD, "count", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("blocks"))
    sizes = released(sizes, "vector-blocks")
    # the block that each row has in its nearest shard
    near = narrow(sizes)
    homes = near.select("label", "dim", F.col("leaf").alias("home"), F.col("blocks").alias("home_blocks"))
    dealt = dealt.withColumn("home", F.get("leaves", F.lit(0))).join(homes, ["label", "dim", "home"]).withColumn("home_block", F.pmod(F.xxhash64("rep"), F.col("home_blocks")).cast("int"))
    dealt = dealt.drop("home", "home_blocks")
    wave_rows, path = max(given.count(), WAVE_ROWS), fresh_path(spark, "vector-links")
    released(spark.createDataFrame([], _FOUND_DDL), "", path)
    n = least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # shards that can't be divided have as many copies of a row as blocks: of those, a wave has some pairs of blocks; of the others, whole shards
    for whole in (True, False):
        some = F.col("count") <= SPLIT_ROWS if whole else F.col("count") > SPLIT_ROWS
        rows, pairs = sizes.where(some).agg(F.sum(F.col("count") * F.greatest(F.col("blocks") - 1, F.lit(1))), F.sum(F.greatest(F.col("blocks") * (F.col("blocks") - 1) / 2, F.lit(1)))).head()
        waves = -(-(rows or 0) // wave_rows)
        for wave in range(waves):
            mine = lambda *c, wave=wave, waves=waves: F.pmod(F.xxhash64(*c), F.lit(waves)) == wave
            each = dealt.select("*", F.explode(F.filter("leaves", lambda leaf: mine("label", "dim", leaf)) if whole else "leaves").alias("leaf")).join(near.where(some), _SHARD)
            each = each.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
            others = F.when(F.col("blocks") > 1, F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block"))).otherwise(F.array(F.lit(0)))
            key = F.transform(others, lambda j: F.concat_ws("/", "label", "dim", "leaf", F.least("block", j), F.greatest("block", j)))
            each = each.select(F.explode(key if whole else F.filter(key, lambda task: mine(task))).alias("task"), "rep", "k", "v", F.array_join("leaves", ",").alias("leaves"), "block", "blocks", "home_block")
            # a stated number of partitions, so that few bytes of much work aren't put together
            n = max(least, min(int(pairs) // waves, MOST_TASKS))
            released(each.repartition(n, "task").sortWithinPartitions("task", "rep").mapInArrow(lambda b: _search(b, threshold), _FOUND_DDL), "", path)
    found = spark.read.schema(_FOUND_DDL).parquet(path)
    again = found.where("kind = 2").repartition(n, "task").sortWithinPartitions("task").mapInArrow(_united, _FOUND_DDL)
    sums = released(found.where("kind < 2").unionByName(again).select("kind", "a", "b"), "vector-sums")
    forget(found)
    return sums, given


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, min_recall: float = MIN_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector with an id."""
    small_batches(vectors.sparkSession)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).where("vec_id is not null")
    clean = source.mapInArrow(_clean, "vec_id long, label string, dim int, h1 long, h2 long, v binary")
    keys = written(clean.drop("v"), "vector-keys")
    same = ["label", "dim", "h1", "h2"]
    classes = released(keys.where("dim > 0").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("k")), "vector-classes")
    # the id is part of the key, so that a very common vector's rows don't meet in one task
    chosen = classes.groupBy("label", F.col("rep").alias("vec_id")).agg(F.min(F.struct("dim", "h1", "h2", "k")).alias("one")).select("label", "vec_id", "one.*")
    reps = clean.join(chosen, [*same, "vec_id"]).dropDuplicates([*same, "vec_id"]).select(F.col("vec_id").alias("rep"), "label", "dim", "k", "v")
    reps = released(reps, "vectors")
    widest, spread = reps.agg(F.max("dim")).head()[0] or 1, SPREAD
    while True:
        found, dealt = _links(reps, threshold, sample_rows, spread)
        counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
        linked = classes.join(counts, "rep", "left").select("rep", *same, (F.col("k") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        linked = released(linked, "vector-counts")
        recall = audit(vectors, keys.join(linked, same).select("vec_id", "n_links"), id_col, vector_col, label_col, threshold, AUDIT_QUERIES)
        _log.info("recall %.4f with shards that overlap by %.1f deviations", recall, spread)
        if recall >= min_recall or spread * spread >= widest:
            break
        spread *= 2
        reps = dealt.drop("leaves")
        forget(found)
        forget(linked)
    forget(dealt)
    parts = components(found.where("kind = 1").select("a", "b"))
    result = linked.join(parts, linked.rep == parts.node, "left").select(*same, "n_links", F.coalesce("component", "rep").alias("component_id"))
    out = keys.join(result, same, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def audit(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, max_queries: int | None = None) -> float:
    """Share of the brute-force links of the vectors with ids divisible by 50 (max_queries of them) that `found` counts; queries go in blocks.

    found: vec_id and n_links.  Vectors that can link with nothing are no queries; ids that
    `found` lacks count as missed; without any brute-force link the share is 1.
    """
    small_batches(vectors.sparkSession)
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).where("vec_id is not null")
    clean = source.mapInArrow(_clean, "vec_id long, label string, dim int, h1 long, h2 long, v binary").where("dim > 0")
    queries = clean.where("vec_id % 50 = 0").select("vec_id", "label", "dim", "v")
    if max_queries is not None:
        queries = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_queries)
    queries = written(queries, "audit")
    blocks = max(1, -(-queries.count() // 2000))
    truth = got = 0
    for k in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).toArrow().to_pylist()

        def scan(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: dict[int, int] = {}
                held: dict[tuple, tuple[list, list]] = {}
                for i, *key, v in zip(*(c.to_pylist() for c in b.columns)):
                    ids, raw = held.setdefault(tuple(key), ([], []))
                    ids.append(i)
                    raw.append(v)
                for key in {(r["label"], r["dim"]) for r in block} & set(held):
                    q = [r for r in block if (r["label"], r["dim"]) == key]
                    ids, y = np.array(held[key][0]), _matrix(held[key][1], key[1])[1]
                    hit = _matrix([i["v"] for i in q], key[1])[1] @ y.T >= threshold
                    for i, one in enumerate(q):
                        out[one["vec_id"]] = out.get(one["vec_id"], 0) + int((ids[hit[i]] != one["vec_id"]).sum())
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], ["vec_id", "n"])

        sums = clean.select("vec_id", "label", "dim", "v").mapInArrow(scan, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))
        t, g = sums.join(found.select("vec_id", "n_links"), "vec_id", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("n_links", F.lit(0))))).head()
        truth, got = truth + (t or 0), got + (g or 0)
    return got / truth if truth else 1.0
