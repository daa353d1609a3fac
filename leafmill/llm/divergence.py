"""Source divergence audit: how far the sources of a language differ in their words.

Terms are runs of letters (everything beyond ASCII counts as one), A-Z folded.  A
language keeps the V terms that stand in at least MIN_DOCS of its documents.  A group
(the documents of one language and source) gives each kept term the integer share
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N being its kept occurrences; so does the
language as a whole.  Two shares differ by f = floor((p - q)^2 / (p + q)).

1. Each task counts its documents' terms with DuckDB, (group, term) rows held in a
   bounded table that is merged and emitted as it fills.
2. Rows are dealt to shards by a hash of language and term; DuckDB adds up a shard's
   counts and keeps the terms of enough documents.
3. Spark sums N and V; the kept counts meet their shards again, with their group's
   N + 2 V.  DuckDB returns each shard's partial sum for each pair of sources, over the
   terms that both have, and its best terms of each group.
4. What a pair sums over terms of one source only depends on the count alone, so it comes
   from the number of terms per count; terms of neither add a constant each.  Spark merges
   the sums and rankings.

No pair is made of terms that a source doesn't have, so the work grows with the counts
that occur.  All arithmetic is in integers: 128 bits before divisions, 64 after.

Defined results: null text, language and source count as ''; each row is a document, also
if its id or text repeats; a group without terms takes part with N = 0; a language that
keeps no term has pairs of value 0 and no terms; a language of one source has no pairs; an
empty table gives no rows.  Equal values rank by the bytes of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import narrow, released, small_batches, written
from leafmill.llm.textkit import NOT_LETTER, buffers, give_back, pieces, words

MIN_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Rows of a task's table between merges, and rows of a shard.
HELD_ROWS, SHARD_ROWS = 400_000, 500_000
#: Characters of text that give a row to a shard, at least about: what the number of shards goes by.
ROW_CHARS = 16
#: Rows of an Arrow batch that a task returns.
OUT_ROWS = 50_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _connect() -> duckdb.DuckDBPyConnection:
    """An engine of one thread that holds everything in memory: tables here are bounded."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


class Held:
    """A table that merges its rows once they are too many: `keys` are kept, `sums` are added up."""

    def __init__(self, columns: str, keys: str, sums: tuple[str, ...]):
        self.db = _connect()
        self.db.execute(f"CREATE TABLE held ({columns})")
        self.merge = f"CREATE TABLE merged AS SELECT {keys}, {', '.join(f'sum({s})::BIGINT AS {s}' for s in sums)} FROM held GROUP BY {keys}"
        self.rows, self.limit = 0, HELD_ROWS

    def add(self, rows: pa.Table, sql: str = "SELECT * FROM rows") -> bool:
        """Add a query's rows; true if the table stays too large even when merged."""
        self.db.register("rows", rows)
        self.rows += self.db.execute(f"INSERT INTO held {sql}").fetchall()[0][0]
        self.db.unregister("rows")
        if self.rows < self.limit:
            return False
        self.db.execute(f"{self.merge}; DROP TABLE held; ALTER TABLE merged RENAME TO held")
        self.rows = self.db.execute("SELECT count(*) FROM held").fetchall()[0][0]
        self.limit = max(self.limit, 2 * self.rows)
        return self.rows > HELD_ROWS // 2

    def clear(self) -> None:
        self.db.execute("DELETE FROM held")
        self.rows, self.limit = 0, HELD_ROWS


def _out(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(OUT_ROWS)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as a string column."""
    n = ends - starts
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], n) + np.repeat(starts, n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[at])))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs) of the task's rows, merged as far as HELD_ROWS go."""
    held = Held("g INTEGER, term VARCHAR, n BIGINT, docs BIGINT", "g, term", ("n", "docs"))
    groups: dict[tuple[str, str], int] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if not groups:
            return
        found = held.db.sql("SELECT g, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY g, term").to_arrow_table()
        g = found.column("g").combine_chunks()
        lang, source = (pa.array([k[i] for k in groups]).take(g) for i in (0, 1))
        yield from _out(pa.table({"lang": lang, "source": source, "term": found.column("term").cast(pa.string()), "n": found.column("n"), "docs": found.column("docs")}))
        held.clear()
        groups.clear()

    for batch in batches:
        for part in pieces(batch, "text"):
            data, offs = buffers(part.column(2))
            s, e, first = words(data, offs, NOT_LETTER)
            if not len(s):
                continue
            row = np.repeat(np.arange(part.num_rows, dtype=np.int32), np.diff(first))
            of = np.array([groups.setdefault(k, len(groups)) for k in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], np.int32)
            rows = pa.table({"g": of[row], "row": row, "term": _strings(_FOLD[data], s, e)})
            full = held.add(rows, "SELECT g, term, sum(n)::BIGINT, count(*) FROM (SELECT g, row, term, count(*) AS n FROM rows GROUP BY ALL) GROUP BY ALL")
            if full:
                yield from flush()
    yield from flush()
    give_back()


def _kept(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """A shard's counts of the terms that enough documents hold; `first` marks one row of each term."""
    held = Held("lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT", "lang, source, term", ("n", "docs"))
    for b in batches:
        held.add(pa.Table.from_batches([b]))
    yield from _out(held.db.sql(f"""
        SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term) = 1 AS first
        FROM (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(sum(docs)) OVER (PARTITION BY lang, term) AS docs FROM held GROUP BY lang, source, term) WHERE docs >= {min_docs}""").to_arrow_table().cast(
        pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.bool_())])
    ))
    give_back()


def _partial(batches: Iterator[pa.RecordBatch], scale: int, top: int) -> Iterator[pa.RecordBatch]:
    """A shard's partial sums of source pairs (kind 0, smaller source first) and best terms of each group (kind 1)."""
    db = _connect()
    db.execute(f"CREATE MACRO share(n, d) AS (1 + ({scale}::HUGEINT * (n + 2)) // d::HUGEINT)::BIGINT")
    db.execute("CREATE MACRO gap(p, q) AS ((p - q) * (p - q)) // (p + q)")
    db.execute("CREATE TABLE shard (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, d BIGINT, whole BIGINT)")
    for b in batches:
        db.register("rows", pa.Table.from_batches([b]))
        db.execute("INSERT INTO shard SELECT * FROM rows")
        db.unregister("rows")
    found = db.sql(f"""
        WITH t AS MATERIALIZED (SELECT lang, source, term, share(n, d) AS p, share(0, d) AS z, share(sum(n) OVER (PARTITION BY lang, term), whole) AS q FROM shard)
        SELECT 0 AS kind, a.lang AS lang, a.source AS source, b.source AS item, sum(gap(a.p, b.p) - gap(a.p, b.z) - gap(a.z, b.p) + gap(a.z, b.z))::BIGINT AS value
        FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
        UNION ALL SELECT 1, lang, source, term, gap(p, q) FROM t WHERE p > q QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY gap(p, q) DESC, term) <= {top}""").to_arrow_table()
    yield from _out(found.cast(pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])))
    give_back()


def _share(n: Column, d: Column, scale: int) -> Column:
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(scale).cast("decimal(10,0)") * whole(n + 2), whole(d))


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, first) of the kept terms, and (lang, source) of all groups; both are written."""
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    chars = given.agg(F.sum(F.length("text"))).head()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // (ROW_CHARS * SHARD_ROWS)))
    counts = given.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    kept = counts.repartition(shards, "lang", "term").mapInArrow(lambda b: _kept(b, min_docs), "lang string, source string, term string, n long, first boolean")
    return released(kept, "kept-terms"), written(given.select("lang", "source").distinct(), "sources")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, scale: int = SCALE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    spark = docs.sparkSession
    kept, sources = term_counts(docs, min_docs, text_col, lang_col, source_col)
    zero = F.lit(0).cast("long")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("held"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("whole"))
    groups = sources.join(held, ["lang", "source"], "left").join(langs, "lang", "left")
    v = F.coalesce("v", zero)
    groups = written(groups.select("lang", "source", v.alias("v"), (F.coalesce("held", zero) + 2 * v).alias("d"), (F.coalesce("whole", zero) + 2 * v).alias("whole")), "groups")
    near = narrow(groups)

    rows = kept.join(near, ["lang", "source"]).select("lang", "source", "term", "n", "d", "whole")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // SHARD_ROWS))
    partial = rows.repartition(shards, "lang", "term").mapInArrow(lambda b: _partial(b, scale, top), "kind int, lang string, source string, item string, value long")
    partial = written(partial, "partial-sums")

    other = near.select("lang", F.col("source").alias("item"), F.col("d").alias("e"))
    z = lambda d: _share(zero, F.col(d), scale)
    # every source of a language with every other one: the rows of the result
    base = groups.join(other, "lang").where("source != item")
    base = base.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * _gap(z("d"), z("e"))).otherwise(0).alias("value"))
    terms_of = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(near, ["lang", "source"]).join(other, "lang").where("source != item")
    one = terms_of.select("lang", "source", "item", (F.col("k") * (_gap(_share(F.col("n"), F.col("d"), scale), z("e")) - _gap(z("d"), z("e")))).alias("value"))
    two = one.unionByName(partial.where("kind = 0").drop("kind"))
    both = two.unionByName(two.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = base.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    best = partial.where("kind = 1").select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(w).alias("rank"))
    return pairs.unionByName(best.where(F.col("rank") <= top))
