"""Queries of storage: merges into a versioned table (K2, K5), files that are new by their bytes (S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.base import Query, table
from leafmill.sources import digest
from leafmill.sources.shared import shared_path
from leafmill.sources.versions import VersionedTable


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents are imported, then labels edit them or, of low quality, delete them; that batch comes twice."""
    held = VersionedTable(spark, shared_path(spark, "versions"), "doc_id long, lang string, n_chars long", ["doc_id"], buckets=16)
    held.merge(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["n_chars", "lang"], source="import")
    edits = table(spark, d, "labels").select("doc_id", F.lit("edited").alias("lang"), F.col("toxic").cast("long").alias("n_chars"), (F.col("quality") == 0).alias("gone"), "quality", "toxic")
    for _ in range(2):
        held.merge(edits, ["quality", "toxic"], "gone", source="labels")
    return held.read()


def _new_contents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all sources but the first are held; which of the first are none of them?"""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("bytes"), F.coalesce(F.col("source") == "src0", F.lit(False)).alias("new"))
    return digest.new_contents(docs.where("new"), docs.where("not new"), F.col("bytes"))


QUERIES: dict[str, Query] = {
    "k2_versioned_edits": Query(
        _versioned,
        """WITH l AS (SELECT * FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, toxic DESC) = 1)
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE 'edited' END AS lang, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE toxic END::BIGINT AS n_chars
FROM documents d FULL JOIN l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR quality IS DISTINCT FROM 0""",
    ),
    "s18_new_contents": Query(_new_contents, "SELECT doc_id::VARCHAR AS path FROM documents n WHERE source = 'src0' AND coalesce(text, '') NOT IN (SELECT coalesce(text, '') FROM documents WHERE source IS DISTINCT FROM 'src0')"),
}
