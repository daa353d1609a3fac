"""Queries that run a stream over a given table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.base import Query, table
from leafmill.plans.inline import tenths_sql
from leafmill.sources.shared import shared_path
from leafmill.streaming import status

_KINDS = {"signup": "book", "view": "job", "purchase": "job", "error": "job", "click": "manifest"}
_STATES = {"view": "running", "purchase": "completed", "error": "failed"}


def _status_stream(spark: SparkSession, d: str) -> DataFrame:
    """Users as books: sign-ups come and go, views, purchases and errors are words of the job, clicks save the manifest."""
    # a pattern: as a plain path, a stream takes folders only, and a table may be one file
    whole = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    pick = lambda names: F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type"))
    state = F.when(F.col("event_type") == "signup", F.when(F.col("value") < 5, "removed").otherwise("present")).when(F.col("event_type") == "click", F.when(F.col("value") < 20, "completed").otherwise("cancelled")).otherwise(pick(_STATES))
    done = F.sequence(F.lit(0), (F.floor("value") % 10).cast("int"))
    events = whole.select(
        F.col("user_id").cast("string").alias("book_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), pick(_KINDS).alias("kind"), state.alias("state"), F.sequence(F.lit(0), F.lit(11)).alias("selected"), done.alias("completed")
    )
    out = shared_path(spark, "status")
    status.follow(events, out, shared_path(spark, "status-checkpoint")).awaitTermination()
    return status.current(spark, out)


_STATUS = f"""
WITH e AS (SELECT user_id::VARCHAR AS book_id, ts, event_id, value, event_type, CASE event_type WHEN 'signup' THEN 'book' WHEN 'click' THEN 'manifest' ELSE 'job' END AS kind,
    CASE event_type WHEN 'signup' THEN CASE WHEN value < 5 THEN 'removed' ELSE 'present' END WHEN 'click' THEN CASE WHEN value < 20 THEN 'completed' ELSE 'cancelled' END WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state FROM events),
  newest AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY ts DESC, event_id DESC) = 1),
  heard AS (SELECT epoch_ms(max(ts)) - 3600000 AS mark FROM e),
  job AS (SELECT book_id, CASE WHEN state = 'running' AND epoch_ms(ts) + 86400000 <= mark THEN NULL ELSE state END AS state FROM newest, heard WHERE kind = 'job'),
  can AS (SELECT book_id, 12 AS total, (floor(value)::BIGINT % 10 + 1)::INTEGER AS completed FROM newest WHERE kind = 'manifest' AND state = 'cancelled'),
  shown AS (SELECT b.book_id, CASE WHEN (job.state IS NULL OR job.state = 'failed') AND can.book_id IS NOT NULL THEN 'resumable' ELSE coalesce(job.state, 'lost') END AS state, total, completed FROM newest b LEFT JOIN job USING (book_id) LEFT JOIN can USING (book_id) WHERE b.kind = 'book' AND b.state = 'present')
SELECT book_id, state, CASE WHEN state = 'resumable' THEN total END AS total, CASE WHEN state = 'resumable' THEN completed END AS completed, CASE WHEN state = 'resumable' THEN {tenths_sql('completed / total::DOUBLE * 100')} END AS progress_percent FROM shown"""

QUERIES: dict[str, Query] = {"p9_status_stream": Query(_status_stream, _STATUS)}
