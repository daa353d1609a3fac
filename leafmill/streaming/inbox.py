"""An inbox folder as a stream: each new text file becomes chapters once; the checkpoint replaces resume files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill import reachable
from leafmill.functions.text import detect_language, speech_seconds
from leafmill.operators.structure import txt_chapters
from leafmill.sources.books import decode_text, stem

FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, inbox: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.txt").load(inbox)


def ingest(spark: SparkSession, inbox: str, out: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived; run again (or with another trigger) for what arrives later."""

    reachable(spark)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_text(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["path", "text"])

    def store(batch: DataFrame, epoch: int) -> None:
        rows = batch.select("path", "content").mapInArrow(text, "path string, text string")
        books = rows.where(F.col("text").rlike(r"(?U)\S")).select(stem(F.col("path")).alias("book_id"), "text")
        chapters = txt_chapters(books)
        done = chapters.select("*", detect_language("text").alias("language"), speech_seconds("text").alias("seconds"))
        done.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # the same epoch again replaces itself

    return arriving(spark, inbox).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
