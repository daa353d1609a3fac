"""Library documents and manifests as JSON, read with a fixed schema and written without chapter text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = (
    "id string, title string, author string, format string, file_path string, cover_path string,"
    " chapters array<struct<index:int,title:string,char_count:int,estimated_duration_seconds:double,edited:boolean>>,"
    " conversions array<struct<timestamp:string,selected_chapters:array<int>,output_files:array<struct<path:string,filename:string,type:string,title:string>>>>,"
    " detected_language string, uploaded_at string"
)
MANIFEST = "book_id string, selected_chapters array<int>, completed_chapters array<int>, tts_provider string, tts_config struct<voice:string,language:string,speed:double,model_path:string>, output_m4b boolean, output_mp3 boolean, state string"


def read_json(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Documents of a folder tree; those that don't parse or lack their key are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & F.col(key).isNotNull()).drop("_bad")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, BOOK, "id")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return ordered(read_json(spark, path, MANIFEST, "book_id"))


def ordered(manifests: DataFrame) -> DataFrame:
    """Manifests; completed chapters lose repeats and keep their order."""
    return manifests.withColumn("completed_chapters", F.array_distinct("completed_chapters"))


def slim(books: DataFrame) -> DataFrame:
    """Books as they are saved: chapters without their text."""
    keep = ("index", "title", "char_count", "estimated_duration_seconds", "edited")
    return books.withColumn("chapters", F.transform("chapters", lambda c: F.struct(*(c[k].alias(k) for k in keep))))


def write_books(books: DataFrame, path: str) -> None:
    """Books as JSON lines."""
    slim(books).write.mode("overwrite").json(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    """The commit protocol makes a manifest appear whole or not at all."""
    manifests.write.mode("overwrite").json(path)
