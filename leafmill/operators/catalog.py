"""The library: books, chapters, edits, conversion records and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.labels import metadata_escape, short_duration_label
from leafmill.functions.numbers import tenths
from leafmill.functions.text import detect_language, edited_seconds, strip

# Language sampling and listing widths.
SAMPLES, SAMPLE_CHARS, SAMPLE_MIN = 5, 500, 20
TITLE_WIDTH, TITLE_SHOWN = 40, 38
TEMPORARY = ("_tmp_", "combined_temp", "_concat_")


def library(books: DataFrame, present: DataFrame, edits: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters of books whose source file is present or unnamed, with a flag where an edit exists.

    detected_language, where the book has none, is that of its chapters' texts; an edit
    stands in for a text that isn't held.  It stays null if no text is long enough.
    """
    absent = books.where("file_path != ''").join(present, books.file_path == present.path, "left_anti").select("id")
    kept = books.join(absent, "id", "left_anti").select(F.col("id").alias("book_id"), F.nullif("detected_language", F.lit("")).alias("known"))
    e = edits.select("book_id", "idx", F.col("text").alias("edit"), F.lit(True).alias("has_edit")).dropDuplicates(["book_id", "idx"])
    rows = chapters.join(kept, "book_id").join(e, ["book_id", "idx"], "left")
    unknown = rows.where("known is null").select("book_id", "idx", F.coalesce(F.nullif("text", F.lit("")), "edit").alias("text"))
    rows = rows.join(book_languages(unknown), "book_id", "left").withColumn("edited", F.coalesce("has_edit", "edited"))
    return rows.withColumn("detected_language", F.coalesce("known", "languages")).drop("has_edit", "edit", "known", "languages")


def new_books(incoming: DataFrame, books: DataFrame) -> DataFrame:
    """Incoming files that no book has as its source."""
    return incoming.join(books, incoming.path == books.file_path, "left_anti")


def chapter_texts(chapters: DataFrame, edits: DataFrame, parsed: DataFrame) -> DataFrame:
    """Text of each chapter: the edit if there is one, even an empty one, else the held text, else the parsed one, else null."""
    e = edits.select("book_id", "idx", F.col("text").alias("edit"), F.lit(True).alias("is_edit"))
    p = parsed.select("book_id", "idx", F.col("text").alias("parsed"))
    rows = chapters.join(e, ["book_id", "idx"], "left").join(p, ["book_id", "idx"], "left")
    held = F.when(F.col("text") != "", F.col("text"))
    return rows.select("book_id", "idx", "title", F.when(F.col("is_edit"), F.col("edit")).otherwise(F.coalesce(held, "parsed")).alias("text"))


def apply_edits(chapters: DataFrame, edits: DataFrame) -> DataFrame:
    """Chapters after edits are saved: raw length, duration of the cleaned text, flag."""
    e = edits.select("book_id", "idx", F.col("text").alias("edit"))
    rows = chapters.join(e, ["book_id", "idx"], "left")
    on = F.col("edit").isNotNull()
    return rows.select(
        "book_id", "idx", "title",
        F.when(on, F.length("edit")).otherwise(F.col("char_count")).alias("char_count"),
        F.when(on, edited_seconds("edit")).otherwise(F.col("seconds")).alias("seconds"),
        (on | F.col("edited")).alias("edited"),
    )


def book_list(books: DataFrame, chapters: DataFrame, conversions: DataFrame) -> DataFrame:
    n = chapters.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("chapter_count"))
    k = conversions.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("conversion_count"))
    rows = books.join(n, "id", "left").join(k, "id", "left")
    return rows.select("id", "title", "author", "format", F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"), "uploaded_at", F.coalesce("conversion_count", F.lit(0)).alias("conversion_count"))


def book_detail(books: DataFrame, chapters: DataFrame) -> DataFrame:
    rows = chapters.join(books.select(F.col("id").alias("book_id"), F.col("title").alias("book")), "book_id")
    return rows.select("book_id", "book", "idx", "title", "char_count", tenths("seconds").alias("seconds"), short_duration_label(F.col("seconds")).alias("label"), "edited")


def book_totals(chapters: DataFrame) -> DataFrame:
    chars = F.when(F.col("char_count") > 0, F.col("char_count")).otherwise(F.length("text"))
    return chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum(chars).alias("chars"), F.sum("seconds").alias("seconds"))


def short_title(title: Column) -> Column:
    return F.when(F.length(title) > TITLE_WIDTH, F.concat(F.substring(title, 1, TITLE_SHOWN), F.lit("..."))).otherwise(title)


def updated_books(books: DataFrame, changes: DataFrame) -> DataFrame:
    """New titles and authors; blank ones keep the old."""
    c = changes.select("id", F.col("title").alias("new_title"), F.col("author").alias("new_author"))
    pick = lambda new, old: F.coalesce(F.nullif(F.trim(new), F.lit("")), F.col(old)).alias(old)
    return books.join(c, "id", "left").select("id", pick("new_title", "title"), pick("new_author", "author"))


def without_books(books: DataFrame, gone: DataFrame) -> DataFrame:
    return books.join(gone, "id", "left_anti")


def add_record(conversions: DataFrame, fresh: DataFrame) -> DataFrame:
    return conversions.unionByName(fresh)


def without_records(conversions: DataFrame, gone: DataFrame) -> DataFrame:
    """Records less those named by book and timestamp."""
    return conversions.join(gone, ["book_id", "ts"], "left_anti")


def history(conversions: DataFrame, outputs: DataFrame) -> DataFrame:
    """Conversion records, newest first by position, with the number of chapter files."""
    files = outputs.groupBy("book_id", "ts").agg(F.count_if(F.col("type") == "chapter").alias("chapter_files"))
    w = Window.partitionBy("book_id").orderBy(F.desc("pos"))
    rows = conversions.join(files, ["book_id", "ts"], "left")
    shown = F.replace(F.substring("ts", 1, 19), F.lit("T"), F.lit(" "))
    return rows.select("book_id", F.row_number().over(w).alias("place"), shown.alias("shown"), F.coalesce("chapter_files", F.lit(0)).alias("chapter_files"))


def book_languages(chapters: DataFrame) -> DataFrame:
    """Languages of each book's first five samples, sorted and comma-joined."""
    sample = F.substring(strip("text"), 1, SAMPLE_CHARS)
    rows = chapters.withColumn("sample", sample).where(F.length("sample") > SAMPLE_MIN)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("idx"))).where(F.col("k") <= SAMPLES)
    return rows.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set(detect_language("sample"))), ",").alias("languages"))


def download_pick(files: DataFrame, kind: str) -> DataFrame:
    """The file that a download of the kind serves; of MP3 files, one without ' - ' in its stem if there is one."""
    rows = files.where(F.col("filename").endswith(f".{kind}"))
    for prefix in TEMPORARY:
        rows = rows.where(~F.col("filename").startswith(prefix))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    part = stem.contains(" - ").cast("int") if kind == "mp3" else F.lit(0)
    w = Window.partitionBy("book_id").orderBy(part, "filename")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("book_id", "filename")


def offsets(durations: DataFrame, by: list[str], order: list[str], seconds: str) -> DataFrame:
    """START and END milliseconds: each duration truncated, then summed."""
    own = (F.col(seconds) * 1000).cast("bigint")
    total = F.sum(own).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return durations.withColumn("end_ms", total).withColumn("start_ms", F.col("end_ms") - own)


def ffmetadata(books: DataFrame, durations: DataFrame) -> DataFrame:
    """The chapter metadata text of each book."""
    rows = offsets(durations, ["book_id"], ["idx"], "seconds")
    line = lambda key, c: F.concat(F.lit(key), c.cast("string"))
    block = F.concat_ws("\n", F.lit(""), F.lit("[CHAPTER]"), F.lit("TIMEBASE=1/1000"), line("START=", F.col("start_ms")), line("END=", F.col("end_ms")), line("title=", metadata_escape(F.col("title"))))
    parts = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("idx", block.alias("block")))).alias("parts"))
    given = lambda key, c: F.when(F.col(c) != "", line(key, metadata_escape(F.col(c))))
    named = parts.join(books.select(F.col("id").alias("book_id"), F.col("title").alias("book"), "author"), "book_id")
    head = F.concat_ws("\n", F.lit(";FFMETADATA1"), given("title=", "book"), given("artist=", "author"))
    return named.select("book_id", F.concat_ws("\n", head, F.array_join(F.transform("parts", lambda p: p["block"]), "\n")).alias("text"))
