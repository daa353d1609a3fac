"""Conversion jobs: selections, manifests, resumable work and the plan of what to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.labels import chapter_file, contiguous_label, safe_filename
from leafmill.functions.numbers import tenths
from leafmill.functions.text import clean, is_blank
from leafmill.operators.catalog import chapter_texts

RESUMABLE = ("running", "failed", "cancelled")


def parse_ranges(spec: Column, total: Column) -> Column:
    """'1-5,7,10-' to sorted distinct 0-based numbers; ranges end at the total, single numbers must lie within it."""

    def one(part: Column) -> Column:
        ends = F.split(part, "-")
        low = F.coalesce(F.try_to_number(F.nullif(F.trim(ends[0]), F.lit("")), F.lit("999999999")).cast("int"), F.lit(1))
        high = F.least(F.coalesce(F.try_to_number(F.nullif(F.trim(ends[1]), F.lit("")), F.lit("999999999")).cast("int"), total), total)
        single = F.trim(part).cast("int")
        bad = F.raise_error(F.concat(F.lit("chapter out of range: "), part)).cast("array<int>")
        several = F.when(low <= high, F.sequence(low - 1, high - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(part.contains("-"), several).when((single < 1) | (single > total), bad).otherwise(F.array(single - 1))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(spec, ","), one))))


def head_lines(text: Column, n: int) -> Column:
    """The first n lines and how many more there are; 0 is no limit."""
    lines = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    more = F.size(lines) - n
    if n == 0:
        return F.array_join(lines, "\n")
    return F.when(more > 0, F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit("\n... ("), more.cast("string"), F.lit(" more lines)"))).otherwise(F.array_join(lines, "\n"))


def resumable(manifests: DataFrame, books: DataFrame) -> DataFrame:
    """Manifests of unfinished jobs whose book exists, with progress."""
    rows = manifests.where(F.col("state").isin(*RESUMABLE)).join(books.select(F.col("id").alias("book_id"), "title"), "book_id")
    total, done = F.size("selected"), F.size(F.array_distinct("completed"))
    percent = F.when(total > 0, tenths(done / total * 100)).otherwise(0.0)
    return rows.select("book_id", "title", total.alias("total"), done.alias("completed"), percent.alias("progress_percent"))


def remaining(manifests: DataFrame) -> DataFrame:
    """Selected chapters that aren't completed, in order."""
    left = F.filter("selected", lambda i: ~F.array_contains("completed", i))
    return manifests.select("book_id", F.posexplode(left).alias("ord", "idx"))


def all_selected(selected: Column, completed: Column) -> Column:
    return F.array_sort(F.array_union(selected, completed))


def job_status(jobs: DataFrame, manifests: DataFrame, books: DataFrame) -> DataFrame:
    """The state shown: resumable where a job is absent or ended badly and a manifest can go on, else its own, else lost."""
    can = resumable(manifests, books).select("book_id", F.lit(True).alias("can"))
    rows = books.select(F.col("id").alias("book_id")).join(jobs.select("book_id", "state"), "book_id", "left").join(can, "book_id", "left")
    open_ = F.col("state").isNull() | F.col("state").isin("failed", "cancelled")
    return rows.select("book_id", F.when(open_ & F.col("can"), "resumable").otherwise(F.coalesce("state", F.lit("lost"))).alias("state"))


def progress(base: Column, index: Column, fraction: Column, total: Column) -> Column:
    return (base + index + fraction) / total * 100


def combined_labels(chapters: DataFrame, selected: DataFrame, books: DataFrame) -> DataFrame:
    """Name of the combined output of each book's selected chapters."""
    total = chapters.groupBy("book_id").agg(F.count("*").alias("total"))
    rows = chapters.join(selected, ["book_id", "idx"], "left_semi")
    chosen = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "title"))).alias("chosen"))
    named = books.select(F.col("id").alias("book_id"), F.col("title").alias("book")).join(total, "book_id").join(chosen, "book_id", "left")
    label = F.when(F.col("chosen").isNull(), F.col("book")).otherwise(contiguous_label(F.col("book"), F.col("total"), F.col("chosen")))
    return named.select("book_id", label.alias("label"))


def conversion_plan(manifests: DataFrame, books: DataFrame, chapters: DataFrame, edits: DataFrame, parsed: DataFrame, files: DataFrame) -> DataFrame:
    """What each selected chapter needs: keep, skip_empty, reuse, rename_legacy, rename_temp, lost or synthesise.

    files: book_id, filename, size.
    """
    picked = manifests.select("book_id", F.explode(all_selected(F.col("selected"), F.col("completed"))).alias("idx"), "completed")
    texts = chapter_texts(chapters, edits, parsed).withColumn("spoken", clean("text"))
    rows = picked.join(texts, ["book_id", "idx"]).join(books.select(F.col("id").alias("book_id"), F.col("title").alias("book")), "book_id")
    names = {
        "named": chapter_file(F.col("book"), F.col("idx"), F.col("title")),
        "legacy": safe_filename(F.concat_ws("", "book", F.lit(" - "), "title", F.lit(".mp3"))),
        "temp": F.format_string("_tmp_%04d.mp3", F.col("idx")),
    }
    for name, file in names.items():
        seen = files.where("size > 0" if name == "temp" else "true").select("book_id", F.col("filename").alias(f"{name}_file"), F.col("size").alias(f"{name}_size")).dropDuplicates(["book_id", f"{name}_file"])
        rows = rows.withColumn(f"{name}_file", file).join(seen, ["book_id", f"{name}_file"], "left")
    done = F.array_contains("completed", F.col("idx"))
    action = (
        F.when(~done & is_blank("spoken"), "skip_empty")
        .when(F.when(done, F.col("named_size").isNotNull()).otherwise(F.col("named_size") > 0), "reuse")
        .when(F.col("named_size").isNull() & F.col("legacy_size").isNotNull() & (done | (F.col("legacy_size") > 0)), "rename_legacy")
        .when(F.col("temp_size").isNotNull(), "rename_temp")
        .when(done, "lost")
        .otherwise("synthesise")
    )
    return rows.select("book_id", "idx", "title", F.length("spoken").alias("chars"), action.alias("action"))


def completed_audio(chapters: DataFrame, files: DataFrame, books: DataFrame) -> DataFrame:
    """File that serves each completed chapter: its own name, else the legacy one, else a non-empty temporary one."""
    rows = chapters.join(books.select(F.col("id").alias("book_id"), F.col("title").alias("book")), "book_id")
    options = F.array(
        F.struct(F.lit(0).alias("rank"), chapter_file(F.col("book"), F.col("idx"), F.col("title")).alias("filename")),
        F.struct(F.lit(1).alias("rank"), safe_filename(F.concat_ws("", "book", F.lit(" - "), "title", F.lit(".mp3"))).alias("filename")),
        F.struct(F.lit(2).alias("rank"), F.format_string("_tmp_%04d.mp3", F.col("idx")).alias("filename")),
    )
    tried = rows.select("book_id", "idx", F.inline(options)).join(files, ["book_id", "filename"]).where("rank < 2 or size > 0")
    return tried.groupBy("book_id", "idx").agg(F.min_by("filename", "rank").alias("filename"))


def needs_merge(manifests: DataFrame, labels: DataFrame, files: DataFrame) -> DataFrame:
    """Books with nothing left to convert whose combined outputs are missing."""
    left = remaining(manifests).select("book_id").distinct()
    rows = manifests.join(left, "book_id", "left_anti").join(labels, "book_id")
    m4b = files.where(F.col("filename").endswith(".m4b")).select("book_id", F.lit(True).alias("has_m4b")).distinct()
    mp3 = files.select("book_id", F.col("filename").alias("combined"), F.lit(True).alias("has_mp3")).distinct()
    rows = rows.withColumn("combined", safe_filename(F.concat("label", F.lit(".mp3")))).join(m4b, "book_id", "left").join(mp3, ["book_id", "combined"], "left")
    need = (F.col("output_m4b") & F.col("has_m4b").isNull()) | (F.col("output_mp3") & F.col("has_mp3").isNull())
    return rows.select("book_id", need.alias("needs_merge"))
