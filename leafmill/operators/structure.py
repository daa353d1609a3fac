"""Chapters out of raw books: plain text, EPUB spines, PDF characters and lines.

All operators take and return DataFrames keyed by book_id; order is always carried by
an explicit ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.numbers import tenths
from leafmill.functions.text import collapse, strip

# Heading patterns, noise patterns and thresholds of the structure rules.
TXT_HEADING = r"(?imUd)^(?:chapter\s+\d+|part\s+\d+|第[一二三四五六七八九十百千\d]+[章节回]|卷[一二三四五六七八九十百千\d]+)"
PDF_HEADING = r"(?Ud)^(第[一二三四五六七八九十百千零〇\d]+[章节回卷篇部]|\bChapter\s+[\dIVXivx]+|\bPart\s+[\dIVXivx]+|\bCHAPTER\s+[\dIVXivx]+|\bPART\s+[\dIVXivx]+)"
SUB_HEADING = r"^(——|–|—|◎|●|◆|◇|▪|▸|>)"
BARE_HEADING, NUMERAL = r"(?Ud)^(CHAPTER|PART|Chapter|Part)\s*$", r"(?Ud)^([\dIVXivx]+)\s*$"
NOISE = r"(?Ud)^([\d+\-*/=().,\s]|[\+\-]{2,}|[a-z]{4,}\d+|\d+[a-z]+\d+|N{3,}|[\+\-]?\d+[\+\-]?)$"
BODY_MARKS = "[，。；：！？,.;:!?]"
MIN_CHAPTER, MIN_PREAMBLE, SECTION_CHARS, PAGE_GROUP = 10, 50, 2000, 5
TITLE_CHARS = 100

#: Rows of a group that one task takes; more are cut into blocks of so many values of the order.
GROUP_ROWS, BLOCK = 1_000_000, 1 << 16
#: Places of a block in which points and spans meet.
SPAN_BLOCK = 16
#: Bytes of the longest text that a row can hold.
MOST_BYTES = (1 << 31) - 64


def _split_hot(rows: DataFrame, by: list[str], sized: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that one task takes, and those of groups of more than `most` rows.

    Group sizes come from the columns `by` alone, of `sized` if its rows are cheaper to read
    than these (a superset of them).  There is at most one hot group in `most` rows, so their
    names are broadcast; where there are none, adaptive execution drops the second branch.
    """
    hot = (rows if sized is None else sized).groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*(F.col(c).alias(f"_hot_{c}") for c in by))
    same = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in by]
    return rows.join(F.broadcast(hot), same, "left_anti"), rows.join(F.broadcast(hot), same, "left_semi")


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, out: str, sized: DataFrame | None = None, most: int = GROUP_ROWS, width: int = BLOCK) -> DataFrame:
    """Sum of `value` over a group's rows up to each row in order, for groups of any size.

    The first order column is an integer.  A hot group is cut into blocks of `width` of its
    values; each block is summed by itself and shifted by the total of the blocks before it,
    so blocks, not rows, of a group meet in one task.
    """
    small, hot = _split_hot(rows, by, sized, most)
    whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    small = small.withColumn(out, F.sum(value).over(whole))
    hot = hot.withColumn("_block", F.floor(F.col(order[0]) / width))
    own = Window.partitionBy(*by, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = hot.groupBy(*by, "_block").agg(F.sum(value).alias("_total"))
    shifts = totals.select(*(F.col(c).alias(f"_of_{c}") for c in by), F.col("_block").alias("_at"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_shift"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_block") == F.col("_at")]
    hot = hot.withColumn(out, F.sum(value).over(own)).join(shifts, same).withColumn(out, F.col(out) + F.col("_shift"))
    return small.unionByName(hot.select(*small.columns))


def ordered_text(rows: DataFrame, by: list[str], order: list[str], text: str, separator: str, out: str = "text", width: int = BLOCK) -> DataFrame:
    """Concatenate a text column per group in a stated order; blank parts are skipped.

    The first order column is an integer.  Each block of `width` of its values is joined
    first, then a group's blocks are, so a group of any size is dealt to many tasks and one
    row per block reaches the last one.  A text of more than 2 GB, which no row can hold, is
    an error that names the group.
    """

    def joined(place: list[str], part: str):
        kept = F.filter(F.transform(F.array_sort(F.collect_list(F.struct(*place, part))), lambda p: p[part]), lambda t: t != "")
        return F.array_join(kept, separator)

    blocks = rows.withColumn("_block", F.floor(F.col(order[0]) / width)).groupBy(*by, "_block").agg(joined(order, text).alias("_text"))
    names = F.concat_ws(", ", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by))
    too_long = F.sum(F.octet_length("_text") + len(separator.encode())) > MOST_BYTES
    error = F.raise_error(F.concat(F.lit("a text of more than 2 GB: "), names)).cast("string")
    return blocks.groupBy(*by).agg(F.when(too_long, error).otherwise(joined(["_block"], "_text")).alias(out))


def reindex(rows: DataFrame, by: list[str], order: list[str], out: str = "idx") -> DataFrame:
    """Number the rows of each group from 0, after filtering."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str = "idx", sized: DataFrame | None = None, most: int = GROUP_ROWS, width: int = BLOCK) -> DataFrame:
    """reindex() for groups of any size; the order is a total one and begins with an integer column."""
    return running_sum(rows.withColumn("_one", F.lit(1)), by, order, "_one", "_sum", sized, most, width).withColumn(out, (F.col("_sum") - 1).cast("int")).drop("_one", "_sum")


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, stop: str, width: int = SPAN_BLOCK) -> DataFrame:
    """The points joined with the spans that hold them, start <= at < stop; spans may overlap.

    Places are ordinals.  A span goes to each block of `width` places that it touches, a
    point to its own, and they meet by group and block: at most the spans that touch its
    block are tried for a point, and the blocks of a large group spread over all tasks.
    """
    touched = spans.where(F.col(start) < F.col(stop)).withColumn("_block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(stop) - 1) / width))))
    return points.withColumn("_block", F.floor(F.col(at) / width)).join(touched, [*by, "_block"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_block")


def txt_chapters(books: DataFrame) -> DataFrame:
    """(book_id, text) -> chapters by heading lines; text without headings falls back to sections."""
    heads = books.withColumn("heads", F.regexp_extract_all("text", F.lit(TXT_HEADING), 0)).withColumn("bodies", F.split("text", TXT_HEADING))
    parts = F.concat(
        F.array(F.struct(F.lit(0).alias("ord"), F.lit("序").alias("title"), F.element_at("bodies", 1).alias("body"))),
        F.zip_with("heads", F.slice("bodies", 2, F.size("bodies")), lambda h, b: F.struct(F.lit(1).alias("ord"), F.trim(h).alias("title"), b.alias("body"))),
    )
    found = heads.where(F.size("heads") > 0).select("book_id", F.posexplode(parts).alias("pos", "part"))
    rows = found.select("book_id", "pos", F.substring("part.title", 1, TITLE_CHARS).alias("title"), collapse(F.col("part.body")).alias("text"))
    rows = rows.where(F.when(F.col("pos") == 0, F.length("text") >= MIN_PREAMBLE).otherwise(F.length("text") > 0))
    chapters = reindex(rows, ["book_id"], ["pos"]).select("book_id", "idx", "title", "text")
    return chapters.unionByName(txt_sections(heads.where(F.size("heads") == 0).select("book_id", "text")))


def txt_sections(books: DataFrame) -> DataFrame:
    """Blocks between blank lines, packed until 2000 characters are reached; white space collapses after packing."""
    blocks = F.filter(F.transform(F.split("text", r"(?Ud)\n\s*\n"), strip), lambda b: b != "")

    def step(acc: Column, block: Column) -> Column:
        grown = F.concat(acc["text"], block, F.lit("\n"))
        full = F.length(grown) >= SECTION_CHARS
        return F.struct(F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(grown).alias("text"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"))
    packed = F.aggregate(blocks, start, step, lambda a: F.when(a["text"] != "", F.concat(a["done"], F.array(a["text"]))).otherwise(a["done"]))
    rows = books.select("book_id", F.posexplode(packed).alias("idx", "text"))
    return rows.select("book_id", "idx", F.concat(F.lit("Section "), (F.col("idx") + 1).cast("string")).alias("title"), collapse("text").alias("text"))


def spine_items(spine: DataFrame, items: DataFrame) -> DataFrame:
    """Spine references with the manifest items they name; unknown references go."""
    return spine.join(items, ["book_id", "item_id"]).select("book_id", "ord", "item_id", "href")


def toc_entries(toc: DataFrame) -> DataFrame:
    """Table-of-contents rows that have a title and name a file, less its fragment; others don't count."""
    return toc.withColumn("href", F.substring_index("href", "#", 1)).where("title != '' and href != ''")


def toc_starts(toc: DataFrame, spine: DataFrame) -> DataFrame:
    """Table-of-contents rows with the spine position their file has; of equal files the last position counts."""
    at = spine.groupBy("book_id", "href").agg(F.max("ord").alias("start"))
    return toc_entries(toc).join(at, ["book_id", "href"]).select("book_id", F.col("ord").alias("toc_ord"), "title", "start")


def toc_spans(starts: DataFrame, spine: DataFrame) -> DataFrame:
    """Half-open spine ranges of the entries; the last ends with the spine."""
    w = Window.partitionBy("book_id").orderBy("start", "toc_ord")
    size = spine.groupBy("book_id").agg((F.max("ord") + 1).alias("n"))
    return starts.join(size, "book_id").withColumn("stop", F.coalesce(F.lead("start").over(w), "n")).drop("n")


def epub_chapters(spine: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters of books by table of contents where it names two places or more, else one per spine document.

    Documents before the first entry are chapters of their own, if they have 50 characters.
    spine: book_id, ord, href, title, text, documents only; toc: book_id, ord, title, href.
    """
    starts = toc_starts(toc, spine)
    entries = toc_entries(toc).groupBy("book_id").agg(F.count("*").alias("entries"))
    usable = starts.groupBy("book_id").agg(F.count("*").alias("hits")).join(entries, "book_id").where("hits >= 2 and entries >= 2").select("book_id")
    ranges = toc_spans(starts.join(usable, "book_id", "left_semi"), spine)
    first = ranges.groupBy("book_id").agg(F.min("start").alias("first"))
    front = spine.join(first, "book_id").where((F.col("ord") < F.col("first")) & (F.length("text") >= MIN_PREAMBLE))
    front = front.select("book_id", F.col("ord").alias("start"), F.lit(-1).alias("toc_ord"), "title", "text")
    inside = within(spine.select("book_id", "ord", F.col("text").alias("part")), ranges, ["book_id"], "ord", "start", "stop")
    text = ordered_text(inside, ["book_id", "start", "toc_ord", "title"], ["ord"], "part", " ").where(F.length("text") >= MIN_CHAPTER)
    rows = reindex(front.unionByName(text), ["book_id"], ["start", "toc_ord"])
    title = F.when(F.col("toc_ord") < 0, document_title("title", "idx")).otherwise(F.col("title"))
    by_toc = rows.select("book_id", "idx", title.alias("title"), "text")
    rest = spine.join(by_toc.select("book_id").distinct(), "book_id", "left_anti")
    return by_toc.unionByName(spine_chapters(rest))


def document_title(title: str, idx: str) -> Column:
    """A document's own title, cut; without one, the number of its chapter."""
    return F.coalesce(F.nullif(F.substring(title, 1, TITLE_CHARS), F.lit("")), F.concat(F.lit("Chapter "), (F.col(idx) + 1).cast("string")))


def spine_chapters(spine: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """One chapter per spine document with 10 characters or more; `sized`: rows with each document's book_id, if they are cheaper to count."""
    rows = spine.where(F.length("text") >= MIN_CHAPTER)
    return numbered(rows, ["book_id"], ["ord"], sized=sized).select("book_id", "idx", document_title("title", "idx").alias("title"), "text")


def html_title(html: Column) -> Column:
    """First non-empty of title, h1, h2, h3."""
    found = [F.nullif(collapse(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), "<[^>]*>", "")), F.lit("")) for t in ("title", "h1", "h2", "h3")]
    return F.substring(F.coalesce(*found), 1, TITLE_CHARS)


def html_text(html: Column) -> Column:
    """Text nodes of the body, joined by spaces (regular expression form)."""
    body = F.regexp_replace(html, r"(?is)^.*?<body\b[^>]*>|</body>.*$", "")
    return collapse(F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " "), "<[^>]*>", " "))


def page_text(text: Column) -> Column:
    """Page text without lines that hold a number only."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(r"(?Ud)^\s*\d+\s*$")), "\n")


def line_sessions(chars: DataFrame) -> DataFrame:
    """Characters with the line they lie on: a step of more than 3 between places rounded to tenths starts one.

    chars: book_id, page, seq, text, size, top, x0.
    """
    page = Window.partitionBy("book_id", "page").orderBy("y", "x0", "seq")
    rows = chars.withColumn("y", tenths("top"))
    rows = rows.withColumn("new", F.coalesce((F.abs(F.col("y") - F.lag("y").over(page)) > 3).cast("int"), F.lit(0)))
    return rows.withColumn("line_no", F.sum("new").over(page.rowsBetween(Window.unboundedPreceding, 0)))


def pdf_lines(chars: DataFrame) -> DataFrame:
    """Characters to lines with their largest size; blank lines go."""
    parts = F.array_sort(F.collect_list(F.struct("y", "x0", "seq", "text")))
    lines = line_sessions(chars).groupBy("book_id", "page", "line_no").agg(strip(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("text"), F.max("size").alias("max_size"))
    return lines.where("text != ''")


def body_size(chars: DataFrame) -> DataFrame:
    """The commonest font size of each book; of equals the one met first."""
    w = Window.partitionBy("book_id").orderBy(F.desc("n"), "first")
    sized = chars.withColumn("size", tenths("size"))
    counts = sized.groupBy("book_id", "size").agg(F.count("*").alias("n"), F.min(F.struct("page", "seq")).alias("first"))
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("book_id", F.col("size").alias("body_size"))


def base_text(text: Column) -> Column:
    """A heading without its trailing page number of up to four digits."""
    return strip(F.regexp_replace(text, r"(?Ud)\d{1,4}$", ""))


def running_text(text: Column) -> Column:
    """A line without all of its trailing digits, as running heads are counted."""
    return strip(F.regexp_replace(text, r"(?Ud)\d+$", ""))


def line_frequency(lines: DataFrame, toc: DataFrame) -> DataFrame:
    """How often each line of 4 to 60 characters occurs in its book outside table-of-contents pages, trailing digits aside."""
    rows = lines.join(toc, ["book_id", "page"], "left_anti").where(F.length("text").between(4, 60))
    rows = rows.withColumn("base", running_text(F.col("text"))).where(F.length("base") >= 4)
    return rows.groupBy("book_id", "base").agg(F.count("*").alias("n"))


def toc_pages(lines: DataFrame, sizes: DataFrame, factor: float = 1.15) -> DataFrame:
    """Pages that look like a table of contents: four or more short large lines."""
    large = (F.col("max_size") >= F.col("body_size") * factor) & (F.length("text") > 2) & (F.length("text") < 60)
    return lines.join(sizes, "book_id").groupBy("book_id", "page").agg(F.count_if(large).alias("n")).where("n >= 4").select("book_id", "page")


def is_noise(text: Column) -> Column:
    digits = F.regexp_count(text, F.lit(r"(?Ud)\d"))
    return (F.length(text) < 3) | text.rlike(NOISE) | ((digits > F.length(text) * 0.5) & (F.length(text) < 30)) | text.rlike(r"\(cid:\d+\)")


def pattern_headings(lines: DataFrame) -> DataFrame:
    """Heading lines whose base was not met before in their book; a bare word borrows the page's first numeral line.

    The test sees the base before it borrows, and what later lines are tested against is
    the title after: bare words with a numeral repeat, one without silences those after it.
    """
    page = Window.partitionBy("book_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numeral = F.first(F.when(strip("text").rlike(NUMERAL), strip("text")), ignorenulls=True).over(page)
    rows = lines.withColumn("numeral", numeral).where(strip("text").rlike(PDF_HEADING)).withColumn("base", base_text(strip("text")))
    rows = rows.where(~(F.col("base").rlike(BODY_MARKS) & (F.length("base") > 15))).withColumn("bare", F.col("base").rlike(BARE_HEADING))
    rows = rows.withColumn("title", F.when(F.col("bare") & F.col("numeral").isNotNull(), F.concat(F.col("base"), F.lit(" "), F.col("numeral"))).otherwise(F.col("base")))
    earlier = Window.partitionBy("book_id", "base").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    silent = F.coalesce(F.max(F.col("bare") & F.col("numeral").isNull()).over(earlier), F.lit(False))
    rows = rows.withColumn("silent", F.col("bare") & silent).where("not silent")
    w = Window.partitionBy("book_id", "title").orderBy("page", "line_no")
    return rows.withColumn("k", F.row_number().over(w)).where("bare or k = 1").select("book_id", "page", "line_no", "title")


def merge_headings(headings: DataFrame, near: int = 5) -> DataFrame:
    """Drop a heading on the last kept one's page; within `near` pages keep that one with the longer title.

    A fold over each book's headings: what is dropped depends on what was kept.
    """

    def step(acc: Column, h: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.when(F.length(h["title"]) > F.length(last["title"]), h["title"]).otherwise(last["title"])
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["page"].alias("page"), longer.alias("title"))))
        return F.when(F.size(acc) == 0, F.array(h)).when(h["page"] == last["page"], acc).when(h["page"] - last["page"] <= near, merged).otherwise(F.concat(acc, F.array(h)))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "title"))), lambda h: F.struct(h["page"].alias("page"), h["title"].alias("title")))
    folded = headings.groupBy("book_id").agg(ordered.alias("h"))
    kept = F.aggregate("h", F.expr("cast(array() as array<struct<page:int,title:string>>)"), step)
    return folded.select("book_id", F.posexplode(kept).alias("ord", "h")).select("book_id", "ord", "h.page", "h.title")


def size_headings(lines: DataFrame, sizes: DataFrame, frequency: DataFrame, toc: DataFrame, factor: float = 1.15) -> DataFrame:
    """Large lines as headings: rare, 2 to 80 characters, no noise.

    A sub-heading joins the heading before it on its page, and goes if there is none.
    """
    rows = lines.join(sizes, "book_id").join(toc, ["book_id", "page"], "left_anti")
    rows = rows.where((F.col("max_size") >= F.col("body_size") * factor) & F.length("text").between(2, 80) & ~is_noise(F.col("text")))
    rows = rows.withColumn("base", running_text(F.col("text"))).join(frequency, ["book_id", "base"], "left").where(F.coalesce("n", F.lit(0)) < 3)

    def step(acc: Column, h: Column) -> Column:
        last = F.element_at(acc, -1)
        sub, joins = h["title"].rlike(SUB_HEADING), (F.size(acc) > 0) & (h["page"] == last["page"])
        merged = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["page"].alias("page"), F.concat(last["title"], F.lit(" "), h["title"]).alias("title"))))
        return F.when(sub & joins, merged).when(sub, acc).when((F.size(acc) > 0) & (h["title"] == last["title"]), acc).otherwise(F.concat(acc, F.array(h)))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda h: F.struct(h["page"].alias("page"), h["text"].alias("title")))
    folded = rows.groupBy("book_id").agg(ordered.alias("h"))
    kept = F.aggregate("h", F.expr("cast(array() as array<struct<page:int,title:string>>)"), step)
    return folded.select("book_id", F.posexplode(kept).alias("ord", "h")).select("book_id", "ord", "h.page", "h.title")


def pdf_headings(chars: DataFrame, lines: DataFrame) -> DataFrame:
    """Headings of each book: three or more by pattern; else pattern and size together, or size alone from two on."""
    sizes = body_size(chars)
    toc = toc_pages(lines, sizes)
    frequency = line_frequency(lines, toc)
    plain = merge_headings(pattern_headings(lines.join(toc, ["book_id", "page"], "left_anti"))).withColumn("src", F.lit(0))
    large = size_headings(lines, sizes, frequency, toc).withColumn("src", F.lit(1))
    counts = lines.select("book_id").distinct()
    for name, rows in (("n_plain", plain), ("n_large", large)):
        counts = counts.join(rows.groupBy("book_id").agg(F.count("*").alias(name)), "book_id", "left").fillna(0, [name])
    both = plain.unionByName(large).join(counts, "book_id")
    use = F.when(F.col("n_plain") >= 3, F.col("src") == 0).when(F.col("n_plain") >= 1, True).otherwise(F.col("n_large") >= 2)
    return reindex(both.where(use), ["book_id"], ["page", "src", "ord"], "pos").select("book_id", "pos", "page", "title")


def without_numbers(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", page_text(F.col("text")))


def chapters_by_page(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters from heading to heading; books with fewer than two headings have none."""
    pages = without_numbers(pages)
    w = Window.partitionBy("book_id").orderBy("page", "pos")
    size = pages.groupBy("book_id").agg((F.max("page") + 1).alias("n"))
    several = headings.groupBy("book_id").agg(F.count("*").alias("k")).where("k >= 2").select("book_id")
    spans = headings.join(several, "book_id", "left_semi").join(size, "book_id").withColumn("stop", F.coalesce(F.lead("page").over(w), "n")).withColumnRenamed("page", "start")
    inside = within(pages.select("book_id", "page", F.col("text").alias("part")), spans, ["book_id"], "page", "start", "stop")
    text = ordered_text(inside, ["book_id", "start", "pos", "title"], ["page"], "part", "\n").withColumn("text", collapse("text"))
    rows = reindex(text.where(F.length("text") >= MIN_CHAPTER), ["book_id"], ["start", "pos"])
    return rows.select("book_id", "idx", F.substring("title", 1, TITLE_CHARS).alias("title"), "text")


def chapters_by_outline(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapters of level-1 outline entries (pages from 1); an entry ends before the next of any level.

    Entries out of page order may hold the same pages.
    """
    pages = without_numbers(pages)
    w = Window.partitionBy("book_id").orderBy("ord")
    size = pages.groupBy("book_id").agg((F.max("page") + 1).alias("n"))
    spans = outline.join(size, "book_id").withColumn("stop", F.coalesce(F.lead("page").over(w) - 1, "n")).where("level = 1")
    spans = spans.select("book_id", "ord", "title", (F.col("page") - 1).alias("start"), "stop")
    inside = within(pages.select("book_id", "page", F.col("text").alias("part")), spans, ["book_id"], "page", "start", "stop")
    text = ordered_text(inside, ["book_id", "ord", "title"], ["page"], "part", "\n").withColumn("text", collapse("text"))
    rows = reindex(text.where(F.length("text") >= MIN_CHAPTER), ["book_id"], ["ord"])
    return rows.select("book_id", "idx", F.substring("title", 1, TITLE_CHARS).alias("title"), "text")


def page_groups(pages: DataFrame, size: int = PAGE_GROUP) -> DataFrame:
    """Sections of five pages each, numbered after short ones are dropped."""
    pages = without_numbers(pages)
    total = pages.groupBy("book_id").agg((F.max("page") + 1).alias("n"))
    grouped = pages.withColumn("g", F.floor(F.col("page") / size).cast("int"))
    text = ordered_text(grouped, ["book_id", "g"], ["page"], "text", "\n", "text").withColumn("text", collapse("text")).where(F.length("text") >= MIN_CHAPTER)
    rows = reindex(text, ["book_id"], ["g"]).join(total, "book_id")
    title = F.format_string("Section %d (pages %d-%d)", F.col("idx") + 1, F.col("g") * size + 1, F.least(F.col("g") * size + size, "n"))
    return rows.select("book_id", "idx", title.alias("title"), "text")


def pdf_chapters(chars: DataFrame, lines: DataFrame, pages: DataFrame, outline: DataFrame) -> DataFrame:
    """By outline where it has two entries or more, else by headings; page groups where that yields no chapter.

    A book without any chapter is named by pdf_errors().
    """
    rich = outline.groupBy("book_id").agg(F.count("*").alias("k")).where("k >= 2").select("book_id")
    by_outline = chapters_by_outline(outline.join(rich, "book_id", "left_semi"), pages)
    by_heading = chapters_by_page(pdf_headings(chars, lines).join(rich, "book_id", "left_anti"), pages)
    found = by_outline.unionByName(by_heading)
    return found.unionByName(page_groups(pages.join(found.select("book_id").distinct(), "book_id", "left_anti")))


def extracted_chars(pages: DataFrame) -> DataFrame:
    """Pages and extracted characters per book, page numbers aside."""
    return without_numbers(pages).groupBy("book_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"))


def pdf_errors(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """The error of each book that yields no chapter, most likely one of scanned pages."""
    message = F.format_string("no extractable text (%d pages, %d characters): scanned pages need character recognition first", "pages", "chars")
    return extracted_chars(pages).join(chapters.select("book_id").distinct(), "book_id", "left_anti").select("book_id", message.alias("error"))


def checked(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapters; as they are read, a book without any raises its error."""
    failed = pdf_errors(pages, chapters).select("book_id", F.lit(0).alias("idx"), F.raise_error(F.concat_ws(": ", "book_id", "error")).cast("string").alias("title"), F.lit("").alias("text"))
    return chapters.unionByName(failed)
