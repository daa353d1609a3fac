"""Structure and job rules beside the SQL comparison: folds, ties, fallbacks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.operators import catalog, jobs
from leafmill.operators import structure as st
from leafmill.operators import voices as vo
from leafmill.plans import inline as t


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_heading_fold_depends_on_what_was_kept(spark):
    heads = spark.createDataFrame([("b", 1, 0, "Chapter 1"), ("b", 1, 1, "Chapter 9"), ("b", 4, 0, "Chapter 2 longer"), ("b", 8, 0, "Chapter 3"), ("b", 20, 0, "Chapter 4")], "book_id string, page int, line_no int, title string")
    assert rows(st.merge_headings(heads), "ord", "page", "title") == [(0, 1, "Chapter 2 longer"), (1, 8, "Chapter 3"), (2, 20, "Chapter 4")]


def test_body_size_tie_goes_to_the_first_met(spark):
    chars = spark.createDataFrame([("b", 0, 0, "a", 12.0, 1.0, 1.0), ("b", 0, 1, "b", 10.0, 1.0, 2.0), ("b", 0, 2, "c", 10.0, 1.0, 3.0), ("b", 0, 3, "d", 12.0, 1.0, 4.0)], "book_id string, page int, seq int, text string, size double, top double, x0 double")
    assert rows(st.body_size(chars), "body_size") == [(12.0,)]


def test_sections_at_the_limit(spark):
    df = spark.createDataFrame([("a", "x" * 1998 + "\n\n" + "y"), ("b", "x" * 1999 + "\n\n" + "y"), ("c", " \n ")], "book_id string, text string")
    assert rows(st.txt_sections(df).groupBy("book_id").count(), "book_id", "count") == [("a", 1), ("b", 2)]


def test_preamble_limit_and_title_prefix(spark):
    df = spark.createDataFrame([("a", "p" * 49 + "\nChapter 1 The Start\nbody"), ("b", "p" * 50 + "\nchapter 2\nbody\nChapter 3\n")], "book_id string, text string")
    assert rows(st.txt_chapters(df), "book_id", "idx", "title") == [("a", 0, "Chapter 1"), ("b", 0, "序"), ("b", 1, "chapter 2")]


def pdf(spark):
    return st.pdf_chapters(t.CHARS.frame(spark), t.LINES.frame(spark), t.PAGES.frame(spark), t.OUTLINE.frame(spark))


def test_scanned_book_has_no_chapters_but_an_error(spark):
    chapters = pdf(spark)
    errors = st.pdf_errors(t.PAGES.frame(spark), chapters)
    assert rows(errors, "book_id", "error") == [("p3", "no extractable text (2 pages, 2 characters): scanned pages need character recognition first")]
    with pytest.raises(Exception, match="p3: no extractable text"):
        st.checked(t.PAGES.frame(spark), chapters).collect()
    kept = t.PAGES.frame(spark).where("book_id != 'p3'")
    assert st.checked(kept, chapters).count() == chapters.count()


def test_outline_without_chapters_falls_to_page_groups(spark):
    assert rows(pdf(spark).where("book_id = 'q4'"), "idx", "title", "text") == [(0, "Section 1 (pages 1-3)", " ".join(f"Page {i} of a book with sub-entries only" for i in range(3)))]


def test_sections_collapse_after_packing(spark):
    got = rows(st.txt_sections(t.TXT.frame(spark)).where("book_id in ('t7', 't8')"), "book_id", "idx", "title", "text")
    # the second book's first block has 1999 characters as it stands, so the section is full before "e"
    assert got == [("t7", 0, "Section 1", "one two three four five"), ("t8", 0, "Section 1", "c d"), ("t8", 1, "Section 2", "e")]


def test_front_matter_documents_are_chapters_of_their_own(spark):
    got = rows(st.epub_chapters(t.SPINE.frame(spark), t.TOC.frame(spark)).where("book_id in ('e4', 'e5')"), "book_id", "idx", "title")
    # e5 lists one titled entry only, so its documents are chapters under their own titles
    assert got == [("e4", 0, "Preface"), ("e4", 1, "Chapter 2"), ("e4", 2, "First"), ("e4", 3, "Second"), ("e5", 0, "First"), ("e5", 1, "Second")]


def test_line_step_is_taken_from_rounded_places(spark):
    # 10.06 and 13.10 round to 10.1 and 13.1, a step of 3.0; 16.2 is 3.1 further
    assert rows(st.pdf_lines(t.CHARS.frame(spark)).where("book_id = 'q5'"), "text") == [("ab",), ("c",)]


def test_bare_headings_repeat_with_a_numeral_and_silence_without(spark):
    got = rows(st.pattern_headings(t.LINES.frame(spark)).where("book_id = 'q2'"), "page", "title")
    assert got == [(0, "CHAPTER IV"), (9, "CHAPTER IV"), (20, "Chapter")]


def test_orphan_sub_heading_goes(spark):
    lines, sizes = t.LINES.frame(spark), st.body_size(t.CHARS.frame(spark))
    toc = st.toc_pages(lines, sizes)
    got = rows(st.size_headings(lines, sizes, st.line_frequency(lines, toc), toc).where("book_id = 'q1'"), "ord", "page", "title")
    assert got == [(0, 0, "Overview ● joined"), (1, 3, "Closing words ◆ of this")]


def test_running_heads_are_counted_outside_contents_pages_without_any_trailing_digit(spark):
    lines = t.LINES.frame(spark).where("book_id = 'q3'")
    toc = st.toc_pages(lines, st.body_size(t.CHARS.frame(spark)))
    assert rows(toc, "page") == [(0,)]
    assert ("Heading", 2) in rows(st.line_frequency(lines, toc), "base", "n")
    assert "Fourth title" not in {r[0] for r in rows(st.line_frequency(lines, toc), "base")}


def test_library_keeps_books_without_a_file_and_fills_in_languages(spark):
    got = rows(catalog.library(t.BOOKS.frame(spark), t.PRESENT.frame(spark), t.EDITS.frame(spark), t.CHAPTERS.frame(spark)), "book_id", "idx", "edited", "detected_language")
    assert {(b, lang) for b, _, _, lang in got} == {("b1", "en-US"), ("b2", "zh-CN"), ("b3", "ru-RU"), ("b6", "ja-JP")}
    assert ("b6", 0, True, "ja-JP") in got and ("b6", 1, False, "ja-JP") in got


def test_text_that_is_nowhere_is_null(spark):
    text = catalog.chapter_texts(t.CHAPTERS.frame(spark), t.EDITS.frame(spark), t.PARSED.frame(spark))
    assert rows(text.where("book_id = 'b6' and idx = 1"), "text") == [(None,)]


def test_numbering_of_hot_groups_equals_a_window(spark):
    df = spark.createDataFrame([(("hot" if i % 4 else f"g{i % 7}") if i % 31 else None, i * 3 % 1009, i) for i in range(900)], "g string, k long, x int")
    want = rows(df.withColumn("idx", F.row_number().over(Window.partitionBy("g").orderBy("k", "x")) - 1).fillna("-", ["g"]), "g", "k", "x", "idx")
    for most, width in ((10**6, 64), (50, 64), (0, 1), (50, 10**6)):
        assert rows(st.numbered(df, ["g"], ["k", "x"], most=most, width=width).fillna("-", ["g"]), "g", "k", "x", "idx") == want
    assert st.numbered(df.limit(0), ["g"], ["k"], most=5).count() == 0
    several = st.numbered(df.where("x < 400"), ["g"], ["k", "x"], sized=df.select("g"), most=50, width=100)
    assert rows(several.where("g = 'hot'"), "idx") == [(i,) for i in range(df.where("x < 400 and g = 'hot'").count())]


def test_sums_of_hot_groups_with_ties(spark):
    df = spark.createDataFrame([("a", i // 3, i % 3, i % 5 - 2) for i in range(300)], "g string, k int, j int, v int")
    want = rows(df.withColumn("s", F.sum("v").over(Window.partitionBy("g").orderBy("k", "j"))), "k", "j", "s")
    assert rows(st.running_sum(df, ["g"], ["k", "j"], "v", "s", most=10, width=8), "k", "j", "s") == want


def test_spans_of_a_large_book_are_tried_by_block(spark):
    """100,000 pages and 20,000 entries of one book: each page meets the few entries of its block."""
    pages = spark.range(100_000).select(F.lit("b").alias("book_id"), F.col("id").cast("int").alias("page"))
    starts = [i * 5 + (i * i) % 4 for i in range(20_000)]
    spans = spark.createDataFrame([("b", i, s, t) for i, (s, t) in enumerate(zip(starts, [*starts[1:], 100_000]))], "book_id string, ord int, start int, stop int")
    got = st.within(pages, spans, ["book_id"], "page", "start", "stop")
    assert got.count() == 100_000 and got.where("page < start or page >= stop").count() == 0 and got.select("page").distinct().count() == 100_000
    block = lambda c: F.floor(c / st.SPAN_BLOCK)
    tried = spans.select(F.explode(F.sequence(block(F.col("start")), block(F.col("stop") - 1))).alias("k")).groupBy("k").agg((F.count("*") * st.SPAN_BLOCK).alias("n")).agg(F.sum("n")).head()[0]
    assert tried < 6 * 100_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_overlapping_empty_and_outer_spans(spark):
    points = spark.createDataFrame([(b, p) for b in ("x", "y") for p in range(-3, 60)] + [("x", None), (None, 3)], "b string, p int")
    spans = spark.createDataFrame([("x", 0, 5, 40), ("x", 1, 10, 12), ("x", 2, 12, 12), ("x", 3, 30, 20), ("x", 4, -2, 1), ("x", 5, 50, 900), ("x", 6, 10, 12), ("z", 7, 0, 9), ("x", 8, None, 9), ("x", 9, 3, None)], "b string, i int, lo int, hi int")
    want = sorted((r.b, r.p, s.i) for r in points.collect() for s in spans.collect() if r.b == s.b and None not in (r.p, s.lo, s.hi) and s.lo <= r.p < s.hi)
    for width in (1, 16, 1000):
        assert rows(st.within(points, spans, ["b"], "p", "lo", "hi", width), "b", "p", "i") == want


def test_outline_entries_out_of_page_order_share_pages(spark):
    pages = spark.createDataFrame([("b", i, f"text of page {i}") for i in range(6)], "book_id string, page int, text string")
    outline = spark.createDataFrame([("b", 0, 1, "A", 2), ("b", 1, 1, "B", 6), ("b", 2, 1, "C", 1), ("b", 3, 1, "D", 4)], "book_id string, ord int, level int, title string, page int")
    text = lambda a, b: " ".join(f"text of page {i}" for i in range(a, b))
    # A holds pages 2-5 and C 1-3; B, whose successor comes earlier, holds none
    assert rows(st.chapters_by_outline(outline, pages), "idx", "title", "text") == [(0, "A", text(1, 5)), (1, "C", text(0, 3)), (2, "D", text(3, 6))]


def test_text_of_a_hot_group_is_joined_by_blocks(spark):
    parts = [(("hot" if i % 10 else "cold"), i, i % 2, ["", f"p{i}", " ", None][i % 4]) for i in range(2000)]
    df = spark.createDataFrame(parts, "g string, k int, j int, t string").repartition(7)
    want = sorted((g, "|".join(t for h, _, _, t in parts if h == g and t)) for g in ("hot", "cold"))
    for width in (1, 64, 10**6):
        assert rows(st.ordered_text(df, ["g"], ["k", "j"], "t", "|", width=width), "g", "text") == want
    blank = spark.createDataFrame([("a", 1, ""), ("a", 900_000, None), (None, 2, "x")], "g string, k int, t string")
    assert sorted(map(str, (r["text"] for r in st.ordered_text(blank, ["g"], ["k"], "t", " ").collect()))) == ["", "x"]
    # most rows of one group, dealt: the largest task of the first step reads a small part of them
    big = spark.range(40_000).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.lit("t").alias("t"))
    share = big.groupBy("g", F.floor(F.col("k") / 512).alias("b")).agg(F.count("*").alias("n")).agg(F.max("n")).head()[0]
    assert share / 40_000 < 0.05 and len(st.ordered_text(big, ["g"], ["k"], "t", "", width=512).head()["text"]) == 40_000


def test_text_beyond_a_row_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(st, "MOST_BYTES", 50)
    df = spark.createDataFrame([("long one", i, "x" * 20) for i in range(4)], "g string, k int, t string")
    with pytest.raises(Exception, match="more than 2 GB: long one"):
        st.ordered_text(df, ["g"], ["k"], "t", " ").collect()
    assert st.ordered_text(df.where("k < 2"), ["g"], ["k"], "t", " ").head()["text"] == "x" * 20 + " " + "x" * 20


def test_lines_and_sizes_at_exact_halves(spark):
    assert rows(st.body_size(t.CHARS.frame(spark).where("book_id = 'q6'")), "body_size") == [(11.2,)]
    assert rows(st.pdf_lines(t.CHARS.frame(spark).where("book_id = 'q6'")), "line_no", "text") == [(0, "d"), (1, "e"), (2, "fghi")]



def test_empty_edit_wins(spark):
    text = catalog.chapter_texts(t.CHAPTERS.frame(spark), t.EDITS.frame(spark), t.PARSED.frame(spark))
    assert rows(text.where("book_id = 'b2' and idx = 1"), "text") == [("",)]


@pytest.mark.parametrize("n,want", [(0, "a\nb\nc"), (2, "a\nb\n... (1 more lines)"), (3, "a\nb\nc")])
def test_head_lines(spark, n, want):
    
    df = spark.createDataFrame([("a\r\nb\x0bc",)], "s string")
    assert df.select(jobs.head_lines(F.col("s"), n)).head()[0] == want


def test_built_in_voices(spark):
    counts = {r["provider"]: r["count"] for r in vo.built_in(spark).groupBy("provider").count().collect()}
    assert counts == {"qwen3_mlx": 9, "edge": 21, "baidu": 9, "iflytek": 5, "supertonic": 10, "elevenlabs": 12, "kokoro": 15}


def test_outline_walk(spark):
    from leafmill.operators.outline import outline_rows

    got = rows(outline_rows(t.OBJECTS.frame(spark), t.STARTS.frame(spark)), "book_id", "ord", "level", "title", "page")
    assert got == [
        ("p1", 0, 1, "Alpha", 1), ("p1", 1, 2, "Alpha sub", 3), ("p1", 2, 2, "Beta", 5), ("p1", 3, 1, "Gamma", 6), ("p1", 4, 1, "Delta", 9),
        ("p2", 0, 1, "One", 1), ("p2", 1, 2, "Child", 1), ("p2", 2, 2, "Second child", 2), ("p2", 3, 1, "Two", 2), ("p2", 4, 1, "Three", 3),
    ]
    chain = spark.range(30_000).selectExpr("'b' AS book_id", "cast(id AS int) AS obj", "concat('t', id) AS title", "if(id % 2 = 0, cast(id + 1 AS int), null) AS first", "if(id % 2 = 1, cast(id + 1 AS int), null) AS next", "1 AS page")
    deep = outline_rows(chain, spark.createDataFrame([("b", 0)], "book_id string, obj int"))
    assert deep.count() == 30_000 and deep.agg(F.max("level")).head()[0] == 15_001
    assert outline_rows(chain.limit(0), spark.createDataFrame([], "book_id string, obj int")).count() == 0
