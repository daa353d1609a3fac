"""Inline rows that both engines get alike: a Spark frame, and a DuckDB subquery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "array<double>": "DOUBLE[]"}


class Rows:
    """A small table: columns as 'name type, ...' and its rows."""

    def __init__(self, columns: str, *rows: tuple):
        self.columns = [tuple(c.strip().split(" ", 1)) for c in columns.split(", ")]
        self.rows = rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), ", ".join(f"{n} {t}" for n, t in self.columns))

    @property
    def sql(self) -> str:
        names = ", ".join(f"CAST(c{i} AS {_DUCK[t]}) AS {n}" for i, (n, t) in enumerate(self.columns))
        values = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in self.rows)
        return f"(SELECT {names} FROM (VALUES {values}) AS v({', '.join(f'c{i}' for i in range(len(self.columns)))}))"


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def tenths_sql(x: str) -> str:
    """A double to the nearest tenth by its exact value, ties to even: as an integer of 60 binary places (for up to a million)."""
    m = f"(({x}) * 1152921504606846976)::HUGEINT"
    half = "1152921504606846976::HUGEINT"
    down = f"(({m} * 20 + {half}) - (({m} * 20 + {half}) % (2 * {half}) + 2 * {half}) % (2 * {half})) // (2 * {half})"
    return f"((({down}) - CASE WHEN ({m} * 20 + {half}) % (2 * {half}) = 0 AND ({down}) % 2 <> 0 THEN 1 ELSE 0 END)::DOUBLE / 10)"


TEXTS = Rows(
    "id int, s string",
    (1, "Plain words, nothing else."), (2, "  spaced\t\tout \n text  "), (3, ""), (4, "   "), (5, None),
    (6, "a&nbsp;b &amp; c &#8217; <b>bold</b> <p class='x'>para</p>"), (7, "![alt](img.png) and [label](http://x.y/z) here"),
    (8, "# Head\n## Sub\n###### Six\ntext"), (9, "`code` and ```fence``` and **bold** _it_ snake_case"),
    (10, "* one\n- two\n+ three\n12. four"), (11, "see https://example.com/a?b=c, or write a.b+c@mail.example.org now"),
    (12, "“quoted” ‘single’ – and — dots…"), (13, "word[1] other [12] x(3) in (1990) a[1][2] end(45)."),
    (14, "wide　space em nbsp line\u0085next"), (15, "你好世界。今天天气很好！"), (16, "これはテストです。もう一つ。"), (17, "안녕하세요 세계"),
    (18, "Привет мир, как дела?"), (19, "mixed 中文 and English words here"), (20, "One. Two! Three? Four.Five"), (21, "emoji 😀 and 𝒳 astral"),
    (22, "a, b; c: d，e；f：g 10:30"), (23, "x" * 25), (24, "short. " + "y" * 12 + ", " + "z" * 31 + "; tail words."), (25, "字" * 23),
)
SECONDS = Rows("id int, s double", (1, 0.0), (2, 0.4), (3, 59.4), (4, 60.0), (5, 90.0), (6, 150.0), (7, 3599.0), (8, 3600.0), (9, 7199.0), (10, 5430.0), (11, 45.2), (12, 210.0))
NAMES = Rows("id int, s string", (1, 'a/b\\c:d*e?f"g<h>i|j'), (2, "n" * 230), (3, "Title (An Author)"), (4, "标题（作者）"), (5, "No author"), (6, "Two (A) (B)"), (7, "k=v#c\\d\r\ne"), (8, ""), (9, "Empty () here"))
SPEEDS = Rows("id int, s double", (1, 1.0), (2, 1.2), (3, 0.75), (4, 2.0), (5, 0.5), (6, 3.4), (7, 1.33), (8, 0.1), (9, 5.0))
TAGS = Rows("id int, tag string, seconds double, cloned boolean", (1, "zh-CN", 120.0, False), (2, "en-US", 120.0, True), (3, "ja-JP", 30.0, False), (4, "xx-YY", 10.0, False), (5, "pt-PT", 90.0, True), (6, "pt-BR", 90.0, False), (7, "zh-TW", 12.5, False), (8, "vi-VN", 45.0, False))
SPECS = Rows("id int, spec string, total int", (1, "1-5,7,10-", 12), (2, "-3", 9), (3, "5-3", 9), (4, "2,2,1", 5), (5, "8-99", 10), (6, "-", 4), (7, "3", 3))
BOOKS = Rows(
    "id string, title string, author string, format string, file_path string, uploaded_at string, detected_language string",
    ("b1", "First Book", "Ann", "epub", "/u/b1.epub", "2024-01-02T03:04:05.678", None), ("b2", "A very long title that goes on and on for more than forty", "Bo = C", "txt", "/u/b2.txt", "2024-02-02T00:00:00", "zh-CN"),
    ("b3", "Third#1", "", "pdf", "/u/b3.pdf", "2024-03-01T10:00:00.1", ""), ("b4", "Fourth", "Di", "epub", "/gone/b4.epub", "2024-04-01T10:00:00", None),
    ("b6", "Held without a file", "Ed", "txt", "", "2024-04-02T10:00:00", None),
)
PRESENT = Rows("path string", ("/u/b1.epub",), ("/u/b2.txt",), ("/u/b3.pdf",), ("/u/new.txt",))
CHAPTERS = Rows(
    "book_id string, idx int, title string, text string, char_count int, seconds double, edited boolean",
    ("b1", 0, "One", "The first chapter has some words to say.", 40, 3.21, False), ("b1", 1, "Two", "", 0, 61.0, False), ("b1", 2, "Three", "Third[1] text, with a note.", 27, 2.4, True), ("b1", 3, "Four", "  [3] ", 6, 0.0, False),
    ("b2", 0, "序", "这是第一章的文字，足够长可以检测语言了吧，是的没错。", 26, 6.5, False), ("b2", 1, "English", "Then English text follows in the second one.", 44, 3.2, False), ("b2", 2, "Tail", "tiny", 4, 0.4, False),
    ("b3", 0, "Only", "привет мир это русский текст для проверки языка", 47, 2.8, False), ("b4", 0, "Solo", "A solitary chapter in a book whose file is gone.", 48, 4.0, False),
    ("b6", 0, "Edited", "", 0, 0.0, False), ("b6", 1, "Unfound", "", 0, 0.0, False),
)
PARSED = Rows("book_id string, idx int, text string", ("b1", 1, "Parsed second chapter."), ("b1", 3, "parsed four"), ("b2", 2, "parsed tail"))
EDITS = Rows("book_id string, idx int, text string", ("b1", 2, "Edited third **text** here."), ("b2", 1, ""), ("b6", 0, "これは編集された章の文章で、言語を判定できます。"), ("b9", 0, "orphan"))
CONVERSIONS = Rows("book_id string, pos int, ts string", ("b1", 0, "2024-05-01T10:00:00.123456"), ("b1", 1, "2024-05-02T11:30:00.5"), ("b2", 0, "2024-05-03T09:00:00"))
GONE_RECORDS = Rows("book_id string, ts string", ("b1", "2024-05-01T10:00:00.123456"), ("b2", "never"))
FRESH_RECORDS = Rows("book_id string, pos int, ts string", ("b3", 0, "2024-06-01T00:00:00"))
OUTPUTS = Rows("book_id string, ts string, filename string, type string", ("b1", "2024-05-01T10:00:00.123456", "First Book.m4b", "m4b"), ("b1", "2024-05-01T10:00:00.123456", "First Book - 0000 - One.mp3", "chapter"), ("b1", "2024-05-01T10:00:00.123456", "First Book - 0001 - Two.mp3", "chapter"), ("b2", "2024-05-03T09:00:00", "x.mp3", "mp3"))
CHANGES = Rows("id string, title string, author string", ("b1", " New Title ", ""), ("b2", "   ", "New Author"), ("b7", "x", "y"))
GONE_BOOKS = Rows("id string", ("b4",), ("b8",))
MANIFESTS = Rows(
    "book_id string, selected array<int>, completed array<int>, state string, output_m4b boolean, output_mp3 boolean",
    ("b1", [0, 1, 2, 3], [0, 0], "running", True, False), ("b2", [0, 1], [0, 1], "failed", True, True), ("b3", [0], [], "completed", False, True), ("b5", [0, 1], [1], "cancelled", True, True), ("b4", [0], [0], "cancelled", False, False),
)
JOBS = Rows("book_id string, state string", ("b1", "running"), ("b2", "failed"), ("b3", "completed"))
FILES = Rows("book_id string, filename string, size bigint", ("b1", "First Book - 0000 - One.mp3", 5000), ("b1", "First Book - Two.mp3", 100), ("b1", "_tmp_0002.mp3", 20), ("b1", "_tmp_0003.mp3", 0), ("b1", "First Book.mp3", 9000), ("b1", "combined_temp.mp3", 1), ("b1", "First Book.m4b", 1), ("b2", "A very long title that goes on and on for more than forty - 0000 - 序.mp3", 900), ("b4", "a - b.mp3", 3))
SELECTED = Rows("book_id string, idx int", ("b1", 0), ("b1", 1), ("b1", 2), ("b2", 0), ("b2", 2), ("b3", 0), ("b4", 5))
ITEMS = Rows("book_id string, item_id string, href string", ("e1", "i0", "front.xhtml"), ("e1", "i1", "c1.xhtml"), ("e1", "i2", "c2.xhtml"), ("e1", "i3", "c3.xhtml"), ("e1", "i4", "c4.xhtml"))
REFS = Rows("book_id string, ord int, item_id string", ("e1", 0, "i0"), ("e1", 1, "i1"), ("e1", 2, "missing"), ("e1", 3, "i3"), ("e1", 4, "i2"))
SPINE = Rows(
    "book_id string, ord int, href string, title string, text string",
    ("e1", 0, "front.xhtml", "", "Front matter that is long enough to be kept as a chapter of its own."), ("e1", 1, "c1.xhtml", "One", "First chapter text here."), ("e1", 2, "c1b.xhtml", "", ""), ("e1", 3, "c2.xhtml", "Two", "Second chapter text."), ("e1", 4, "c3.xhtml", "Three", "Third chapter text runs on."),
    ("e2", 0, "a.xhtml", "", "A document without any contents."), ("e2", 1, "b.xhtml", "Bee", "short"), ("e2", 2, "c.xhtml", "See", "Another document of the spine."),
    ("e3", 0, "x.xhtml", "X", "Text before the repeated file."), ("e3", 1, "y.xhtml", "Y", "Repeated file, first place."), ("e3", 2, "y.xhtml", "Y", "Repeated file, second place."),
    ("e4", 0, "cover.xhtml", "Cover", "Too short to be kept."), ("e4", 1, "preface.xhtml", "Preface", "A preface that is long enough to be kept as a chapter of its own."), ("e4", 2, "note.xhtml", "", "An untitled note that is long enough to be kept as a chapter too."),
    ("e4", 3, "c1.xhtml", "One", "The first chapter of the fourth book."), ("e4", 4, "c2.xhtml", "Two", "The second chapter of the fourth book."),
    ("e5", 0, "c1.xhtml", "First", "The first document, listed without a title."), ("e5", 1, "c2.xhtml", "Second", "The second document, listed with one."),
)
TOC = Rows("book_id string, ord int, title string, href string", ("e1", 0, "Chapter One", "c1.xhtml#top"), ("e1", 1, "Chapter Two", "c2.xhtml"), ("e1", 2, "Two again", "c2.xhtml#b"), ("e1", 3, "Nowhere", "zz.xhtml"), ("e1", 4, "Chapter Three", "c3.xhtml"), ("e2", 0, "Only", "a.xhtml"), ("e3", 0, "X", "x.xhtml"), ("e3", 1, "Y", "y.xhtml"), ("e4", 0, "First", "c1.xhtml"), ("e4", 1, "", "c1.xhtml"), ("e4", 2, "Dangling", "#x"), ("e4", 3, "Second", "c2.xhtml"), ("e5", 0, "", "c1.xhtml"), ("e5", 1, "Second", "c2.xhtml"))
TXT = Rows(
    "book_id string, text string",
    ("t1", "A preamble that is long enough to be kept, fifty characters at least.\nChapter 1 The Start\nIt begins here.\nCHAPTER 2\n\nChapter 3\nIt goes on."), ("t2", "Short.\nPart 1\nBody of part one.\nPart 2\nBody of part two."), ("t3", "第一章 开始\n这里是正文。\n第二章\n更多正文。\n卷三 终\n完。"),
    ("t4", "\n\n".join(f"Block {i} " + "word " * 120 for i in range(9))), ("t5", "Just a little.\n\nAnd more."), ("t6", "a" * 1999 + "\n\n" + "b" * 10),
    ("t7", "one\ntwo\n\n  three  \n \nfour\n   five"), ("t8", "c\n" + " " * 1996 + "d\n\ne"),
)
PAGES = Rows("book_id string, page int, text string", *[("p1", i, f"Text of page {i} goes here.\n{i + 1}\nmore of it") for i in range(12)], *[("p2", i, f"Body {i} of the second book") for i in range(4)], ("p3", 0, "  "), ("p3", 1, ""), *[("q4", i, f"Page {i} of a book with sub-entries only\n{i}") for i in range(3)])
OUTLINE = Rows("book_id string, ord int, level int, title string, page int", ("p1", 0, 1, "Alpha", 1), ("p1", 1, 2, "Alpha sub", 3), ("p1", 2, 1, "Beta", 5), ("p1", 3, 1, "Gamma", 5), ("p1", 4, 1, "Delta", 9), ("q4", 0, 2, "Sub one", 1), ("q4", 1, 2, "Sub two", 2))
OBJECTS = Rows(
    "book_id string, obj int, title string, first int, next int, page int",
    # nested entries, an untitled one with a child, one without a page but with a child, a reference to nothing
    ("p1", 10, "Alpha", 11, 12, 1), ("p1", 11, "Alpha sub", None, None, 3), ("p1", 12, "", 13, 14, 4), ("p1", 13, "under nothing", None, None, 4), ("p1", 14, "No page", 15, 16, None), ("p1", 15, "Beta", None, 99, 5), ("p1", 16, "Gamma", 98, 17, 6), ("p1", 17, "Delta", None, None, 9),
    # cycles: back to a sibling, to an ancestor, to itself; an entry of two parents
    ("p2", 1, "One", 4, 2, 1), ("p2", 2, "Two", 2, 3, 2), ("p2", 3, "Three", 4, 1, 3), ("p2", 4, "Child", 1, 5, 1), ("p2", 5, "Second child", None, 4, 2),
    ("p3", 7, None, None, None, 1), ("q4", 1, "Unreached", None, None, 1),
)
STARTS = Rows("book_id string, obj int", ("p1", 10), ("p2", 1), ("p3", 7), ("p4", 5))
_LINES = [
    ("p1", 0, [("Contents", 18.0), ("Chapter 1 5", 14.0), ("Chapter 2 9", 14.0), ("Chapter 3 11", 14.0), ("Index", 14.0)]), ("p1", 1, [("Chapter 1", 18.0), ("The body of the page is here.", 10.0), ("Running head", 10.0)]),
    ("p1", 2, [("Running head", 10.0), ("More body text of the page.", 10.0)]), ("p1", 4, [("Chapter 2", 18.0), ("Some more body text, it is long.", 10.0)]), ("p1", 8, [("CHAPTER", 18.0), ("IV", 16.0), ("Body text once again.", 10.0)]),
    ("p1", 11, [("Chapter 2", 12.0), ("The end of the book.", 10.0)]), ("p2", 0, [("Opening", 20.0), ("— a start", 18.0), ("text text text", 10.0), ("12", 20.0)]), ("p2", 2, [("Closing", 20.0), ("(cid:3)(cid:4)", 20.0), ("text text text again", 10.0)]),
    ("q1", 0, [("● orphan", 18.0), ("Overview", 18.0), ("● joined", 16.0), ("body text of the page", 10.0)]), ("q1", 3, [("Closing words", 18.0), ("◆ of this", 18.0), ("more body text here", 10.0)]),
    ("q2", 0, [("CHAPTER 1", 10.0), ("IV", 10.0)]), ("q2", 9, [("CHAPTER 2", 10.0), ("IV", 10.0)]), ("q2", 20, [("Chapter 7", 10.0)]), ("q2", 30, [("Chapter 8", 10.0), ("V", 10.0)]), ("q2", 40, [("CHAPTER IV", 10.0)]),
    ("q3", 0, [("Heading 12345", 18.0), ("Other title", 18.0), ("Third title", 18.0), ("Fourth title", 18.0)]), ("q3", 1, [("Heading 12345", 18.0), ("body text on the first page of the third book", 10.0)]),
    ("q3", 2, [("Heading 67", 18.0), ("body text on the second page of the third book", 10.0)]), ("q4", 0, [("Chapter 1 One", 18.0), ("body text", 10.0)]), ("q4", 2, [("Another large line", 18.0), ("body text", 10.0)]),
]
LINES = Rows("book_id string, page int, line_no int, text string, max_size double", *[(b, p, i, t, s) for b, p, ls in _LINES for i, (t, s) in enumerate(ls)])
CHARS = Rows("book_id string, page int, seq int, text string, size double, top double, x0 double", *[(b, p, i * 100 + k, c, s, 20.0 * i + (0.02 if k % 2 else 0.0), 5.0 * k) for b, p, ls in _LINES for i, (t, s) in enumerate(ls) for k, c in enumerate(t)],
    ("q5", 0, 0, "a", 10.0, 10.06, 0.0), ("q5", 0, 1, "b", 10.0, 13.1, 0.0), ("q5", 0, 2, "c", 10.0, 16.2, 0.0), ("q5", 0, 3, "\t", 10.0, 30.0, 0.0),
    # exact halves: 11.25 is the tie that goes to 11.2, where the other 11.2 is; 10.25 and 13.3 are more than 3 apart
    ("q6", 0, 0, "d", 11.25, 10.25, 0.0), ("q6", 0, 1, "e", 11.2, 13.3, 0.0), ("q6", 0, 2, "f", 11.3, 40.0, 0.0), ("q6", 0, 3, "g", 11.35, 40.0, 1.0), ("q6", 0, 4, "h", 10.75, 40.0, 2.0), ("q6", 0, 5, "i", 11.25, 40.0, 3.0))
PROBES = Rows("path string, size bigint, has_stream boolean, seconds double", ("a", 2048, True, 3.0), ("b", 100, True, 3.0), ("c", 4096, False, 3.0), ("d", 4096, True, 0.4), ("e", 1024, True, 0.5), ("f", None, None, None))
SEGMENTS = Rows("chunk int, seg int, samples array<double>, rate int", (1, 0, [0.5, -0.5, 0.25, 0.0, 0.0, 0.0], 10), (1, 1, [0.001, -0.001, 0.002], 10), (2, 0, [0.0, 0.0], 10), (3, 0, [0.125, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 10), (3, 1, [0.0, 0.02], 20))
HIDDEN = Rows("provider string, id string", ("edge", "en-US-GuyNeural"), ("kokoro", "zf_003"), ("edge", "nobody"))
CUSTOM = Rows("id string, name string, gender string, language string, provider string, description string", ("my_voice", "Mine", None, "en-US", "edge", None), ("other", "Other", "male", "zh", "newprov", "New"))
CLONED = Rows("id string, name string, gender string, language string, description string", ("clone1", "Clone", None, "multi", None))
REQUESTS = Rows(
    "id int, provider string, voice string, language string, detected string, force boolean",
    (1, "edge", "zh-CN-XiaoxiaoNeural", "zh-CN", "zh-CN", False), (2, "edge", "en-US-EmmaNeural", "en-US", "zh-CN", False), (3, "kokoro", "zf_048", "zh-CN", "ja-JP", False), (4, "qwen3_mlx", "vivian", "en-US", "en-US,zh-CN", False),
    (5, "edge", "en-US-EmmaNeural", "en-US", "en-US,zh-CN", False), (6, "kokoro", "zf_048", "zh-CN", "ja-JP,ru-RU", True), (7, "edge", "x", "en-US", None, False), (8, "nope", "x", "en-US", "zh-CN", False), (9, "baidu", "3", "zh-CN", "en-US,zh-CN", False),
)
WISHES = Rows("wish int, wanted string", (1, "zh-CN"), (2, "en-US"), (3, "en-GB"), (4, "ZH-TW"), (5, None), (6, "fr"))
