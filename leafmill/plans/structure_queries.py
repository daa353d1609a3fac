"""Queries of the structure operators (S, C, W, J1-J4, A3-A5, A12, A13, F4, F8, F9, L1, L2, L6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import outline
from leafmill.operators import structure as st
from leafmill.plans.base import Query, table
from leafmill.plans.inline import CHARS, ITEMS, LINES, OBJECTS, OUTLINE, PAGES, REFS, SPINE, STARTS, TOC, TXT, tenths_sql
from leafmill.plans.text_queries import W, collapse_sql, strip_sql

_HEADING = r"(?im)^(?:chapter\s+\d+|part\s+\d+|第[一二三四五六七八九十百千\d]+[章节回]|卷[一二三四五六七八九十百千\d]+)"
_MARKED = f"regexp_replace(text, '({_HEADING})', chr(1) || '\\1' || chr(2), 'g')"
_SECTIONS = f"""
  blocks AS (SELECT book_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda q: {strip_sql('q')}), lambda q: q <> '') AS l FROM {{src}}),
  packed AS (SELECT book_id, list_reduce(l, lambda z, q: CASE WHEN length(z.t || q || chr(10)) >= 2000 THEN {{'d': list_append(z.d, z.t || q || chr(10)), 't': ''}} ELSE {{'d': z.d, 't': z.t || q || chr(10)}} END, {{'d': []::VARCHAR[], 't': ''}}) AS z FROM blocks),
  sections AS (SELECT book_id, unnest(CASE WHEN z.t <> '' THEN list_append(z.d, z.t) ELSE z.d END) AS text, generate_subscripts(CASE WHEN z.t <> '' THEN list_append(z.d, z.t) ELSE z.d END, 1) - 1 AS idx FROM packed)"""
_TXT = f"""WITH src AS {TXT.sql}, marked AS (SELECT book_id, string_split({_MARKED}, chr(1)) AS parts, text FROM src),
  plain AS (SELECT book_id, text FROM marked WHERE len(parts) = 1),
  pieces AS (SELECT book_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS pos FROM marked WHERE len(parts) > 1),
  named AS (SELECT book_id, pos, CASE WHEN pos = 0 THEN '序' ELSE substring(split_part(p, chr(2), 1), 1, 100) END AS title, CASE WHEN pos = 0 THEN {collapse_sql('p')} ELSE {collapse_sql('split_part(p, chr(2), 2)')} END AS text FROM pieces),
  kept AS (SELECT * FROM named WHERE CASE WHEN pos = 0 THEN length(text) >= 50 ELSE length(text) > 0 END),{_SECTIONS.replace('{src}', 'plain')}
SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY pos) - 1)::INTEGER AS idx, title, text FROM kept
UNION ALL SELECT book_id, idx::INTEGER, 'Section ' || (idx + 1), {collapse_sql('text')} FROM sections"""
_TOC = f"""spine AS {SPINE.sql}, toc AS (SELECT book_id, ord, title, split_part(href, '#', 1) AS href FROM {TOC.sql} WHERE title <> '' AND split_part(href, '#', 1) <> ''),
  place AS (SELECT book_id, href, max(ord) AS start FROM spine GROUP BY ALL), n AS (SELECT book_id, max(ord) + 1 AS n FROM spine GROUP BY ALL),
  starts AS (SELECT toc.book_id, toc.ord AS toc_ord, toc.title, start FROM toc JOIN place ON toc.book_id = place.book_id AND toc.href = place.href)"""
_SPANS = "spans AS (SELECT starts.*, coalesce(lead(start) OVER (PARTITION BY starts.book_id ORDER BY start, toc_ord), n) AS stop FROM starts JOIN n USING (book_id))"
_USABLE = "usable AS (SELECT book_id FROM starts GROUP BY 1 HAVING count(*) >= 2 AND (SELECT count(*) FROM toc WHERE toc.book_id = starts.book_id) >= 2)"
_BY_TOC = """ranges AS (SELECT * FROM spans WHERE book_id IN (FROM usable)), head AS (SELECT book_id, min(start) AS first FROM ranges GROUP BY 1),
  joined AS (SELECT r.book_id, start, toc_ord, r.title, string_agg(s.text, ' ' ORDER BY s.ord) FILTER (s.text <> '') AS text FROM ranges r JOIN spine s ON s.book_id = r.book_id AND s.ord >= start AND s.ord < stop GROUP BY ALL HAVING length(string_agg(s.text, ' ' ORDER BY s.ord) FILTER (s.text <> '')) >= 10
    UNION ALL SELECT book_id, ord, -1, title, text FROM spine JOIN head USING (book_id) WHERE ord < first AND length(text) >= 50),
  places AS (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY start, toc_ord) - 1)::INTEGER AS idx FROM joined),
  by_toc AS (SELECT book_id, idx, CASE WHEN toc_ord >= 0 THEN title ELSE coalesce(nullif(substring(title, 1, 100), ''), 'Chapter ' || (idx + 1)) END AS title, text FROM places)"""
_BY_SPINE = "SELECT book_id, idx, coalesce(nullif(substring(title, 1, 100), ''), 'Chapter ' || (idx + 1)) AS title, text FROM (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1)::INTEGER AS idx, title, text FROM spine WHERE length(text) >= 10 {where})"
_FONT = f"SELECT book_id, {tenths_sql('size')} AS size, count(*) AS n, min(page * 100000 + seq) AS first FROM {CHARS.sql} GROUP BY ALL"
_BODY = f"body AS (SELECT book_id, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, first) AS k FROM ({_FONT})) WHERE k = 1)"
_BASE = "trim(regexp_replace({x}, '\\d{{1,4}}$', ''))"
_TOCP = "tocp AS (SELECT book_id, page FROM lines JOIN body USING (book_id) GROUP BY ALL HAVING count(*) FILTER (max_size >= body_size * 1.15 AND length(text) > 2 AND length(text) < 60) >= 4)"
_RUNNING = "trim(regexp_replace({x}, '\\d+$', ''))"
_FREQ = f"freq AS (SELECT book_id, {_RUNNING.format(x='text')} AS base, count(*) AS n FROM lines WHERE (book_id, page) NOT IN (SELECT (book_id, page) FROM tocp) AND length(text) BETWEEN 4 AND 60 AND length({_RUNNING.format(x='text')}) >= 4 GROUP BY ALL)"
_PDF_HEADING = r"^(第[一二三四五六七八九十百千零〇\d]+[章节回卷篇部]|Chapter\s+[\dIVXivx]+|Part\s+[\dIVXivx]+|CHAPTER\s+[\dIVXivx]+|PART\s+[\dIVXivx]+)"
_PLAIN = f"""cand AS (SELECT *, first_value(CASE WHEN regexp_matches(trim(text), '^[\\dIVXivx]+\\s*$') THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY book_id, page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS numeral FROM lines WHERE (book_id, page) NOT IN (SELECT (book_id, page) FROM tocp)),
  hits AS (SELECT *, {_BASE.format(x='trim(text)')} AS base FROM cand WHERE regexp_matches(trim(text), '{_PDF_HEADING}')),
  bared AS (SELECT *, regexp_matches(base, '^(CHAPTER|PART|Chapter|Part)\\s*$') AS bare FROM hits WHERE NOT (regexp_matches(base, '[，。；：！？,.;:!?]') AND length(base) > 15)),
  told AS (SELECT *, count(*) FILTER (bare AND numeral IS NULL) OVER (PARTITION BY book_id, base ORDER BY page, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS silencers, CASE WHEN bare AND numeral IS NOT NULL THEN base || ' ' || numeral ELSE base END AS title FROM bared),
  plain AS (SELECT book_id, page, line_no, title FROM (SELECT *, row_number() OVER (PARTITION BY book_id, title ORDER BY page, line_no) AS k FROM told WHERE NOT (bare AND silencers > 0)) WHERE bare OR k = 1)"""
_MERGE = """folded AS (SELECT book_id, list_reduce(list({'page': page, 'title': title} ORDER BY page, line_no), lambda z, h: CASE WHEN len(z) = 0 THEN [h] WHEN h.page = z[-1].page THEN z WHEN h.page - z[-1].page <= 5 THEN list_append(z[1:len(z)-1], {'page': z[-1].page, 'title': CASE WHEN length(h.title) > length(z[-1].title) THEN h.title ELSE z[-1].title END}) ELSE list_append(z, h) END, []::STRUCT(page INTEGER, title VARCHAR)[]) AS z FROM plain GROUP BY book_id),
  merged AS (SELECT book_id, (generate_subscripts(z, 1) - 1)::INTEGER AS ord, unnest(z) AS h FROM folded)"""
_NOISE = r"(length(text) < 3 OR regexp_matches(text, '^([\d+\-*/=().,\s]|[\+\-]{2,}|[a-z]{4,}\d+|\d+[a-z]+\d+|N{3,}|[\+\-]?\d+[\+\-]?)$') OR (length(text) - length(regexp_replace(text, '\d', '', 'g')) > length(text) * 0.5 AND length(text) < 30) OR regexp_matches(text, '\(cid:\d+\)'))"
_LARGE = f"""large AS (SELECT book_id, page, line_no, text FROM lines JOIN body USING (book_id) WHERE (book_id, page) NOT IN (SELECT (book_id, page) FROM tocp) AND max_size >= body_size * 1.15 AND length(text) BETWEEN 2 AND 80 AND NOT {_NOISE} AND coalesce((SELECT n FROM freq WHERE freq.book_id = lines.book_id AND freq.base = {_RUNNING.format(x='lines.text')}), 0) < 3),
  folded2 AS (SELECT book_id, list_reduce(list({{'page': page, 'title': text}} ORDER BY page, line_no), lambda z, h: CASE WHEN regexp_matches(h.title, '^(——|–|—|◎|●|◆|◇|▪|▸|>)') THEN CASE WHEN len(z) > 0 AND h.page = z[-1].page THEN list_append(z[1:len(z)-1], {{'page': z[-1].page, 'title': z[-1].title || ' ' || h.title}}) ELSE z END WHEN len(z) > 0 AND h.title = z[-1].title THEN z ELSE list_append(z, h) END, []::STRUCT(page INTEGER, title VARCHAR)[]) AS z FROM large GROUP BY book_id),
  sized AS (SELECT book_id, (generate_subscripts(z, 1) - 1)::INTEGER AS ord, unnest(z) AS h FROM folded2)"""
_PDF = f"WITH lines AS {LINES.sql}, {_BODY}, {_TOCP}, {_FREQ}, {_PLAIN}, {_MERGE}, {_LARGE}"
_HEADINGS = """heads AS (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY page, src, ord) - 1)::INTEGER AS pos, page, title FROM (
    SELECT book_id, ord, h.page AS page, h.title AS title, 0 AS src FROM merged UNION ALL SELECT book_id, ord, h.page, h.title, 1 FROM sized) x
  WHERE CASE WHEN (SELECT count(*) FROM merged m WHERE m.book_id = x.book_id) >= 3 THEN src = 0 WHEN (SELECT count(*) FROM merged m WHERE m.book_id = x.book_id) >= 1 THEN TRUE ELSE (SELECT count(*) FROM sized s WHERE s.book_id = x.book_id) >= 2 END)"""
_NO_NUMBERS = "array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*\\d+\\s*$')), chr(10))"
_PAGED = f"pages_ AS (SELECT book_id, page, {_NO_NUMBERS} AS text FROM {PAGES.sql}), pn AS (SELECT book_id, max(page) + 1 AS n FROM pages_ GROUP BY 1)"
_BY_HEAD = f"""hspans AS (SELECT heads.*, coalesce(lead(page) OVER (PARTITION BY heads.book_id ORDER BY page, pos), n) AS stop FROM heads JOIN pn USING (book_id) WHERE book_id IN (SELECT book_id FROM heads GROUP BY 1 HAVING count(*) >= 2)),
  htext AS (SELECT h.book_id, h.page AS start, pos, title, {collapse_sql("string_agg(p.text, chr(10) ORDER BY p.page) FILTER (p.text <> '')")} AS text FROM hspans h JOIN pages_ p ON p.book_id = h.book_id AND p.page >= h.page AND p.page < stop GROUP BY ALL),
  by_head AS (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY start, pos) - 1)::INTEGER AS idx, substring(title, 1, 100) AS title, text FROM htext WHERE length(text) >= 10)"""
_BY_OUTLINE = f"""ol AS {OUTLINE.sql}, ospans AS (SELECT ol.*, coalesce(lead(page) OVER (PARTITION BY ol.book_id ORDER BY ord) - 1, n) AS stop FROM ol JOIN pn USING (book_id)),
  otext AS (SELECT o.book_id, ord, title, {collapse_sql("string_agg(p.text, chr(10) ORDER BY p.page) FILTER (p.text <> '')")} AS text FROM ospans o JOIN pages_ p ON p.book_id = o.book_id AND p.page + 1 >= o.page AND p.page + 1 <= stop WHERE level = 1 GROUP BY ALL),
  by_outline AS (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1)::INTEGER AS idx, substring(title, 1, 100) AS title, text FROM otext WHERE length(text) >= 10)"""
_GROUPS = f"""gtext AS (SELECT book_id, page // 5 AS g, {collapse_sql("string_agg(text, chr(10) ORDER BY page) FILTER (text <> '')")} AS text FROM pages_ GROUP BY ALL),
  by_group AS (SELECT book_id, idx, 'Section ' || (idx + 1) || ' (pages ' || (g * 5 + 1) || '-' || least(g * 5 + 5, n) || ')' AS title, text FROM (SELECT *, (row_number() OVER (PARTITION BY book_id ORDER BY g) - 1)::INTEGER AS idx FROM gtext WHERE length(text) >= 10) JOIN pn USING (book_id))"""
_PAGE_HOST = "regexp_extract(url, '://([^/]+)', 1)"


def _page_hosts(spark, d):
    return table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("book_id"))


def _page_spine(spark, d):
    """Pages as the spine of a book per host."""
    return table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("book_id"), F.col("page_id").alias("ord"), st.html_title(F.col("html")).alias("title"), st.html_text(F.col("html")).alias("text"))


def _title_sql(x: str) -> str:
    found = [f"nullif({collapse_sql(f'''regexp_replace(regexp_extract({x}, '(?is)<{t}\\b[^>]*>(.*?)</{t}>', 1), '<[^>]*>', '', 'g')''')}, '')" for t in ("title", "h1", "h2", "h3")]
    return f"substring(coalesce({', '.join(found)}), 1, 100)"


def _text_sql(x: str) -> str:
    body = f"regexp_replace({x}, '(?is)^.*?<body\\b[^>]*>|</body>.*$', '', 'g')"
    return collapse_sql(f"regexp_replace(regexp_replace({body}, '(?is)<(script|style)\\b.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')")


def _bounds(places):
    """Where each place of a book ends: the next one, or nowhere, by the ranges that number them."""
    at = st.numbered(places, ["book_id"], ["ord"])
    after = at.select("book_id", F.col("ord").alias("next"), (F.col("idx") - 1).alias("idx"))
    return at.join(after, ["book_id", "idx"], "left").select("book_id", "ord", "next")


def _usable(spark):
    """Books that their table of contents divides."""
    return st.toc_starts(TOC.frame(spark), SPINE.frame(spark)).groupBy("book_id").agg(F.count("*").alias("n")).where("n >= 2").select("book_id")


def _size_headings(spark, d):
    lines, sizes = LINES.frame(spark), st.body_size(CHARS.frame(spark))
    toc = st.toc_pages(lines, sizes)
    return st.size_headings(lines, sizes, st.line_frequency(lines, toc), toc)


def _pdf_chapters(spark):
    return st.pdf_chapters(CHARS.frame(spark), LINES.frame(spark), PAGES.frame(spark), OUTLINE.frame(spark))


_CHOSEN = """rich AS (SELECT book_id FROM ol GROUP BY 1 HAVING count(*) >= 2),
  found AS (SELECT * FROM by_outline WHERE book_id IN (FROM rich) UNION ALL SELECT * FROM by_head WHERE book_id NOT IN (FROM rich)),
  chosen AS (SELECT * FROM found UNION ALL SELECT book_id, idx, title, text FROM by_group WHERE book_id NOT IN (SELECT book_id FROM found))"""

# A walk's place is a list of steps, 0 to the first child and 1 to the next sibling: lists in order are the walk in pre-order.
_WALK = f"""WITH RECURSIVE o AS {OBJECTS.sql}, s AS {STARTS.sql},
  walk AS (SELECT o.book_id, o.obj, 1 AS level, []::INTEGER[] AS place, [o.obj] AS met, title, first, next, page FROM s JOIN o ON o.book_id = s.book_id AND o.obj = s.obj
    UNION ALL SELECT w.book_id, o.obj, w.level + 1 - step, list_append(w.place, step), list_append(w.met, o.obj), o.title, o.first, o.next, o.page FROM (SELECT *, unnest(CASE WHEN title <> '' THEN [0, 1] ELSE [1] END) AS step FROM walk) w
      JOIN o ON o.book_id = w.book_id AND o.obj = CASE step WHEN 0 THEN w.first ELSE w.next END WHERE NOT list_contains(w.met, o.obj)),
  once AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY book_id, obj ORDER BY place) = 1),
  outline AS (SELECT book_id, (row_number() OVER (PARTITION BY book_id ORDER BY place) - 1)::INTEGER AS ord, level::INTEGER AS level, title, page FROM once WHERE title <> '' AND page IS NOT NULL)"""


def _outline(spark):
    return outline.outline_rows(OBJECTS.frame(spark), STARTS.frame(spark))


QUERIES: dict[str, Query] = {
    "s7_html_text": Query(lambda spark, d: table(spark, d, "pages").select("page_id", st.html_text(F.col("html")).alias("text")), f"SELECT page_id, {_text_sql('html')} AS text FROM pages"),
    "s8_title": Query(lambda spark, d: table(spark, d, "pages").select("page_id", st.html_title(F.col("html")).alias("title")), f"SELECT page_id, {_title_sql('html')} AS title FROM pages"),
    "s11_page_text": Query(lambda spark, d: PAGES.frame(spark).select("book_id", "page", st.page_text(F.col("text")).alias("text")), f"SELECT book_id, page, {_NO_NUMBERS} AS text FROM {PAGES.sql}"),
    "s12_lines": Query(
        lambda spark, d: st.pdf_lines(CHARS.frame(spark)).select("book_id", "page", "text", "max_size"),
        f"WITH c AS (SELECT *, {tenths_sql('top')} AS y FROM {CHARS.sql}), s AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 3 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY book_id, page ORDER BY y, x0, seq)), l AS (SELECT *, sum(new) OVER (PARTITION BY book_id, page ORDER BY y, x0, seq ROWS UNBOUNDED PRECEDING) AS line FROM s) SELECT book_id, page, regexp_replace(string_agg(text, '' ORDER BY y, x0, seq), '^\\s+|\\s+$', '', 'g') AS text, max(size) AS max_size FROM l GROUP BY book_id, page, line HAVING regexp_replace(string_agg(text, '' ORDER BY y, x0, seq), '^\\s+|\\s+$', '', 'g') <> ''",
    ),
    "a3_body_size": Query(lambda spark, d: st.body_size(CHARS.frame(spark)), f"WITH {_BODY} SELECT * FROM body"),
    "a4_line_frequency": Query(lambda spark, d: st.line_frequency(LINES.frame(spark), st.toc_pages(LINES.frame(spark), st.body_size(CHARS.frame(spark)))), f"WITH lines AS {LINES.sql}, {_BODY}, {_TOCP}, {_FREQ} SELECT * FROM freq"),
    "a5_toc_pages": Query(lambda spark, d: st.toc_pages(LINES.frame(spark), st.body_size(CHARS.frame(spark))), f"WITH lines AS {LINES.sql}, {_BODY}, {_TOCP} SELECT * FROM tocp"),
    "a12_extracted_chars": Query(lambda spark, d: st.extracted_chars(PAGES.frame(spark)), f"SELECT book_id, count(*) AS pages, sum(length({_NO_NUMBERS}))::BIGINT AS chars FROM {PAGES.sql} GROUP BY 1"),
    "a13_ordered_text": Query(
        lambda spark, d: st.ordered_text(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text", " "), "SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) FILTER (text <> '') AS text FROM conversations GROUP BY conv_id"
    ),
    "f4_min_length": Query(lambda spark, d: SPINE.frame(spark).where(F.length("text") >= st.MIN_CHAPTER).select("book_id", "ord"), f"SELECT book_id, ord FROM {SPINE.sql} WHERE length(text) >= 10"),
    "f8_noise_lines": Query(lambda spark, d: LINES.frame(spark).select("book_id", "page", "line_no", st.is_noise(F.col("text")).alias("noise")), f"SELECT book_id, page, line_no, {_NOISE} AS noise FROM {LINES.sql}"),
    "f9_heading_lines": Query(lambda spark, d: st.pattern_headings(LINES.frame(spark)), f"WITH lines AS {LINES.sql}, tocp AS (SELECT '' AS book_id, -1 AS page), {_PLAIN} SELECT * FROM plain"),
    "w6_first_headings": Query(lambda spark, d: st.pattern_headings(LINES.frame(spark)).groupBy("book_id").agg(F.count("*").alias("n"), F.min("page").alias("page")), f"WITH lines AS {LINES.sql}, tocp AS (SELECT '' AS book_id, -1 AS page), {_PLAIN} SELECT book_id, count(*) AS n, min(page) AS page FROM plain GROUP BY 1"),
    "w5_merged_headings": Query(lambda spark, d: st.merge_headings(st.pattern_headings(LINES.frame(spark))), f"WITH lines AS {LINES.sql}, tocp AS (SELECT '' AS book_id, -1 AS page), {_PLAIN}, {_MERGE} SELECT book_id, ord, h.page AS page, h.title AS title FROM merged"),
    "w7_size_headings": Query(_size_headings, f"{_PDF} SELECT book_id, ord, h.page AS page, h.title AS title FROM sized"),
    "c6_pdf_headings": Query(lambda spark, d: st.pdf_headings(CHARS.frame(spark), LINES.frame(spark)), f"{_PDF}, {_HEADINGS} SELECT * FROM heads"),
    "l2_merged_heading_order": Query(lambda spark, d: st.pdf_headings(CHARS.frame(spark), LINES.frame(spark)).select("book_id", "pos", "page"), f"{_PDF}, {_HEADINGS} SELECT book_id, pos, page FROM heads"),
    "c7_chapters_by_headings": Query(lambda spark, d: st.chapters_by_page(st.pdf_headings(CHARS.frame(spark), LINES.frame(spark)), PAGES.frame(spark)), f"{_PDF}, {_HEADINGS}, {_PAGED}, {_BY_HEAD} SELECT * FROM by_head"),
    "c8_chapters_by_outline": Query(lambda spark, d: st.chapters_by_outline(OUTLINE.frame(spark), PAGES.frame(spark)), f"WITH {_PAGED}, {_BY_OUTLINE} SELECT * FROM by_outline"),
    "j4_page_ranges": Query(
        lambda spark, d: st.chapters_by_outline(OUTLINE.frame(spark), PAGES.frame(spark)).select("book_id", "idx", "title", F.length("text").alias("chars")), f"WITH {_PAGED}, {_BY_OUTLINE} SELECT book_id, idx, title, length(text)::INTEGER AS chars FROM by_outline"
    ),
    "s13_outline": Query(lambda spark, d: _outline(spark), f"{_WALK} SELECT * FROM outline"),
    "s13_outline_chapters": Query(lambda spark, d: st.chapters_by_outline(_outline(spark), PAGES.frame(spark)), f"{_WALK}, {_PAGED}, {_BY_OUTLINE.replace(OUTLINE.sql, '(FROM outline)')} SELECT * FROM by_outline"),
    "c9_page_groups": Query(lambda spark, d: st.page_groups(PAGES.frame(spark)), f"WITH {_PAGED}, {_GROUPS} SELECT * FROM by_group"),
    "w4_page_groups": Query(
        lambda spark, d: st.page_groups(table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("int").alias("page"), "text")),
        f"WITH pages_ AS (SELECT conv_id AS book_id, turn::INTEGER AS page, {_NO_NUMBERS} AS text FROM conversations), pn AS (SELECT book_id, max(page) + 1 AS n FROM pages_ GROUP BY 1), {_GROUPS} SELECT * FROM by_group",
    ),
    "c10_pdf_chapters": Query(lambda spark, d: _pdf_chapters(spark), f"{_PDF}, {_HEADINGS}, {_PAGED}, {_BY_HEAD}, {_BY_OUTLINE}, {_GROUPS}, {_CHOSEN} SELECT * FROM chosen"),
    "c10_pdf_errors": Query(
        lambda spark, d: st.pdf_errors(PAGES.frame(spark), _pdf_chapters(spark)),
        f"{_PDF}, {_HEADINGS}, {_PAGED}, {_BY_HEAD}, {_BY_OUTLINE}, {_GROUPS}, {_CHOSEN} SELECT book_id, 'no extractable text (' || count(*) || ' pages, ' || sum(length(text)) || ' characters): scanned pages need character recognition first' AS error FROM pages_ WHERE book_id NOT IN (SELECT book_id FROM chosen) GROUP BY 1",
    ),
    "c1_txt_chapters": Query(lambda spark, d: st.txt_chapters(TXT.frame(spark)), _TXT),
    "c2_txt_sections": Query(lambda spark, d: st.txt_sections(TXT.frame(spark)), f"WITH src AS {TXT.sql},{_SECTIONS.replace('{src}', 'src')} SELECT book_id, idx::INTEGER AS idx, 'Section ' || (idx + 1) AS title, {collapse_sql('text')} AS text FROM sections"),
    "w9_document_sections": Query(
        lambda spark, d: st.txt_sections(table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))).groupBy("book_id").agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars")),
        f"WITH src AS (SELECT doc_id AS book_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents),{_SECTIONS.replace('{src}', 'src')} SELECT book_id, count(*) AS sections, sum(length({collapse_sql('text')}))::BIGINT AS chars FROM sections GROUP BY 1",
    ),
    "j1_spine_items": Query(lambda spark, d: st.spine_items(REFS.frame(spark), ITEMS.frame(spark)), f"SELECT r.book_id, r.ord, r.item_id, href FROM {REFS.sql} r JOIN {ITEMS.sql} i ON r.book_id = i.book_id AND r.item_id = i.item_id"),
    "j2_toc_starts": Query(lambda spark, d: st.toc_starts(TOC.frame(spark), SPINE.frame(spark)), f"WITH {_TOC} SELECT * FROM starts"),
    "j3_toc_spans": Query(lambda spark, d: st.toc_spans(st.toc_starts(TOC.frame(spark), SPINE.frame(spark)), SPINE.frame(spark)), f"WITH {_TOC}, {_SPANS} SELECT * FROM spans"),
    "w2_next_bounds": Query(
        lambda spark, d: _bounds(_page_spine(spark, d).select("book_id", "ord")),
        f"SELECT {_PAGE_HOST} AS book_id, page_id AS ord, lead(page_id) OVER (PARTITION BY {_PAGE_HOST} ORDER BY page_id) AS next FROM pages",
    ),
    "c3_epub_toc_chapters": Query(
        lambda spark, d: st.epub_chapters(SPINE.frame(spark).join(_usable(spark), "book_id", "left_semi"), TOC.frame(spark)), f"WITH {_TOC}, {_SPANS}, {_USABLE}, {_BY_TOC} SELECT * FROM by_toc"
    ),
    "c4_spine_chapters": Query(
        lambda spark, d: st.spine_chapters(_page_spine(spark, d), _page_hosts(spark, d)),
        f"WITH spine AS (SELECT {_PAGE_HOST} AS book_id, page_id AS ord, {_title_sql('html')} AS title, {_text_sql('html')} AS text FROM pages) {_BY_SPINE.format(where='')}",
    ),
    "c5_epub_chapters": Query(lambda spark, d: st.epub_chapters(SPINE.frame(spark), TOC.frame(spark)), f"WITH {_TOC}, {_SPANS}, {_USABLE}, {_BY_TOC} SELECT * FROM by_toc UNION ALL {_BY_SPINE.format(where='AND book_id NOT IN (SELECT book_id FROM by_toc)')}"),
    "w3_reindex": Query(
        lambda spark, d: st.numbered(table(spark, d, "documents").where(F.length("text") >= 1000).select("source", "doc_id"), ["source"], ["doc_id"], sized=table(spark, d, "documents").select("source")),
        "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS idx FROM documents WHERE length(text) >= 1000",
    ),
    "w8_line_sessions": Query(
        lambda spark, d: st.line_sessions(CHARS.frame(spark)).groupBy("book_id", "page").agg(F.countDistinct("line_no").alias("n")),
        f"WITH c AS (SELECT *, {tenths_sql('top')} AS y FROM {CHARS.sql}), s AS (SELECT *, CASE WHEN abs(y - lag(y) OVER (PARTITION BY book_id, page ORDER BY y, x0, seq)) > 3 THEN 1 ELSE 0 END AS new FROM c) SELECT book_id, page, 1 + sum(new)::BIGINT AS n FROM s GROUP BY ALL",
    ),
    "l1_toc_order": Query(
        lambda spark, d: st.reindex(st.toc_starts(TOC.frame(spark), SPINE.frame(spark)), ["book_id"], ["start", "toc_ord"], "place").select("book_id", "title", "place"), f"WITH {_TOC} SELECT book_id, title, (row_number() OVER (PARTITION BY book_id ORDER BY start, toc_ord) - 1)::INTEGER AS place FROM starts"
    ),
}
