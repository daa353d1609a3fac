"""Queries of the text functions (E1-E28, L3-L5, F12)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import labels as lb
from leafmill.functions import text as tx
from leafmill.operators.jobs import head_lines
from leafmill.plans.base import Query, table
from leafmill.plans.inline import NAMES, SECONDS, SPEEDS, TAGS, TEXTS, Rows

W = r"[\s\x0b\x{85}\p{Z}]"
NOT_W = r"[^\s\x0b\x{85}\p{Z}]"


def strip_sql(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '^{W}+', ''), '{W}+$', '')"


def collapse_sql(s: str) -> str:
    return f"trim(regexp_replace({s}, '{W}+', ' ', 'g'))"


def clean_sql(s: str, endnotes: bool = True) -> str:
    """The cleaning rules in RE2: white space classes spelt out, no look-behind."""
    out = f"coalesce({s}, '')"
    rules = [
        ("&nbsp;", " "), ("&[a-zA-Z]+;", " "), ("<[^>]+>", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (rf"(?m)^#{{1,6}}{W}*", ""), ("`{1,3}", ""), (r"\*{1,2}|_{1,2}", ""),
        (rf"(?m)^{W}*[-*+]{W}+", ""), (rf"(?m)^{W}*\d+\.{W}+", ""), (rf"https?://{NOT_W}+", ""), (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", ""), (" ", " "), ("[“”]", '"'), ("[‘’]", "''"), ("[–—]", "-"), ("…", "..."),
        (r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), (rf"{W}+", " "),
    ]
    for pattern, new in rules:
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    out = f"trim({out})"
    for left, right in ((r"\[", r"\]"), (r"\(", r"\)")) if endnotes else ():
        out = rf"regexp_replace({out}, '([\p{{L}}\p{{N}}_]){W}*{left}\d{{1,3}}{right}', '\1', 'g')"
    return out


def language_sql(s: str) -> str:
    part = f"substring(coalesce({s}, ''), 1, 2000)"
    share = lambda chars: f"(length({part}) - length(regexp_replace({part}, '[{chars}]', '', 'g'))) / length({part})"
    kana, cjk, hangul, cyr = r"\x{3040}-\x{30FF}", r"\x{4E00}-\x{9FFF}", r"\x{AC00}-\x{D7AF}", r"\x{0400}-\x{04FF}"
    return f"CASE WHEN {strip_sql(part)} = '' THEN 'en-US' WHEN {share(kana)} > 0.05 THEN 'ja-JP' WHEN {share(cjk)} > 0.1 THEN 'zh-CN' WHEN {share(hangul)} > 0.1 THEN 'ko-KR' WHEN {share(cyr)} > 0.1 THEN 'ru-RU' ELSE 'en-US' END"


def seconds_sql(s: str) -> str:
    wide = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
    rest = f"regexp_replace(coalesce({s}, ''), '{wide}', '', 'g')"
    return f"(length(coalesce({s}, '')) - length({rest})) / 4.0::DOUBLE + len(regexp_extract_all({rest}, '{NOT_W}+')) / 2.5::DOUBLE"


def sentences_sql(s: str) -> str:
    parts = rf"string_split(regexp_replace({s}, '([.!?。！？]){W}+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({parts}, lambda x: {strip_sql('x')}), lambda x: x <> '')"


def chunk_sql(s: str, limit: int) -> str:
    """Sentence fold; the pieces of over-long sentences are made first."""
    clauses = rf"string_split(regexp_replace(q, '([,;:，；：]){W}*', '\1' || chr(1), 'g'), chr(1))"
    cuts = f"greatest(ceil(length(x) / {limit}.0)::INT - 1, 0)"
    hard = f"list_transform(range(0, {cuts}), lambda i: substring(x, (i * {limit} + 1)::INT, {limit}))"
    flush = "CASE WHEN a.t <> '' THEN list_append(a.d, a.t) ELSE a.d END"
    start = "{'d': []::VARCHAR[], 't': ''}"
    inner = f"list_reduce({clauses}, lambda a, x: CASE WHEN length(a.t) + length(x) > {limit} THEN {{'d': list_concat({flush}, {hard}), 't': substring(x, ({cuts} * {limit} + 1)::INT)}} ELSE {{'d': a.d, 't': a.t || x}} END, {start})"
    pieces = f"list_transform(list_value({inner}), lambda a: {flush})[1]"
    made = f"list_transform({sentences_sql(s)}, lambda q: {{'s': q, 'p': CASE WHEN length(q) > {limit} THEN {pieces} ELSE []::VARCHAR[] END}})"
    step = f"CASE WHEN length(y.s) > {limit} THEN {{'d': list_concat({flush}, y.p), 't': ''}} WHEN length(a.t) + length(y.s) + 1 > {limit} THEN {{'d': {flush}, 't': y.s}} ELSE {{'d': a.d, 't': CASE WHEN a.t = '' THEN y.s ELSE a.t || ' ' || y.s END}} END"
    fold = f"list_transform(list_value(list_reduce({made}, lambda a, y: {step}, {start})), lambda a: {flush})[1]"
    return f"CASE WHEN length({s}) > {limit} THEN {fold} WHEN {strip_sql(s)} = '' THEN []::VARCHAR[] ELSE [{s}] END"


def _inline(rows: Rows, sql: str, columns: Callable[[], tuple[Column, ...]]) -> Query:
    return Query(lambda spark, d: rows.frame(spark).select(*columns()), sql.replace("{t}", rows.sql))


def _docs(sql: str, columns: Callable[[], tuple[Column, ...]], where: str = "true") -> Query:
    return Query(lambda spark, d: table(spark, d, "documents").where(where).select("doc_id", *columns()), sql)


def _chunked(limit: int, frame, sql_from: str, key: str, s: str) -> Query:
    def run(spark, d):
        rows = frame(spark, d).withColumn("t", tx.collapse("s"))
        return rows.select(key, F.posexplode(tx.chunk("t", limit)).alias("pos", "chunk"))

    one = f"SELECT {key}, {collapse_sql(s)} AS t FROM {sql_from}"
    split = f"SELECT {key}, {chunk_sql('t', limit)} AS c FROM ({one})"
    return Query(run, f"SELECT {key}, (generate_subscripts(c, 1) - 1)::INTEGER AS pos, unnest(c) AS chunk FROM ({split})")



def _rule_sentences(spark, d):
    """Sentences of the documents by the rules of their language."""
    by_lang = F.lit(None).cast("array<string>")
    for lang in tx.ABBREVIATIONS:
        by_lang = F.when(F.col("lang") == lang, tx.rule_sentences("t", lang)).otherwise(by_lang)
    rows = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.coalesce(by_lang, tx.rule_sentences("t", "")).alias("l"))
    return rows.select("doc_id", F.size("l").alias("sentences"), F.array_join(F.transform("l", lambda x: F.length(x).cast("string")), ",").alias("lengths"))


def _rule_sql() -> str:
    """The same by marks: every place that may be a break gets one, then those that are none lose it."""
    q = lambda x: x.replace("'", "''")
    out = f"regexp_replace(coalesce(text, ''), '([.!?…][{q(tx.CLOSING)}]{{0,3}}{W}+)', '\\1' || chr(1), 'g')"
    out = f"regexp_replace({out}, chr(1) || '(\\p{{Ll}})', '\\1', 'g')"
    without = lambda x, never: f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}])({never}\\.{W}+)' || chr(1), '\\1\\2', 'g')"
    cases = []
    for lang, known in tx.ABBREVIATIONS.items():
        never = "(?:\\p{Lu}|" + "|".join(a.replace(".", "\\.").replace(" ", W) for a in known) + ")"
        found = without(without(out, never), never)  # twice: the first pass takes the character before
        if lang == "de":
            found = f"regexp_replace({found}, '(^|[^0-9])([0-9]{{1,2}}\\.{W}+)' || chr(1), '\\1\\2', 'g')"
        cases.append(f"WHEN '{lang}' THEN {found}")
    initial = without(without(out, "\\p{Lu}"), "\\p{Lu}")
    marked = f"CASE lang {' '.join(cases)} ELSE {initial} END"
    wide = f"regexp_replace({marked}, '([。！？][{tx.CLOSING_WIDE}]{{0,3}})', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({wide}, chr(1)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


QUERIES: dict[str, Query] = {
    "e1_language": _docs(f"SELECT doc_id, {language_sql('text')} AS language FROM documents", lambda: (tx.detect_language("text").alias("language"),)),
    "e1_language_inline": _inline(TEXTS, f"SELECT id, {language_sql('s')} AS language FROM {{t}}", lambda: (F.col("id"), tx.detect_language("s").alias("language"),)),
    "e2_clean": _docs(f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents", lambda: (tx.clean("text").alias("cleaned"),)),
    "e2_clean_inline": _inline(TEXTS, f"SELECT id, {clean_sql('s')} AS cleaned, {clean_sql('s', False)} AS with_notes FROM {{t}}", lambda: (F.col("id"), tx.clean("s").alias("cleaned"), tx.clean("s", False).alias("with_notes"),)),
    "e2_clean_pages": Query(lambda spark, d: table(spark, d, "pages").select("page_id", tx.clean("html").alias("cleaned")), f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages"),
    "e3_duration": _docs(f"SELECT doc_id, round({seconds_sql('text')}, 6) AS seconds FROM documents", lambda: (F.round(tx.speech_seconds("text"), 6).alias("seconds"),)),
    "e3_duration_inline": _inline(TEXTS, f"SELECT id, round({seconds_sql('s')}, 6) AS seconds FROM {{t}}", lambda: (F.col("id"), F.round(tx.speech_seconds("s"), 6).alias("seconds"),)),
    "e3b_edit_duration": _inline(TEXTS, f"SELECT id, length({clean_sql('s')}) / 4.0::DOUBLE AS seconds FROM {{t}}", lambda: (F.col("id"), tx.edited_seconds("s").alias("seconds"),)),
    "e4_chunk": _chunked(3000, lambda spark, d: table(spark, d, "documents").withColumnRenamed("text", "s"), "documents", "doc_id", "text"),
    "e4_chunk_long": _chunked(300, lambda spark, d: table(spark, d, "documents").withColumnRenamed("text", "s"), "documents", "doc_id", "text"),
    "e4_chunk_inline": _chunked(10, lambda spark, d: TEXTS.frame(spark), TEXTS.sql, "id", "coalesce(s, '')"),
    "e6_sentences": _inline(TEXTS, f"SELECT id, array_to_string({sentences_sql("coalesce(s, '')")}, '|') AS parts FROM {{t}}", lambda: (F.col("id"), F.array_join(tx.sentences(F.coalesce("s", F.lit(""))), "|").alias("parts"),)),
    "e5_rule_sentences": Query(_rule_sentences, f"WITH parts AS (SELECT doc_id, {_rule_sql()} AS l FROM documents) SELECT doc_id, len(l)::INTEGER AS sentences, array_to_string(list_transform(l, lambda x: length(x)), ',') AS lengths FROM parts"),
    "e7_split_long": _chunked(12, lambda spark, d: TEXTS.frame(spark), TEXTS.sql, "id", "coalesce(s, '')"),
    "e8_filename": _inline(NAMES, "SELECT id, substring(translate(s, '/\\:*?\"<>|', '---------'), 1, 200) AS name FROM {t}", lambda: (F.col("id"), lb.safe_filename(F.col("s")).alias("name"),)),
    "e9_chapter_file": _inline(NAMES, "SELECT id, substring(translate(s || ' - ' || printf('%04d', id) || ' - ' || s || '.mp3', '/\\:*?\"<>|', '---------'), 1, 200) AS name FROM {t}", lambda: (F.col("id"), lb.chapter_file(F.col("s"), F.col("id"), F.col("s")).alias("name"),)),
    "e10_duration_format": _inline(
        SECONDS,
        "SELECT id, CASE WHEN s < 60 THEN greatest(1, round_even(s, 0)::INT) || 's' WHEN s < 3600 THEN round_even(s / 60, 0)::INT || ' min' ELSE floor(s / 3600)::INT || 'h ' || round_even((s - floor(s / 3600) * 3600) / 60, 0)::INT || 'min' END AS label FROM {t}",
        lambda: (F.col("id"), lb.duration_label(F.col("s")).alias("label"),),
    ),
    "p10_short_duration": _inline(SECONDS, "SELECT id, CASE WHEN s >= 60 THEN round_even(s / 60, 0)::INT || ' min' ELSE greatest(1, round_even(s, 0)::INT) || 's' END AS label FROM {t}", lambda: (F.col("id"), lb.short_duration_label(F.col("s")).alias("label"),)),
    "e11_thousands": _docs("SELECT doc_id, format('{:,}', n_chars * 1000) AS label FROM documents", lambda: (lb.thousands(F.col("n_chars") * 1000).alias("label"),)),
    "e12_collapse": _inline(TEXTS, f"SELECT id, {collapse_sql('s')} AS t FROM {{t}}", lambda: (F.col("id"), tx.collapse("s").alias("t"),)),
    "e13_author": _inline(NAMES, "SELECT id, coalesce(nullif(regexp_extract(s, '[(（](.+?)[)）]', 1), ''), 'Unknown') AS author FROM {t}", lambda: (F.col("id"), lb.author_from_name(F.col("s")).alias("author"),)),
    "e14_rate": _inline(SPEEDS, "SELECT id, CASE WHEN round_even((s - 1) * 100, 0) >= 0 THEN '+' ELSE '' END || round_even((s - 1) * 100, 0)::INT || '%' AS rate FROM {t}", lambda: (F.col("id"), lb.speed_rate(F.col("s")).alias("rate"),)),
    "e15_speed_maps": _inline(SPEEDS, "SELECT id, greatest(1, least(15, round_even(s * 5, 0)::INT)) AS five, greatest(0, least(200, trunc(s * 50)::INT)) AS fifty FROM {t}", lambda: (F.col("id"), lb.baidu_speed(F.col("s")).alias("five"), lb.iflytek_speed(F.col("s")).alias("fifty"),)),
    "e16_language_codes": _inline(
        TAGS,
        "SELECT id, " + "CASE tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lb.LANGUAGE_NAMES.items()) + " ELSE 'auto' END AS name, CASE WHEN lower(split_part(tag, '-', 1)) IN (" + ", ".join(f"'{c}'" for c in lb.SHORT_CODES) + ") THEN lower(split_part(tag, '-', 1)) ELSE 'na' END AS short, CASE WHEN tag LIKE 'zh%' THEN 'zh' ELSE 'en' END AS two FROM {t}",
        lambda: (F.col("id"), lb.language_name(F.col("tag")).alias("name"), lb.short_code(F.col("tag")).alias("short"), lb.two_way_code(F.col("tag")).alias("two"),),
    ),
    "e17_chunk_limit": _inline(
        TAGS,
        "SELECT id, greatest(100, trunc((CASE WHEN cloned THEN least(seconds, 60) ELSE seconds END) * (CASE WHEN tag IN ('ja-JP','ko-KR') THEN 5 WHEN tag IN ('en-US','en-GB') THEN 15 WHEN tag = 'fr-FR' THEN 14 WHEN tag IN ('de-DE','pt-PT','es-ES','it-IT') THEN 13 WHEN tag = 'ru-RU' THEN 12 ELSE 4 END))::INT) AS chars FROM {t}",
        lambda: (F.col("id"), lb.chunk_limit(F.col("tag"), F.col("seconds"), F.col("cloned")).alias("chars"),),
    ),
    "e18_token_budget": _inline(TAGS, "SELECT id, greatest(1024, trunc(seconds * 12.5 * 1.8)::INT) AS tokens FROM {t}", lambda: (F.col("id"), lb.token_budget(F.col("seconds")).alias("tokens"),)),
    "e19_truncation": _inline(TAGS, "SELECT id, (seconds > 2 AND id * 10 < seconds * 0.3::DOUBLE) AS truncated FROM {t}", lambda: (F.col("id"), lb.is_truncated(F.col("seconds"), F.col("id") * 10).alias("truncated"),)),
    "e22_escape": _inline(NAMES, "SELECT id, replace(replace(replace(replace(replace(s, '\\', '\\\\'), '=', '\\='), '#', '\\#'), chr(13), ' '), chr(10), ' ') AS escaped FROM {t}", lambda: (F.col("id"), lb.metadata_escape(F.col("s")).alias("escaped"),)),
    "e25_prefix": _inline(TAGS, "SELECT id, split_part(tag, '-', 1) AS prefix FROM {t}", lambda: (F.col("id"), lb.prefix(F.col("tag")).alias("prefix"),)),
    "l3_head_lines": Query(
        lambda spark, d: table(spark, d, "documents").select("doc_id", head_lines(F.col("text"), 3).alias("head")),
        r"WITH x AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS l FROM documents) SELECT doc_id, CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], chr(10)) || chr(10) || '... (' || (len(l) - 3) || ' more lines)' ELSE array_to_string(l, chr(10)) END AS head FROM x",
    ),
    "l5_truncations": _docs("SELECT doc_id, substring(text, 1, 100) AS title, substring(text, 1, 2000) AS sample FROM documents", lambda: (F.substring("text", 1, 100).alias("title"), F.substring("text", 1, 2000).alias("sample"),)),
    "f12_language_sample": _docs(
        f"SELECT doc_id, substring({strip_sql('text')}, 1, 500) AS sample FROM documents WHERE length(substring({strip_sql('text')}, 1, 500)) > 20",
        lambda: (F.substring(F.regexp_replace("text", r"(?Ud)^\s+|\s+$", ""), 1, 500).alias("sample"),), where=r"length(substring(regexp_replace(text, r'(?Ud)^\s+|\s+$', ''), 1, 500)) > 20",
    ),
}

_E3C = Rows("id int, provider string, n int, speed double, setting double", (1, "edge", 400, 1.25, 1.0), (2, "qwen3_mlx", 90, 0.5, 1.0), (3, "kokoro", 41, 1.0, 2.0), (4, "supertonic", 120, 1.5, 2.0), (5, "baidu", 77, 3.0, 1.0), (6, "iflytek", 10, 2.0, 1.0), (7, "elevenlabs", 0, 1.0, 1.0))
_E27 = Rows("id int, provider string, requested double, setting double, voice string", (1, "kokoro", None, 1.5, ""), (2, "kokoro", 0.9, 1.5, "v"), (3, "edge", None, 1.5, None), (4, "supertonic", None, None, "x"))
QUERIES |= {
    "e3c_provider_duration": _inline(
        _E3C,
        "SELECT id, CASE WHEN provider IN ('baidu','iflytek','elevenlabs') THEN n / 4.0::DOUBLE WHEN provider = 'supertonic' THEN n / (4.0::DOUBLE * speed * setting) ELSE n / (4.0::DOUBLE * speed) END AS seconds FROM {t}",
        lambda: (F.col("id"), lb.provider_seconds(F.col("provider"), F.col("n"), F.col("speed"), F.col("setting")).alias("seconds"),),
    ),
    "e27_speed": _inline(
        _E27, "SELECT id, coalesce(requested, CASE WHEN provider IN ('qwen3_mlx','supertonic','kokoro') THEN setting END, 1.0) AS speed FROM {t}", lambda: (F.col("id"), lb.effective_speed(F.col("requested"), F.col("setting"), F.col("provider")).alias("speed"),)
    ),
    "e28_voice_default": _inline(_E27, "SELECT id, coalesce(nullif(voice, ''), 'zf_048') AS voice FROM {t}", lambda: (F.col("id"), F.coalesce(F.nullif("voice", F.lit("")), F.lit("zf_048")).alias("voice"),)),
}


def _headline(spark, d):
    """The first slice end to end: cleaned documents, their chunks and spoken time by source."""
    rows = table(spark, d, "documents").select("lang", tx.clean("text").alias("t"))
    rows = rows.select("lang", F.length("t").alias("chars"), tx.speech_seconds("t").alias("seconds"), F.size(tx.chunk("t", 3000)).alias("chunks"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.round(F.sum("seconds"), 3).alias("seconds"), F.sum("chunks").alias("chunks"))


QUERIES["narration_totals"] = Query(
    _headline,
    f"WITH spoken AS (SELECT lang, {clean_sql('text')} AS t FROM documents), counted AS (SELECT lang, length(t) AS chars, {seconds_sql('t')} AS seconds, len({chunk_sql('t', 3000)}) AS chunks FROM spoken) SELECT lang, count(*) AS docs, sum(chars)::BIGINT AS chars, round(sum(seconds), 3) AS seconds, sum(chunks)::BIGINT AS chunks FROM counted GROUP BY lang",
)
