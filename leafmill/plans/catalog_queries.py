"""Queries of the catalog, job, voice and audio operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafmill.functions import labels as lb
from leafmill.functions import text as tx
from leafmill.operators import audio, catalog, jobs
from leafmill.operators import voices as vo
from leafmill.plans import inline as t
from leafmill.plans.base import Query, table
from leafmill.plans.text_queries import clean_sql, language_sql, seconds_sql, strip_sql
from leafmill.sources.settings import setting

_VOICES = "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + c.replace("'", "''") + "'" for c in v) + ")" for v in vo.BUILT_IN) + ") AS v(id, name, gender, language, provider, description))"
_DECLARED = "(SELECT provider, ord::INTEGER AS ord, language FROM (VALUES " + ", ".join(f"('{p}', {i}, '{tag}')" for p, tags in vo.DECLARED.items() for i, tag in enumerate(tags)) + ") AS d(provider, ord, language))"
_SAFE = "substring(translate({x}, '/\\:*?\"<>|', '---------'), 1, 200)"
_TEXTS = f"""texts AS (SELECT c.book_id, c.idx, c.title, CASE WHEN e.book_id IS NOT NULL THEN e.text ELSE coalesce(nullif(c.text, ''), p.text) END AS text
  FROM {t.CHAPTERS.sql} c LEFT JOIN {t.EDITS.sql} e USING (book_id, idx) LEFT JOIN {t.PARSED.sql} p USING (book_id, idx))"""
_LEFT = "list_filter(selected, lambda x: NOT list_contains(completed, x))"
_LABELS = f"""tot AS (SELECT book_id, count(*) AS total FROM {t.CHAPTERS.sql} GROUP BY 1),
  chosen AS (SELECT c.book_id, count(*) AS n, min(c.idx) AS lo, max(c.idx) AS hi, arg_min(c.title, c.idx) AS a, arg_max(c.title, c.idx) AS b FROM {t.CHAPTERS.sql} c JOIN {{sel}} s USING (book_id, idx) GROUP BY 1),
  labels AS (SELECT b.id AS book_id, CASE WHEN n IS NULL OR n = total THEN title WHEN n = 1 THEN title || ' - ' || a WHEN hi - lo + 1 = n THEN title || ' - ' || a || '~' || b ELSE title || ' - ' || a || '等' || n || '章' END AS label FROM {t.BOOKS.sql} b JOIN tot ON tot.book_id = b.id LEFT JOIN chosen ON chosen.book_id = b.id)"""
_RESUMABLE = f"SELECT m.book_id, title, len(selected)::INTEGER AS total, len(list_distinct(completed))::INTEGER AS completed, CASE WHEN len(selected) > 0 THEN {t.tenths_sql('len(list_distinct(completed)) / len(selected)::DOUBLE * 100')} ELSE 0.0 END::DOUBLE AS progress_percent FROM {t.MANIFESTS.sql} m JOIN {t.BOOKS.sql} b ON b.id = m.book_id WHERE state IN ('running', 'failed', 'cancelled')"
_NAMED = _SAFE.format(x="b.title || ' - ' || printf('%04d', c.idx) || ' - ' || c.title || '.mp3'")
_LEGACY = _SAFE.format(x="b.title || ' - ' || c.title || '.mp3'")
_TEMP = "'_tmp_' || printf('%04d', c.idx) || '.mp3'"
_OFFSETS = "SELECT *, end_ms - own AS start_ms FROM (SELECT *, sum(own) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS end_ms FROM (SELECT *, trunc({s} * 1000)::BIGINT AS own FROM {src}))"
_ESCAPE = "replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '=', '\\='), '#', '\\#'), chr(13), ' '), chr(10), ' ')"
_MERGED = f"""merged AS (SELECT v.*, FALSE AS custom FROM {_VOICES} v WHERE NOT EXISTS (SELECT 1 FROM {t.HIDDEN.sql} h WHERE h.provider = v.provider AND h.id = v.id)
  UNION ALL SELECT id, name, coalesce(gender, 'female'), language, provider, coalesce(description, ''), TRUE FROM {t.CUSTOM.sql}
  UNION ALL SELECT id, name, coalesce(gender, 'female'), language, 'qwen3_mlx', coalesce(description, ''), TRUE FROM {t.CLONED.sql})"""
_PRE = "split_part({x}, '-', 1)"


def _chapters(spark):
    return t.CHAPTERS.frame(spark)


def _merged(spark):
    return vo.merged(vo.built_in(spark), t.HIDDEN.frame(spark), t.CUSTOM.frame(spark), t.CLONED.frame(spark))


def _labels(spark, selected=None):
    return jobs.combined_labels(_chapters(spark), t.SELECTED.frame(spark) if selected is None else selected, t.BOOKS.frame(spark))


def _turns(spark, d):
    """Conversations as books: a turn is a chapter with its spoken time."""
    return table(spark, d, "conversations").select("conv_id", "turn", "text", tx.speech_seconds("text").alias("seconds"))


def _voice_fit(spark, d):
    return vo.built_in(spark).join(t.WISHES.frame(spark), vo.speaks(F.col("language"), F.col("wanted"))).select("wish", "provider", "id")


def _edit_specs(spark):
    """Each comma-free part of the range specifications."""
    return t.SPECS.frame(spark).select("id", "total", F.explode(F.split("spec", ",")).alias("part"))


_TURNS = f"(SELECT conv_id, turn, text, {seconds_sql('text')} AS seconds FROM conversations)"

_SETTINGS = t.Rows("id int, doc string", (1, '{"tts": {"provider": "edge", "max": 3000}, "x": 1}'), (2, '{"tts": {}}'), (3, '{"tts": 5}'))

QUERIES: dict[str, Query] = {
    "e24_setting": Query(
        lambda spark, d: _SETTINGS.frame(spark).select("id", setting(F.col("doc"), "tts.provider").alias("provider"), setting(F.col("doc"), "tts.max").alias("chars")),
        f"SELECT id, json_extract_string(doc, '$.tts.provider') AS provider, json_extract_string(doc, '$.tts.max') AS chars FROM {_SETTINGS.sql}",
    ),
    "s14_library": Query(
        lambda spark, d: catalog.library(t.BOOKS.frame(spark), t.PRESENT.frame(spark), t.EDITS.frame(spark), _chapters(spark)).select("book_id", "idx", "title", "edited", "detected_language"),
        f"""WITH kept AS (SELECT id AS book_id, nullif(detected_language, '') AS known FROM {t.BOOKS.sql} WHERE file_path = '' OR file_path IN (FROM {t.PRESENT.sql})),
  c AS (SELECT c.book_id, c.idx, c.title, e.book_id IS NOT NULL OR c.edited AS edited, known, substring({strip_sql("coalesce(nullif(c.text, ''), e.text)")}, 1, 500) AS sample FROM {t.CHAPTERS.sql} c JOIN kept USING (book_id) LEFT JOIN {t.EDITS.sql} e USING (book_id, idx)),
  k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS k FROM c WHERE known IS NULL AND length(sample) > 20), found AS (SELECT book_id, string_agg(DISTINCT {language_sql('sample')}, ',' ORDER BY {language_sql('sample')}) AS languages FROM k WHERE k <= 5 GROUP BY 1)
SELECT c.book_id, idx, title, edited, coalesce(known, languages) AS detected_language FROM c LEFT JOIN found USING (book_id)""",
    ),
    "s15_manifests": Query(lambda spark, d: t.MANIFESTS.frame(spark).select("book_id", "state", F.array_join(F.array_distinct("completed"), ",").alias("completed")), f"SELECT book_id, state, array_to_string(list_sort(list_distinct(completed)), ',') AS completed FROM {t.MANIFESTS.sql}"),
    "s18_new_files": Query(lambda spark, d: catalog.new_books(t.PRESENT.frame(spark), t.BOOKS.frame(spark)), f"SELECT path FROM {t.PRESENT.sql} WHERE path NOT IN (SELECT file_path FROM {t.BOOKS.sql})"),
    "k2_save_edit": Query(
        lambda spark, d: catalog.apply_edits(_chapters(spark), t.EDITS.frame(spark)),
        f"SELECT c.book_id, c.idx, c.title, CASE WHEN e.book_id IS NOT NULL THEN length(e.text) ELSE c.char_count END::INTEGER AS char_count, CASE WHEN e.book_id IS NOT NULL THEN length({clean_sql('e.text')}) / 4.0::DOUBLE ELSE c.seconds END AS seconds, (e.book_id IS NOT NULL OR c.edited) AS edited FROM {t.CHAPTERS.sql} c LEFT JOIN {t.EDITS.sql} e USING (book_id, idx)",
    ),
    "k4_ffmetadata": Query(
        lambda spark, d: catalog.ffmetadata(t.BOOKS.frame(spark), _chapters(spark)),
        f"WITH o AS ({_OFFSETS.format(by='book_id', order='idx', s='seconds', src=t.CHAPTERS.sql)}), parts AS (SELECT book_id, string_agg(concat_ws(chr(10), '', '[CHAPTER]', 'TIMEBASE=1/1000', 'START=' || start_ms, 'END=' || end_ms, 'title=' || {_ESCAPE.format(x='title')}), chr(10) ORDER BY idx) AS p FROM o GROUP BY 1) "
        f"SELECT book_id, concat_ws(chr(10), ';FFMETADATA1', CASE WHEN title <> '' THEN 'title=' || {_ESCAPE.format(x='title')} END, CASE WHEN author <> '' THEN 'artist=' || {_ESCAPE.format(x='author')} END, p) AS text FROM parts JOIN {t.BOOKS.sql} b ON b.id = parts.book_id",
    ),
    "k5_add_record": Query(lambda spark, d: catalog.add_record(t.CONVERSIONS.frame(spark), t.FRESH_RECORDS.frame(spark)), f"FROM {t.CONVERSIONS.sql} UNION ALL FROM {t.FRESH_RECORDS.sql}"),
    "k5_delete_record": Query(lambda spark, d: catalog.without_records(t.CONVERSIONS.frame(spark), t.GONE_RECORDS.frame(spark)), f"SELECT book_id, ts, pos FROM {t.CONVERSIONS.sql} c WHERE NOT EXISTS (SELECT 1 FROM {t.GONE_RECORDS.sql} g WHERE g.book_id = c.book_id AND g.ts = c.ts)"),
    "k6_delete_book": Query(lambda spark, d: catalog.without_books(t.BOOKS.frame(spark), t.GONE_BOOKS.frame(spark)).select("id", "title"), f"SELECT id, title FROM {t.BOOKS.sql} WHERE id NOT IN (FROM {t.GONE_BOOKS.sql})"),
    "k7_update_book": Query(
        lambda spark, d: catalog.updated_books(t.BOOKS.frame(spark), t.CHANGES.frame(spark)), f"SELECT b.id, coalesce(nullif(trim(c.title), ''), b.title) AS title, coalesce(nullif(trim(c.author), ''), b.author) AS author FROM {t.BOOKS.sql} b LEFT JOIN {t.CHANGES.sql} c USING (id)"
    ),
    "k9_download": Query(
        lambda spark, d: catalog.download_pick(t.FILES.frame(spark), "mp3"),
        f"SELECT book_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN contains(regexp_replace(filename, '\\.[^.]*$', ''), ' - ') THEN 1 ELSE 0 END, filename) AS k FROM {t.FILES.sql} WHERE filename LIKE '%.mp3' AND NOT starts_with(filename, '_tmp_') AND NOT starts_with(filename, 'combined_temp') AND NOT starts_with(filename, '_concat_')) WHERE k = 1",
    ),
    "p1_book_list": Query(
        lambda spark, d: catalog.book_list(t.BOOKS.frame(spark), _chapters(spark), t.CONVERSIONS.frame(spark)),
        f"SELECT id, title, author, format, (SELECT count(*) FROM {t.CHAPTERS.sql} c WHERE c.book_id = id) AS chapter_count, uploaded_at, (SELECT count(*) FROM {t.CONVERSIONS.sql} c WHERE c.book_id = id) AS conversion_count FROM {t.BOOKS.sql}",
    ),
    "p2_book_detail": Query(
        lambda spark, d: catalog.book_detail(t.BOOKS.frame(spark), _chapters(spark)),
        f"SELECT book_id, b.title AS book, idx, c.title, char_count, {t.tenths_sql('seconds')}::DOUBLE AS seconds, CASE WHEN seconds >= 60 THEN round_even(seconds / 60, 0)::INT || ' min' ELSE greatest(1, round_even(seconds, 0)::INT) || 's' END AS label, edited FROM {t.CHAPTERS.sql} c JOIN {t.BOOKS.sql} b ON b.id = c.book_id",
    ),
    "p3_voice_list": Query(lambda spark, d: vo.built_in(spark).select("id", "name", "gender", "language", "description"), f"SELECT id, name, gender, language, description FROM {_VOICES}"),
    "p4_voices_hidden": Query(lambda spark, d: vo.with_hidden_flag(vo.built_in(spark), t.HIDDEN.frame(spark)).select("provider", "id", "hidden"), f"SELECT provider, id, EXISTS (SELECT 1 FROM {t.HIDDEN.sql} h WHERE h.provider = v.provider AND h.id = v.id) AS hidden FROM {_VOICES} v"),
    "p5_resumable": Query(lambda spark, d: jobs.resumable(t.MANIFESTS.frame(spark), t.BOOKS.frame(spark)), _RESUMABLE),
    "p6_library_table": Query(
        lambda spark, d: t.BOOKS.frame(spark).select("id", catalog.short_title(F.col("title")).alias("title")), f"SELECT id, CASE WHEN length(title) > 40 THEN substring(title, 1, 38) || '...' ELSE title END AS title FROM {t.BOOKS.sql}"
    ),
    "p6_document_titles": Query(
        lambda spark, d: table(spark, d, "documents").select("doc_id", catalog.short_title(F.substring("text", 1, 60)).alias("title")), "SELECT doc_id, CASE WHEN length(substring(text, 1, 60)) > 40 THEN substring(text, 1, 38) || '...' ELSE substring(text, 1, 60) END AS title FROM documents"
    ),
    "p7_history": Query(
        lambda spark, d: catalog.history(t.CONVERSIONS.frame(spark), t.OUTPUTS.frame(spark)),
        f"SELECT c.book_id, row_number() OVER (PARTITION BY c.book_id ORDER BY pos DESC)::INTEGER AS place, replace(substring(c.ts, 1, 19), 'T', ' ') AS shown, (SELECT count(*) FROM {t.OUTPUTS.sql} o WHERE o.book_id = c.book_id AND o.ts = c.ts AND type = 'chapter') AS chapter_files FROM {t.CONVERSIONS.sql} c",
    ),
    "p9_job_status": Query(
        lambda spark, d: jobs.job_status(t.JOBS.frame(spark), t.MANIFESTS.frame(spark), t.BOOKS.frame(spark)),
        f"SELECT b.id AS book_id, CASE WHEN (state IS NULL OR state IN ('failed', 'cancelled')) AND b.id IN (SELECT book_id FROM ({_RESUMABLE})) THEN 'resumable' ELSE coalesce(state, 'lost') END AS state FROM {t.BOOKS.sql} b LEFT JOIN {t.JOBS.sql} j ON j.book_id = b.id",
    ),
    "f1_selected": Query(lambda spark, d: _chapters(spark).join(t.SELECTED.frame(spark), ["book_id", "idx"], "left_semi").select("book_id", "idx", "title"), f"SELECT book_id, idx, title FROM {t.CHAPTERS.sql} c WHERE (book_id, idx) IN (SELECT (book_id, idx) FROM {t.SELECTED.sql})"),
    "f1_selected_orders": Query(
        lambda spark, d: table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total")),
        "SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
    ),
    "f2_range": Query(
        lambda spark, d: t.SPECS.frame(spark).select("id", F.array_join(jobs.parse_ranges(F.col("spec"), F.col("total")), ",").alias("chapters")),
        f"WITH p AS (SELECT id, total, unnest(string_split(spec, ',')) AS p FROM {t.SPECS.sql}), r AS (SELECT id, CASE WHEN contains(p, '-') THEN range(coalesce(nullif(split_part(p, '-', 1), '')::INT, 1), least(coalesce(nullif(split_part(p, '-', 2), '')::INT, total), total) + 1) ELSE [p::BIGINT] END AS l FROM p) SELECT s.id, coalesce((SELECT string_agg(DISTINCT x - 1, ',' ORDER BY x - 1) FROM (SELECT unnest(l) AS x FROM r WHERE r.id = s.id)), '') AS chapters FROM {t.SPECS.sql} s",
    ),
    "f3_edit_range": Query(
        lambda spark, d: _edit_specs(spark).select("id", "part", F.size(jobs.parse_ranges(F.col("part"), F.col("total"))).alias("n")),
        f"SELECT id, part, CASE WHEN contains(part, '-') THEN greatest(0, least(coalesce(nullif(split_part(part, '-', 2), '')::INT, total), total) - coalesce(nullif(split_part(part, '-', 1), '')::INT, 1) + 1) ELSE 1 END::INTEGER AS n FROM (SELECT id, total, unnest(string_split(spec, ',')) AS part FROM {t.SPECS.sql})",
    ),
    "f5_blank_chapters": Query(lambda spark, d: catalog.chapter_texts(_chapters(spark), t.EDITS.frame(spark), t.PARSED.frame(spark)).select("book_id", "idx", tx.is_blank(tx.clean("text")).alias("skip")), f"WITH {_TEXTS} SELECT book_id, idx, {clean_sql('text')} = '' AS skip FROM texts"),
    "f6_voice_match": Query(
        _voice_fit,
        f"SELECT wish, provider, id FROM {_VOICES} v, {t.WISHES.sql} WHERE wanted IS NULL OR language = 'multi' OR (contains(language, '-') AND lower(language) = lower(wanted)) OR (NOT contains(language, '-') AND lower(language) = lower({_PRE.format(x='wanted')}))",
    ),
    "f7_resumable_state": Query(lambda spark, d: t.MANIFESTS.frame(spark).where(F.col("state").isin(*jobs.RESUMABLE)).select("book_id", "state"), f"SELECT book_id, state FROM {t.MANIFESTS.sql} WHERE state IN ('running', 'failed', 'cancelled')"),
    "f10_kokoro_voice": Query(lambda spark, d: vo.built_in(spark).select("id", vo.is_kokoro_voice(F.concat(F.lit(" "), F.upper("id"))).alias("valid")), f"SELECT id, (regexp_matches(lower(id), '^(zf|zm)_[0-9]{{3}}$') OR lower(id) IN ('af_maple', 'af_sol', 'bf_vale')) AS valid FROM {_VOICES}"),
    "f11_audio_valid": Query(lambda spark, d: t.PROBES.frame(spark).select("path", audio.is_valid(F.col("size"), F.col("has_stream"), F.col("seconds")).alias("valid")), f"SELECT path, coalesce(size >= 1024 AND has_stream AND seconds >= 0.5, FALSE) AS valid FROM {t.PROBES.sql}"),
    "j5_chapter_text": Query(lambda spark, d: catalog.chapter_texts(_chapters(spark), t.EDITS.frame(spark), t.PARSED.frame(spark)), f"WITH {_TEXTS} SELECT * FROM texts"),
    "j6_text_lookup": Query(lambda spark, d: t.SELECTED.frame(spark).join(_chapters(spark), ["book_id", "idx"]).select("book_id", "idx", "text"), f"SELECT book_id, idx, text FROM {t.SELECTED.sql} JOIN {t.CHAPTERS.sql} USING (book_id, idx)"),
    "j7_remaining": Query(lambda spark, d: jobs.remaining(t.MANIFESTS.frame(spark)), f"SELECT book_id, (generate_subscripts({_LEFT}, 1) - 1)::INTEGER AS ord, unnest({_LEFT}) AS idx FROM {t.MANIFESTS.sql}"),
    "j7_remaining_orders": Query(
        lambda spark, d: table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n")),
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1",
    ),
    "j8_manifests_of_books": Query(lambda spark, d: t.MANIFESTS.frame(spark).join(t.BOOKS.frame(spark).select(F.col("id").alias("book_id")), "book_id", "left_semi").select("book_id", "state"), f"SELECT book_id, state FROM {t.MANIFESTS.sql} WHERE book_id IN (SELECT id FROM {t.BOOKS.sql})"),
    "j9_visible_voices": Query(lambda spark, d: vo.built_in(spark).join(t.HIDDEN.frame(spark), ["provider", "id"], "left_anti").groupBy("provider").agg(F.count("*").alias("n")), f"SELECT provider, count(*) AS n FROM {_VOICES} v WHERE NOT EXISTS (SELECT 1 FROM {t.HIDDEN.sql} h WHERE h.provider = v.provider AND h.id = v.id) GROUP BY 1"),
    "j10_languages": Query(
        lambda spark, d: vo.served_languages(vo.built_in(spark), vo.declared_languages(spark)),
        f"SELECT provider, ord, language FROM {_DECLARED} d WHERE EXISTS (SELECT 1 FROM {_VOICES} v WHERE v.provider = d.provider AND (v.language = 'multi' OR lower({_PRE.format(x='v.language')}) = lower({_PRE.format(x='d.language')})))",
    ),
    "j11_voice_lookup": Query(
        lambda spark, d: vo.first_match(vo.built_in(spark).withColumn("ord", F.when(F.col("provider") == "elevenlabs", 0).otherwise(1)).select("id", "ord", "name"), vo.built_in(spark).where("language = 'multi'").select("id").distinct()),
        f"SELECT id, ord, name FROM (SELECT id, CASE WHEN provider = 'elevenlabs' THEN 0 ELSE 1 END::INTEGER AS ord, name, row_number() OVER (PARTITION BY id ORDER BY provider = 'elevenlabs' DESC) AS k FROM {_VOICES} WHERE language = 'multi') WHERE k = 1",
    ),
    "j12_completed_audio": Query(
        lambda spark, d: jobs.completed_audio(_chapters(spark), t.FILES.frame(spark), t.BOOKS.frame(spark)),
        f"WITH o AS (SELECT c.book_id, c.idx, unnest([0, 1, 2]) AS r, unnest([{_NAMED}, {_LEGACY}, {_TEMP}]) AS filename FROM {t.CHAPTERS.sql} c JOIN {t.BOOKS.sql} b ON b.id = c.book_id) SELECT book_id, idx, arg_min(filename, r) AS filename FROM o JOIN {t.FILES.sql} f USING (book_id, filename) WHERE r < 2 OR size > 0 GROUP BY ALL",
    ),
    "a1_book_totals": Query(lambda spark, d: catalog.book_totals(_chapters(spark)), f"SELECT book_id, count(*) AS chapters, sum(CASE WHEN char_count > 0 THEN char_count ELSE length(text) END)::BIGINT AS chars, sum(seconds) AS seconds FROM {t.CHAPTERS.sql} GROUP BY 1"),
    "a1_conversation_totals": Query(
        lambda spark, d: catalog.book_totals(_turns(spark, d).select(F.col("conv_id").alias("book_id"), F.length("text").alias("char_count"), "text", F.round("seconds", 6).alias("seconds"))).withColumn("seconds", F.round("seconds", 3)),
        f"SELECT conv_id AS book_id, count(*) AS chapters, sum(length(text))::BIGINT AS chars, round(sum(round(seconds, 6)), 3) AS seconds FROM {_TURNS} GROUP BY 1",
    ),
    "a2_counts": Query(lambda spark, d: table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs")), "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY 1"),
    "a6_language_set": Query(
        lambda spark, d: catalog.book_languages(_chapters(spark)),
        f"WITH s AS (SELECT book_id, idx, substring({strip_sql('text')}, 1, 500) AS sample FROM {t.CHAPTERS.sql}), k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS k FROM s WHERE length(sample) > 20) SELECT book_id, string_agg(DISTINCT {language_sql('sample')}, ',' ORDER BY {language_sql('sample')}) AS languages FROM k WHERE k <= 5 GROUP BY 1",
    ),
    "a6_conversation_languages": Query(
        lambda spark, d: catalog.book_languages(table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("idx"), "text")),
        f"WITH s AS (SELECT conv_id AS book_id, turn AS idx, substring({strip_sql('text')}, 1, 500) AS sample FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY idx) AS k FROM s WHERE length(sample) > 20) SELECT book_id, string_agg(DISTINCT {language_sql('sample')}, ',' ORDER BY {language_sql('sample')}) AS languages FROM k WHERE k <= 5 GROUP BY 1",
    ),
    "a7_distinct_sorted": Query(lambda spark, d: t.MANIFESTS.frame(spark).select("book_id", F.array_join(F.array_sort(F.array_distinct(F.concat("completed", "selected"))), ",").alias("all")), f"SELECT book_id, array_to_string(list_sort(list_distinct(list_concat(completed, selected))), ',') AS \"all\" FROM {t.MANIFESTS.sql}"),
    "a8_ordered_distinct": Query(
        lambda spark, d: t.MANIFESTS.frame(spark).select("book_id", F.array_join(F.array_distinct(F.concat(F.reverse("selected"), "completed")), ",").alias("kept")),
        f"SELECT book_id, array_to_string(list_reduce(list_concat(list_reverse(selected), completed), lambda z, x: CASE WHEN list_contains(z, x) THEN z ELSE list_append(z, x) END, []::INTEGER[]), ',') AS kept FROM {t.MANIFESTS.sql}",
    ),
    "a9_label": Query(lambda spark, d: _labels(spark), f"WITH {_LABELS.replace('{sel}', t.SELECTED.sql)} SELECT * FROM labels"),
    "a10_progress": Query(lambda spark, d: t.SPECS.frame(spark).select("id", jobs.progress(F.lit(1), F.col("id"), F.lit(0.5), F.col("total")).alias("percent")), f"SELECT id, (1 + id + 0.5::DOUBLE) / total * 100 AS percent FROM {t.SPECS.sql}"),
    "a11_rms": Query(
        lambda spark, d: t.SEGMENTS.frame(spark).select("chunk", "seg", audio.rms(F.col("samples")).alias("rms"), audio.is_audible(F.col("samples")).alias("kept")),
        f"SELECT chunk, seg, sqrt(list_sum(list_transform(samples, lambda x: x * x)) / len(samples)) AS rms, sqrt(list_sum(list_transform(samples, lambda x: x * x)) / len(samples)) > 0.005 AS kept FROM {t.SEGMENTS.sql}",
    ),
    "e21_trim": Query(
        lambda spark, d: t.SEGMENTS.frame(spark).select("chunk", "seg", F.size(audio.trim_silence(F.col("samples"), F.col("rate"))).alias("n")),
        f"WITH x AS (SELECT *, list_max(list_transform(range(0, len(samples)), lambda i: CASE WHEN abs(samples[i + 1]) > 0.01 THEN i END)) AS last FROM {t.SEGMENTS.sql}) SELECT chunk, seg, CASE WHEN last IS NULL THEN len(samples) ELSE least(len(samples), last + trunc(rate * 0.3)::INT) END::INTEGER AS n FROM x",
    ),
    "w1_offsets": Query(
        lambda spark, d: catalog.offsets(_turns(spark, d), ["conv_id"], ["turn"], "seconds").select("conv_id", "turn", "start_ms", "end_ms"), f"SELECT conv_id, turn, start_ms, end_ms FROM ({_OFFSETS.format(by='conv_id', order='turn', s='seconds', src=_TURNS)})"
    ),
    "l4_first_samples": Query(
        lambda spark, d: table(spark, d, "documents").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("k <= 5").select("source", "doc_id", "k"),
        "SELECT source, doc_id, k::INTEGER AS k FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 5",
    ),
    "l6_first_match": Query(lambda spark, d: table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role")), "SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY 1"),
    "l7_output_order": Query(
        lambda spark, d: jobs.completed_audio(_chapters(spark), t.FILES.frame(spark), t.BOOKS.frame(spark)).withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("idx"))).select("book_id", "idx", "place"),
        f"WITH o AS (SELECT DISTINCT c.book_id, c.idx FROM {t.CHAPTERS.sql} c JOIN {t.BOOKS.sql} b ON b.id = c.book_id JOIN {t.FILES.sql} f ON f.book_id = c.book_id AND (f.filename IN ({_NAMED}, {_LEGACY}) OR (f.filename = {_TEMP} AND size > 0))) SELECT book_id, idx, row_number() OVER (PARTITION BY book_id ORDER BY idx)::INTEGER AS place FROM o",
    ),
    "x1_voice_union": Query(lambda spark, d: _merged(spark), f"WITH {_MERGED} SELECT * FROM merged"),
    "x2_all_selected": Query(lambda spark, d: t.MANIFESTS.frame(spark).select("book_id", F.array_join(jobs.all_selected(F.col("selected"), F.col("completed")), ",").alias("chapters")), f"SELECT book_id, array_to_string(list_sort(list_distinct(list_concat(selected, completed))), ',') AS chapters FROM {t.MANIFESTS.sql}"),
    "x3_unsupported": Query(
        lambda spark, d: vo.conversion_gate(t.REQUESTS.frame(spark), vo.built_in(spark), vo.declared_languages(spark)).where("missing != ''").select("id", "missing"),
        f"WITH f AS (SELECT id, provider, force, unnest(list_distinct(list_transform(string_split(detected, ','), lambda x: split_part(x, '-', 1)))) AS p FROM {t.REQUESTS.sql}) SELECT id, string_agg(p, ',' ORDER BY p) AS missing FROM f WHERE NOT force AND provider IN (SELECT provider FROM {_DECLARED}) AND NOT EXISTS (SELECT 1 FROM {_DECLARED} d WHERE d.provider = f.provider AND {_PRE.format(x='d.language')} = p) GROUP BY 1",
    ),
    "x4_prefix_sets": Query(
        lambda spark, d: t.REQUESTS.frame(spark).where("detected is not null").withColumn("p", F.array_sort(F.array_distinct(F.transform(F.split("detected", ","), lambda x: lb.prefix(x))))).select("id", (F.size("p") > 1).alias("mixed"), (F.array_join("p", ",") == lb.prefix(F.col("language"))).alias("same")),
        f"WITH f AS (SELECT id, language, list_sort(list_distinct(list_transform(string_split(detected, ','), lambda x: split_part(x, '-', 1)))) AS p FROM {t.REQUESTS.sql} WHERE detected IS NOT NULL) SELECT id, len(p) > 1 AS mixed, p = [split_part(language, '-', 1)] AS same FROM f",
    ),
    "x5_gate": Query(
        lambda spark, d: vo.conversion_gate(t.REQUESTS.frame(spark), vo.built_in(spark), vo.declared_languages(spark)),
        f"WITH f AS (SELECT *, list_sort(list_distinct(list_transform(string_split(detected, ','), lambda x: split_part(x, '-', 1)))) AS p, (SELECT list(DISTINCT {_PRE.format(x='d.language')}) FROM {_DECLARED} d WHERE d.provider = r.provider) AS sup, coalesce((SELECT bool_or(v.language = 'multi') FROM {_VOICES} v WHERE v.provider = r.provider AND v.id = r.voice), FALSE) AS multi FROM {t.REQUESTS.sql} r), "
        "g AS (SELECT *, list_filter(p, lambda x: NOT list_contains(sup, x)) AS miss FROM f) SELECT id, CASE WHEN force OR detected IS NULL OR sup IS NULL THEN 'ok' WHEN len(miss) > 0 THEN 'error_unsupported' WHEN NOT multi AND len(p) > 1 THEN 'warn_mixed' WHEN NOT multi AND p[1] <> split_part(language, '-', 1) THEN 'warn_mismatch' ELSE 'ok' END AS decision, CASE WHEN NOT force AND detected IS NOT NULL AND sup IS NOT NULL AND len(miss) > 0 THEN array_to_string(miss, ',') ELSE '' END AS missing FROM g",
    ),
    "c11_conversion_plan": Query(
        lambda spark, d: jobs.conversion_plan(t.MANIFESTS.frame(spark), t.BOOKS.frame(spark), _chapters(spark), t.EDITS.frame(spark), t.PARSED.frame(spark), t.FILES.frame(spark)),
        f"WITH {_TEXTS}, pick AS (SELECT book_id, unnest(list_distinct(list_concat(selected, completed))) AS idx, completed FROM {t.MANIFESTS.sql}), r AS (SELECT c.book_id, c.idx, c.title, {clean_sql('c.text')} AS spoken, list_contains(completed, c.idx) AS done, (SELECT max(size) FROM {t.FILES.sql} f WHERE f.book_id = c.book_id AND filename = {_NAMED}) AS named, (SELECT max(size) FROM {t.FILES.sql} f WHERE f.book_id = c.book_id AND filename = {_LEGACY}) AS legacy, (SELECT max(size) FROM {t.FILES.sql} f WHERE f.book_id = c.book_id AND filename = {_TEMP} AND size > 0) AS temp FROM pick JOIN texts c USING (book_id, idx) JOIN {t.BOOKS.sql} b ON b.id = c.book_id) "
        "SELECT book_id, idx, title, length(spoken)::INTEGER AS chars, CASE WHEN NOT done AND spoken = '' THEN 'skip_empty' WHEN (done AND named IS NOT NULL) OR (NOT done AND named > 0) THEN 'reuse' WHEN named IS NULL AND legacy IS NOT NULL AND (done OR legacy > 0) THEN 'rename_legacy' WHEN temp IS NOT NULL THEN 'rename_temp' WHEN done THEN 'lost' ELSE 'synthesise' END AS action FROM r",
    ),
    "c12_needs_merge": Query(
        lambda spark, d: jobs.needs_merge(t.MANIFESTS.frame(spark), _labels(spark, t.MANIFESTS.frame(spark).select("book_id", F.explode("selected").alias("idx"))), t.FILES.frame(spark)),
        f"WITH {_LABELS.replace('{sel}', f'(SELECT book_id, unnest(selected) AS idx FROM {t.MANIFESTS.sql})')} SELECT m.book_id, ((output_m4b AND NOT EXISTS (SELECT 1 FROM {t.FILES.sql} f WHERE f.book_id = m.book_id AND filename LIKE '%.m4b')) OR (output_mp3 AND NOT EXISTS (SELECT 1 FROM {t.FILES.sql} f WHERE f.book_id = m.book_id AND filename = {_SAFE.format(x='''label || '.mp3' ''')}))) AS needs_merge FROM {t.MANIFESTS.sql} m JOIN labels ON labels.book_id = m.book_id WHERE len({_LEFT}) = 0",
    ),
}
