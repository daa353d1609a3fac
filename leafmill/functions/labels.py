"""Names, labels and provider parameters as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that file names may not hold, and the provider settings.
UNSAFE, SAFE = '/\\:*?"<>|', "---------"
FILE_NAME_CHARS, TITLE_CHARS = 200, 100
LANGUAGE_NAMES = {
    "zh-CN": "chinese", "zh-TW": "chinese", "zh-HK": "chinese", "en-US": "english", "en-GB": "english", "ja-JP": "japanese", "ko-KR": "korean",
    "fr-FR": "french", "de-DE": "german", "ru-RU": "russian", "pt-PT": "portuguese", "es-ES": "spanish", "it-IT": "italian",
}
CHARS_PER_SECOND = {"chinese": 4, "japanese": 5, "korean": 5, "english": 15, "french": 14, "german": 13, "russian": 12, "portuguese": 13, "spanish": 13, "italian": 13}
SHORT_CODES = ("en", "ko", "ja", "ar", "bg", "cs", "da", "de", "el", "es", "et", "fi", "fr", "hi", "hr", "hu", "id", "it", "lt", "lv", "nl", "pl", "pt", "ro", "ru", "sk", "sl", "sv", "tr", "uk", "vi")
CHUNK_CHARS = {"edge": 3000, "baidu": 500, "iflytek": 500, "elevenlabs": 2500, "supertonic": 300, "kokoro": 300}

def safe_filename(c: Column) -> Column:
    return F.substring(F.translate(c, UNSAFE, SAFE), 1, FILE_NAME_CHARS)


def chapter_file(book: Column, index: Column, title: Column) -> Column:
    """File name of a chapter; the number keeps equal titles apart."""
    return safe_filename(F.format_string("%s - %04d - %s.mp3", book, index, title))


def duration_label(seconds: Column) -> Column:
    """'45s', '12 min' or '1h 5min'; halves round to even."""
    hours = F.floor(seconds / 3600)
    return (
        F.when(seconds < 60, F.concat(F.greatest(F.lit(1), F.bround(seconds, 0).cast("int")).cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat(F.bround(seconds / 60, 0).cast("int").cast("string"), F.lit(" min")))
        .otherwise(F.concat(hours.cast("string"), F.lit("h "), F.bround((seconds - hours * 3600) / 60, 0).cast("int").cast("string"), F.lit("min")))
    )


def short_duration_label(seconds: Column) -> Column:
    """The label of listings: minutes from 60 s on, no hours."""
    whole = lambda c: F.bround(c, 0).cast("int").cast("string")
    return F.when(seconds >= 60, F.concat(whole(seconds / 60), F.lit(" min"))).otherwise(F.concat(F.greatest(F.lit(1), F.bround(seconds, 0).cast("int")).cast("string"), F.lit("s")))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def author_from_name(stem: Column) -> Column:
    """The author in 'Title (Author)', ASCII or full-width parentheses."""
    return F.coalesce(F.nullif(F.regexp_extract(stem, "[(（](.+?)[)）]", 1), F.lit("")), F.lit("Unknown"))


def speed_rate(speed: Column) -> Column:
    """'+20%' for 1.2."""
    percent = F.bround((speed - 1) * 100, 0).cast("int")
    return F.concat(F.when(percent >= 0, "+").otherwise(""), percent.cast("string"), F.lit("%"))


def baidu_speed(speed: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(15), F.bround(speed * 5, 0).cast("int")))


def iflytek_speed(speed: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(200), (speed * 50).cast("int")))


def prefix(tag: Column) -> Column:
    return F.substring_index(tag, "-", 1)


def language_name(tag: Column) -> Column:
    """The language parameter of the local provider: a name, or 'auto'."""
    return F.coalesce(_lookup(LANGUAGE_NAMES)[tag], F.lit("auto"))


def short_code(tag: Column) -> Column:
    code = F.lower(prefix(tag))
    return F.when(code.isin(*SHORT_CODES), code).otherwise("na")


def two_way_code(tag: Column) -> Column:
    return F.when(tag.startswith("zh"), "zh").otherwise("en")


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def chunk_limit(language: Column, seconds: Column, cloned: Column) -> Column:
    """Characters that fit the target duration; cloned voices take 60 s at most."""
    target = F.when(cloned, F.least(seconds, F.lit(60))).otherwise(seconds)
    return F.greatest(F.lit(100), (target * F.coalesce(_lookup(CHARS_PER_SECOND)[language_name(language)], F.lit(4))).cast("int"))


def token_budget(seconds: Column) -> Column:
    return F.greatest(F.lit(1024), (seconds * 12.5 * 1.8).cast("int"))


def is_truncated(expected: Column, actual: Column) -> Column:
    return (expected > 2) & (actual < expected * 0.3)


def provider_seconds(provider: Column, n_chars: Column, speed: Column, setting: Column) -> Column:
    """Duration estimate of a provider for a number of characters."""
    plain = n_chars / 4.0
    return F.when(provider.isin("baidu", "iflytek", "elevenlabs"), plain).when(provider == "supertonic", n_chars / (4.0 * speed * setting)).otherwise(n_chars / (4.0 * speed))


def effective_speed(requested: Column, setting: Column, provider: Column) -> Column:
    own = F.when(provider.isin("qwen3_mlx", "supertonic", "kokoro"), setting)
    return F.coalesce(requested, own, F.lit(1.0))


def metadata_escape(c: Column) -> Column:
    """Escapes of ffmetadata values: backslash, equals, hash; line ends become spaces."""
    for old, new in (("\\", "\\\\"), ("=", "\\="), ("#", "\\#"), ("\r", " "), ("\n", " ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def contiguous_label(title: Column, total: Column, chosen: Column) -> Column:
    """Name of an output of some chapters; `chosen` is array<struct<index,title>> in order."""
    first, last, n = F.element_at(chosen, 1), F.element_at(chosen, -1), F.size(chosen)
    joined = lambda tail: F.concat(title, F.lit(" - "), tail)
    return (
        F.when(n == total, title)
        .when(n == 1, joined(first["title"]))
        .when(last["index"] - first["index"] + 1 == n, joined(F.concat(first["title"], F.lit("~"), last["title"])))
        .otherwise(joined(F.concat(first["title"], F.lit("等"), n.cast("string"), F.lit("章"))))
    )
