"""Voices, their languages, and the checks made before a conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions.labels import prefix

COLUMNS = "id string, name string, gender string, language string, provider string, description string"

# The built-in voices as id, name, gender, language, provider, description.
BUILT_IN = (
    ("vivian", "Vivian", "female", "multi", "qwen3_mlx", "明亮略带棱角的年轻女声"),
    ("serena", "Serena", "female", "multi", "qwen3_mlx", "温暖柔和的年轻女声"),
    ("uncle_fu", "Uncle Fu", "male", "multi", "qwen3_mlx", "沉稳低沉的男声"),
    ("dylan", "Dylan", "male", "multi", "qwen3_mlx", "北京口音年轻男声"),
    ("eric", "Eric", "male", "multi", "qwen3_mlx", "成都口音男声，略带沙哑"),
    ("ryan", "Ryan", "male", "multi", "qwen3_mlx", "Dynamic male, strong rhythm"),
    ("aiden", "Aiden", "male", "multi", "qwen3_mlx", "Sunny American male voice"),
    ("ono_anna", "Ono Anna", "female", "multi", "qwen3_mlx", "Playful Japanese female"),
    ("sohee", "Sohee", "female", "multi", "qwen3_mlx", "Warm Korean female"),
    ("zh-CN-XiaoxiaoNeural", "晓晓", "female", "zh-CN", "edge", ""),
    ("zh-CN-XiaoyiNeural", "晓伊", "female", "zh-CN", "edge", ""),
    ("zh-CN-YunxiNeural", "云希", "male", "zh-CN", "edge", ""),
    ("zh-CN-YunjianNeural", "云健", "male", "zh-CN", "edge", ""),
    ("zh-CN-YunyangNeural", "云扬", "male", "zh-CN", "edge", "新闻播报风格"),
    ("en-US-EmmaNeural", "Emma", "female", "en-US", "edge", ""),
    ("en-US-JennyNeural", "Jenny", "female", "en-US", "edge", ""),
    ("en-US-GuyNeural", "Guy", "male", "en-US", "edge", ""),
    ("en-US-ChristopherNeural", "Christopher", "male", "en-US", "edge", ""),
    ("ja-JP-NanamiNeural", "Nanami", "female", "ja-JP", "edge", ""),
    ("ja-JP-KeitaNeural", "Keita", "male", "ja-JP", "edge", ""),
    ("ko-KR-SunHiNeural", "SunHi", "female", "ko-KR", "edge", ""),
    ("ko-KR-InJoonNeural", "InJoon", "male", "ko-KR", "edge", ""),
    ("fr-FR-DeniseNeural", "Denise", "female", "fr-FR", "edge", ""),
    ("fr-FR-HenriNeural", "Henri", "male", "fr-FR", "edge", ""),
    ("de-DE-KatjaNeural", "Katja", "female", "de-DE", "edge", ""),
    ("de-DE-ConradNeural", "Conrad", "male", "de-DE", "edge", ""),
    ("es-ES-ElviraNeural", "Elvira", "female", "es-ES", "edge", ""),
    ("es-ES-AlvaroNeural", "Alvaro", "male", "es-ES", "edge", ""),
    ("ru-RU-SvetlanaNeural", "Svetlana", "female", "ru-RU", "edge", ""),
    ("ru-RU-DmitryNeural", "Dmitry", "male", "ru-RU", "edge", ""),
    ("3", "度逍遥", "male", "zh", "baidu", "情感-磁性男声"),
    ("4", "度丫丫", "female", "zh", "baidu", "情感-甜美女声"),
    ("5", "度小娇", "female", "zh", "baidu", "精品女声"),
    ("103", "度米朵", "female", "zh", "baidu", "精品-温柔女声"),
    ("106", "度博文", "male", "zh", "baidu", "精品-磁性男声"),
    ("110", "度小童", "female", "zh", "baidu", "精品-童声"),
    ("111", "度小萌", "female", "zh", "baidu", "精品-活泼女声"),
    ("5003", "度逍遥", "male", "zh", "baidu", "专业版-磁性男声"),
    ("5118", "度小鹿", "female", "zh", "baidu", "专业版-温柔女声"),
    ("x4_xiaoyan", "小燕", "female", "zh", "iflytek", "X4高品质女声"),
    ("x4_yezi", "小露", "female", "zh", "iflytek", "X4高品质女声"),
    ("aisjiuxu", "许久", "male", "zh", "iflytek", "亲和男声"),
    ("aisjinger", "小婧", "female", "zh", "iflytek", "柔美女声"),
    ("aisbabyxu", "许小宝", "female", "zh", "iflytek", "童声"),
    ("M1", "M1 · Marcus", "male", "multi", "supertonic", "Warm, clear male"),
    ("M2", "M2 · James", "male", "multi", "supertonic", "Deep, resonant male"),
    ("M3", "M3 · Kai", "male", "multi", "supertonic", "Bright, energetic male"),
    ("M4", "M4 · Lucas", "male", "multi", "supertonic", "Smooth, narrator male"),
    ("M5", "M5 · Oscar", "male", "multi", "supertonic", "Soft, gentle male"),
    ("F1", "F1 · Clara", "female", "multi", "supertonic", "Bright, professional female"),
    ("F2", "F2 · Nova", "female", "multi", "supertonic", "Warm, friendly female"),
    ("F3", "F3 · Luna", "female", "multi", "supertonic", "Soft, calm female"),
    ("F4", "F4 · Iris", "female", "multi", "supertonic", "Clear, articulate female"),
    ("F5", "F5 · Sophie", "female", "multi", "supertonic", "Sweet, melodic female"),
    ("pNInz6obpgDQGcFmaJgB", "Adam", "male", "multi", "elevenlabs", "Dominant, Firm · American"),
    ("hpp4J3VqNfWAUOO0d1Us", "Bella", "female", "multi", "elevenlabs", "Professional, Bright · American"),
    ("nPczCjzI2devNBz1zQrb", "Brian", "male", "multi", "elevenlabs", "Deep, Resonant · American"),
    ("onwK4e9ZLuTAKqWW03F9", "Daniel", "male", "multi", "elevenlabs", "Steady Broadcaster · British"),
    ("cjVigY5qzO86Huf0OWal", "Eric", "male", "multi", "elevenlabs", "Smooth, Trustworthy · American"),
    ("JBFqnCBsd6RMkjVDRZzb", "George", "male", "multi", "elevenlabs", "Warm Storyteller · British"),
    ("Xb7hH8MSUJpSbSDYk0k2", "Alice", "female", "multi", "elevenlabs", "Clear Educator · British"),
    ("pFZP5JQG7iQjIQuC4Bku", "Lily", "female", "multi", "elevenlabs", "Velvety Actress · British"),
    ("XrExE9yKIg1WjnnlVkGX", "Matilda", "female", "multi", "elevenlabs", "Professional · American"),
    ("pqHfZKP75CvOlQylNhV4", "Bill", "male", "multi", "elevenlabs", "Wise, Mature · American"),
    ("iP95p4xoKVk53GoZ742B", "Chris", "male", "multi", "elevenlabs", "Charming · American"),
    ("SAz9YHcvj6GT2YYXdXww", "River", "female", "multi", "elevenlabs", "Calm, Informative · American"),
    ("zf_003", "Kokoro 女声 003", "female", "zh", "kokoro", ""),
    ("zf_024", "Kokoro 女声 024", "female", "zh", "kokoro", ""),
    ("zf_038", "Kokoro 女声 038", "female", "zh", "kokoro", ""),
    ("zf_047", "Kokoro 女声 047", "female", "zh", "kokoro", ""),
    ("zf_048", "Kokoro 女声 048", "female", "zh", "kokoro", ""),
    ("zf_059", "Kokoro 女声 059", "female", "zh", "kokoro", ""),
    ("zm_011", "Kokoro 男声 011", "male", "zh", "kokoro", ""),
    ("zm_012", "Kokoro 男声 012", "male", "zh", "kokoro", ""),
    ("zm_029", "Kokoro 男声 029", "male", "zh", "kokoro", ""),
    ("zm_069", "Kokoro 男声 069", "male", "zh", "kokoro", ""),
    ("zm_089", "Kokoro 男声 089", "male", "zh", "kokoro", ""),
    ("zm_098", "Kokoro 男声 098", "male", "zh", "kokoro", ""),
    ("af_maple", "Maple", "female", "en-US", "kokoro", "American female"),
    ("af_sol", "Sol", "female", "en-US", "kokoro", "American female"),
    ("bf_vale", "Vale", "female", "en-GB", "kokoro", "British female"),
)

# The languages that each provider declares, in order.
DECLARED = {
    "edge": ("zh-CN", "en-US", "ja-JP", "ko-KR", "fr-FR", "de-DE", "ru-RU", "es-ES"),
    "qwen3_mlx": ("zh-CN", "en-US", "ja-JP", "ko-KR", "fr-FR", "de-DE", "ru-RU", "pt-PT", "es-ES", "it-IT"),
    "elevenlabs": ("zh-CN", "en-US", "ja-JP", "ko-KR", "fr-FR", "de-DE", "ru-RU", "pt-PT", "es-ES", "it-IT"),
    "supertonic": ("en-US", "en-GB", "ko-KR", "ja-JP", "ar-SA", "bg-BG", "cs-CZ", "da-DK", "de-DE", "el-GR", "es-ES", "et-EE", "fi-FI", "fr-FR", "hi-IN", "hr-HR", "hu-HU", "id-ID", "it-IT", "lt-LT", "lv-LV", "nl-NL", "pl-PL", "pt-PT", "pt-BR", "ro-RO", "ru-RU", "sk-SK", "sl-SI", "sv-SE", "tr-TR", "uk-UA", "vi-VN"),
    "kokoro": ("zh-CN", "en-US", "en-GB"),
    "baidu": ("zh-CN",),
    "iflytek": ("zh-CN",),
}
KOKORO_ENGLISH = ("af_maple", "af_sol", "bf_vale")


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUILT_IN, COLUMNS)


def declared_languages(spark: SparkSession) -> DataFrame:
    rows = [(p, i, t) for p, tags in DECLARED.items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "provider string, ord int, language string")


def merged(voices: DataFrame, hidden: DataFrame, custom: DataFrame, cloned: DataFrame) -> DataFrame:
    """Built-in voices less hidden ones, then custom and cloned ones with their defaults."""
    own = voices.join(hidden, ["provider", "id"], "left_anti").withColumn("custom", F.lit(False))
    filled = lambda df, provider: df.select(
        "id", "name", F.coalesce("gender", F.lit("female")).alias("gender"), "language", provider.alias("provider"), F.coalesce("description", F.lit("")).alias("description"), F.lit(True).alias("custom")
    )
    return own.unionByName(filled(custom, F.col("provider"))).unionByName(filled(cloned, F.lit("qwen3_mlx")))


def with_hidden_flag(voices: DataFrame, hidden: DataFrame) -> DataFrame:
    flags = hidden.select("provider", "id", F.lit(True).alias("is_hidden")).distinct()
    return voices.join(flags, ["provider", "id"], "left").withColumn("hidden", F.coalesce("is_hidden", F.lit(False))).drop("is_hidden")


def speaks(voice_language: Column, wanted: Column) -> Column:
    """multi always; a regional tag only exactly; a bare one by prefix; no wish, all."""
    regional = voice_language.contains("-")
    return wanted.isNull() | (wanted == "") | (voice_language == "multi") | F.when(regional, F.lower(voice_language) == F.lower(wanted)).otherwise(F.lower(voice_language) == F.lower(prefix(wanted)))


def served_languages(voices: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared languages that a voice covers, by prefix or because one is multilingual."""
    covered = voices.groupBy("provider").agg(F.max((F.col("language") == "multi")).alias("multi"), F.collect_set(F.when(F.col("language") != "multi", F.lower(prefix(F.col("language"))))).alias("prefixes"))
    rows = declared.join(covered, "provider")
    return rows.where(F.col("multi") | F.array_contains("prefixes", F.lower(prefix(F.col("language"))))).select("provider", "ord", "language")


def conversion_gate(requests: DataFrame, voices: DataFrame, declared: DataFrame) -> DataFrame:
    """Decision per request: ok, warn_mismatch, warn_mixed or error_unsupported, and the unsupported prefixes.

    requests: id, provider, voice, language, detected (comma-joined or null), force.
    """
    supported = declared.groupBy("provider").agg(F.collect_set(prefix(F.col("language"))).alias("supported"))
    kinds = voices.groupBy("provider", F.col("id").alias("voice")).agg(F.max(F.col("language") == "multi").alias("multi"))
    rows = requests.join(supported, "provider", "left").join(kinds, ["provider", "voice"], "left")
    found = F.array_sort(F.array_distinct(F.transform(F.split("detected", ","), lambda t: prefix(t))))
    rows = rows.withColumn("found", found).withColumn("missing", F.when(F.col("supported").isNull(), F.array().cast("array<string>")).otherwise(F.array_except("found", "supported")))
    multi, mixed = F.coalesce("multi", F.lit(False)), F.size("found") > 1
    decision = (
        F.when(F.col("force") | F.col("detected").isNull() | F.col("supported").isNull(), "ok")
        .when(F.size("missing") > 0, "error_unsupported")
        .when(~multi & mixed, "warn_mixed")
        .when(~multi & (F.col("found")[0] != prefix(F.col("language"))), "warn_mismatch")
        .otherwise("ok")
    )
    return rows.select("id", decision.alias("decision"), F.when(decision == "error_unsupported", F.array_join("missing", ",")).otherwise("").alias("missing"))


def is_kokoro_voice(voice: Column) -> Column:
    v = F.lower(F.trim(voice))
    return v.rlike(r"^(zf|zm)_[0-9]{3}$") | v.isin(*KOKORO_ENGLISH)


def first_match(voices: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first voice (by ord) of each wanted id."""
    w = Window.partitionBy("id").orderBy("ord")
    return voices.join(wanted, "id").withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
