"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

A URL's host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z
lower-cased; its path goes on up to "?", "#" or the end.  A rule has a host, a path and a
verdict: it fits its host and all subdomains if the path starts with the rule's path.  The
longest rule decides (host and path together; of equals the longer host, then the earlier
rule).  URLs that no rule fits are judged by the model: the distinct 3 to 5 character
n-grams of "^host$" and of the path are hashed to FEATURES columns, scaled to length 1, and
a regularised logistic regression over them gives the probability of `block`.

The model is Spark's own, trained on a labelled table of URLs (a parameter; LABELLED is a
small one).  Rules are a list in the plan, meant for up to a few thousand.  Everything is a
map over the rows in the JVM: no shuffle, no Python.

Defined results: null and "://"-less URLs have an empty host and path, fit no rule and get
the model's score of an empty URL; repeated rows each get the same result; labelled rows
without a URL or label don't count; with labels of one kind the score is 0 or 1, and 0
without labelled rows; an empty table stays empty.  Characters count as code points.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTHS, FEATURES, STRENGTH, ITERATIONS, BLOCK_FROM = (3, 4, 5), 1 << 16, 0.0001, 100, 0.5


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))

# A small table of labelled URLs: gambling, pills, adult, advertising, spam and piracy; then others.
BLOCKED = (
    "https://www.casino-royal.example.com/en/12", "http://casino-win.example.net/de/7.html", "https://win-casino.example.org/", "http://m.online-casino.example.com/fr/3?ref=x", "https://blog.slots-casino.example.net/es/40#top",
    "http://jackpot-slots.example.com/en/5/", "https://poker-stars-win.example.org/en/71", "http://www.poker-bonus.example.net/de/18?page=2", "https://free-bets.example.com/en/2", "http://www.free-bets.example.org/es/9.html",
    "https://m.bets-online.example.net/fr/14", "http://sports-bets.example.com/", "https://best-odds-bet.example.org/de/33", "http://blog.lucky-bet.example.net/en/80/", "https://roulette-win.example.com/es/6",
    "https://cheap-pills.example.com/en/4", "http://www.cheap-pills.example.net/fr/91.html", "https://m.pills-online.example.org/de/2?utm_source=feed", "http://diet-pills.example.com/es/17", "https://blog.buy-pills.example.net/en/63#top",
    "http://viagra-cheap.example.org/", "https://cheap-meds.example.com/fr/55/", "http://www.pharma-discount.example.net/en/20", "https://no-prescription-meds.example.org/de/8", "http://cialis-pharmacy.example.com/en/39",
    "https://adult-x.example.com/en/1", "http://www.adult-x.example.org/de/76.html", "https://m.adult-videos.example.net/fr/23", "http://blog.adult-cams.example.com/es/12?page=2&ref=x", "https://xxx-tube.example.org/en/44",
    "http://hot-xxx.example.net/", "https://www.sex-cams.example.com/fr/60/", "http://porn-free.example.org/en/31", "https://live-porn.example.net/de/5#top", "http://escort-x.example.com/es/28",
    "https://ads-track.example.com/en/10", "http://www.ads-track.example.org/fr/2", "https://m.ads-server.example.net/de/47.html", "http://blog.ads-click.example.com/en/85", "https://click-track.example.org/es/13/",
    "http://banner-ads.example.net/en/21", "https://pop-ads.example.com/?id=3", "http://pixel-track.example.org/fr/66", "https://www.ad-tracker.example.net/de/30", "http://track-clicks.example.com/en/52?utm_source=feed",
    "https://spam-farm.example.com/en/3", "http://www.spam-farm.example.net/es/58.html", "https://m.link-farm.example.org/fr/70", "http://blog.spam-links.example.com/de/11", "https://content-farm-seo.example.net/en/9#top",
    "http://seo-spam.example.org/", "https://buy-links.example.com/fr/16/", "http://free-money-win.example.net/en/77", "https://www.win-prize.example.org/de/24", "http://fast-loans.example.com/es/35",
    "https://payday-loan.example.net/en/90", "http://cheap-replica.example.org/fr/4", "https://replica-watches-cheap.example.com/de/62", "http://m.warez-crack.example.net/en/19?page=2", "https://torrent-keygen.example.org/es/81",
)
ALLOWED = (
    "https://www.example.com/en/12", "http://example.org/de/7.html", "https://news.example.net/", "http://m.daily-herald.example.com/fr/3?ref=x", "https://blog.gardening.example.net/es/40#top",
    "http://library.example.com/en/5/", "https://university.example.org/en/71", "http://www.museum.example.net/de/18?page=2", "https://recipes.example.com/en/2", "http://www.cooking-school.example.org/es/9.html",
    "https://m.weather.example.net/fr/14", "http://city-council.example.com/", "https://history-archive.example.org/de/33", "http://blog.travel-notes.example.net/en/80/", "https://music-review.example.com/es/6",
    "https://open-source.example.com/en/4", "http://www.software-docs.example.net/fr/91.html", "https://m.hospital.example.org/de/2?utm_source=feed", "http://health-advice.example.com/es/17", "https://blog.parenting.example.net/en/63#top",
    "http://bookshop.example.org/", "https://train-times.example.com/fr/55/", "http://www.football-club.example.net/en/20", "https://astronomy.example.org/de/8", "http://chess-friends.example.com/en/39",
    "https://thester.example.com/en/1", "http://www.ringer.example.org/de/76.html", "https://m.therand.example.net/fr/23", "http://blog.tionest.example.com/es/12?page=2&ref=x", "https://hanthe.example.org/en/44",
    "http://erdenth.example.net/", "https://www.lystion.example.com/fr/60/", "http://whether.example.org/en/31", "https://thhesti.example.net/de/5#top", "http://ouress.example.com/es/28",
    "https://blethan.example.com/en/10", "http://www.thornt.example.org/fr/2", "https://m.shares.example.net/de/47.html", "http://blog.theory.example.com/en/85", "https://atheron.example.org/es/13/",
    "http://handed.example.net/en/21", "https://ndther.example.com/?id=3", "http://tionwh.example.org/fr/66", "https://www.entionth.example.net/de/30", "http://rethsh.example.com/en/52?utm_source=feed",
    "https://community-farm.example.com/en/3", "http://www.local-news.example.net/es/58.html", "https://m.village-school.example.org/fr/70", "http://blog.photography.example.com/de/11", "https://philosophy.example.net/en/9#top",
    "http://mathematics.example.org/", "https://language-course.example.com/fr/16/", "http://bicycle-repair.example.net/en/77", "https://www.choir.example.org/de/24", "http://birdwatching.example.com/es/35",
    "https://public-radio.example.net/en/90", "http://courthouse.example.org/fr/4", "https://watchmaker.example.com/de/62", "http://m.carpentry.example.net/en/19?page=2", "https://geology.example.org/es/81",
    "https://wiki.example.com/articles/history-of-printing", "http://forum.example.net/threads/1452", "https://docs.example.org/guide/install.html", "http://shop.example.com/garden/tools", "https://blog.example.net/2021/03/a-walk-in-the-hills",
    "http://kids-club.example.com/fr/41", "https://winter-sports.example.org/en/68", "http://better-homes.example.net/de/15", "https://alphabet.example.com/es/22", "http://tracking-wildlife.example.org/en/57",
    "https://berlin.example.com/de/3", "http://www.robin.example.net/en/48.html", "https://m.cabin.example.org/fr/7", "http://darwin-college.example.com/en/29", "https://mountain.example.org/es/64", "http://latin.example.net/en/15/",
    "https://rainbow.example.com/fr/82", "http://blog.captain.example.org/en/11#top", "https://www.spain.example.net/es/36", "http://origin.example.com/de/50?page=2",
)


def labelled(spark: SparkSession) -> DataFrame:
    """The small table: url, block (0 or 1), in one partition."""
    return spark.createDataFrame([(u, 1.0) for u in BLOCKED] + [(u, 0.0) for u in ALLOWED], "url string, block double").coalesce(1)


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def deciding_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host)))
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    listed = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("host", "under", "path", "rule", "verdict"), (r.host, "." + r.host, r.path, r.host + r.path, r.verdict)))) for r in ordered))
    first = F.get(F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, r["under"])) & F.startswith(path, r["path"])), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def grams(host: Column, path: Column) -> Column:
    """The n-grams of host and path, told apart by a mark in front."""

    def of(text: Column, mark: str, n: int) -> Column:
        # a look-ahead finds overlapping n-grams in one pass over the text
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1), lambda g: F.concat(F.lit(mark), g))

    whole = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*(of(text, mark, n) for text, mark in ((whole, "h"), (path, "p")) for n in LENGTHS))


def train(rows: DataFrame, url_col: str = "url", label_col: str = "block", features: int = FEATURES, strength: float = STRENGTH) -> PipelineModel | None:
    """The model of a table of URLs and labels (above 0: block); none for an empty table."""
    given = rows.select(F.col(url_col).alias("url"), (F.col(label_col) > 0).cast("double").alias("label")).where("url is not null and label is not null")
    if not given.head(1):
        return None
    regression = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=strength, maxIter=ITERATIONS, standardization=False)
    stages = [HashingTF(inputCol="grams", outputCol="hashed", numFeatures=features, binary=True), Normalizer(inputCol="hashed", outputCol="scaled"), regression]
    return Pipeline(stages=stages).fit(given.select("label", grams(*host_and_path(F.col("url"))).alias("grams")))


def judge(pages: DataFrame, model: PipelineModel | None, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of each row."""
    host, path = host_and_path(F.col("u"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    if model is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        rows = model.transform(rows.withColumn("grams", grams(F.col("host"), F.col("path")))).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    found = rows.withColumn("found", deciding_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("score") >= BLOCK_FROM, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "score")
