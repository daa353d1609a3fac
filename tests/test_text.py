"""Text functions against plain restatements of their rules, with generated texts."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import labels as lb
from leafmill.functions import text as tx
from leafmill.operators import audio, jobs


def column(spark, rows, c, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, s {kind}")
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def expected_chunks(text, limit):
    if len(text) <= limit:
        return [text] if text.strip() else []
    done, held = [], ""
    for s in (p.strip() for p in re.split(r"(?<=[.!?。！？])\s+", text)):
        if not s:
            continue
        if len(s) > limit:
            done += [held] if held else []
            held, part_held = "", ""
            for p in re.split(r"(?<=[,;:，；：])\s*", s):
                if len(part_held) + len(p) > limit:
                    done += [part_held] if part_held else []
                    while len(p) > limit:
                        done.append(p[:limit])
                        p = p[limit:]
                    part_held = p
                else:
                    part_held += p
            done += [part_held] if part_held else []
        elif len(held) + len(s) + 1 > limit:
            done += [held] if held else []
            held = s
        else:
            held = f"{held} {s}" if held else s
    return done + ([held] if held else [])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 。.!?,;: 字\n"), max_size=80), min_size=20, max_size=40))
def test_chunk_follows_the_rules(spark, texts):
    got = column(spark, texts, tx.chunk("s", 9))
    assert [list(g) for g in got] == [expected_chunks(t, 9) for t in texts]
    assert all(len(c) <= 9 for g, t in zip(got, texts) if len(t) > 9 for c in g)


def test_clean_cases(spark):
    cases = {
        "a&nbsp;b &amp; c": "a b c", "<b>x</b> y": "x y", "![i](u) [label](u) z": "label z", "# Head\ntext": "Head text", "snake_case **b**": "snakecase b",
        "12. item": "item", "see https://x.y/z now": "see now", "mail a.b@c.de end": "mail end", "“q” ‘s’ – …": "\"q\" 's' - ...", "w[1] x (23) (1990) a[1][2]": "w x (1990) a[2]", "a\x00b\x1fc": "abc", "　wide　": "wide",
    }
    assert column(spark, [*cases, None, ""], tx.clean("s")) == [*cases.values(), "", ""]


def test_language_ratio_is_strict(spark):
    rows = ["あ" + "x" * 19, "あ" * 2 + "x" * 19, "字" + "x" * 9, "字" * 2 + "x" * 9, "x" * 2000 + "字" * 2000, "", None, "   "]
    assert column(spark, rows, tx.detect_language("s")) == ["en-US", "ja-JP", "en-US", "zh-CN", "en-US", "en-US", "en-US", "en-US"]


def test_speech_seconds(spark):
    assert column(spark, ["one two three", "你好", "你 a好b", None, " "], tx.speech_seconds("s")) == [1.2, 0.5, 0.9, 0.0, 0.0]


def test_out_of_range_chapter_raises(spark):
    df = spark.createDataFrame([("7", 3)], "s string, n int")
    with pytest.raises(Exception, match="out of range"):
        df.select(jobs.parse_ranges(F.col("s"), F.col("n"))).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([("0", 3)], "s string, n int").select(jobs.parse_ranges(F.col("s"), F.col("n"))).collect()


def test_labels(spark):
    assert column(spark, [0.4, 59.5, 150.0, 7199.0], lb.duration_label(F.col("s")), "double") == ["1s", "60s", "2 min", "1h 60min"]
    assert column(spark, ["x" * 300], F.length(lb.safe_filename(F.col("s")))) == [200]


def test_tempo_chain(spark):
    speeds = [(1.0,), (2.0,), (5.0,), (0.2,)]
    want = ["atempo=1.0000", "atempo=2.0000", "atempo=2.0000,atempo=2.0000,atempo=1.2500", "atempo=0.5000,atempo=0.5000,atempo=0.8000"]
    assert [r[0] for r in spark.createDataFrame(speeds, "s double").select(audio.tempo_chain(F.col("s"))).collect()] == want
    with pytest.raises(Exception, match="positive"):
        spark.createDataFrame([(0.0,)], "s double").select(audio.tempo_chain(F.col("s"))).collect()


RULED = [
    ("en", "Dr. Smith met Mr. Jones at 5 p.m. on Main St. yesterday. They left.", ["Dr. Smith met Mr. Jones at 5 p.m. on Main St. yesterday.", "They left."]),
    ("en", 'He asked, "Why?" She said nothing. "Stop!" he cried. J. R. Hand wrote 3.5 pages... and slept. Wait... What?', ['He asked, "Why?"', "She said nothing.", '"Stop!" he cried.', "J. R. Hand wrote 3.5 pages... and slept.", "Wait...", "What?"]),
    ("en", "  (It ended.)  Then, e.g. later, vol. 2 came.\n\nNew line! ", ["(It ended.)", "Then, e.g. later, vol. 2 came.", "New line!"]),
    ("de", "Am 3. Oktober kam Prof. Braun, z. B. mit Hr. Lang. Er blieb bzw. ging. Gut!", ["Am 3. Oktober kam Prof. Braun, z. B. mit Hr. Lang.", "Er blieb bzw. ging.", "Gut!"]),
    ("fr", "M. Dupont et Mme. Petit, p. ex. hier, sont venus. Voir chap. 3. Fin ?", ["M. Dupont et Mme. Petit, p. ex. hier, sont venus.", "Voir chap. 3.", "Fin ?"]),
    ("es", "El Sr. Gómez vive en la Avda. Central, núm. 4. ¿Quién es? Nadie.", ["El Sr. Gómez vive en la Avda.", "Central, núm. 4.", "¿Quién es?", "Nadie."]),
    ("es", "La Dra. Ruiz vio la pág. 9 etc. con Ud. ayer. Fin.", ["La Dra. Ruiz vio la pág. 9 etc. con Ud. ayer.", "Fin."]),
    ("zh-CN", "你好。他说：“走吧！”我们走了。真的吗？？是", ["你好。", "他说：“走吧！”", "我们走了。", "真的吗？？", "是"]),
    ("xx", "No. list here. Next", ["No. list here.", "Next"]), ("en", "", []), ("en", "   ", []), ("en", "no mark at all", ["no mark at all"]),
]


@pytest.mark.parametrize("language,text,want", RULED)
def test_sentences_by_rules(spark, language, text, want):
    df = spark.createDataFrame([(text,), (None,)], "s string")
    got = [r[0] for r in df.select(tx.rule_sentences("s", language)).collect()]
    assert got == [want, None]
    assert got[0] is None or "".join("".join(got[0]).split()) == "".join(text.split())  # nothing is lost


def test_chunks_by_rules(spark):
    text = "Dr. Smith met Mr. Jones. They left at once."
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(tx.chunk("s", 26, "en")).head()[0] == ["Dr. Smith met Mr. Jones.", "They left at once."]
    assert df.select(tx.chunk("s", 10)).head()[0] != df.select(tx.chunk("s", 10, "en")).head()[0]


def test_addresses_and_digits_are_ascii_as_in_the_sql(spark):
    import duckdb

    from leafmill.plans.text_queries import clean_sql

    texts = ["x ekf.25@mail6.example.comü St", "Éléa@mail.example.org.", "é.foo@x.com", "a@b.c+d@e.f", "a@b.c-. a@b.-", "a@b.é", "a@é.b", "_x@y.z_.", "٣. kein Punkt\n12. Punkt", "Wort[٣] Wort[3] Wort(٣) Wort (12)", "@", "a@@b.c d@e..f--"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, s string").select("id", tx.clean("s").alias("t")).collect()
    db = duckdb.connect()
    expected = [db.execute(f"SELECT {clean_sql('?::VARCHAR')}", [t]).fetchone()[0] for t in texts]
    assert [r["t"] for r in sorted(rows)] == expected
    assert expected[0] == "x ü St" and expected[8] == "٣. kein Punkt Punkt"
