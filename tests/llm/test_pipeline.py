"""The pipeline's stages on documents with known flaws."""

import random

import numpy as np

import corpus_pipeline as cp
from leafmill.llm import bpe
from leafmill.llm.queries import vocabulary

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    item = say(30)
    base = say(120)
    rows = [(i, say(60)) for i in range(40)] + [(40, base), (41, base), (42, base.replace(base.split()[60], "edited")), (43, f"{say(20)} {item} {say(20)}"), (44, f"{say(10)} password = hunter2hunter2 {say(10)}"), (45, None), (46, "123 456"), (47, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    text, ids = dict(rows), []
    now = docs
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.dtypes == docs.dtypes
        ids.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert ids[0] == set(text) - {45, 46, 47}
    assert ids[1] == ids[0] - {41, 42}
    assert ids[2] == ids[1] - {43}
    assert ids[3] == ids[4] == ids[2]
    clean = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "out3")).collect()}
    assert "hunter2" not in clean[44]["text"] and clean[44]["n_chars"] == len(clean[44]["text"])
    assert all(clean[i]["text"] == text[i] for i in clean if i != 44)
    codec = bpe.ForcedBoundaryBPE(vocabulary("byte_bpe_50k.json"))
    for r in now.collect():
        assert codec.decode(bytes(r["ids"])) == clean[r["doc_id"]]["text"]
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == codec.tokenizer.encode(clean[r["doc_id"]]["text"], add_special_tokens=False).ids
    assert cp.run(spark, str(tmp_path)).count() == len(ids[4])


def test_passages_in_rows_without_an_id(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    item, clean = say(30), say(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"{say(20)} {item} {say(20)}"), (None, clean), (None, None), (1, say(60)), (2, f"{say(9)} {item}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], COLUMNS)
    got = {(r["doc_id"], r["text"]) for r in cp.benchmark_passages(spark, docs, str(tmp_path)).collect()}
    assert got == {rows[1], rows[2], rows[3]}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_columns_of_any_name(spark, tmp_path):
    """Names that the stages use themselves, dotted and spaced ones pass through every stage with their values and types."""
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    more = ["_key", "_token", "a.b", "with space", "id", "c0", "component_id", "spans", "item_id", "score", "lang_pred", "node", "h", "`"]
    item, twin = say(30), say(80)
    texts = [say(60), twin, twin, f"{say(20)} {item}", f"{say(9)} password = hunter2hunter2 {say(9)}", say(50)]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, t, "en", "s", len(t), *(f"{n}{i}" for n in more)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, COLUMNS.split(", ")[0].split(" ")[:1] + ["text", "lang", "source", "n_chars", *more])
    now = docs
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.dtypes == docs.dtypes
            for r in now.collect():
                assert list(r)[5:] == [f"{n}{r[0]}" for n in more]
    assert {r["doc_id"] for r in now.collect()} == {0, 1, 4, 5}
