"""BPE round trip and token files against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from leafmill.llm import bpe, token_files
from leafmill.llm.common import fresh_path
from leafmill.llm.queries import vocabulary
from leafmill.llm.textkit import buffers

PARTS = ["'", "s", "re", "ll", "qz", "Q", "é", "É", " ", "  ", "\n", "\t", " ", "　", "1", "99", "!", "?", "<|endoftext|>", "<|", "x", "a'", "ñ", "😀", "\x1c", "\x85", "́", "的", "-", "''", "İ", "Σ", "½", "_", "the", "ing"]


def texts(n=4000):
    rng = random.Random(5)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)]


def test_byte_bpe_equals_library():
    codec = bpe.ForcedBoundaryBPE(vocabulary("byte_bpe_50k.json"))
    some = [*texts(), "", "word " * 30_000]
    got = codec.encode(*buffers(pa.array(some)))
    for text, ids, e in zip(some, got, codec.tokenizer.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert codec.decode(ids) == codec.tokenizer.decode(e.ids, skip_special_tokens=False)


def test_cut_pairs_never_occur_inside_tokens():
    codec = bpe.ForcedBoundaryBPE(vocabulary("byte_bpe_50k.json"))
    for i in range(0, 50_256, 7):
        t = codec.flat[codec.start[i] : codec.start[i] + codec.length[i]]
        assert not codec.cut[t[:-1], t[1:]].any()


def test_roundtrip_rows(spark):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello there", "x"), (None, "no id", "w"), (5, "é" * 5000, "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(bpe.encode_decode(df, vocabulary("byte_bpe_50k.json"))).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[5]["decoded_sha256"] == hashlib.sha256(("é" * 5000).encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_word_encoder_equals_library():
    encoder = token_files.WordEncoder(vocabulary("word_bpe_49k.json"))
    some = [*texts(), "<|ENDOFTEXT|> <|startoftext|>x"]
    got = encoder.encode([s.encode() for s in some])
    for ids, e in zip(got, encoder.tokenizer.encode_batch(some, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids


def test_word_encoder_equals_library_on_every_letter():
    encoder = token_files.WordEncoder(vocabulary("word_bpe_49k.json"))
    some = [f.format(chr(c)) for c in range(0x250) for f in ("{}", "President {}liyev spoke", "a{0}B {0}1")]
    got = encoder.encode([s.encode() for s in some])
    wrong = [s for s, ids, e in zip(some, got, encoder.tokenizer.encode_batch(some, add_special_tokens=False)) if np.frombuffer(ids, "<u4").tolist() != e.ids]
    assert not wrong


def test_token_files(spark):
    rows = [(7, "Some words here", 1), (3, None, 2), (5, "", 3), (11, "MORE Words, here!", 4), (9, "w " * 20_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    out = fresh_path(spark, "t")
    token_files.write_ids(df, out, vocabulary("word_bpe_49k.json"))
    got = token_files.digests(token_files.read_ids(spark, out)).orderBy("doc_id").collect()
    library, at = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0
    for r, (doc_id, text, _) in zip(got, sorted(rows)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.lookup(spark, out, [5, 11]).count() == 2
    plan = token_files.lookup(spark, out, [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [5])]" in plan or "EqualTo(doc_id,5)" in plan or "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan
    empty = fresh_path(spark, "t")
    token_files.write_ids(df.limit(0), empty, vocabulary("word_bpe_49k.json"))
    assert token_files.read_ids(spark, empty).count() == 0


def test_orc_files_hold_indexes_and_runs(spark):
    """What the ORC footers say: integer run-length encoding, row indexes and Bloom filters on ids, ids in order over the files."""
    df = spark.range(25_000).selectExpr("id * 3 AS doc_id", "concat('word ', id) AS text").repartition(4)
    out = fresh_path(spark, "t")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # several files, small as they are
    token_files.write_ids(df, out, vocabulary("word_bpe_49k.json"))
    spark.conf.unset(key)
    jvm, orc, conf = spark._jvm, spark._jvm.org.apache.orc, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(out)
    spans, rows = [], 0
    for f in folder.getFileSystem(conf).listStatus(folder):
        if not f.getPath().getName().endswith(".orc"):
            continue
        reader = orc.OrcFile.createReader(f.getPath(), orc.OrcFile.readerOptions(conf))
        if not reader.getNumberOfRows():
            continue
        names = list(reader.getSchema().getFieldNames())
        column = reader.getSchema().getChildren().get(names.index("doc_id")).getId()
        ids = next(c for c in range(reader.getSchema().getMaximumId() + 1) if c == reader.getSchema().getChildren().get(names.index("ids")).getId()) + 1  # the list's elements
        found = reader.rows()
        for stripe in reader.getStripes():
            footer = found.readStripeFooter(stripe)
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert footer.getColumns(column).getKind().toString() == footer.getColumns(ids).getKind().toString() == "DIRECT_V2"
            assert (column, "ROW_INDEX") in kinds and (ids, "ROW_INDEX") in kinds
            assert any(c == column and k.startswith("BLOOM_FILTER") for c, k in kinds) and not any(c == ids and k.startswith("BLOOM_FILTER") for c, k in kinds)
        assert reader.getRowIndexStride() > 0
        least = reader.getStatistics()[column]
        spans.append((least.getMinimum(), least.getMaximum()))
        rows += reader.getNumberOfRows()
        found.close()
    assert rows == 25_000 and len(spans) > 1
    spans.sort()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert token_files.lookup(spark, out, [30, 31, 33]).count() == 2


def test_repeated_ids_in_token_files(spark):
    df = spark.createDataFrame([(5, "one two"), (5, "one two"), (5, "three"), (2, "first"), (None, "no id")], "doc_id long, text string")
    out = fresh_path(spark, "t")
    token_files.write_ids(df, out, vocabulary("word_bpe_49k.json"))
    got = token_files.digests(token_files.read_ids(spark, out)).collect()
    by_start = sorted(got, key=lambda r: (r["start"], r["n_tokens"]))
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [2, 5, 5, 5]
    assert token_files.lookup(spark, out, [5]).count() == 3
