"""Secret scan against plain leftmost searches."""

import hashlib
import random
import re
import zlib

from leafmill.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def test_base_spans_equal_plain_search(spark):
    rng = random.Random(1)
    parts = ["password", "PassWD", "secret", "token", "api_key", "apikey", "\"", "'", " ", "  ", ":", "=", "abcdef12", "AKIA", "ABCDEFGH1234", "0123456789abcdef" * 2, "deadbeef", "é", "字", "ſecret", "Key", "x", "\n", "İ", "-", "tokentoken=aaaaaaaaaaaa"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)] + [None, "", "a" * 100_000, "token=" + "z" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in secrets.digests(secrets.find_secrets(df)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [got[i][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == x for _, k, _ in want) for x in range(3)]


def test_checksums_add_spans(spark):
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()))
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    df = spark.createDataFrame([(1, f"see {good} ok"), (2, f"see {bad} ok")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.digests(secrets.find_secrets(df)).collect()}
    assert got == {1: "checked:4:44", 2: ""}


def test_redaction_and_edges(spark):
    rows = [(1, "é token = abcdefgh12 end", "s"), (2, "token=0123456789abcdef0123456789abcdef", "t"), (3, None, "u"), (1, "é token = abcdefgh12 end", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans2 string")
    found = secrets.find_secrets(df, keep=("spans2",), mark="[secret]")
    assert found.columns == ["doc_id", "text", "spans2", "spans"]
    got = sorted((r["doc_id"], r["text"]) for r in found.where("text is not null").collect())
    assert got == [(1, "é [secret] end"), (1, "é [secret] end"), (2, "[secret]")]
    assert found.where("text is null").count() == 1
    assert secrets.find_secrets(df.limit(0)).count() == 0
