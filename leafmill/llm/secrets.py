"""Secret scan: Aho-Corasick keywords, anchored expressions near hits, checksums.

One automaton finds all keywords of a text in one pass.  Only at a hit the
expression of its kind is tried, anchored there; hits inside an earlier match of
the kind are passed over, which equals a leftmost non-overlapping search.  Runs of
hexadecimal digits have no keyword: 32 of them cover four consecutive multiples of
8, so these positions serve as their prefilter.  Token formats with an embedded
checksum (a base-62 CRC-32 in the last six characters) are added when it holds.

Spans count code points, ends exclusive.  Defined results: null or empty text has
no spans; each row is scanned on its own, so repeated rows repeat; other columns
aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches
from leafmill.llm.textkit import buffers, give_back, pieces

KINDS = ("assign", "access", "hex", "checked")
BASE = KINDS[:3]
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_HEX_RUN = re.compile(rb"[0-9a-f]+")
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = {i: i + 32 for i in range(65, 91)}


def base62(n: int) -> str:
    out = ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = _DIGITS[k] + out
    return out


def checksum_holds(body: str, tail: str) -> bool:
    return base62(zlib.crc32(body.encode())) == tail


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in ((0, _ASSIGN_WORDS), (1, ("akia",)), (3, _CHECKED_WORDS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def keyword_spans(text: str, auto) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches that begin at a keyword."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(_FOLD)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in auto.iter(low))
    out, past = [], [0, 0, 0, 0]
    for at, kind in hits:
        if at < past[kind]:
            continue
        m = (_ASSIGN if kind == 0 else _ACCESS if kind == 1 else _CHECKED).match(text, at)
        if not m:
            continue
        past[kind] = m.end()
        if (kind == 0 and len(m[2]) >= 8) or (kind == 1 and m.end() - at >= 16) or (kind == 3 and checksum_holds(m[1], m[2])):
            out.append((at, kind, m.end()))
    return out


def hex_runs(data: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """By document, byte spans of maximal runs of 32 or more hexadecimal digits."""
    seen = _HEX[data[::8]]
    if len(seen) < 4:
        return {}
    spots = np.flatnonzero(seen[:-3] & seen[1:-2] & seen[2:-1] & seen[3:]) * 8
    out: dict[int, list[tuple[int, int]]] = {}
    docs = np.searchsorted(offs, spots, "right") - 1
    done = -1
    for p, d in zip(spots.tolist(), docs.tolist()):
        if p < done:
            continue
        lo, hi = int(offs[d]), int(offs[d + 1])
        s = p
        while s > lo and _HEX[data[s - 1]]:
            s -= 1
        e = p + len(_HEX_RUN.match(data[p:hi].tobytes() if hi - p < 256 else _run_bytes(data, p, hi))[0])
        done = e
        if e - s >= 32:
            out.setdefault(d, []).append((s - lo, e - lo))
    return out


def _run_bytes(data: np.ndarray, p: int, hi: int) -> bytes:
    n = 256
    while p + n < hi and _HEX[data[p : p + n]].all():
        n *= 2
    return data[p : min(p + n, hi)].tobytes()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None, mark: str | None = None) -> DataFrame:
    """doc_id and `spans` array<struct<kind,start,end>> ordered by start, then kind.

    With `keep`, the text and those columns too; with `mark`, the text has it in place of each span.
    """
    small_batches(docs.sparkSession)
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c) for c in keep or ())]
    source = docs.select(*columns)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in batches:
            for part in pieces(batch, "text"):
                column = part.column(1)
                data, offs = buffers(column)
                runs = hex_runs(data, offs)
                rows, texts = [], column.to_pylist()
                for i, text in enumerate(texts):
                    text = text or ""
                    spans = keyword_spans(text, auto)
                    for s, e in runs.get(i, ()):
                        at = s if text.isascii() else len(data[offs[i] : offs[i] + s].tobytes().decode())
                        spans.append((at, 2, at + e - s))
                    spans.sort()
                    if spans and mark is not None:
                        texts[i] = redacted(text, spans, mark)
                    rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
                arrays = [part.column(0), *([] if keep is None else [column if mark is None else pa.array(texts, pa.string())]), *(part.column(2 + j) for j in range(len(keep or ()))), pa.array(rows, pa.list_(item))]
                yield pa.RecordBatch.from_arrays(arrays, names)
        give_back()

    names = ["doc_id", *([] if keep is None else ["text"]), *(keep or ()), "spans"]
    fields = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"`{n}` {fields[n]}" for n in names[:-1]) + ", spans array<struct<kind:string,start:long,end:long>>"
    return source.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each (start, kind, end) replaced by the mark; overlapping spans count as one."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans (kind:start:end, comma-joined) of find_secrets()'s rows."""
    label = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.transform(F.filter("spans", lambda x: x["kind"].isin(*BASE)), label)
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )
