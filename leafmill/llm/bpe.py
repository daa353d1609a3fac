"""Byte-level BPE encoding and decoding with forced boundaries.

A merge result is always a vocabulary token, so two bytes that stand side by
side in no token can never end up in one token: between them a cut is certain.
The text is cut at those pairs, each fragment is encoded on its own, and the ids
are concatenated.  Fragments repeat, so an encoded fragment is remembered.

Three guards keep the pre-tokeniser's view of the text unchanged: a cut needs an
ASCII byte other than white space on its left (white space looks ahead), a cut
before an apostrophe needs a letter or digit on its left, and an apostrophe is
never cut from a following contraction letter.  Special tokens in a text are
single fragments, as the library treats them.

Defined results: null text counts as empty and gives no ids and an empty decoded
text; repeated rows and equal ids give equal rows; extra columns are ignored or
kept as asked; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import small_batches
from leafmill.llm.textkit import binary_array, buffers, give_back, pieces

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fragments remembered within a task, and the longest one remembered.
CACHE_ENTRIES, CACHE_BYTES = 200_000, 48


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder over one byte-level vocabulary file."""

    #: Fragments that are one pre-token for certain: an optional space, then Latin letters, digits or other ASCII marks.
    _one = re.compile("[ ]?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.model = self.tokenizer.model
        self.characters = {b: c for c, b in to_byte.items() if ord(c) != b}
        self.space = self.characters[32]
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        inside = np.zeros((256, 256), bool)
        for t in tokens.values():
            b = np.frombuffer(t, np.uint8)
            inside[b[:-1], b[1:]] = True
        tokens |= {i: t for t, i in self.specials.items()}
        self.cut = ~inside & self._guards()
        size = max(tokens) + 1
        flat = [tokens.get(i, b"") for i in range(size)]
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.length = np.fromiter(map(len, flat), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.known: dict[bytes, bytes] = {}
        self.special_re = re.compile(b"|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new fragments; the short ones are remembered, the others returned.

        A fragment that is one pre-token goes to the library's model, another through
        the library's whole pipeline.
        """
        once: dict[bytes, bytes] = {}
        other = []
        for p in missing:
            text = p.decode()
            if not self._one.fullmatch(text):
                other.append(p)
                continue
            text = text.replace(" ", self.space) if text.isascii() else p.decode("latin-1").translate(self.characters)
            (self.known if len(p) <= CACHE_BYTES else once)[p] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        for lo in range(0, len(other), 4096):
            some = other[lo : lo + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)):
                (self.known if len(p) <= CACHE_BYTES else once)[p] = array("I", e.ids).tobytes()
        return once

    @staticmethod
    def _guards() -> np.ndarray:
        ok = np.zeros((256, 256), bool)
        left = [b for b in range(128) if b not in (*range(9, 14), *range(28, 33))]
        ok[left] = True
        ok[:, 0x80:0xC0] = False
        quote = ord("'")
        alnum = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
        ok[~alnum, quote] = False
        ok[quote, [ord(c) for c in "stmrvld"]] = False
        return ok

    def bounds(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Sorted byte positions of all cuts, document ends and special tokens included."""
        mark = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            mark[1:-1] = self.cut[data[:-1], data[1:]]
        mark[offs] = True
        if self.special_re is not None:
            raw = data.tobytes()
            if any(s in raw for s in self.specials):
                for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                    for m in self.special_re.finditer(raw, lo, hi):
                        mark[m.start() + 1 : m.end()] = False
                        mark[[m.start(), m.end()]] = True
        return np.flatnonzero(mark)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each document as little-endian unsigned 32-bit integers."""
        raw = data.tobytes()
        cuts = self.bounds(data, offs)
        edge = cuts.tolist()
        parts = [raw[i:j] for i, j in zip(edge, edge[1:])]
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        extra = self._learn(list({p for p in parts if p not in known}))
        if extra:
            got = [known[p] if p in known else extra[p] for p in parts]
        else:
            got = [known[p] for p in parts]
        at = np.searchsorted(cuts, offs).tolist()
        return [b"".join(got[i:j]) for i, j in zip(at, at[1:])]

    def decode(self, ids: bytes) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        k = np.frombuffer(ids, "<u4").astype(np.int64)
        k = k[k < len(self.length)]
        n = self.length[k]
        end = np.cumsum(n)
        at = np.repeat(self.start[k] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
        return self.flat[at].tobytes().decode("utf-8", "replace")


_loaded: dict[str, ForcedBoundaryBPE] = {}


def loaded(path: str) -> ForcedBoundaryBPE:
    """The codec of a file, read once in a worker."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `ids` (binary, little-endian unsigned 32-bit), `decoded` (string).

    A pure map over the input's partitions: no shuffle, nothing kept between
    documents but the remembered fragments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = codec.encode(*buffers(part.column(1)))
                decoded = pa.array([codec.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), binary_array(ids), decoded], ["doc_id", "ids", "decoded"])
        codec.known.clear()
        give_back()

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_decode()'s rows."""
    return encoded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
