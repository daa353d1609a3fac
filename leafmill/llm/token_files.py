"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters.

Documents are range-partitioned and sorted by id, so file numbers ascend with the
ids and the row-index statistics of stripes are disjoint: a lookup by id skips
files, stripes and row groups by metadata, then by the Bloom filter on doc_id.
Stripes are independent, so a scan is split at them.

Words are encoded by the tokenizers library and remembered: white space separates
pre-tokens of this vocabulary, so equal words have equal ids wherever they stand.

Defined results: null text counts as empty and gives the end id only; a null id
sorts first; equal ids are ordered by text; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.bpe import byte_alphabet
from leafmill.llm.common import small_batches, written
from leafmill.llm.textkit import pieces, split_texts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words and pre-tokens that a worker remembers, and the longest remembered one.
CACHE_WORDS, CACHE_PRETOKENS, CACHE_CHARS = 200_000, 800_000, 40
STRIPE_BYTES = 16 << 20
#: File offsets are broadcast up to this many (16 bytes each), else joined by shuffle.
BROADCAST_FILES = 200_000


class WordEncoder:
    """Encodes whole texts by the tokenizers library, a pre-token at a time with memory.

    Texts of ASCII and Latin letters, without apostrophes (they may start a
    contraction), are cut into pre-tokens here: letter runs, single digits, runs of
    other marks.  Each new one goes to the library's model.  Other texts are cut at
    white space, and each new word goes through the library's whole pipeline.
    """

    _letters = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f"
    _pieces = re.compile(f"[{_letters}]+|[0-9]|[\x00-\x08\x0e-\x1f\x21-\x2f\x3a-\x60\x7b-\x7f]+")
    # letters whose lower case is no letter of these (as of U+018F) count as others
    _latin = "".join(c for c in map(chr, range(0xC0, 0x250)) if c not in "\u00d7\u00f7\u0130" and re.fullmatch("[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]", c.lower()))
    _other = re.compile(f"[^\x00-\x26\x28-\x7f{_latin}]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.characters = {b: c for c, b in byte_alphabet().items() if ord(c) != b}
        self.words: dict[bytes, bytes] = {}
        self.pretokens: dict[str, bytes] = {}

    def _whole(self, some: list[bytes]) -> list[bytes]:
        texts = [x.decode() for x in some]
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pretoken(self, text: str) -> bytes:
        if not text.isascii() or not text.isprintable():
            text = text.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text, without added tokens."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.pretokens) > CACHE_PRETOKENS:
            self.pretokens.clear()
        known, out = self.pretokens, []
        for raw in texts:
            text = raw.decode()
            if "<|" in text:  # the mark of special tokens
                out.append(self._whole([raw])[0])
                continue
            if self._other.search(text):
                out.append(self._by_word(raw))
                continue
            pieces = self._pieces.findall(text.lower())
            got = list(map(known.get, pieces))
            if None in got:
                for i, g in enumerate(got):
                    if g is None:
                        p = pieces[i]
                        got[i] = known.get(p) or self._pretoken(p)
                        if len(p) <= CACHE_CHARS:
                            known[p] = got[i]
            out.append(b"".join(got))
        return out

    def _by_word(self, raw: bytes) -> bytes:
        words = raw.split()
        fresh = list({w for w in words if w not in self.words})
        once = {}
        for lo in range(0, len(fresh), 4096):
            part = fresh[lo : lo + 4096]
            for w, ids in zip(part, self._whole(part)):
                (self.words if len(w) <= CACHE_CHARS else once)[w] = ids
        return b"".join([self.words[w] if w in self.words else once[w] for w in words])


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def write_ids(docs: DataFrame, out: str, vocab: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (doc_id, ids, n_tokens, start_in_file) in ascending id order to the ORC folder `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, before = encoder(vocab), 0
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = [x + last for x in codec.encode(split_texts(part.column(1)))]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offs = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(n, out=offs[1:])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                arrays = pa.ListArray.from_arrays(pa.array(offs), values)
                yield pa.RecordBatch.from_arrays([part.column(0), arrays, pa.array(n), pa.array(before + offs[:-1].astype(np.int64))], ["doc_id", "ids", "n_tokens", "start_in_file"])
                before += int(n.sum())

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, start_in_file long")
    rows.write.option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id").option("orc.stripe.size", str(STRIPE_BYTES)).orc(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of a folder from write_ids()."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    files = spark.read.orc(path).withColumn("file_no", number)
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))  # a row per file
    ahead = F.sum("total").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    base = written(totals.select("file_no", F.coalesce(ahead, F.lit(0)).alias("base")), "token-bases")
    if base.count() <= BROADCAST_FILES:
        base = F.broadcast(base)
    return files.join(base, "file_no").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some ids; the filter prunes stripes and row groups by statistics and Bloom filters.

    Ids that the files lack, and null, give no row; an id of several documents gives each.
    """
    small_batches(spark)
    return spark.read.orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids", "n_tokens")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (over little-endian unsigned 32-bit ids) of read_ids()'s rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            offs = ids.offsets.to_numpy()
            raw = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
