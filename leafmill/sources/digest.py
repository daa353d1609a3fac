"""Which files are new, by their bytes: a link to or a copy of a registered file isn't.

Lengths are compared first, which needs a listing only; bytes are read, and hashed, of
those files alone that have a length in common with one on the other side.  Equal contents
meet as one row of (length, digest), so thousands of copies are no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import reachable
from leafmill.sources.reader import _system

BLOCK_BYTES = 1 << 20


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of the files of a folder tree; none is opened.  Spark lists no empty files: there is no book in one."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def digests(files: DataFrame) -> DataFrame:
    """(path, length) with the SHA-256 of each file, read in blocks; null for one that can't be read."""
    reachable(files.sparkSession)

    def one(path: str) -> str | None:
        try:
            system, at = _system(path)
            found = hashlib.sha256()
            with system.open_input_stream(at) as file:
                while block := file.read(BLOCK_BYTES):
                    found.update(block)
            return found.hexdigest()
        except (OSError, ValueError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(p) for p in b.column(0).to_pylist()], pa.string())], ["path", "length", "digest"])

    return files.select("path", "length").mapInArrow(run, "path string, length long, digest string")


def _new(found: DataFrame, held: DataFrame, digest) -> DataFrame:
    lengths = lambda rows: rows.select("length").distinct()
    mine, other = (digest(a.join(lengths(b), "length", "left_semi")) for a, b in ((found, held), (held, found)))
    known = mine.join(other.select("length", "digest").where("digest is not null").distinct(), ["length", "digest"], "left_semi").select("path")
    return found.join(known, "path", "left_anti").join(held.select("path"), "path", "left_anti").select("path")


def new_files(found: DataFrame, held: DataFrame) -> DataFrame:
    """Paths of the found files (path, length) that are no registered file's path and equal none's bytes."""
    return _new(found, held, digests)


def new_contents(found: DataFrame, held: DataFrame, content: Column) -> DataFrame:
    """new_files() for rows with a path and the bytes themselves; null counts as empty."""
    raw = F.coalesce(content, F.lit("").cast("binary"))
    sized = lambda rows: rows.select("path", F.octet_length(raw).cast("long").alias("length"), raw.alias("_raw"))
    return _new(sized(found), sized(held), lambda rows: rows.select("path", "length", F.sha2("_raw", 256).alias("digest")))
