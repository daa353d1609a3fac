"""Session plumbing of the operators: shared storage, table reading, hashing of ids."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill import reachable


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the setting is absent, a local session (a test) gets a folder of this
    machine, made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch: of long documents, more would be large.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session asks for smaller ones yet; workers find this package.

    Both stay set for the session: frames are lazy, so their batches are cut when the caller reads them.
    """
    reachable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


#: What the names of all intermediate tables begin with.
PREFIX = "leafmill-"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{PREFIX}{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Shuffle files are deleted when the query that wrote them is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """written(), but the shuffle files of the job go with it; with a path, rows are added to those there."""
    spark, path = df.sparkSession, path or fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow frame (ids and the like) that may be broadcast, once they are counted; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def narrow(df: DataFrame) -> DataFrame:
    """A narrow frame that is already written: with a broadcast hint if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def forget(df: DataFrame) -> None:
    """Delete the files behind a frame that came from written()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession, hours: float = 48) -> int:
    """Delete intermediate tables that are older than any job still reading them; returns how many.

    A result reads its last intermediate tables when it is consumed, so an operator can't
    delete those itself: run this between jobs, with more hours than the longest takes.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in files.listStatus(top) if f.getPath().getName().startswith(PREFIX) and f.getModificationTime() <= (time.time() - hours * 3600) * 1000]
    for path in old:
        files.delete(path, True)
    return len(old)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))
