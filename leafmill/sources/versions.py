"""A keyed table that changes by whole versions: upserts and deletes that readers see at once or not at all.

The table is cut into buckets by a hash of its key.  A version is a small file that names
the folder of each bucket; a merge writes new folders for the buckets that it touches only,
then the version file under a temporary name, and renames that last.  Until then readers see
the version before; a writer that dies leaves folders that no version names.  The rename
fails if the version exists, so of two writers one is told to try again.

A merge that carries (source, epoch), as a stream's batches do, is remembered in the version:
the same or an earlier epoch of a source does nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Conflict(RuntimeError):
    """Another writer made this version first."""


class VersionedTable:
    """Rows of `schema` by `keys`; `buckets` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self) -> object:
        return self._path().getFileSystem(self.conf)

    def versions(self) -> list[int]:
        top = self._path("versions")
        if not self._files().exists(top):
            return []
        names = [f.getPath().getName() for f in self._files().listStatus(top)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def state(self, version: int | None = None) -> dict:
        """The newest version (or a given one): its number, folder of each bucket and the epochs it holds."""
        found = self.versions()
        if not found:
            return {"version": 0, "buckets": self.buckets, "folders": {}, "applied": {}}
        stream = self._files().open(self._path("versions", f"{version or found[-1]:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(sorted(self.state(version)["folders"].values()))

    def _publish(self, state: dict) -> None:
        """The version file, whole or not at all, and only if it is new."""
        files, name = self._files(), f"{state['version']:010d}.json"
        draft = self._path("versions", f"_{uuid.uuid4().hex}")
        out = files.create(draft)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, self._path("versions", name), options)
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {state['version']} of {self.path} exists") from e
            raise

    def merge(self, changes: DataFrame, order: list[str] | None = None, deleted: str | None = None, source: str | None = None, epoch: int = 0) -> int:
        """Upsert the rows, the last by `order` of each key; those whose `deleted` column is true go.  Returns the version."""
        state = self.state()
        if source is not None and state["applied"].get(source, -1) >= epoch:
            return state["version"]
        columns = [f.name for f in self._rows([]).schema]
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        place = F.struct(*(order or self.keys))
        last = changes.groupBy(*self.keys).agg(F.max_by(F.struct(*(c for c in columns if c not in self.keys), gone.alias("_gone")), place).alias("_row"))
        last = last.withColumn("_bucket", F.pmod(F.hash(*self.keys), F.lit(state["buckets"]))).persist()
        try:
            touched = [r[0] for r in last.select("_bucket").distinct().collect()]  # at most `buckets` numbers
            held = self._rows([f for b, f in state["folders"].items() if int(b) in touched])
            same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(self.keys)]
            kept = held.join(last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys))), same, "left_anti").withColumn("_bucket", F.pmod(F.hash(*self.keys), F.lit(state["buckets"])))
            fresh = last.where("not _row._gone").select(*(c if c in self.keys else F.col("_row")[c].alias(c) for c in columns), "_bucket")
            folder = f"data/{uuid.uuid4().hex}"
            kept.unionByName(fresh).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        finally:
            last.unpersist()
        files = self._files()
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched}
        folders |= {str(b): f"{folder}/_bucket={b}" for b in touched if files.exists(self._path(folder, f"_bucket={b}"))}
        applied = {**state["applied"], **({source: epoch} if source is not None else {})}
        self._publish({"version": state["version"] + 1, "buckets": state["buckets"], "folders": folders, "applied": applied})
        return state["version"] + 1

    def follow(self, changes: DataFrame, checkpoint: str, source: str, order: list[str] | None = None, deleted: str | None = None) -> StreamingQuery:
        """Merge a stream's batches as they come; a batch that is run again changes nothing."""
        merge = lambda batch, epoch: self.merge(batch, order, deleted, source, epoch)
        return changes.writeStream.foreachBatch(lambda batch, epoch: merge(batch, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def vacuum(self, keep: int = 10) -> int:
        """Delete all but the last `keep` versions and the folders that only they name; returns the folders deleted.  Not beside a running merge."""
        files, found = self._files(), self.versions()
        used = {f.split("/")[1] for v in found[-keep:] for f in self.state(v)["folders"].values()}
        for v in found[:-keep]:
            files.delete(self._path("versions", f"{v:010d}.json"), False)
        top = self._path("data")
        old = [f.getPath() for f in files.listStatus(top) if f.getPath().getName() not in used] if files.exists(top) else []
        for path in old:
            files.delete(path, True)
        return len(old)
