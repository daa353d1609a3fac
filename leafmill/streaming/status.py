"""Job status as a stream with state: events of books, jobs and manifests in, changes of the shown status out.

Each book keeps the newest event of each kind, by (at, seq).  An event that isn't newer
than the one held, a repeat or one that comes late, changes nothing, so the outcome doesn't
depend on the order of arrival; events older than the watermark are dropped by Spark.  A
running job that isn't heard of for `silence` of event time counts as absent, as after a
crash: a timer sees to that.

The status follows the same rule as the batch operator: resumable, with its progress, where
the job is absent, failed or cancelled and a manifest can go on; else the job's own state;
else lost.  A removed book's status is null.

Changes are numbered per book, and each batch is written to a folder of its number, which a
batch that is run again replaces.  With the checkpoint, a stopped query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from leafmill import reachable
from leafmill.operators.jobs import RESUMABLE

#: kind: book (state removed: it is gone), job, or manifest (a null state: it is gone).
EVENT = "book_id string, at timestamp, seq long, kind string, state string, selected array<int>, completed array<int>"
CHANGE = "book_id string, version long, state string, total int, completed int, progress_percent double"
_BOOK, _JOB, _MANIFEST = "at long, seq long, present boolean", "at long, seq long, state string", "at long, seq long, state string, total int, completed int"


class _Status(StatefulProcessor):
    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = {kind: handle.getValueState(kind, schema) for kind, schema in (("book", _BOOK), ("job", _JOB), ("manifest", _MANIFEST))}
        self.shown = handle.getValueState("shown", "version long, state string, total int, completed int")

    def _get(self, kind: str) -> tuple:
        return tuple(self.held[kind].get()) if self.held[kind].exists() else ()

    def _status(self) -> tuple:
        book, job, manifest = (self._get(k) for k in ("book", "job", "manifest"))
        if not book or not book[2]:
            return None, None, None
        state = job[2] if job else None
        if state in (None, "failed", "cancelled") and manifest and manifest[2] in RESUMABLE:
            return "resumable", manifest[3], manifest[4]
        return state or "lost", None, None

    def _changes(self, key: tuple) -> Iterator[Row]:
        now = self._status()
        version, *before = tuple(self.shown.get()) if self.shown.exists() else (0, None, None, None)
        if tuple(before) != now:
            self.shown.update((version + 1, *now))
            state, total, done = now
            percent = None if total is None else round(done / total * 100, 1) if total else 0.0
            yield Row(book_id=key[0], version=version + 1, state=state, total=total, completed=done, progress_percent=percent)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        for r in rows:
            if r.kind in self.held and r.at_ms is not None and r.seq is not None:
                newest[r.kind] = max(newest.get(r.kind, ()), (r.at_ms, r.seq, r), key=lambda x: x[:2])
        for kind, (at, seq, r) in newest.items():
            old = self._get(kind)
            if old and (at, seq) <= old[:2]:
                continue
            if kind == "book":
                self.held[kind].update((at, seq, r.state != "removed"))
            elif kind == "manifest":
                self.held[kind].update((at, seq, r.state, len(r.selected or ()), len(set(r.completed or ()))))
            else:
                if old and old[2] == "running":
                    self.handle.deleteTimer(old[0] + self.silence_ms)
                self.held[kind].update((at, seq, r.state))
                if r.state == "running":
                    self.handle.registerTimer(at + self.silence_ms)
        yield from self._changes(key)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        job = self._get("job")
        if job and job[2] == "running" and job[0] + self.silence_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.held["job"].update((job[0], job[1], None))  # the place in time stays, so older events stay old
        yield from self._changes(key)

    def close(self) -> None:
        pass


def changes(events: DataFrame, silence: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The stream of status changes of a stream of events (EVENT); needs RocksDB as the state store."""
    spark = events.sparkSession
    reachable(spark)
    silence_ms = int(spark.sql(f"SELECT CAST(CAST(INTERVAL {silence} AS INTERVAL SECOND) AS DECIMAL(20,3)) * 1000").head()[0])
    timed = events.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("book_id").transformWithState(_Status(silence_ms), CHANGE, "Update", "EventTime")


def follow(events: DataFrame, out: str, checkpoint: str, silence: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Process what has arrived and write the changes; run again for what arrives later."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return changes(events, silence, late).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The status of each book now: its newest change; removed books have none."""
    last = spark.read.schema(CHANGE).parquet(f"{out}/epoch=*").groupBy("book_id").agg(F.max_by(F.struct("state", "total", "completed", "progress_percent"), "version").alias("s"))
    return last.select("book_id", "s.*").where("state is not null")
