"""The status stream: against the batch operator, orders of arrival, restarts, silence."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leafmill.operators import jobs
from leafmill.plans import inline as t
from leafmill.streaming import status

T0 = dt.datetime(2024, 5, 1)


def event(book, hours, kind, state=None, selected=None, completed=None, seq=None):
    return (book, T0 + dt.timedelta(hours=hours), seq if seq is not None else int(hours * 10), kind, state, selected, completed)


def put(spark, folder, rows):
    spark.createDataFrame(rows, status.EVENT).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, checkpoint, **more):
    events = spark.readStream.schema(status.EVENT).option("maxFilesPerTrigger", more.pop("files", 1000)).parquet(folder)
    status.follow(events, out, checkpoint, **more).awaitTermination()
    return sorted((r.book_id, r.state) for r in status.current(spark, out).collect())


def test_equals_the_batch_operator(spark, tmp_path):
    rows = [event(b[0], 0, "book", "present") for b in t.BOOKS.rows]
    rows += [event(b, 1, "job", s) for b, s in t.JOBS.rows]
    rows += [event(m[0], 2, "manifest", m[3], m[1], m[2]) for m in t.MANIFESTS.rows]
    # older and repeated events, and jobs without books
    rows += [event("b1", 0.5, "job", "failed"), event("b2", 0.1, "manifest", "completed", [0], [0]), event("b1", 1, "job", "running"), event("nobook", 3, "job", "running")]
    random.Random(1).shuffle(rows)
    for k in range(0, len(rows), 5):
        put(spark, f"{tmp_path}/in", rows[k : k + 5])
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", files=2, late="2 days")
    batch = jobs.job_status(t.JOBS.frame(spark), t.MANIFESTS.frame(spark), t.BOOKS.frame(spark))
    assert got == sorted((r.book_id, r.state) for r in batch.collect())
    shown = {r.book_id: (r.total, r.completed, r.progress_percent) for r in status.current(spark, f"{tmp_path}/out").where("state = 'resumable'").collect()}
    want = {r.book_id: (r.total, r.completed, r.progress_percent) for r in jobs.resumable(t.MANIFESTS.frame(spark), t.BOOKS.frame(spark)).collect()}
    assert shown and shown == {b: want[b] for b in shown}


def test_restart_goes_on_and_silence_is_absence(spark, tmp_path):
    folder, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    put(spark, folder, [event("a", 0, "book"), event("b", 0, "book"), event("c", 0, "book"), event("a", 1, "job", "running"), event("b", 1, "job", "running"), event("b", 1, "manifest", "running", [0, 1, 2], [0, 0])])
    assert run(spark, folder, out, check) == [("a", "running"), ("b", "running"), ("c", "lost")]
    # a stays in touch, b falls silent, c is removed; the first events come again
    put(spark, folder, [event("a", 40, "job", "running"), event("c", 41, "book", "removed"), event("d", 50, "book"), event("b", 1, "job", "running")])
    assert run(spark, folder, out, check) == [("a", "running"), ("b", "resumable"), ("d", "lost")]
    before = {r.book_id: r.version for r in spark.read.schema(status.CHANGE).parquet(f"{out}/epoch=*").groupBy("book_id").agg(F.max("version").alias("version")).collect()}
    # nothing new: nothing changes; then b's job speaks again, and an older word of it doesn't count
    assert run(spark, folder, out, check) == [("a", "running"), ("b", "resumable"), ("d", "lost")]
    put(spark, folder, [event("b", 60, "job", "completed"), event("b", 59.9, "job", "running"), event("a", 52, "job", "cancelled")])
    assert run(spark, folder, out, check) == [("a", "cancelled"), ("b", "completed"), ("d", "lost")]
    after = {r.book_id: r.version for r in spark.read.schema(status.CHANGE).parquet(f"{out}/epoch=*").groupBy("book_id").agg(F.max("version").alias("version")).collect()}
    assert after == {**before, "a": before["a"] + 1, "b": before["b"] + 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_order_of_arrival_does_not_matter(spark, tmp_path, seed):
    rng = random.Random(7)
    rows = [event(rng.choice("xyz"), rng.randint(0, 20), k, rng.choice(["running", "failed", "completed"]), [0, 1], [rng.randint(0, 3)], seq=i) for i in range(60) for k in [rng.choice(["book", "job", "manifest"])]]
    newest = {}
    for r in rows:
        newest[r[0], r[3]] = max(newest.get((r[0], r[3]), r), r, key=lambda e: e[1:3])
    want = []
    for b in "xyz":
        if (b, "book") in newest:
            job, manifest = (newest.get((b, k), (None,) * 7)[4] for k in ("job", "manifest"))
            want.append((b, "resumable" if job in (None, "failed") and manifest in ("running", "failed") else job or "lost"))
    random.Random(seed).shuffle(rows)
    for k in range(0, 60, 20):
        put(spark, f"{tmp_path}/in", rows[k : k + 20])
    assert run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check", files=1, late="2 days", silence="9 days") == want
