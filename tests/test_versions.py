"""The versioned table: against a dictionary, dying writers, repeated batches, conflicts."""

import random

import pytest

from leafmill.sources import versions
from leafmill.sources.versions import Conflict, VersionedTable

SCHEMA = "book_id string, idx int, text string"
CHANGE = SCHEMA + ", at int, gone boolean"


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGE)


def held(table, version=None):
    return {(r["book_id"], r["idx"]): r["text"] for r in table.read(version).collect()}


def test_equals_a_dictionary(spark, tmp_path):
    table, want, rng = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["book_id", "idx"], buckets=5), {}, random.Random(4)
    assert held(table) == {} and table.versions() == []
    past = {}
    for v in range(1, 5):
        rows = [(rng.choice(["a", "b", None]), rng.randint(0, 9), f"{v}-{i}", i, rng.random() < 0.3) for i in range(25)]
        for b, i, text, _, gone in rows:
            want.pop((b, i), None) if gone else want.__setitem__((b, i), text)
        rng.shuffle(rows)
        assert table.merge(changes(spark, rows), ["at"], "gone") == v
        assert held(table) == want
        past[v] = dict(want)
    assert all(held(table, v) == past[v] for v in past)
    before = table.state()["folders"]
    table.merge(changes(spark, [("z", 1, "one row", 0, False)]))
    after = table.state()["folders"]
    assert sum(before.get(b) != f for b, f in after.items()) == 1  # only the touched bucket is written
    assert table.vacuum(keep=1) > 0 and held(table) == {**want, ("z", 1): "one row"} and table.versions() == [5]


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["book_id", "idx"], buckets=3)
    table.merge(changes(spark, [("a", 1, "old", 0, False)]), source="s", epoch=0)

    def die(self, state):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions.VersionedTable, "_publish", die)
    with pytest.raises(KeyboardInterrupt):
        table.merge(changes(spark, [("a", 1, "new", 0, False)]), source="s", epoch=1)
    monkeypatch.undo()
    again = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["book_id", "idx"])
    assert held(again) == {("a", 1): "old"} and again.versions() == [1]
    assert again.merge(changes(spark, [("a", 1, "new", 0, False)]), source="s", epoch=1) == 2
    assert again.merge(changes(spark, [("a", 1, "newer", 0, False)]), source="s", epoch=1) == 2  # known: nothing is done
    assert held(again) == {("a", 1): "new"}


def test_of_two_writers_one_is_told(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["book_id", "idx"]) for _ in range(2))
    start = one.state()
    one.merge(changes(spark, [("a", 1, "first", 0, False)]))
    monkeypatch.setattr(two, "state", lambda version=None: start)
    with pytest.raises(Conflict):
        two.merge(changes(spark, [("a", 1, "second", 0, False)]))
    assert held(one) == {("a", 1): "first"}


def test_a_stream_of_edits(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", SCHEMA, ["book_id", "idx"], buckets=3)
    put = lambda rows: changes(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: table.follow(spark.readStream.schema(CHANGE).parquet(f"{tmp_path}/in"), f"{tmp_path}/check", "edits", ["at"], "gone").awaitTermination()
    put([("a", 1, "x", 1, False), ("a", 2, "y", 1, False)])
    run()
    put([("a", 1, "z", 2, False), ("a", 2, None, 2, True)])
    run()
    assert held(table) == {("a", 1): "z"} and table.state()["applied"] == {"edits": 1}
    run()
    assert len(table.versions()) == 2
