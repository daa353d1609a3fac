"""Files that are new by their bytes."""

import os

from leafmill.sources import digest


def test_links_and_copies_are_known(spark, tmp_path, monkeypatch):
    found, held = tmp_path / "found", tmp_path / "held"
    found.mkdir()
    held.mkdir()
    (held / "a.txt").write_bytes(b"x" * 3_000_000)
    (held / "b.txt").write_bytes(b"same length 1")
    (held / "empty").write_bytes(b"")
    os.link(held / "a.txt", found / "hard-link.txt")
    os.symlink(held / "a.txt", found / "soft-link.txt")
    (found / "copy.txt").write_bytes(b"same length 1")
    (found / "other.txt").write_bytes(b"same length 2")
    (found / "long.txt").write_bytes(b"y" * 77)
    (found / "nothing").write_bytes(b"")
    names = lambda df: sorted(os.path.basename(r["path"]) for r in df.collect())
    mine, theirs = digest.listed(spark, str(found)), digest.listed(spark, str(held))
    assert names(digest.new_files(mine, theirs)) == ["long.txt", "other.txt"]
    assert names(digest.new_files(mine, mine)) == []
    assert len(names(digest.new_files(mine, theirs.limit(0)))) == 5
    gone = spark.createDataFrame([("file:/nowhere/z", 13)], "path string, length long")
    assert names(digest.new_files(gone, theirs)) == ["z"]  # what can't be read equals nothing


def test_only_equal_lengths_are_read(spark):
    files = spark.createDataFrame([("/nowhere/1", 5), ("/nowhere/2", 6)], "path string, length long")
    other = spark.createDataFrame([("/nowhere/3", 7)], "path string, length long")
    plan = digest.new_files(files, other)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("LeftSemi", plan.index("MapInArrow"))  # lengths are matched below the reading
    assert digest.new_files(files, other).count() == 2
