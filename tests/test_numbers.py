"""Rounding by the exact value, as the language's own round() does."""

import random
import struct

import duckdb

from leafmill.functions.numbers import tenths
from leafmill.plans.inline import tenths_sql


def test_tenths_equal_exact_rounding(spark):
    rng = random.Random(8)
    values = [k / 20 for k in range(-4000, 4001)] + [k / 4 for k in range(-2000, 2001)] + [k / 20 + d for k in range(2000) for d in (1e-12, -1e-12)]
    values += [rng.uniform(-1000, 1000) for _ in range(60_000)] + [round(rng.uniform(0, 100), 2) for _ in range(30_000)] + [rng.uniform(0, 1e13) for _ in range(8000)]
    values += [struct.unpack("d", struct.pack("q", struct.unpack("q", struct.pack("d", k / 20))[0] + s))[0] for k in range(1, 2000) for s in (-1, 1)]  # the doubles next to a half
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    assert [(x, y) for x, y in df.select("x", tenths("x")).collect() if y != round(x, 1)] == []


def test_tenths_edges(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.04,), (1e300,), (0.0,), (5e-324,)], "x double")
    got = [r[0] for r in df.select(tenths("x")).collect()]
    assert got[0] is None and got[1] != got[1] and got[2:] == [float("inf"), 0.0, 1e300, 0.0, 0.0]


def test_sql_for_tenths():
    values = [k / 20 for k in range(-500, 500)] + [11.25, 10.75, 0.35, 2.675, 1000.25, -0.25, -0.75]
    c = duckdb.connect()
    c.execute("create table v (x double)")
    c.executemany("insert into v values (?)", [[v] for v in values])
    assert [(x, y) for x, y in c.execute(f"select x, {tenths_sql('x')} from v").fetchall() if y != round(x, 1)] == []
