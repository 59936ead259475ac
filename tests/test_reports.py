"""Literal frames for comparisons, gates, resampling and the stream."""

import math

import pytest

from rankloom.operators import behavior, compare, gates, metrics
from rankloom.streaming import counters


def test_diff_and_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id long, v string")
    b = spark.createDataFrame([(4, "n"), (3, "Z"), (2, None)], "id long, v string")
    assert {(r.id, r.change) for r in compare.table_diff(a, b, "id").collect()} == {(1, "deleted"), (3, "modified"), (4, "added")}
    one, other = (compare.fingerprint(x, ["id", "v"]).first() for x in (a, a.orderBy("v").repartition(3)))
    assert one == other and compare.fingerprint(b, ["id", "v"]).first() != one
    assert compare.fingerprint(a.limit(0), ["id", "v"]).first().n == 0


@pytest.mark.parametrize(("value", "hold", "status"), [(1.0, True, "LAUNCH"), (0.1, True, "HOLD"), (0.1, False, "ITERATE"), (math.nan, True, "HOLD"), (None, True, "HOLD")])
def test_status(spark, value, hold, status):
    found = spark.createDataFrame([("m", value), ("unasked", 0.0)], "metric string, value double")
    spec = spark.createDataFrame([("g", "m", ">=", 0.5, hold)], "gate string, metric string, op string, threshold double, hold boolean")
    assert [r.status for r in gates.release(found, spec).collect()] == [status]


def test_poisson_steps_and_bounds(spark):
    steps = metrics.poisson_steps()
    assert steps == sorted(steps) and steps[0] == math.floor(math.exp(-1) * 2**32)
    rows = spark.range(300).selectExpr("id", "cast(id % 2 as double) as v")
    got = metrics.bootstrap_mean(rows, "v", "id", 200).first()
    assert got.mean == 0.5 and 0.4 < got.low < 0.5 < got.high < 0.6


def test_third_click(spark):
    log = spark.createDataFrame([(i, 1 + i % 2, 0, int(i not in (0, 4))) for i in range(9)], "event_seq long, product_id long, time_block int, clicked int")
    assert {(r.product_id, r.event_seq) for r in behavior.warmed_up(log).collect()} == {(1, 8), (2, 5)}


def test_stream_over_several_files(spark, tmp_path):
    rows = spark.sql("select timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,cast(id as int)) as ts, if(id % 2 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(48)")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    got = counters.daily_counters(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out")
    assert sorted((str(r.day), r.event_type, r.n, r.total) for r in got.collect()) == [
        ("2024-01-01", "a", 12, 132.0), ("2024-01-01", "b", 12, 144.0), ("2024-01-02", "a", 12, 420.0), ("2024-01-02", "b", 12, 432.0)]
