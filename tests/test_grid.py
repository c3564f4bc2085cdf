import datetime as dt

from pyspark.sql import functions as F

from haatgrid.operators.grid import distinct_readings, grid_series, rolling_totals
from haatgrid.util import day_number, key_of_day


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_gaps_are_filled_or_marked(spark):
    r = spark.createDataFrame([("a", 10, 1.0), ("a", 12, 3.0), ("a", 18, 9.0), ("b", 5, 7.0)], "k string, day int, value double")
    got = rows(grid_series(r, ["k"], "day", "value"), "k", "day")
    assert [(x[1], x[3]) for x in got if x[0] == "a"] == [(10, "reading"), (11, "interpolated"), (12, "reading"), (13, "carried"), (14, "carried"), (15, "carried"), (16, "missing"), (17, "missing"), (18, "reading")]
    assert got[1][2] == 2.0 and got[6][2] is None and got[3][2] == 3.0
    assert got[-1] == ("b", 5, 7.0, "reading", 0)


def test_grid_extends_to_boundaries(spark):
    r = spark.createDataFrame([("a", 3, 1.0), (None, 4, 2.0)], "k string, day int, value double")
    got = rows(grid_series(r, ["k"], "day", "value", start=2, end=5), "k", "day")
    assert [(x[0], x[1], x[3]) for x in got] == [(None, 2, "before_first"), (None, 3, "before_first"), (None, 4, "reading"), (None, 5, "after_last"), ("a", 2, "before_first"), ("a", 3, "reading"), ("a", 4, "after_last"), ("a", 5, "after_last")]


def test_empty_and_null_values(spark):
    e = spark.createDataFrame([], "k string, day int, value double")
    assert grid_series(e, ["k"], "day", "value").count() == 0
    n = spark.createDataFrame([("a", 1, None), ("a", 3, 2.0)], "k string, day int, value double")
    assert [x[2] for x in rows(grid_series(n, ["k"], "day", "value"), "day")] == [None, None, 2.0]


def test_repeated_rows_count_once(spark):
    f = spark.createDataFrame([("a", 20240101, 5, "x"), ("a", 20240101, 5, "x"), ("a", 20240101, 5, "y"), ("a", 20240230, 9, "x"), ("a", None, 9, "x"), ("a", 20240102, None, "x")], "k string, day int, value int, rest string")
    got = rows(distinct_readings(f.withColumn("value_2", F.lit(1)), ["k"], day_number(F.col("day")), "value"), "day")
    assert got == [("a", (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days, 10, 2)]


def test_rolling_totals_against_brute_force(spark):
    data = {("a", d): v for d, v in [(1, 10), (2, 20), (9, 5), (40, 7)]}
    daily = spark.createDataFrame([(k, d, v, 1) for (k, d), v in data.items()], "k string, day int, total long, n int")
    got = {x["day"]: x for x in rolling_totals(daily, ["k"], "day", "total", "n").collect()}
    assert sorted(got) == list(range(1, 41))
    for d, x in got.items():
        for w in (7, 30):
            inside = [v for (_, e), v in data.items() if d - w < e <= d]
            assert x[f"total_{w}"] == sum(inside) and x[f"n_{w}"] == len(inside)
            assert x[f"avg_{w}"] == (sum(inside) / len(inside) if inside else None)


def test_key_of_day(spark):
    assert spark.range(1).select(key_of_day(F.lit(19723)).alias("k")).first()["k"] == 20240101
