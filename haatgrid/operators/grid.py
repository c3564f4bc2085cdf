"""Irregular readings onto a regular daily grid, and rolling totals over trailing days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_readings(df: DataFrame, keys: list[str], day: Column, value: str) -> DataFrame:
    """Readings of ``df``: rows with a value and a day, whole repeated rows counting once.

    Returns keys, ``day`` (days since 1970-01-01), ``total`` and ``n``: the sum and the number of the
    day's distinct readings. Rows with a null key, day or value are no readings. Repeats are recognised by
    a 64-bit hash of the remaining columns, so a narrow row is shuffled; the first exchange is spread
    over whole rows, so a series that holds a large part of the rows is collapsed before its days meet,
    and only distinct readings reach the exchange by series, which later windows over the series reuse.
    """
    rest = [c for c in df.columns if c not in {*keys, value}]
    slim = df.select(*keys, day.alias("day"), F.col(value).alias("value"), F.xxhash64(*rest).alias("rest") if rest else F.lit(0).alias("rest"))
    for c in (*keys, "day", "value"):
        slim = slim.filter(F.col(c).isNotNull())
    once = slim.groupBy(*keys, "day", "value", "rest").agg(F.lit(1).alias("one"))
    return once.repartition(*keys).groupBy(*keys, "day").agg(F.sum("value").alias("total"), F.sum("one").alias("n"))


def grid_series(readings: DataFrame, keys: list[str], day: str, value: str, fill_days: int = 3, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row per calendar day of each series, from irregular readings.

    ``readings`` has at most one row per key and ``day`` (an integer), with a numeric ``value``.
    Consecutive readings are paired by lead; only the days between them are generated. A gap of at most
    ``fill_days`` missing days is filled by linear interpolation. In a longer gap the first ``fill_days``
    days carry the last reading and the others are marked missing. ``start`` and ``end`` extend
    every series to those days explicitly.

    Returns keys, ``day``, ``value`` (null where missing), ``status`` (reading, interpolated, carried,
    missing, before_first, after_last) and ``gap_days`` (missing days of the gap; 0 for a reading).
    A series with one reading gives one row, an empty input none; null keys form a series of their own;
    a null value is a reading without a value and is given back as such.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    r = readings.select(*keys, F.col(day).cast("int").alias("day"), F.col(value).cast("double").alias("value"))
    w = Window.partitionBy(*keys).orderBy("day")
    paired = r.withColumns({"next_day": F.lead("day").over(w), "next_value": F.lead("value").over(w), "first": F.row_number().over(w) == 1})
    last_day = F.coalesce(F.col("next_day") - 1, F.greatest(F.col("day"), F.lit(end)) if end is not None else F.col("day"))
    first_day = F.when(F.col("first"), F.least(F.col("day"), F.lit(start))).otherwise(F.col("day")) if start is not None else F.col("day")
    spread = paired.withColumn("at", F.explode(F.sequence(first_day, last_day)))
    step = F.col("at") - F.col("day")
    gap = F.col("next_day") - F.col("day") - 1
    status = (
        F.when(step == 0, "reading")
        .when(step < 0, "before_first")
        .when(F.col("next_day").isNull(), "after_last")
        .when(gap <= fill_days, "interpolated")
        .when(step <= fill_days, "carried")
        .otherwise("missing")
    )
    line = F.col("value") + (F.col("next_value") - F.col("value")) * step / (gap + 1)
    at_value = F.when(F.col("status").isin("reading", "carried"), F.col("value")).when(F.col("status") == "interpolated", line)
    return spread.withColumn("status", status).select(
        *keys, F.col("at").alias("day"), at_value.alias("value"), "status", F.when(step == 0, 0).otherwise(F.coalesce(gap, F.abs(step))).cast("int").alias("gap_days")
    )


def rolling_totals(daily: DataFrame, keys: list[str], day: str, total: str, n: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals, counts and averages over the trailing ``windows`` days of each series, one row per calendar
    day from its first to its last reading, days without a reading included.

    ``daily`` has one row per key and ``day`` (an integer) with the day's ``total`` and number ``n`` of
    readings. The days between two readings are generated from the pair (entity times calendar, limited to
    the entity's own span) and carry zero, so each window is a fixed number of preceding rows. The
    average of a period without readings is null. An empty input gives no rows.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    r = daily.select(*keys, F.col(day).cast("int").alias("day"), F.col(total).alias("total"), F.col(n).cast("long").alias("n"))
    paired = r.withColumn("until", F.coalesce(F.lead("day").over(w) - 1, F.col("day")))
    dense = paired.withColumn("at", F.explode(F.sequence("day", "until"))).select(
        *keys, F.col("at").alias("day"), F.when(F.col("at") == F.col("day"), F.col("total")).otherwise(F.lit(0)).alias("total"), F.when(F.col("at") == F.col("day"), F.col("n")).otherwise(F.lit(0)).alias("n")
    )
    out = {}
    for k in windows:
        frame = w.rowsBetween(1 - k, 0)
        out[f"total_{k}"], out[f"n_{k}"] = F.sum("total").over(frame), F.sum("n").over(frame)
    rolled = dense.withColumns(out)
    return rolled.withColumns({f"avg_{k}": F.try_divide(F.col(f"total_{k}").cast("double"), F.col(f"n_{k}")) for k in windows})
