"""Queries of the general data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import distinct_readings, grid_series, rolling_totals
from ..operators.aliases import resolve_markets
from ..operators.near import near_pairs, on_globe
from ..operators.spikes import implausible
from ..operators.units import anchors, narrow, other_units
from ..util import BROADCAST_LONGS, cut, day_number, key_of_day, small, table

SERIES = ["market_key", "commodity_key"]


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily readings of fact_daily_price in paise, so that totals are exact."""
    days = table(spark, sf_dir, "dim_date").select("date_key").distinct()
    fact = table(spark, sf_dir, "fact_daily_price").join(small(days), "date_key", "left_semi")
    fact = fact.withColumn("modal_price", (F.col("modal_price") * 100).cast("long"))
    return distinct_readings(fact, SERIES, day_number(F.col("date_key")), "modal_price")


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).withColumn("price", F.col("total") / F.col("n") / 100)
    return grid_series(r, SERIES, "day", "price").select(*SERIES, key_of_day(F.col("day")).alias("date_key"), F.round("value", 4).alias("modal_price"), "status", "gap_days")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _readings(spark, sf_dir).withColumn("price", F.col("total") / F.col("n") / 100)
    return grid_series(r, SERIES, "day", "price").filter(F.col("status") == "missing").select(*SERIES, key_of_day(F.col("day")).alias("date_key"))


def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rolling_totals(_readings(spark, sf_dir), SERIES, "day", "total", "n")
    money = lambda c: (F.col(c) / 100).alias(c)
    return x.select(*SERIES, key_of_day(F.col("day")).alias("date_key"), money("total_7"), "n_7", F.round(F.col("avg_7") / 100, 4).alias("avg_7"), money("total_30"), "n_30", F.round(F.col("avg_30") / 100, 4).alias("avg_30"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = rolling_totals(_readings(spark, sf_dir), SERIES, "day", "total", "n")
    return x.filter(F.col("total_7") * 10 < F.col("total_30")).select(*SERIES, key_of_day(F.col("day")).alias("date_key"))


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_pairs(table(spark, sf_dir, "dim_market"), "market_key", "latitude", "longitude", 2.5)
    return near.select(F.col("id_a").alias("market_key_a"), F.col("id_b").alias("market_key_b"), F.round("km", 4).alias("km"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_near(spark, sf_dir).select("market_key_a", "market_key_b").distinct()


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets with the class of those on one spot (the smallest key) and how many others lie at most 2.5 km away."""
    m = table(spark, sf_dir, "dim_market").select("market_key", F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")).filter(on_globe(F.col("lat"), F.col("lon"))).distinct()
    near = near_pairs(m, "market_key", "lat", "lon", 2.5)
    links = near.select(F.explode(F.array("id_a", "id_b")).alias("market_key")).groupBy("market_key").agg(F.count("*").alias("n_links"))
    spots = m.groupBy("lat", "lon").agg(F.min("market_key").alias("spot"))
    return m.join(spots, ["lat", "lon"]).join(links, "market_key", "left").select("market_key", "spot", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of mandi_prices ready for units and spikes. The register names every spelling that occurs."""
    prices = table(spark, sf_dir, "mandi_prices")
    ids = cut(resolve_markets(table(spark, sf_dir, "market_names"), table(spark, sf_dir, "dim_market")))
    return narrow(prices, small(ids, BROADCAST_LONGS), small(cut(anchors(prices))))


def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(_narrow(spark, sf_dir)).withColumns({"price": F.round("price", 4), "level": F.round("level", 4)})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_flags(spark, sf_dir).select("raw_id").distinct()


def p5_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return other_units(_narrow(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("modal_price", "min_price", "max_price")})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_units(spark, sf_dir).select("raw_id", "unit").distinct()


QUERIES = {"p3_found": p3_found, "p3_flags": p3_flags, "p5_found": p5_found, "p5_units": p5_units, "p1_found": p1_found, "p1_grid": p1_grid, "p6_found": p6_found, "p6_rolling": p6_rolling, "p7_found": p7_found, "p7_near": p7_near, "p7_classes": p7_classes}

_READINGS = """r0 as (select distinct f.*, d.calendar_date as day from fact_daily_price f join dim_date d using (date_key) where modal_price is not null),
r as (select market_key, commodity_key, day, cast(sum(cast(modal_price * 100 as bigint)) as bigint) as total, count(*) as n from r0 group by all)"""
_SPAN = """s as (select market_key, commodity_key, min(day) as a, max(day) as b from r group by all),
g as (select market_key, commodity_key, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from s)"""
_KEY = "cast(strftime({}, '%Y%m%d') as integer)"
_NEAR = """with p as (select distinct market_key, latitude as lat, longitude as lon from dim_market where latitude between -90 and 90 and longitude between -180 and 180 and not (latitude = 0 and longitude = 0)),
q as (select a.market_key as market_key_a, b.market_key as market_key_b,
  2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) as km
  from p a join p b on a.market_key < b.market_key and abs(a.lat - b.lat) < 0.03)"""

SQL = {
    "p1_found": f"""with {_READINGS}, n as (select *, lead(day) over (partition by market_key, commodity_key order by day) as nx from r),
x as (select market_key, commodity_key, cast(unnest(generate_series(day + interval 4 day, nx - interval 1 day, interval 1 day)) as date) as day from n where nx - day > 4)
select market_key, commodity_key, {_KEY.format("day")} as date_key from x""",
    "p1_grid": f"""with {_READINGS}, {_SPAN},
j as (select g.*, r.total / r.n / 100.0 as v, r.day as has from g left join r using (market_key, commodity_key, day)),
k as (select *, last_value(has ignore nulls) over b as d0, last_value(v ignore nulls) over b as v0, first_value(has ignore nulls) over f as d1, first_value(v ignore nulls) over f as v1 from j
  window b as (partition by market_key, commodity_key order by day rows between unbounded preceding and current row), f as (partition by market_key, commodity_key order by day rows between current row and unbounded following)),
m as (select *, case when has is not null then 'reading' when d1 - d0 - 1 <= 3 then 'interpolated' when day - d0 <= 3 then 'carried' else 'missing' end as status from k)
select market_key, commodity_key, {_KEY.format("day")} as date_key, round(case status when 'reading' then v when 'carried' then v0 when 'interpolated' then v0 + (v1 - v0) * (day - d0) / (d1 - d0) end, 4) as modal_price, status,
  cast(case when has is not null then 0 else d1 - d0 - 1 end as integer) as gap_days from m""",
    "p6_rolling": f"""with {_READINGS}, {_SPAN},
j as (select g.*, coalesce(total, 0) as t, coalesce(n, 0) as c from g left join r using (market_key, commodity_key, day)),
k as (select *, sum(t) over a as t7, sum(c) over a as c7, sum(t) over b as t30, sum(c) over b as c30 from j
  window a as (partition by market_key, commodity_key order by day rows between 6 preceding and current row), b as (partition by market_key, commodity_key order by day rows between 29 preceding and current row))
select market_key, commodity_key, {_KEY.format("day")} as date_key, t7 / 100.0 as total_7, cast(c7 as bigint) as n_7, round(t7 / nullif(c7, 0) / 100.0, 4) as avg_7,
  t30 / 100.0 as total_30, cast(c30 as bigint) as n_30, round(t30 / nullif(c30, 0) / 100.0, 4) as avg_30 from k""",
    "p6_found": f"""with {_READINGS}, {_SPAN},
j as (select g.*, coalesce(total, 0) as t from g left join r using (market_key, commodity_key, day)),
k as (select *, sum(t) over a as t7, sum(t) over b as t30 from j
  window a as (partition by market_key, commodity_key order by day rows between 6 preceding and current row), b as (partition by market_key, commodity_key order by day rows between 29 preceding and current row))
select market_key, commodity_key, {_KEY.format("day")} as date_key from k where t7 * 10 < t30""",
    "p7_near": f"{_NEAR} select market_key_a, market_key_b, round(km, 4) as km from q where km <= 2.5",
    "p7_classes": f"""{_NEAR}, l as (select market_key, count(*) as n from (select unnest([market_key_a, market_key_b]) as market_key from q where km <= 2.5) group by market_key)
select market_key, min(market_key) over (partition by lat, lon) as spot, coalesce(n, 0) as n_links from p left join l using (market_key)""",
    "p7_found": f"{_NEAR} select distinct market_key_a, market_key_b from q where km <= 2.5",
}
