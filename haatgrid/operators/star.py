"""Calendar, markets and daily facts as a star schema, and the base of the analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import Settings

PLACE = ["state", "district", "market"]


def market_key() -> Column:
    return F.md5(F.concat("state", F.lit("|"), "district", F.lit("|"), "market"))


def calendar(spark: SparkSession, first: str, last: str, main_end: str | None = None) -> DataFrame:
    """One row per day from ``first`` to ``last``; the period is main up to ``main_end``, or throughout."""
    d = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("calendar_date"))
    return d.select(
        F.date_format("calendar_date", "yyyyMMdd").cast("int").alias("date_key"), "calendar_date", (F.weekday("calendar_date") + 1).alias("day_of_week"), F.date_format("calendar_date", "EEEE").alias("day_name"),
        F.weekofyear("calendar_date").alias("iso_week"), F.month("calendar_date").alias("month_of_year"), F.date_format("calendar_date", "MMMM").alias("month_name"), F.quarter("calendar_date").alias("quarter_of_year"), F.year("calendar_date").alias("calendar_year"), (F.weekday("calendar_date") >= 5).alias("is_weekend"),
        F.when(F.col("calendar_date") > F.lit(main_end).cast("date"), "post_format_change").otherwise("main").alias("period"),
    )


def merge_overrides(geo: DataFrame, overrides: DataFrame) -> DataFrame:
    """Coordinates of ``geo`` (place, latitude, longitude, geo_precision) with those of ``overrides`` where it has the place."""
    o = overrides.select(*PLACE, F.col("latitude").alias("o_lat"), F.col("longitude").alias("o_lon"), F.lit(True).alias("o"))
    x = geo.join(o, PLACE, "left")
    return x.withColumns({"latitude": F.coalesce("o_lat", "latitude"), "longitude": F.coalesce("o_lon", "longitude"), "geo_precision": F.when(F.col("o"), "manual").otherwise(F.col("geo_precision"))}).drop("o_lat", "o_lon", "o")


def market_dimension(staged: DataFrame, daily: DataFrame, geo: DataFrame) -> DataFrame:
    """One row per market with key, coordinates, town and span of activity. Markets without a town count together as one town."""
    m = staged.select(*PLACE).distinct()
    g = geo.select(*PLACE, "latitude", "longitude", "geo_precision").dropDuplicates(PLACE)
    a = daily.groupBy(*PLACE).agg(F.min("arrival_date").alias("first_report_date"), F.max("arrival_date").alias("last_report_date"), F.countDistinct("arrival_date").alias("n_report_days"))
    x = m.join(g, PLACE, "left").join(a, PLACE, "left")
    town = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.md5(F.concat(F.format_string("%.6f", "latitude"), F.lit(","), F.format_string("%.6f", "longitude"))))
    x = x.select(market_key().alias("market_key"), *PLACE, "latitude", "longitude", F.coalesce("geo_precision", F.lit("not_found")).alias("geo_precision"), town.alias("town_key"), "first_report_date", "last_report_date", F.coalesce("n_report_days", F.lit(0)).alias("n_report_days"))
    per_town = x.groupBy("town_key").agg(F.count("*").alias("n_markets_in_town"))
    x = x.withColumn("has_valid_data", F.col("n_report_days") > 0)
    return x.join(per_town.withColumnRenamed("town_key", "t"), F.col("town_key").eqNullSafe(F.col("t"))).drop("t")


def facts(daily: DataFrame, commodities: DataFrame) -> DataFrame:
    """Daily prices by keys; commodities that are not in the dimension are left out."""
    return daily.join(F.broadcast(commodities.select("commodity", "commodity_key")), "commodity").withColumns({"market_key": market_key(), "date_key": F.date_format("arrival_date", "yyyyMMdd").cast("int")})


def analysis_prices(facts_: DataFrame, markets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Prices of the analysis period of markets with valid data, by the price set chosen."""
    price = "modal_price_incl_suspect" if s.include_suspect_low else "modal_price"
    m = markets.filter("has_valid_data").select("market_key", "town_key", "latitude", "longitude", "geo_precision")
    x = facts_.filter((F.col("period") == s.period) & F.col(price).isNotNull()).join(m, "market_key")
    return x.select("market_key", "commodity_key", "commodity", *PLACE, F.col("arrival_date").alias("date"), "date_key", F.col(price).alias("modal_price"), "town_key", "latitude", "longitude", "geo_precision")
