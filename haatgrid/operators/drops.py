"""Sustained price drops: labels from a trailing median and the days ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from .quality import trailing


def drop_labels(prices: DataFrame, s: Settings = Settings()) -> DataFrame:
    """For each price the median of the days up to it, and how many of the reports ahead lie below a share of that median.

    The days ahead are gathered by a RANGE frame of a bounded number of days, so nothing is joined. The label is null where there
    are too few days to look back on, none ahead, or the data end too soon."""
    keys = ["market_key", "commodity"]
    x = trailing(prices.select(*keys, "state", "date", "modal_price"), keys, "date", "modal_price", 1 - s.drop_lookback, 0)
    ahead = Window.partitionBy(*keys).orderBy("_d").rangeBetween(1, s.drop_horizon)
    x = x.withColumn("_d", F.unix_date("date")).withColumn("next", F.collect_list("modal_price").over(ahead)).drop("_d")
    last = prices.agg(F.max("date").alias("last_date"))
    x = x.crossJoin(F.broadcast(last))  # one row
    limit = F.col("trail_median") * s.drop_ratio
    x = x.select(*keys, "state", "date", "modal_price", F.col("trail_median").alias("lookback_median"), F.col("trail_n").alias("n_lookback_obs"), F.array_min("next").alias("future_min"), F.size("next").cast("long").alias("n_future_obs"), F.size(F.filter("next", lambda p: p < limit)).cast("long").alias("n_future_below"), "last_date")
    unknown = (F.col("n_lookback_obs") < s.drop_min_obs) | (F.col("n_future_obs") == 0) | (F.col("date") > F.date_sub("last_date", s.drop_horizon))
    return x.withColumns({"is_drop": F.when(~unknown, F.col("n_future_below") >= s.drop_min_days), "is_drop_any": F.when(~unknown, F.col("n_future_below") >= 1)}).drop("last_date")
