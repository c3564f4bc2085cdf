"""Features on a daily grid that look back only, targets that look ahead, and measures of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["market_key", "commodity"]


def daily_grid(prices: DataFrame, fill_days: int = 3) -> DataFrame:
    """One row per calendar day of each series from its first to its last report: ``price`` where reported, ``lp`` the log price carried for at most ``fill_days``
    days, ``since`` days since the last report."""
    w = Window.partitionBy(*KEYS).orderBy("day")
    r = prices.select(*KEYS, "state", F.unix_date("date").alias("day"), F.col("modal_price").alias("price"))
    r = r.withColumn("until", F.coalesce(F.lead("day").over(w) - 1, F.col("day")))
    g = r.withColumn("at", F.explode(F.sequence("day", "until"))).withColumn("since", F.col("at") - F.col("day"))
    return g.select(*KEYS, "state", F.col("at").alias("day"), F.when(F.col("since") == 0, F.col("price")).alias("price"), F.when(F.col("since") <= fill_days, F.ln("price")).alias("lp"), "since")


def regional(grid: DataFrame) -> DataFrame:
    """Per state, commodity and day: median log price, markets reporting, share of series below their price a week before."""
    w = Window.partitionBy(*KEYS).orderBy("day")
    g = grid.withColumn("week", F.lag("lp", 7).over(w))
    return g.groupBy("state", "commodity", "day").agg(F.median("lp").alias("state_lp"), F.count("price").alias("n_markets"), F.avg((F.col("lp") < F.col("week")).cast("int")).alias("share_falling"))


def forecast_features(grid: DataFrame, horizon: int = 7) -> DataFrame:
    """Features of each day on which a series has a price, from that day and before, regional ones from the day before; ``target`` is the log
    of a real report ``horizon`` days later. Calendar columns are of the target's day."""
    w = Window.partitionBy(*KEYS).orderBy("day")
    back = lambda k: w.rowsBetween(1 - k, 0)
    cols = {f"d_lag_{k}": F.col("lp") - F.lag("lp", k).over(w) for k in (1, 3, 7, 14, 28)}
    for k in (7, 14, 30):
        cols |= {f"mean_{k}": F.avg("lp").over(back(k)) - F.col("lp"), f"std_{k}": F.stddev_samp("lp").over(back(k)), f"min_{k}": F.min("lp").over(back(k)) - F.col("lp"), f"max_{k}": F.max("lp").over(back(k)) - F.col("lp")}
    cols |= {"yoy_change": F.col("lp") - F.lag("lp", 364).over(w), "momentum_30": F.avg("lp").over(back(7)) - F.avg("lp").over(back(30)), "report_freq_30": F.count("price").over(back(30)) / F.lit(30.0), "target": F.ln(F.lead("price", horizon).over(w)), "lp_week_ago": F.lag("lp", 7).over(w), "mean_level_7": F.avg("lp").over(back(7))}
    x = grid.withColumns(cols)
    states = Window.partitionBy("state", "commodity").orderBy("day").rangeBetween(-7, -7)
    r = regional(grid).withColumn("state_change", F.col("state_lp") - F.first("state_lp").over(states))
    r = r.select("state", "commodity", (F.col("day") + 1).alias("day"), F.col("state_lp").alias("state_lp_prev1"), F.col("state_change").alias("state_change_7_prev1"), F.col("n_markets").alias("state_n_prev1"), F.col("share_falling").alias("state_falling_prev1"))
    x = x.join(r, ["state", "commodity", "day"], "left").filter(F.col("lp").isNotNull())
    on = F.date_from_unix_date(F.col("day") + horizon)
    return x.withColumns({"state_n_prev1": F.coalesce("state_n_prev1", F.lit(0)), "dow": F.weekday(on) + 1, "week": F.weekofyear(on), "month": F.month(on)})


def baselines(features: DataFrame) -> DataFrame:
    """Last price, price a week ago and mean of the last week as forecasts; the latter two fall back on the first."""
    return features.withColumns({"p_last": F.col("lp"), "p_week": F.coalesce("lp_week_ago", "lp"), "p_mean": F.coalesce("mean_level_7", "lp")})


def errors(df: DataFrame, actual: str, forecasts: list[str], by: list[str]) -> DataFrame:
    """MAE, MAPE and sMAPE (in percent) of forecasts in logs, in prices, by group and forecast."""
    x = df.filter(F.col(actual).isNotNull()).select(*by, F.exp(actual).alias("y"), F.explode(F.array(*(F.struct(F.lit(f).alias("forecast"), F.exp(f).alias("p")) for f in forecasts))).alias("f")).select(*by, "y", "f.*")
    e = F.abs(F.col("y") - F.col("p"))
    return x.groupBy(*by, "forecast").agg(F.count("*").alias("n"), F.avg(e).alias("mae"), F.avg(100 * e / F.col("y")).alias("mape"), F.avg(200 * e / (F.col("y") + F.col("p"))).alias("smape"))


def conformal_width(df: DataFrame, actual: str, low: str, high: str, by: list[str], cover: float = 0.8) -> DataFrame:
    """Per group the score at rank ceil((n + 1) * cover), at most n, of max(low - actual, actual - high): what both ends of the band are to be widened by."""
    s = df.select(*by, F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high)).alias("score")).filter(F.col("score").isNotNull())
    w = Window.partitionBy(*by)
    r = s.withColumns({"rn": F.row_number().over(w.orderBy("score")), "n": F.count("*").over(w)})
    return r.filter(F.col("rn") == F.least(F.ceil((F.col("n") + 1) * cover), F.col("n"))).select(*by, F.col("score").alias("width"), "n")


def precision_recall(df: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """Precision and recall at each distinct score as the threshold, by group. Scores are pre-aggregated, so a window holds distinct scores only."""
    g = df.groupBy(*by, F.col(score).alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("int")).alias("hits"))
    up = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    c = g.withColumns({"alerts": F.sum("n").over(up), "caught": F.sum("hits").over(up), "all": F.sum("hits").over(Window.partitionBy(*by))})
    return c.select(*by, "threshold", "alerts", F.try_divide("caught", "alerts").alias("precision"), F.try_divide("caught", "all").alias("recall"), (F.col("hits") / F.col("all") * F.col("caught") / F.col("alerts")).alias("ap_part"))


def average_precision(pr: DataFrame, by: list[str]) -> DataFrame:
    return pr.groupBy(*by).agg(F.sum("ap_part").alias("average_precision"))


def alert_threshold(pr: DataFrame, by: list[str], precision: float = 0.6) -> DataFrame:
    """Lowest threshold with at least that precision, else the one of the best F1."""
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return pr.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("precision") >= precision, F.col("threshold"))), F.max_by("threshold", F.coalesce(f1, F.lit(0.0)))).alias("threshold"))


def coverage(df: DataFrame, by: list[str]) -> DataFrame:
    """Of forecasts with a band in logs: how many targets are known, the share within the band, and the mean absolute error in prices of the middle and of the last price."""
    x, y = df.filter(F.col("target").isNotNull()), F.exp("target")
    inside = F.col("target").between(F.col("p10"), F.col("p90")).cast("int")
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.avg(inside).alias("coverage"), F.avg(F.abs(F.exp("p50") - y)).alias("mae"), F.avg(F.abs(F.exp("lp") - y)).alias("mae_last"))


def latest_rows(df: DataFrame, within: int = 7) -> DataFrame:
    """The last row of each series that ends at most ``within`` days before the data do."""
    end = df.agg(F.max("day").alias("_end"))
    last = Window.partitionBy(*KEYS).orderBy(F.desc("day"))
    x = df.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").crossJoin(F.broadcast(end))  # one row
    return x.filter(F.col("day") >= F.col("_end") - within).drop("_rn", "_end")
