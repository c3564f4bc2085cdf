"""Seasons, volatility, access of districts to markets, features of series, concentration: frames made from the pipeline's steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from .near import near_join, near_pairs

SERIES = ["market_key", "commodity"]
#: Precisions of coordinates that do not stand for the place itself.
ROUGH = ("district_centroid", "not_found")


def _rate(flag: Column) -> Column:
    return F.avg(flag.cast("int"))


def seasonality(prices: DataFrame, drops: DataFrame, commodities: DataFrame) -> DataFrame:
    """By commodity, state and month of the year: median price and report days, the median over the years of month to year median, and the drop rate.

    Months without a labelled day have no drop rate; an empty input gives no rows."""
    p = prices.select("commodity", "state", F.year("date").alias("yr"), F.month("date").alias("mon"), "modal_price")
    by = ["commodity", "state", "mon"]
    month = p.groupBy(*by, "yr").agg(F.median("modal_price").alias("month_median"))
    year = p.groupBy("commodity", "state", "yr").agg(F.median("modal_price").alias("year_median"))
    index = month.join(year, ["commodity", "state", "yr"]).groupBy(*by).agg(F.median(F.col("month_median") / F.col("year_median")).alias("price_index"), F.count("*").alias("n_years"))
    level = p.groupBy(*by).agg(F.median("modal_price").alias("median_price"), F.count("*").alias("n_market_days"))
    lab = drops.filter("is_drop is not null").groupBy("commodity", "state", F.month("date").alias("mon")).agg(F.count("*").alias("n_labelled"), F.count_if("is_drop").alias("n_drops"))
    x = level.join(index, by).join(lab, by, "left").join(F.broadcast(commodities.select("commodity", "category")), "commodity", "left")  # a row per commodity
    return x.withColumns({"month_name": F.date_format(F.make_date(F.lit(2000), "mon", F.lit(1)), "MMM"), "drop_rate": F.try_divide("n_drops", "n_labelled")})


def seasonality_by_month(season: DataFrame) -> DataFrame:
    """Seasons of all states together: the median of their indices and the pooled drop rate, a ratio of sums."""
    g = season.groupBy("commodity", "mon", "month_name").agg(F.median("price_index").alias("median_index"), F.sum("n_labelled").alias("n_labelled"), F.sum("n_drops").alias("n_drops"))
    return g.withColumn("drop_rate", F.try_divide("n_drops", "n_labelled"))


def volatility(prices: DataFrame, s: Settings = Settings()) -> DataFrame:
    """By series and year of at least ``year_min_days`` reports: variation, mean size of changes within three days, deepest fall from the year's peak."""
    year = Window.partitionBy(*SERIES, "yr").orderBy("date")
    x = prices.select(*SERIES, "state", "date", "modal_price", F.year("date").alias("yr"))
    x = x.withColumns({"before": F.lag("modal_price").over(year), "gap": F.datediff("date", F.lag("date").over(year)), "peak": F.max("modal_price").over(year.rowsBetween(Window.unboundedPreceding, 0))})
    change = F.when(F.col("gap") <= s.fill_days, F.abs(F.col("modal_price") / F.col("before") - 1))
    g = x.groupBy(*SERIES, "state", "yr").agg(
        F.count("*").alias("n_days"), F.try_divide(F.stddev_samp("modal_price"), F.avg("modal_price")).alias("cv"), F.avg(change).alias("avg_change"), F.max(1 - F.col("modal_price") / F.col("peak")).alias("max_drawdown")
    )
    return g.filter(F.col("n_days") >= s.year_min_days)


def _located(markets: DataFrame) -> DataFrame:
    return markets.filter(F.col("has_valid_data") & F.col("town_key").isNotNull())


def district_access(prices: DataFrame, markets: DataFrame, market_days: DataFrame, s: Settings = Settings()) -> DataFrame:
    """By district and commodity: towns with reports within ``near_km`` of the district's centre (across states), the mean of the daily ratio of district to state median,
    and the share of its market-days with an opportunity in the middle scenario; the same of precisely located places only.

    A district's centre is the mean of its located markets. One without a centre has no towns near; one without compared market-days has no rate."""
    place = _located(markets)
    centre = place.groupBy("state", "district").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")).withColumn("place", F.concat_ws("|", "state", "district"))
    towns = place.select(F.col("town_key").alias("point"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).distinct()
    near = near_join(centre, towns, s.near_km).join(centre.select("place", "state", "district"), "place")
    sells = prices.filter("town_key is not null").groupBy(F.col("town_key").alias("point"), "commodity").agg(F.bool_or(~F.col("geo_precision").isin(*ROUGH)).alias("precise"))
    n = near.join(sells, "point").groupBy("state", "district", "commodity").agg(F.count("*").alias("n_towns"), F.count_if("precise").alias("n_towns_precise"))
    day = prices.groupBy("state", "district", "commodity", "date").agg(F.median("modal_price").alias("own"))
    land = prices.groupBy("state", "commodity", "date").agg(F.median("modal_price").alias("usual"))
    index = day.join(land, ["state", "commodity", "date"]).groupBy("state", "district", "commodity").agg(F.avg(F.col("own") / F.col("usual")).alias("price_index"), F.count("*").alias("n_price_days"))
    home = market_days.filter("scenario = 'mid'").join(markets.select(F.col("market_key").alias("home_market_key"), "state", "district"), "home_market_key")
    sure = F.when(F.col("n_neighbors_market_precision") > 0, F.col("has_opportunity_market_precision"))
    rate = home.groupBy("state", "district", "commodity").agg(F.count("*").alias("n_market_days"), _rate(F.col("has_opportunity")).alias("opportunity_rate"), _rate(sure).alias("opportunity_rate_precise"))
    key = ["state", "district", "commodity"]
    x = index.join(n, key, "left").join(rate, key, "left").fillna(0, ["n_towns", "n_towns_precise"])
    low = F.col("price_index") < s.low_index
    return x.withColumns({"thin_and_low": (F.col("n_towns") <= s.thin_towns) & low, "thin_and_low_precise": (F.col("n_towns_precise") <= s.thin_towns) & low})


def access_summary(access: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Districts by commodity: all, thin and low, thin, low, and their opportunity rates."""
    both = F.col("thin_and_low")
    return access.groupBy("commodity").agg(
        F.count("*").alias("n_districts"), F.count_if(both).alias("n_thin_and_low"), F.count_if(F.col("n_towns") <= s.thin_towns).alias("n_thin"), F.count_if(F.col("price_index") < s.low_index).alias("n_low"),
        F.avg(F.when(both, F.col("opportunity_rate"))).alias("rate_thin_and_low"), F.avg(F.when(~both, F.col("opportunity_rate"))).alias("rate_others"),
    )


def near_towns(prices: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Other towns within ``near_km`` that sell a series' commodity, by series; series of places without coordinates have no row."""
    at = prices.filter("town_key is not null").select(*SERIES, "town_key", "latitude", "longitude").distinct()
    towns = near_pairs(at.select("town_key", "latitude", "longitude").distinct(), "town_key", "latitude", "longitude", s.near_km)
    both = towns.select(F.col("id_a").alias("town_key"), F.col("id_b").alias("other")).unionByName(towns.select(F.col("id_b").alias("town_key"), F.col("id_a").alias("other")))
    sells = at.select(F.col("town_key").alias("other"), "commodity").distinct()
    return at.join(both, "town_key").join(sells, ["other", "commodity"]).groupBy(*SERIES).agg(F.countDistinct("other").alias("n_towns_near"))


def series_features(prices: DataFrame, drops: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of each series with at least ``series_min_days`` reports: variation, ratio to the state's daily median, report frequency, seasonal amplitude, drop rate and
    near towns. A series without labelled days has a drop rate of 0."""
    span = F.datediff(F.max("date"), F.min("date")) + 1
    own = prices.groupBy(*SERIES, "state").agg(F.count("*").alias("n_days"), F.try_divide(F.stddev_samp("modal_price"), F.avg("modal_price")).alias("cv"), (F.count("*") / span).alias("freq"), F.median("modal_price").alias("level")).filter(F.col("n_days") >= s.series_min_days)
    usual = prices.groupBy("state", "commodity", "date").agg(F.median("modal_price").alias("usual"))
    index = prices.join(usual, ["state", "commodity", "date"]).groupBy(*SERIES).agg(F.avg(F.col("modal_price") / F.col("usual")).alias("price_index"))
    month = prices.groupBy(*SERIES, F.month("date").alias("mon")).agg(F.median("modal_price").alias("m"))
    swing = month.groupBy(*SERIES).agg((F.max("m") - F.min("m")).alias("swing"))
    falls = drops.filter("is_drop is not null").groupBy(*SERIES).agg(_rate(F.col("is_drop")).alias("drop_rate"))
    x = own.join(index, SERIES).join(swing, SERIES).join(falls, SERIES, "left").join(near_towns(prices, s), SERIES, "left")
    return x.withColumn("amplitude", F.col("swing") / F.col("level")).drop("swing").fillna(0, ["drop_rate", "n_towns_near"])


def suspect_series(flags: DataFrame) -> DataFrame:
    """Series with persistently low rows: how many, when, how low, and the variety and grade that most of them have (ties: the alphabetically first)."""
    key = ["state", "district", "market", "commodity"]
    s = flags.filter("flag_persistent_low")
    most = s.groupBy(*key, "variety", "grade").agg(F.count("*").alias("n")).groupBy(*key).agg(F.min(F.struct((-F.col("n")).alias("less"), "variety", "grade")).alias("top"))
    g = s.groupBy(*key).agg(
        F.count("*").alias("n_low"), F.countDistinct("arrival_date").alias("n_days"), F.min("arrival_date").alias("first_date"), F.max("arrival_date").alias("last_date"), F.median("modal_price").alias("median_price"),
        F.median("state_median").alias("median_usual"), F.median(F.col("modal_price") / F.col("state_median")).alias("median_ratio"),
    )
    x = g.join(most, key)
    return x.withColumns({"main_variety": F.col("top.variety"), "main_grade": F.col("top.grade"), "share_main": -F.col("top.less") / F.col("n_low")}).drop("top")


def concentration(directed: DataFrame, scenario: str = "mid") -> DataFrame:
    """Share of all opportunities that the busiest destinations take: the first ten, twentieth and fifth of them. The ranking has a row per destination."""
    o = directed.filter((F.col("scenario") == scenario) & F.col("is_opportunity")).groupBy("dest_market_key").agg(F.count("*").alias("n"))
    r = o.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("n"), "dest_market_key")), "all": F.sum("n").over(Window.partitionBy()), "k": F.count("*").over(Window.partitionBy())})
    cuts = {"top 10": F.lit(10), "top 5 %": F.ceil(F.col("k") * 0.05), "top 20 %": F.ceil(F.col("k") * 0.2)}
    return r.withColumn("c", F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), v.cast("long").alias("upto")) for k, v in cuts.items())))).filter(F.col("rank") <= F.col("c.upto")).groupBy("c.slice").agg((F.sum("n") / F.max("all")).alias("share"))


def gain_histogram(market_days: DataFrame) -> DataFrame:
    """Market-days with an opportunity by commodity and hundreds of their best gain, those of 2,000 and more together."""
    gain = F.least(F.floor(F.col("best_gain") / 100) * 100, F.lit(2000)).cast("int").alias("gain_from")
    return market_days.filter("has_opportunity").groupBy("commodity", gain).agg(F.count("*").alias("n_market_days"))


def opportunity_rates(directed: DataFrame, market_days: DataFrame) -> DataFrame:
    """By scenario and commodity: the share of market-days and of single comparisons with an opportunity, the median of the market-days' best gains, and the mean number of neighbours."""
    m = market_days.groupBy("scenario", "commodity").agg(F.count("*").alias("n_market_days"), _rate(F.col("has_opportunity")).alias("market_day_rate"), F.median("best_opportunity_gain").alias("median_best_gain"), F.avg("n_neighbors_reporting").alias("avg_neighbors"))
    return m.join(directed.groupBy("scenario", "commodity").agg(_rate(F.col("is_opportunity")).alias("single_rate")), ["scenario", "commodity"])
