"""Pairs of markets, their spreads of a day, and directed comparisons."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from ..util import cut, small
from .near import EARTH_KM, haversine_km, near_pairs, on_globe


def market_pairs(markets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Unordered pairs of different towns within reach; two centroids of one district are no pair. Found by the curve-cell range join."""
    m = markets.filter("has_valid_data").select("market_key", "state", "district", "geo_precision", "town_key", "latitude", "longitude")
    near = near_pairs(m, "market_key", "latitude", "longitude", s.max_pair_km)
    side = lambda t: m.select(*(F.col(c).alias(f"{c}_{t}") for c in ("market_key", "state", "district", "geo_precision", "town_key")))
    p = near.join(side("a"), F.col("id_a") == F.col("market_key_a")).join(side("b"), F.col("id_b") == F.col("market_key_b"))
    return p.filter(_apart()).select(*_pair(F.col("km"), s))


def _centroids() -> list[Column]:
    return [F.col(f"geo_precision_{t}") == "district_centroid" for t in "ab"]


def _apart() -> Column:
    """Different towns, and not both the centroid of one district."""
    a, b = _centroids()
    return (F.col("town_key_a") != F.col("town_key_b")) & ~(a & b & (F.col("state_a") == F.col("state_b")) & (F.col("district_a") == F.col("district_b")))


def _pair(km: Column, s: Settings) -> list[Column]:
    """Columns of a pair."""
    a, b = _centroids()
    precision = F.when(a & b, "both_centroid").when(a | b, "one_centroid").otherwise("both_market")
    return [F.md5(F.concat("market_key_a", F.lit("|"), "market_key_b")).alias("pair_key"), F.col("market_key_a"), F.col("market_key_b"), F.col("state_a"), F.col("state_b"), F.round(km, 2).alias("haversine_km"), F.round(km * s.road_factor, 2).alias("road_km_est"), precision.alias("pair_precision"), (F.col("state_a") == F.col("state_b")).alias("is_same_state")]


def spreads(prices: DataFrame, pairs: DataFrame, s: Settings = Settings(), by: tuple[str, ...] = ("commodity", "date")) -> DataFrame:
    """Both prices of each pair on days (and other ``by`` columns) on which both reported, with the gap over the lower price."""
    p = pairs.filter(F.col("road_km_est") <= s.spread_km)
    a = prices.select(F.col("market_key").alias("market_key_a"), *by, F.col("modal_price").alias("price_a"))
    b = prices.select(F.col("market_key").alias("market_key_b"), *by, F.col("modal_price").alias("price_b"))
    x = p.join(a, "market_key_a").join(b, ["market_key_b", *by])
    return _gaps(x)


def _gaps(x: DataFrame) -> DataFrame:
    gap = F.abs(F.col("price_a") - F.col("price_b"))
    return x.withColumns({"abs_gap": gap, "pct_gap": F.round(gap / F.least("price_a", "price_b"), 4)})


def day_spreads(prices: DataFrame, markets: DataFrame, s: Settings = Settings(), by: tuple[str, ...] = ("commodity", "date")) -> DataFrame:
    """``spreads`` over the ``market_pairs`` of ``markets``, without a list of pairs: the prices of a day meet, and distance decides.

    Pairs grow with the square of the markets, and each is on as many days as both report; here only the prices are shuffled, once and by ``by``, however many
    spreads come of them, and the rows of a day stay in one task for what is counted by it."""
    x = _placed(prices, markets, by).repartition(*by)
    by_road = (s.spread_km + 0.01) / s.road_factor  # km beyond which no road is short enough
    near = [_km() <= s.max_pair_km] if by_road >= s.max_pair_km else []
    both = _meet(x, x, by, min(s.max_pair_km, by_road), F.col("market_key_a") < F.col("market_key_b"), *near, F.round(_km() * s.road_factor, 2) <= s.spread_km)
    return _gaps(both.select(*_pair(_km(), s), *by, "price_a", "price_b"))


def _km() -> Column:
    return haversine_km(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b"))


def _placed(prices: DataFrame, markets: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Prices of located markets with where these are, as degrees and as points of the unit sphere."""
    m = markets.filter(F.col("has_valid_data") & on_globe(F.col("latitude"), F.col("longitude"))).select("market_key", "state", "district", "geo_precision", "town_key", "latitude", F.when(F.col("longitude") == 180, F.lit(-180.0)).otherwise(F.col("longitude")).alias("longitude"))
    x = prices.select("market_key", *by, F.col("modal_price").alias("price")).join(m, "market_key")
    lat, lon = F.radians("latitude"), F.radians("longitude")
    return x.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})


def _meet(x: DataFrame, y: DataFrame, by: tuple[str, ...], far: float, *more: Column) -> DataFrame:
    """Rows of ``x`` (suffix a) and ``y`` (suffix b) alike in ``by``, of different towns and at most about ``far`` km apart, for which ``more`` hold.

    The rows of a cube of space, which has the reach as its edge, meet those of the same and the adjacent cubes as lists, so that few rows are compared that
    are out of reach. Lists are made behind the shuffle by ``by``, which the join keeps to: cubes as its keys would shuffle once more."""
    chord = (2 * math.sin(far / EARTH_KM / 2)) ** 2 * (1 + 1e-6) + 1e-12  # a cheap bound that every pair within reach meets
    edge = math.sqrt(chord) * (1 + 1e-6)
    cells = [f"cell_{c}" for c in "xyz"]

    def lists(df: DataFrame, t: str) -> DataFrame:
        row = F.struct(*(F.col(c).alias(f"{c}_{t}") for c in df.columns if c not in by))
        return df.groupBy(*by, *(F.floor(F.col(c) / edge).alias(f"cell_{c}") for c in "xyz")).agg(F.collect_list(row).alias(f"rows_{t}"))

    adjacent = [F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= 1 for c in cells]
    met = lists(x, "a").alias("l").join(lists(y, "b").alias("r"), [*(F.col(f"l.{c}") == F.col(f"r.{c}") for c in by), *adjacent]).select(*(F.col(f"l.{c}") for c in by), "rows_a", "rows_b")
    both = met.select(*by, "rows_b", F.explode("rows_a").alias("row_a")).select(*by, "row_a", F.explode("rows_b").alias("row_b")).select(*by, "row_a.*", "row_b.*")
    square = lambda c: (F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b"))
    for condition in (square("x") + square("y") + square("z") <= chord, more[0], _apart(), *more[1:]):
        both = both.filter(condition)
    return both


def near_prices(prices: DataFrame, markets: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Median price of the markets within ``near_km`` that report on the same day, or else a day off, and the number of those that do either: ``home, commodity, date,
    neighbour_median, n``.

    As in ``day_spreads`` no pairs are listed: prices are spread over the days about theirs, and those of a day meet by distance."""
    by = ("commodity", "date")
    x = _placed(prices, markets, by)
    around = x.withColumn("d", F.explode(F.array(*(F.struct(F.date_add("date", k).alias("date"), F.lit(k).alias("off")) for k in (-1, 0, 1))))).withColumns({"date": F.col("d.date"), "off": F.col("d.off")}).drop("d")
    both = _meet(x.repartition(*by), around.repartition(*by), by, s.near_km + 0.01, F.col("market_key_a") != F.col("market_key_b"), F.round(_km(), 2) <= s.near_km)
    both = both.select(F.col("market_key_a").alias("home"), *by, "market_key_b", "off_b", "price_b")
    g = both.groupBy("home", *by).agg(F.median(F.when(F.col("off_b") == 0, F.col("price_b"))).alias("same_day"), F.median("price_b").alias("around"), F.size(F.collect_set(F.xxhash64("market_key_b"))).cast("long").alias("n"))
    return g.select("home", *by, F.coalesce("same_day", "around").alias("neighbour_median"), "n")


def gap_figures(spread: DataFrame, markets: DataFrame) -> DataFrame:
    """By commodity the days of pairs, their pairs, median and ninth decile of the gap, and the share of gaps of a fifth at least.

    Pairs are counted as numbers of their markets, apart from the quantiles: in one aggregate the quantiles would be made by pair first and shuffled with its key."""
    of = F.col("pct_gap")
    g = spread.groupBy("commodity").agg(F.count("*").alias("n_pair_days"), F.round(F.percentile(of, 0.5), 6).alias("median_gap"), F.round(F.percentile(of, 0.9), 6).alias("p90_gap"), F.round(F.avg((of >= 0.2).cast("int")), 4).alias("share_20"))
    number = cut(markets.select("market_key", F.row_number().over(Window.orderBy("market_key")).cast("long").alias("number")))  # a row per market
    side = lambda t: small(number).select(F.col("market_key").alias(f"market_key_{t}"), F.col("number").alias(f"number_{t}"))
    pair = spread.select("commodity", "market_key_a", "market_key_b").join(side("a"), "market_key_a").join(side("b"), "market_key_b").select("commodity", F.shiftleft("number_a", 32).bitwiseOR(F.col("number_b")).alias("pair"))
    n = pair.distinct().groupBy("commodity").agg(F.count("*").alias("n_pairs"))
    return g.join(n, "commodity").select("commodity", "n_pair_days", "n_pairs", "median_gap", "p90_gap", "share_20")


def spread_days(spread: DataFrame) -> DataFrame:
    """Spreads by state and day; a pair across a border counts in both states."""
    cols = ["date", "commodity", "abs_gap", "pct_gap"]
    sides = spread.select(*cols, F.explode(F.when(F.col("is_same_state"), F.array("state_a")).otherwise(F.array("state_a", "state_b"))).alias("state"))
    r = lambda c, q, n: F.round(F.percentile(c, q), n)
    return sides.groupBy("date", "commodity", "state").agg(F.count("*").alias("n_pairs"), r("abs_gap", 0.5, 4).alias("median_abs_gap"), r("abs_gap", 0.9, 4).alias("p90_abs_gap"), r("pct_gap", 0.5, 6).alias("median_pct_gap"), r("pct_gap", 0.9, 6).alias("p90_pct_gap"))


def directed(spread: DataFrame, s: Settings = Settings(), rounded: bool = True) -> DataFrame:
    """Each spread in both directions under each cost scenario, with the gain net of costs. ``rounded`` rounds the costs to cents first.

    Rounded costs are made of whole numbers, so that halves of a cent are rounded alike everywhere: hundredths of a kilometre and ten-thousandths of the
    currency, which each spread is turned into once, for all its directions and scenarios."""
    keep = [c for c in ("pair_key", "date", "commodity", "variety", "road_km_est", "pair_precision") if c in spread.columns]
    whole = lambda c, n: F.rint(F.round(c, n) * 10**n).cast("long")
    x = spread.withColumns({"whole_km": whole("road_km_est", 2), "whole_a": whole("price_a", 4), "whole_b": whole("price_b", 4)}) if rounded else spread
    also = ["whole_km"] if rounded else []
    way = lambda a, b: F.struct(F.col(f"market_key_{a}").alias("home_market_key"), F.col(f"market_key_{b}").alias("dest_market_key"), F.col(f"price_{a}").alias("price_home"), F.col(f"price_{b}").alias("price_dest"), *([F.col(f"whole_{b}").alias("whole_dest")] if rounded else []))
    ways = x.select(*keep, *also, F.explode(F.array(way("a", "b"), way("b", "a"))).alias("w")).select(*keep, *also, "w.*")  # no union: the spreads are made once, and stay where they are
    of = lambda v, n: F.lit(int((Decimal(str(v)) * 10**n).to_integral_value(ROUND_HALF_UP))).cast("long") if rounded else F.lit(v)
    scenario = F.explode(F.array(*(F.struct(F.lit(k).alias("scenario"), of(a, 2).alias("per_km"), of(b, 2).alias("fixed"), of(c, 4).alias("fee")) for k, (a, b, c) in s.scenarios.items())))
    x = ways.withColumn("s", scenario).select("*", "s.*").drop("s")
    if rounded:
        costs = {"transport_cost": _cents(F.col("whole_km") * F.col("per_km") + F.col("fixed") * 100, 2), "fee_cost": _cents(F.col("whole_dest") * F.col("fee"), 6)}
    else:
        costs = {"transport_cost": F.col("road_km_est") * F.col("per_km") + F.col("fixed"), "fee_cost": F.col("price_dest") * F.col("fee")}
    x = x.withColumns(costs).drop("per_km", "fixed", "fee", "whole_km", "whole_dest")
    x = x.withColumn("gain", F.col("price_dest") - F.col("transport_cost") - F.col("fee_cost") - F.col("price_home"))
    return x.withColumns({"gain_pct": F.col("gain") / F.col("price_home"), "is_opportunity": (F.col("gain") >= s.gain_min) & (F.col("gain") / F.col("price_home") >= s.gain_min_share)})


def _cents(n: Column, digits: int) -> Column:
    """Whole ``n`` of 10 ** (-2 - digits) as currency, rounded half up to cents."""
    half = 10**digits // 2
    return F.call_function("div", n + F.when(n < 0, -half).otherwise(half), F.lit(10**digits).cast("long")).cast("double") / 100


def market_days(directed_: DataFrame) -> DataFrame:
    """Directed comparisons by home market, day and scenario."""
    opp, sure = F.col("is_opportunity"), F.col("pair_precision") == "both_market"
    return directed_.groupBy("home_market_key", "date", "commodity", "scenario").agg(
        F.count("*").alias("n_neighbors_reporting"), F.count_if(opp).alias("n_opportunities"), F.max("gain").alias("best_gain"), F.bool_or(opp).alias("has_opportunity"), F.max(F.when(opp, F.col("gain"))).alias("best_opportunity_gain"),
        F.count_if(sure).alias("n_neighbors_market_precision"), F.coalesce(F.bool_or(F.when(sure, opp)), F.lit(False)).alias("has_opportunity_market_precision"),
    )
