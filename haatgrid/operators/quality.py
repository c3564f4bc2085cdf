"""Quality flags against a series' own history and its peers of the day, and daily prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from ..util import cut, small

SERIES = ["state", "district", "market", "commodity"]


def baseline(staged: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Median modal price of each series and day, of positive prices within the unit bounds."""
    ok = (F.col("modal_price") > 0) & F.col("modal_price").between(s.price_min, s.price_max)
    return staged.filter(ok).groupBy(*SERIES, "arrival_date").agg(F.median("modal_price").alias("baseline_modal"))


def trailing(df: DataFrame, keys: list[str], day: str, value: str, first: int, last: int) -> DataFrame:
    """``df`` with ``trail_median`` and ``trail_n`` of ``value`` over the days from ``first`` to ``last`` relative to each row's day, by a RANGE frame. Days
    without rows do not count; the median of none is null."""
    w = Window.partitionBy(*keys).orderBy("_d").rangeBetween(first, last)
    x = df.withColumn("_d", F.unix_date(day))
    return x.withColumns({"trail_median": F.percentile(value, 0.5).over(w), "trail_n": F.count(value).over(w)}).drop("_d")


def rolling_median(base: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Median of the days before each day of a series, that day excluded."""
    return trailing(base, SERIES, "arrival_date", "baseline_modal", -s.outlier_days, -1).withColumnsRenamed({"trail_median": "rolling_median", "trail_n": "rolling_n_obs"}).drop("baseline_modal")


def state_day(base: DataFrame) -> DataFrame:
    """Median over the markets of a state of each commodity and day."""
    return base.groupBy("state", "commodity", "arrival_date").agg(F.median("baseline_modal").alias("state_median"), F.count("*").alias("n_markets"))


def flags(staged: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Staged records with deviations, flags and validity. Bounds of zero count as missing; order is only checked against present bounds; a series is
    suspect as persistently low if enough of its valid rows are far below the state's median of the day.

    The rows are shuffled once, by series; what a series' own days and rows tell is found by windows within it, and the medians of the states' days (a row
    per state, commodity and day) are sent to them if there are few enough."""
    states = small(cut(state_day(baseline(staged, s))))
    bound = (lambda c: F.when(F.col(c) > 0, F.col(c))) if s.zero_bounds_missing else F.col
    true = lambda c: F.coalesce(c, F.lit(False))
    p = staged.withColumns({"is_min_max_placeholder": true((F.col("min_price") <= 0) | (F.col("max_price") <= 0)), "min_price_raw": F.col("min_price"), "max_price_raw": F.col("max_price"), "min_price": bound("min_price"), "max_price": bound("max_price")})
    p = p.repartition(*SERIES)
    day = Window.partitionBy(*SERIES, "arrival_date")
    ok = (F.col("modal_price") > 0) & F.col("modal_price").between(s.price_min, s.price_max)
    p = p.withColumns({"_base": F.median(F.when(ok, F.col("modal_price"))).over(day), "_rn": F.row_number().over(day.orderBy("raw_id"))})
    # a day counts once, by its first row; days without a usable price have no history
    p = trailing(p.withColumn("_once", F.when(F.col("_rn") == 1, F.col("_base"))), SERIES, "arrival_date", "_once", -s.outlier_days, -1)
    has = F.col("_base").isNotNull()
    p = p.withColumns({"rolling_median": F.when(has, F.col("trail_median")), "rolling_n_obs": F.when(has, F.col("trail_n"))}).drop("_base", "_rn", "_once", "trail_median", "trail_n")
    p = p.join(states, ["state", "commodity", "arrival_date"], "left")
    far = lambda ref: F.abs(F.ln("modal_price") - F.ln(ref))
    p = p.withColumns(
        {
            "dev_own_history": F.when((F.col("modal_price") > 0) & (F.col("rolling_n_obs") >= s.outlier_min_obs) & (F.col("rolling_median") > 0), far("rolling_median")),
            "dev_state_day": F.when((F.col("modal_price") > 0) & (F.col("n_markets") >= s.outlier_min_markets) & (F.col("state_median") > 0), far("state_median")),
        }
    )
    own = true(F.col("dev_own_history") > s.outlier_log_ratio)
    outlier = own if s.outlier_rule == "temporal" else own & (F.col("dev_state_day").isNull() | (F.col("dev_state_day") > s.outlier_log_ratio))
    p = p.withColumns(
        {
            "rolling_n_obs": F.coalesce("rolling_n_obs", F.lit(0)),
            "state_n_markets": F.coalesce("n_markets", F.lit(0)),
            "flag_nonpositive": F.coalesce("modal_price", F.lit(0.0)) <= 0,
            "flag_order": true(F.col("modal_price") < F.col("min_price")) | true(F.col("modal_price") > F.col("max_price")) | true(F.col("min_price") > F.col("max_price")),
            "flag_unit_suspect": true((F.col("modal_price") < s.price_min) | (F.col("modal_price") > s.price_max)),
            "flag_outlier_temporal": own,
            "flag_outlier": outlier,
        }
    ).drop("n_markets")
    p = p.withColumn("is_valid", ~(F.col("flag_nonpositive") | F.col("flag_order") | F.col("flag_outlier") | F.col("flag_unit_suspect")))
    p = p.withColumn("is_low_vs_state", true(F.col("is_valid") & (F.col("modal_price") < F.col("state_median")) & (F.col("dev_state_day") > s.low_log_ratio)))
    series = Window.partitionBy(*SERIES)
    p = p.withColumns({"series_n_low": F.count_if("is_low_vs_state").over(series), "series_n_with_ref": F.count_if(F.col("is_valid") & F.col("dev_state_day").isNotNull()).over(series)})
    return p.withColumn("flag_persistent_low", F.col("is_low_vs_state") & (F.col("series_n_low") >= s.low_min_rows) & (F.col("series_n_low") >= s.low_min_share * F.col("series_n_with_ref")))


def daily_prices(flagged: DataFrame) -> DataFrame:
    """Median price of each series and day over valid records, with and without suspect ones; bounds only where every record has one."""
    good = ~F.col("flag_persistent_low")
    pick = lambda c: F.when(good, F.col(c))
    n_good = F.count_if(good)
    return (
        flagged.filter("is_valid")
        .select(*SERIES, "arrival_date", "modal_price", "min_price", "max_price", "variety", "period", "source", "flag_persistent_low")
        .repartition(*SERIES)  # the groups lie within series, so the distinct varieties need no further shuffle
        .groupBy(*SERIES, "arrival_date")
        .agg(
            F.median(pick("modal_price")).alias("modal_price"),
            F.when(F.count(pick("min_price")) == n_good, F.min(pick("min_price"))).alias("min_price"),
            F.when(F.count(pick("max_price")) == n_good, F.max(pick("max_price"))).alias("max_price"),
            F.median("modal_price").alias("modal_price_incl_suspect"),
            F.when(F.count("min_price") == F.count("*"), F.min("min_price")).alias("min_price_incl_suspect"),
            F.when(F.count("max_price") == F.count("*"), F.max("max_price")).alias("max_price_incl_suspect"),
            F.countDistinct("variety").alias("n_varieties"),
            F.count("*").alias("n_rows"),
            F.count_if("flag_persistent_low").alias("n_suspect_rows"),
            F.bool_and("flag_persistent_low").alias("is_suspect_low"),
            F.max("period").alias("period"),
            F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"),
        )
    )
