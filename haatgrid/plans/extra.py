"""Queries of operators beyond the saved ones: calendar, aliases, checks, serving views, features, models, files and streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ratio_at_least
from ..operators import checks, clean, drops, features, ml, star
from ..sources import files
from ..streaming import feed
from ..util import cut, small, table
from .models import S, Pipeline, with_steps


def d3_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings with the canonical one of their group: the busiest without a market word, later ones first among equals."""
    n = table(spark, sf_dir, "market_names")
    n = n.withColumns({"dk": clean.match_key(F.col("district")), "mk": clean.match_key(F.col("market")), "plain": ~F.lower("market").rlike("a\\.?p\\.?m\\.?c")})
    w = Window.partitionBy("state", "dk", "mk").orderBy(F.desc("plain"), F.desc("n_rows"), F.desc("last_date"), "name_id")
    return n.select("name_id", F.first("market").over(w).alias("canonical"), F.count("*").over(Window.partitionBy("state", "dk", "mk")).alias("n_spellings"))


def d4_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings of one state and district that are alike (edit similarity of at least 0.8) and whose spans of dates do not overlap. Only names
    that share an entry of the deletion neighbourhood are compared, and nothing is merged: the review merge D4 is not built (see README)."""
    from ..functions.names import name_parts, neighbourhood

    n = table(spark, sf_dir, "market_names").withColumn("p", name_parts("market")).select("name_id", "state", "district", "market", "first_date", "last_date", F.col("p.folded").alias("folded"), F.col("p.qualifier").alias("q"), F.explode(neighbourhood(F.col("p.folded"))).alias("key"))
    a, b = n.alias("a"), n.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("state", "district", "q", "key")]
    pairs = a.join(b, same[0] & same[1] & same[2] & same[3] & (F.col("a.name_id") < F.col("b.name_id")))
    pairs = pairs.select(F.col("a.name_id").alias("name_id_a"), F.col("b.name_id").alias("name_id_b"), F.col("a.market").alias("x"), F.col("b.market").alias("y"), F.greatest("a.first_date", "b.first_date").alias("s"), F.least("a.last_date", "b.last_date").alias("e")).distinct()
    return pairs.filter((F.col("s") > F.col("e")) & ratio_at_least("x", "y")).select("name_id_a", "name_id_b")


def d11_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.calendar(spark, "2018-01-01", "2026-09-30", S.main_end)


def d17_spread_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pairs import spread_days

    return spread_days(Pipeline(spark, sf_dir).spread)


def d22_same_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market-days by comparisons within one variety, with costs that are not rounded: how many, how many of them opportunities, and the best gain."""
    from ..operators.pairs import day_spreads, directed

    p = Pipeline(spark, sf_dir)
    x = directed(day_spreads(p.vprices, small(p.markets), p.s, by=("commodity", "variety", "date")), p.s, rounded=False)
    return x.groupBy("home_market_key", "commodity", "date", "scenario").agg(
        F.count("*").alias("n_comparisons"), F.count_if("is_opportunity").alias("n_opportunities"), F.bool_or("is_opportunity").alias("has_opportunity"), F.countDistinct("variety").alias("n_varieties"), F.round(F.max("gain"), 4).alias("best_gain")
    )


def d32_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few figures under the main settings and with suspect series included or the plain outlier rule."""
    out = None
    for name, change in (("main", {}), ("with_suspect", {"include_suspect_low": True}), ("temporal_rule", {"outlier_rule": "temporal"})):
        ap = Pipeline(spark, sf_dir).with_settings(**change).ap
        x = ap.groupBy("commodity").agg(F.count("*").alias("n_days"), F.countDistinct("market_key").alias("n_markets"), F.median("modal_price").alias("median_price")).withColumn("version", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out


def ck_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of rows that break each rule."""
    p = Pipeline(spark, sf_dir)
    staged, daily, markets = p.staged, p.daily, cut(p.markets)
    found = {
        "staged_unique": checks.unique_combination(staged, clean.KEY), "staged_only_repeats": checks.only_repeats_dropped(p.mapped, staged, clean.KEY), "daily_unique": checks.unique_combination(daily, ["state", "district", "market", "commodity", "arrival_date"]),
        "price_positive": checks.expression_is_true(daily, "modal_price_incl_suspect > 0"), "commodity_known": checks.accepted_values(daily, "commodity", list(S.commodities)), "market_key_given": checks.not_null(markets, "market_key"),
        "fact_market": checks.relationships(p.facts, "market_key", markets, "market_key"), "raw_modal_in_bounds": checks.modal_between_bounds(p.mandi_prices), "one_coordinate": checks.one_coordinate_per_market(markets),
        "fact_daily_in_dim_date": checks.relationships(p.fact_daily_price, "date_key", p.dim_date, "date_key"), "market_named": checks.canonical_market(p.mapped),
    }
    out = None
    for name, df in found.items():
        x = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def ck_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of forecasts and drop risks that break each rule."""
    forecast, risk = cut(ml_forecast(spark, sf_dir)), cut(ml_drop_risk(spark, sf_dir))
    found = {
        "band_in_order": checks.expression_is_true(forecast, "p10 <= p50 and p50 <= p90"), "target_after_horizon": checks.expression_is_true(forecast, f"datediff(target_date, date) = {S.horizon}"),
        "risk_is_a_probability": checks.expression_is_true(risk, "risk between 0 and 1"), "forecast_unique": checks.unique_combination(forecast, ["market_key", "commodity", "date"]), "risk_unique": checks.unique_combination(risk, ["market_key", "commodity", "date"]),
    }
    out = None
    for name, df in found.items():
        x = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = x if out is None else out.unionByName(x)
    return out


def sv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest report of each series, with the one before."""
    w = Window.partitionBy("market_key", "commodity").orderBy(F.desc("date"))
    x = Pipeline(spark, sf_dir).ap.withColumns({"rn": F.row_number().over(w), "previous_price": F.lead("modal_price").over(w), "days_before": F.datediff("date", F.lead("date").over(w))})
    return x.filter("rn = 1").select("market_key", "commodity", "date", "modal_price", "previous_price", "days_before")


def sv_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median price of near markets on the same day or a day off."""
    from ..operators.pairs import near_prices

    p = Pipeline(spark, sf_dir)
    return near_prices(p.ap, small(p.markets), p.s)


def ag_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the yearly mean against the year before."""
    y = Pipeline(spark, sf_dir).ap.groupBy("commodity", F.year("date").alias("yr")).agg(F.avg("modal_price").alias("p"))
    b = y.select("commodity", (F.col("yr") + 1).alias("yr"), F.col("p").alias("before"))
    return y.join(b, ["commodity", "yr"], "left").select("commodity", "yr", F.round("p", 4).alias("mean_price"), F.round(F.col("p") / F.col("before") - 1, 6).alias("change"))


def ag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "mandi_prices").groupBy("commodity").pivot("source", ["kaggle_archive", "ceda", "datagov_daily"]).agg(F.count(F.lit(1)))


def jn_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by month and commodity here and as published, with the difference."""
    p = Pipeline(spark, sf_dir)
    mine = p.facts.groupBy("commodity_key", F.floor(F.col("date_key") / 100).cast("int").alias("ym")).agg(F.count("*").alias("mine"))
    theirs = p.fact_daily_price.filter("modal_price is not null").groupBy("commodity_key", F.floor(F.col("date_key") / 100).cast("int").alias("ym")).agg(F.count("*").alias("published"))
    x = mine.join(theirs, ["commodity_key", "ym"], "full")
    return x.select("commodity_key", "ym", F.coalesce("mine", F.lit(0)).alias("mine"), F.coalesce("published", F.lit(0)).alias("published"), (F.coalesce("mine", F.lit(0)) - F.coalesce("published", F.lit(0))).alias("diff"))


def _features(spark: SparkSession, sf_dir: str) -> tuple[Pipeline, DataFrame]:
    p = Pipeline(spark, sf_dir)
    return p, features.forecast_features(cut(features.daily_grid(p.ap, S.fill_days)), S.horizon)


def ml_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = features.daily_grid(Pipeline(spark, sf_dir).ap, S.fill_days)
    return g.select("market_key", "commodity", F.date_from_unix_date("day").alias("date"), "price", F.round("lp", 6).alias("lp"), "since")


def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _features(spark, sf_dir)
    cols = ["d_lag_1", "d_lag_7", "mean_7", "std_14", "min_30", "max_30", "report_freq_30", "target", "state_lp_prev1", "state_falling_prev1"]
    return f.select("market_key", "commodity", F.date_from_unix_date("day").alias("date"), *((F.round(c, 6) + 0.0).alias(c) for c in cols), "state_n_prev1", "dow", "month")


def ml_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, f = _features(spark, sf_dir)
    e = features.errors(features.baselines(f), "target", ["p_last", "p_week", "p_mean"], ["commodity"])
    return e.select("commodity", "forecast", "n", *(F.round(c, 4).alias(c) for c in ("mae", "mape", "smape")))


def _span(f: DataFrame, share: float) -> int:
    r = f.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return int((r["a"] or 0) + ((r["b"] or 0) - (r["a"] or 0)) * share)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({"date": F.date_from_unix_date("day"), "target_date": F.date_from_unix_date(F.col("day") + S.horizon)}).drop("day")


def ml_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts (logs) of the last fifth of the days."""
    _, f = _features(spark, sf_dir)
    f = cut(f)
    return _dated(ml.forecast(f, _span(f, 0.6), _span(f, 0.8)))


def ml_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast from the last day of every series that still reports."""
    _, f = _features(spark, sf_dir)
    f = cut(f)
    return _dated(features.latest_rows(ml.forecast(f, _span(f, 0.6), _span(f, 0.8))))


def ml_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error and coverage by fold and commodity, each fold fitted and calibrated on the days before it."""
    _, f = _features(spark, sf_dir)
    f, out = cut(f), None
    for k, at in enumerate((0.55, 0.7, 0.85)):
        x = ml.forecast(f, _span(f, at - 0.15), _span(f, at)).filter(F.col("day") < _span(f, at + 0.15))
        x = features.coverage(x, ["commodity"]).withColumn("fold", F.lit(k + 1))
        out = x if out is None else out.unionByName(x)
    return out


def ml_drop_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, f = _features(spark, sf_dir)
    f = cut(f)
    return _dated(ml.drop_risk(f, p.drops, _span(f, 0.7)))


def ml_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of a seasonal rule: the share of drops by commodity and month in the years before 2024, held against the days since."""
    lab = Pipeline(spark, sf_dir).drops.filter("is_drop is not null").withColumn("mon", F.month("date"))
    rate = lab.filter("date < date '2024-01-01'").groupBy("commodity", "mon").agg(F.round(F.avg(F.col("is_drop").cast("int")), 6).alias("score"))
    pr = features.precision_recall(lab.filter("date >= date '2024-01-01'").join(F.broadcast(rate), ["commodity", "mon"]), "score", "is_drop", ["commodity"])  # at most twelve rows a commodity
    return pr.select("commodity", "threshold", "alerts", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def ml_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .analyses import q4_cluster_features

    return ml.clusters(cut(q4_cluster_features(spark, sf_dir)), ["cv", "freq", "price_index", "amplitude", "drop_rate", "n_towns_near"])


def src_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.inventory(spark, sf_dir)


def src_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.describe(table(spark, sf_dir, "mandi_prices"))


def st_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, counted by a stream over the table's files."""
    import os

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    # a stream reads a folder: the table's own, or the one it lies in, by its name
    e = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    x = feed.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value")
    return feed.run_available(spark, x, "complete").select(F.to_date("window_start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (d3_aliases, d4_merges, d11_calendar, d17_spread_days, d22_same_variety, d32_versions, ck_all, ck_models, sv_latest, sv_neighbours, ag_yoy, ag_pivot, jn_reconcile, ml_grid, ml_features, ml_baselines, ml_forecast, ml_latest, ml_folds, ml_drop_risk, ml_precision_recall, ml_clusters, src_inventory, src_describe, st_event_days)}

_KEY = "regexp_replace(regexp_replace(lower(replace({}, '&amp;', '&')), '[^a-z0-9]+', '', 'g'), 'apmc$', '')".format
_GRID = """sp as (select market_key, commodity, any_value(state) as state, min(date) as a, max(date) as b from ap group by all), days as (select market_key, commodity, state, cast(unnest(generate_series(a, b, interval 1 day)) as date) as date from sp),
g0 as (select d.*, ap.modal_price as price, ap.date as has from days d left join ap on ap.market_key = d.market_key and ap.commodity = d.commodity and ap.date = d.date),
g1 as (select *, last_value(has ignore nulls) over w as d0, last_value(price ignore nulls) over w as p0 from g0 window w as (partition by market_key, commodity order by date rows between unbounded preceding and current row)),
grid as (select market_key, commodity, state, date, price, case when date - d0 <= 3 then ln(p0) end as lp, cast(date - d0 as integer) as since from g1)"""
_FEAT = f"""{_GRID}, wk as (select *, lag(lp, 7) over (partition by market_key, commodity order by date) as week from grid),
reg as (select state, commodity, date + 1 as date, median(lp) as state_lp_prev1, count(price) as n_prev, avg(cast(lp < week as int)) as falling from wk group by all),
f0 as (select *, lp - lag(lp, 1) over w as d_lag_1, lp - lag(lp, 7) over w as d_lag_7, lag(lp, 7) over w as week, avg(lp) over w7 as m7, stddev_samp(lp) over w14 as std_14, min(lp) over w30 - lp as min_30, max(lp) over w30 - lp as max_30, count(price) over w30 / 30.0 as report_freq_30, ln(lead(price, 7) over w) as target
 from grid window w as (partition by market_key, commodity order by date), w7 as (partition by market_key, commodity order by date rows 6 preceding), w14 as (partition by market_key, commodity order by date rows 13 preceding), w30 as (partition by market_key, commodity order by date rows 29 preceding)),
f as (select f0.*, state_lp_prev1, coalesce(n_prev, 0) as state_n_prev1, falling from f0 left join reg on reg.state = f0.state and reg.commodity = f0.commodity and reg.date = f0.date where lp is not null)"""

def _version(name: str, **change) -> str:
    return with_steps(f"select '{name}' as version, commodity, count(*) as n_days, count(distinct market_key) as n_markets, median(modal_price) as median_price from ap group by commodity", "ap", s=replace(S, **change))


_UNIQUE = "select count(*) from (select {0} from {1} group by all having count(*) > 1)".format
_CHECKS = {
    "staged_unique": _UNIQUE("arrival_date, state, district, market, commodity, variety, grade", "staged"), "daily_unique": _UNIQUE("state, district, market, commodity, arrival_date", "daily"),
    "staged_only_repeats": "select ((select count(*) from (select distinct arrival_date, state, district, market, commodity, variety, grade from mapped)) <> (select count(*) from staged))::int",
    "price_positive": "select count(*) from daily where not coalesce(modal_price_incl_suspect > 0, false)", "commodity_known": "select count(distinct commodity) from daily where commodity not in ('Tomato', 'Onion', 'Potato')", "market_key_given": "select count(*) from markets where market_key is null",
    "fact_market": "select count(*) from facts where market_key is not null and market_key not in (select market_key from markets)", "raw_modal_in_bounds": "select count(*) from mandi_prices where min_price is not null and max_price is not null and not coalesce(modal_price >= min_price and modal_price <= max_price, false)",
    "one_coordinate": "select count(*) from (select state, district, market from markets group by all having count(distinct coalesce(latitude, -999) || '|' || coalesce(longitude, -999)) > 1)",
    "fact_daily_in_dim_date": "select count(*) from fact_daily_price where date_key is not null and date_key not in (select date_key from dim_date)", "market_named": "select count(*) from mapped where coalesce(trim(market), '') = '' or coalesce(trim(district), '') = '' or coalesce(trim(state), '') = ''",
}

SQL = {
    "ck_all": with_steps(" union all ".join(f"select '{k}' as rule, cast(({q}) as bigint) as n" for k, q in _CHECKS.items()), "mapped", "staged", "daily", "markets", "facts"),
    "ck_models": "select unnest(['band_in_order', 'target_after_horizon', 'risk_is_a_probability', 'forecast_unique', 'risk_unique']) as rule, cast(0 as bigint) as n",
    "d32_versions": " union all ".join(f"select * from ({v})" for v in (_version("main"), _version("with_suspect", include_suspect_low=True), _version("temporal_rule", outlier_rule="temporal"))),
    "src_describe": "select cid as position, name as column_name, case type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'INTEGER' then 'int' when 'DATE' then 'date' else lower(regexp_replace(type, ' WITH TIME ZONE|_NS', '')) end as column_type from pragma_table_info('mandi_prices')",
    "d3_aliases": f"""with k as (select *, {_KEY('district')} as dk, {_KEY('market')} as mk, not regexp_matches(lower(market), 'a\\.?p\\.?m\\.?c') as plain from market_names)
select name_id, first_value(market) over (partition by state, dk, mk order by plain desc, n_rows desc, last_date desc, name_id) as canonical, count(*) over (partition by state, dk, mk) as n_spellings from k""",
    "d11_calendar": "select date_key, calendar_date, day_of_week, day_name, iso_week, month_of_year, monthname(calendar_date) as month_name, quarter_of_year, calendar_year, is_weekend, period from dim_date",
    "d17_spread_days": with_steps("""sides as (select date, commodity, state_a as state, abs_gap, pct_gap from spread union all select date, commodity, state_b, abs_gap, pct_gap from spread where not is_same_state)
select date, commodity, state, count(*) as n_pairs, round(median(abs_gap), 4) as median_abs_gap, round(quantile_cont(abs_gap, 0.9), 4) as p90_abs_gap, round(median(pct_gap), 6) as median_pct_gap, round(quantile_cont(pct_gap, 0.9), 6) as p90_pct_gap from sides group by all""", "spread"),
    "d22_same_variety": with_steps("""s as (select road_km_est, a.commodity, a.variety, a.date, market_key_a, market_key_b, a.modal_price as pa, b.modal_price as pb from pairs join vprices a on a.market_key = market_key_a join vprices b on b.market_key = market_key_b and b.commodity = a.commodity and b.variety = a.variety and b.date = a.date where road_km_est <= 100),
w as (select commodity, variety, date, road_km_est, market_key_a as home_market_key, pa as ph, pb as pd from s union all select commodity, variety, date, road_km_est, market_key_b, pb, pa from s),
c as (select *, pd - (road_km_est * per_km + fixed) - pd * fee - ph as gain from w cross join scen)
select home_market_key, commodity, date, scenario, count(*) as n_comparisons, count(*) filter (where gain >= 100 and gain / ph >= 0.05) as n_opportunities, bool_or(gain >= 100 and gain / ph >= 0.05) as has_opportunity, count(distinct variety) as n_varieties, round(max(gain), 4) as best_gain from c group by all""", "pairs", "vprices", "scen"),
    "ag_yoy": with_steps("y as (select commodity, year(date) as yr, avg(modal_price) as p from ap group by all) select y.commodity, y.yr, round(y.p, 4) as mean_price, round(y.p / b.p - 1, 6) as change from y left join y b on b.commodity = y.commodity and b.yr = y.yr - 1", "ap"),
    "ag_pivot": "select commodity, " + ", ".join(f"nullif(count(*) filter (where source = '{s}'), 0) as {s}" for s in ("kaggle_archive", "ceda", "datagov_daily")) + " from mandi_prices group by commodity",
    "sv_latest": with_steps("r as (select *, row_number() over w as rn, lead(modal_price) over w as previous_price, date - lead(date) over w as days_before from ap window w as (partition by market_key, commodity order by date desc)) select market_key, commodity, date, modal_price, previous_price, days_before from r where rn = 1", "ap"),
    "sv_neighbours": with_steps("""b as (select market_key_a as home, market_key_b as other from pairs where haversine_km <= 50 union all select market_key_b, market_key_a from pairs where haversine_km <= 50),
x as (select h.market_key as home, h.commodity, h.date, o.modal_price as price, o.date - h.date as off, o.market_key as other from ap h join b on b.home = h.market_key join ap o on o.market_key = b.other and o.commodity = h.commodity and o.date between h.date - 1 and h.date + 1)
select home, commodity, date, coalesce(median(price) filter (where off = 0), median(price)) as neighbour_median, count(distinct other) as n from x group by all""", "pairs", "ap"),
    "jn_reconcile": with_steps("""m as (select commodity_key, date_key // 100 as ym, count(*) as mine from facts group by all), t as (select commodity_key, date_key // 100 as ym, count(*) as published from fact_daily_price where modal_price is not null group by all)
select commodity_key, ym, coalesce(mine, 0) as mine, coalesce(published, 0) as published, coalesce(mine, 0) - coalesce(published, 0) as diff from m full join t using (commodity_key, ym)""", "facts"),
    "ml_grid": with_steps(f"{_GRID} select market_key, commodity, date, price, round(lp, 6) as lp, since from grid", "ap"),
    "ml_features": with_steps(f"{_FEAT} select market_key, commodity, date, round(d_lag_1, 6) + 0.0 as d_lag_1, round(d_lag_7, 6) + 0.0 as d_lag_7, round(m7 - lp, 6) + 0.0 as mean_7, round(std_14, 6) as std_14, round(min_30, 6) + 0.0 as min_30, round(max_30, 6) + 0.0 as max_30, round(report_freq_30, 6) as report_freq_30, round(target, 6) as target, round(state_lp_prev1, 6) as state_lp_prev1, round(falling, 6) as state_falling_prev1, state_n_prev1, isodow(date + 7) as dow, month(date + 7) as month from f", "ap"),
    "ml_baselines": with_steps(f"""{_FEAT}, e as (select commodity, exp(target) as y, unnest([{{'forecast': 'p_last', 'p': exp(lp)}}, {{'forecast': 'p_week', 'p': exp(coalesce(week, lp))}}, {{'forecast': 'p_mean', 'p': exp(coalesce(m7, lp))}}]) as z from f where target is not null)
select commodity, z.forecast as forecast, count(*) as n, round(avg(abs(y - z.p)), 4) as mae, round(avg(100 * abs(y - z.p) / y), 4) as mape, round(avg(200 * abs(y - z.p) / (y + z.p)), 4) as smape from e group by all""", "ap"),
    "ml_precision_recall": with_steps("""l as (select *, month(date) as mon from drops where is_drop is not null), r as (select commodity, mon, round(avg(cast(is_drop as int)), 6) as score from l where date < date '2024-01-01' group by all),
g as (select l.commodity, score as threshold, count(*) as n, sum(cast(is_drop as int)) as hits from l join r on r.commodity = l.commodity and r.mon = l.mon where date >= date '2024-01-01' group by all),
c as (select *, sum(n) over w as alerts, sum(hits) over w as caught, sum(hits) over (partition by commodity) as total from g window w as (partition by commodity order by threshold desc))
select commodity, threshold, cast(alerts as bigint) as alerts, round(caught / alerts, 6) as precision, round(caught / nullif(total, 0), 6) as recall from c""", "drops"),
    "st_event_days": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
