"""Queries of the analyses and their SQL, which is written apart from the operators."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyses as A
from ..operators.pairs import day_spreads, directed, gap_figures, market_days
from ..util import cut, small
from .models import _NEEDS, S, Pipeline, _sql, with_steps


def q3_same_variety_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of pairs within one variety; its SQL is that of the saved query."""
    p = Pipeline(spark, sf_dir)
    x = day_spreads(p.vprices, small(p.markets), p.s, by=("commodity", "variety", "date")).withColumn("gap", F.col("abs_gap") / F.least("price_a", "price_b"))
    return x.groupBy("commodity", "variety").agg(F.count("*").alias("n"), F.countDistinct("pair_key").alias("n_pairs"), F.round(F.median("gap"), 6).alias("median_gap"))


def q3_gap_by_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of pairs; its SQL is that of the saved query."""
    p = Pipeline(spark, sf_dir)
    return gap_figures(p.spread, p.markets)


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def q2_suspect_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.suspect_series(Pipeline(spark, sf_dir).flags), median_price=2, median_usual=2, median_ratio=4, share_main=4)


def q3_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    return _round(A.opportunity_rates(p.directed, p.mday), market_day_rate=4, median_best_gain=4, avg_neighbors=4, single_rate=4)


def q3_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.concentration(Pipeline(spark, sf_dir).directed_under("mid")), share=4)


def q3_gain_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market-days with an opportunity by their best gain; its SQL is that of the saved query."""
    return A.gain_histogram(market_days(Pipeline(spark, sf_dir).directed_under("mid")))


def _season(p: Pipeline) -> DataFrame:
    return A.seasonality(p.ap, p.drops, p.dim_commodity)


def q3_seasonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_season(Pipeline(spark, sf_dir)), median_price=2, price_index=4, drop_rate=4)


def q3_seasonality_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.seasonality_by_month(_season(Pipeline(spark, sf_dir))), median_index=4, drop_rate=4)


def q3_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.volatility(Pipeline(spark, sf_dir).ap), cv=4, avg_change=4, max_drawdown=4)


def q3_volatility_by_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline(spark, sf_dir)
    g = A.volatility(p.ap).groupBy("commodity").agg(F.count("*").alias("n_series_years"), *(F.round(F.median(c), 4).alias(f"median_{c}") for c in ("cv", "avg_change", "max_drawdown")))
    return g.join(F.broadcast(p.dim_commodity.select("commodity", "category")), "commodity", "left")  # a row per commodity


def _access(p: Pipeline) -> DataFrame:
    return A.district_access(p.ap, p.markets, p.mday, p.s)


def q3_district_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_access(Pipeline(spark, sf_dir)), price_index=4, opportunity_rate=4, opportunity_rate_precise=4)


def q3_access_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(A.access_summary(_access(Pipeline(spark, sf_dir))), rate_thin_and_low=4, rate_others=4)


def q4_cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of series, suspect ones included and marked."""
    p = Pipeline(spark, sf_dir).with_settings(include_suspect_low=True)
    low = p.flags.filter("flag_persistent_low").select("state", "district", "market", "commodity").distinct()
    low = low.join(p.markets.select("state", "district", "market", "market_key"), ["state", "district", "market"]).select("market_key", "commodity", F.lit(True).alias("is_suspect"))
    x = A.series_features(p.ap, p.drops, p.s).join(low, A.SERIES, "left").fillna(False, ["is_suspect"]).drop("level", "state")
    return _round(x, cv=4, freq=4, price_index=4, amplitude=4, drop_rate=4)


def sv_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the last 90 days of the data, and the days before by series and month: their number and median, under the first day of the month."""
    ap = Pipeline(spark, sf_dir).ap
    x = ap.crossJoin(F.broadcast(ap.agg(F.date_sub(F.max("date"), 90).alias("upto")))).select(*A.SERIES, "date", "modal_price", (F.col("date") > F.col("upto")).alias("recent"))  # one row
    days = x.filter("recent").select(*A.SERIES, F.lit("day").alias("grain"), "date", "modal_price", F.lit(1).cast("long").alias("n_days"))
    months = x.filter("not recent").groupBy(*A.SERIES, F.trunc("date", "month").cast("date").alias("date")).agg(F.median("modal_price").alias("modal_price"), F.count("*").alias("n_days"))
    return days.unionByName(months.withColumn("grain", F.lit("month")))


def _versions(name: str, base: DataFrame, precise: DataFrame, suspect: DataFrame, *cols: str) -> DataFrame:
    one = lambda df, v: df.select(*cols, F.lit(v).alias("version"))
    return one(base, "a_default").unionByName(one(precise, "b_no_centroid")).unionByName(one(suspect, "c_incl_suspect"))


def d32_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of gaps, opportunities, drops, access and volatility under four versions: as they are, precisely located places only, suspect series included, and (for
    opportunities) one variety at a time: ``question, metric, commodity, version, value``."""
    p = Pipeline(spark, sf_dir)
    c = p.with_settings(include_suspect_low=True)
    sure = p.markets.filter(~F.col("geo_precision").isin(*A.ROUGH)).select("market_key")
    out: list[DataFrame] = []

    def tell(question: str, df: DataFrame, **metrics) -> None:
        g = df.groupBy("commodity", "version").agg(*(v.alias(k) for k, v in metrics.items()))
        out.append(g.select(F.lit(question).alias("question"), "commodity", "version", F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in metrics)))))

    both = F.col("pair_precision") == "both_market"
    gaps = _versions("q1", p.spread, p.spread.filter(both), c.spread, "commodity", "pct_gap", "abs_gap")
    tell("Q1", gaps, median_pct_gap=F.median("pct_gap") * 100, median_abs_gap=F.median("abs_gap"), p90_pct_gap=F.percentile("pct_gap", 0.9) * 100)

    one = directed(day_spreads(p.vprices, small(p.markets), p.s, by=("commodity", "variety", "date")), p.s, rounded=False)
    one = one.groupBy("home_market_key", "commodity", "date", "scenario").agg(F.bool_or("is_opportunity").alias("has_opportunity"), F.count_if("is_opportunity").alias("hits"), F.count("*").alias("n"))
    one = cut(one).withColumn("version", F.lit("d_same_variety"))
    precise = p.mday.filter("n_neighbors_market_precision > 0").withColumns({"has_opportunity": F.col("has_opportunity_market_precision"), "best_opportunity_gain": F.lit(None).cast("double")})
    days = _versions("q2", p.mday, precise, c.mday, "commodity", "scenario", "has_opportunity", "best_opportunity_gain").unionByName(one.select("commodity", "scenario", "has_opportunity", F.lit(None).cast("double").alias("best_opportunity_gain"), "version"))
    hits = F.col("is_opportunity").cast("long")
    single = lambda d: d.groupBy("commodity", "scenario").agg(F.sum(hits).alias("hits"), F.count("*").alias("n"))
    singles = _versions("q2", single(p.directed), single(p.directed.filter(both)), single(c.directed), "commodity", "scenario", "hits", "n").unionByName(one.select("commodity", "scenario", "hits", "n", "version"))
    with_all = lambda d: d.withColumn("commodity", F.explode(F.array("commodity", F.lit("All"))))
    is_ = lambda k: F.col("scenario") == k
    tell("Q2", with_all(days), **{f"opportunity_rate_pct_{k}": 100 * F.avg(F.when(is_(k), F.col("has_opportunity").cast("int"))) for k in p.s.scenarios}, median_best_gain_mid=F.median(F.when(is_("mid") & F.col("has_opportunity"), F.col("best_opportunity_gain"))))
    tell("Q2", with_all(singles), **{f"single_rate_pct_{k}": 100 * F.try_divide(F.sum(F.when(is_(k), F.col("hits"))), F.sum(F.when(is_(k), F.col("n")))) for k in p.s.scenarios})

    lab = lambda q: q.drops.filter("is_drop is not null")
    falls = _versions("q3", lab(p), lab(p).join(sure, "market_key", "left_semi"), lab(c), "commodity", "date", "is_drop")
    tell("Q3", falls, drop_rate_pct=100 * F.avg(F.col("is_drop").cast("int")))
    month = falls.groupBy("commodity", "version", F.month("date").alias("mon")).agg(F.avg(F.col("is_drop").cast("int")).alias("rate"))
    tell("Q3", month, drop_rate_pct_peak_month=100 * F.max("rate"), peak_month=-F.max(F.struct("rate", (-F.col("mon")).alias("m")))["m"])

    near, near_c = cut(_access(p)), _access(c)
    access = _versions("q4", near, near.withColumn("thin_and_low", F.col("thin_and_low_precise")), near_c, "state", "district", "commodity", "thin_and_low")
    tell("Q4", with_all(access), n_thin_and_low=F.count_if("thin_and_low"), n_series=F.count("*"), n_districts=F.countDistinct(F.when(F.col("thin_and_low"), F.struct("state", "district"))))

    vol = A.volatility(p.ap, p.s)
    swings = _versions("q5", vol, vol.join(sure, "market_key", "left_semi"), A.volatility(c.ap, c.s), "commodity", "cv", "avg_change")
    tell("Q5", swings, median_cv=F.median("cv"), median_change_pct=100 * F.median("avg_change"))
    x = out[0]
    for df in out[1:]:
        x = x.unionByName(df)
    return x.filter("value is not null").select("question", "metric", "commodity", "version", F.round("value", 3).alias("value"))


QUERIES = {f.__name__: f for f in (q2_suspect_low, q3_gap_by_commodity, q3_same_variety_days, q3_rate, q3_concentration, q3_gain_histogram, q3_seasonality, q3_seasonality_by_month, q3_volatility, q3_volatility_by_commodity, q3_district_access, q3_access_summary, q4_cluster_features, sv_recent, d32_robustness)}

_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, power(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * power(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))".format
_VOL = f"""v1 as (select *, year(date) as yr, row_number() over w as rn, lag(date) over w as d0, lag(modal_price) over w as p0 from ap window w as (partition by market_key, commodity, year(date) order by date)),
vol as (select a.market_key, a.commodity, a.state, a.yr, count(*) as n_days, stddev_samp(a.modal_price) / avg(a.modal_price) as cv, avg(abs(a.modal_price / a.p0 - 1)) filter (where a.date - a.d0 <= {S.fill_days}) as avg_change,
 max((top - a.modal_price) / top) as max_drawdown from (select *, max(modal_price) over (partition by market_key, commodity, yr order by rn rows unbounded preceding) as top from v1) a group by all having count(*) >= {S.year_min_days})"""
_ACCESS = f"""spots as (select distinct state, district, market_key, town_key, latitude, longitude from markets where has_valid_data and town_key is not null),
centre as (select state, district, avg(latitude) as latitude, avg(longitude) as longitude from spots group by all),
shops as (select distinct town_key, latitude, longitude, commodity, geo_precision not in ('district_centroid', 'not_found') as ok from ap where town_key is not null),
nt as (select c.state, c.district, t.commodity, count(distinct town_key) as n, count(distinct town_key) filter (where ok) as np from centre c join shops t on {_KM(a='c', b='t')} <= {S.near_km} group by all),
rel as (select distinct state, district, commodity, date, median(modal_price) over (partition by state, district, commodity, date) / median(modal_price) over (partition by state, commodity, date) as q from ap),
ri as (select state, district, commodity, avg(q) as price_index, count(*) as n_price_days from rel group by all),
ro as (select m.state, m.district, d.commodity, count(*) as n_market_days, avg(has_opportunity::int) as opportunity_rate, avg(has_opportunity_market_precision::int) filter (where n_neighbors_market_precision > 0) as opportunity_rate_precise
 from mday d join markets m on m.market_key = d.home_market_key where scenario = 'mid' group by all),
access as (select ri.state, ri.district, ri.commodity, coalesce(nt.n, 0) as n_towns, coalesce(nt.np, 0) as n_towns_precise, price_index, n_price_days, n_market_days, opportunity_rate, opportunity_rate_precise,
 coalesce(nt.n, 0) <= {S.thin_towns} and price_index < {S.low_index} as thin_and_low, coalesce(nt.np, 0) <= {S.thin_towns} and price_index < {S.low_index} as thin_and_low_precise
 from ri left join nt on nt.state = ri.state and nt.district = ri.district and nt.commodity = ri.commodity left join ro on ro.state = ri.state and ro.district = ri.district and ro.commodity = ri.commodity)"""
_SEASON = """sm as (select distinct commodity, state, year(date) as yr, month(date) as mon, median(modal_price) over (partition by commodity, state, year(date), month(date)) / median(modal_price) over (partition by commodity, state, year(date)) as idx from ap),
season as (select a.commodity, a.state, a.mon, strftime(make_date(2000, a.mon, 1), '%b') as month_name, a.n as n_market_days, a.med as median_price, (select median(idx) from sm where sm.commodity = a.commodity and sm.state = a.state and sm.mon = a.mon) as price_index,
 (select count(*) from sm where sm.commodity = a.commodity and sm.state = a.state and sm.mon = a.mon) as n_years, l.nl as n_labelled, l.nd as n_drops, l.nd / l.nl as drop_rate, category
 from (select commodity, state, cast(month(date) as int) as mon, count(*) as n, median(modal_price) as med from ap group by all) a left join (select commodity, state, cast(month(date) as int) as mon, count(*) as nl, count(*) filter (where is_drop) as nd from drops where is_drop is not null group by all) l on l.commodity = a.commodity and l.state = a.state and l.mon = a.mon
 left join dim_commodity c on c.commodity = a.commodity)"""
_WITH_LOW = replace(S, include_suspect_low=True)


def _twice(query: str, names: str, again: str) -> str:
    """SQL of ``query`` after the steps ``names``, and after those of ``again`` once more under names ending in _c, suspect series included."""
    differ, low, order = {"ap", "vprices"}, _sql(_WITH_LOW), []
    while more := {k for k, v in _NEEDS.items() if set(v.split()) & differ} - differ:
        differ |= more

    def need(n: str) -> None:
        for m in _NEEDS.get(n, "").split():
            need(m)
        if n in differ and n not in order:
            order.append(n)

    for n in again.split():
        need(n)
    named = lambda text: re.sub(r"\b(from|join) (" + "|".join(sorted(differ, key=len, reverse=True)) + r")\b", r"\1 \2_c", text)
    steps = ",\n".join(f"{n}_c as materialized ({named(low[n])})" for n in order)
    return with_steps(f"{steps},\n{query}", *names.split())


def _other(text: str, names: str) -> str:
    """Steps in ``text`` renamed to read and be the ones with suspect series."""
    return re.sub(r"\b(" + "|".join(names.split()) + r")\b", r"\1_c", text)


_V = "select *, 'a_default' as version from {0} union all by name select *, 'b_no_centroid' as version from {1} union all by name select *, 'c_incl_suspect' as version from {2}".format
_ROBUST = f"""{_VOL},
{_other(_VOL, 'v1 vol ap')},
{_ACCESS},
{_other(_ACCESS, 'centre spots shops nt rel ri ro access ap mday')},
sure as (select market_key from markets where geo_precision not in ('district_centroid', 'not_found')),
g as ({_V("(select commodity, pct_gap, abs_gap from spread)", "(select commodity, pct_gap, abs_gap from spread where pair_precision = 'both_market')", "(select commodity, pct_gap, abs_gap from spread_c)")}),
sv as (select road_km_est, a.commodity, a.date, market_key_a as ka, market_key_b as kb, a.modal_price as pa, b.modal_price as pb from pairs join vprices a on a.market_key = market_key_a join vprices b on b.market_key = market_key_b and b.commodity = a.commodity and b.variety = a.variety and b.date = a.date where road_km_est <= {S.spread_km}),
sw as (select commodity, date, ka as home, road_km_est, pa as ph, pb as pd from sv union all select commodity, date, kb, road_km_est, pb, pa from sv),
sd as (select home, commodity, date, scenario, count(*) as n, count(*) filter (where g >= {S.gain_min} and g / ph >= {S.gain_min_share}) as hits from (select *, pd - (road_km_est * per_km + fixed) - pd * fee - ph as g from sw cross join scen) group by all),
q2 as ({_V("(select commodity, scenario, has_opportunity as o, best_opportunity_gain as gain from mday)", "(select commodity, scenario, has_opportunity_market_precision as o, null::double as gain from mday where n_neighbors_market_precision > 0)", "(select commodity, scenario, has_opportunity as o, best_opportunity_gain as gain from mday_c)")} union all by name select commodity, scenario, hits > 0 as o, null::double as gain, 'd_same_variety' as version from sd),
q2a as (select * from q2 union all select 'All', * exclude (commodity) from q2),
s2 as ({_V("(select commodity, scenario, is_opportunity::int as h, 1 as n from directed)", "(select commodity, scenario, is_opportunity::int as h, 1 as n from directed where pair_precision = 'both_market')", "(select commodity, scenario, is_opportunity::int as h, 1 as n from directed_c)")} union all by name select commodity, scenario, hits as h, n, 'd_same_variety' as version from sd),
s2a as (select * from s2 union all select 'All', * exclude (commodity) from s2),
q3 as ({_V("(select commodity, month(date) as mon, is_drop from drops where is_drop is not null)", "(select commodity, month(date) as mon, is_drop from drops where is_drop is not null and market_key in (select market_key from sure))", "(select commodity, month(date) as mon, is_drop from drops_c where is_drop is not null)")}),
q3r as (select commodity, version, mon, avg(is_drop::int) as r from q3 group by all), q3m as (select *, row_number() over (partition by commodity, version order by r desc, mon) as k from q3r),
q4 as ({_V("(select state, district, commodity, thin_and_low as t from access)", "(select state, district, commodity, thin_and_low_precise as t from access)", "(select state, district, commodity, thin_and_low as t from access_c)")}),
q4a as (select * from q4 union all select * replace ('All' as commodity) from q4),
q5 as ({_V("(select commodity, cv, avg_change from vol)", "(select commodity, cv, avg_change from vol where market_key in (select market_key from sure))", "(select commodity, cv, avg_change from vol_c)")}),
r as (select 'Q1' as question, 'median_pct_gap' as metric, commodity, version, 100 * median(pct_gap) as value from g group by all union all select 'Q1', 'median_abs_gap', commodity, version, median(abs_gap) from g group by all union all select 'Q1', 'p90_pct_gap', commodity, version, 100 * quantile_cont(pct_gap, 0.9) from g group by all
union all select 'Q2', 'opportunity_rate_pct_' || scenario, commodity, version, 100 * avg(o::int) from q2a group by commodity, version, scenario union all select 'Q2', 'median_best_gain_mid', commodity, version, median(gain) from q2a where scenario = 'mid' and o group by commodity, version
union all select 'Q2', 'single_rate_pct_' || scenario, commodity, version, 100 * sum(h) / sum(n) from s2a group by commodity, version, scenario
union all select 'Q3', 'drop_rate_pct', commodity, version, 100 * avg(is_drop::int) from q3 group by all union all select 'Q3', 'drop_rate_pct_peak_month', commodity, version, 100 * r from q3m where k = 1 union all select 'Q3', 'peak_month', commodity, version, mon from q3m where k = 1
union all select 'Q4', 'n_thin_and_low', commodity, version, count(*) filter (where t) from q4a group by all union all select 'Q4', 'n_series', commodity, version, count(*) from q4a group by all union all select 'Q4', 'n_districts', commodity, version, count(distinct state || '|' || district) filter (where t) from q4a group by all
union all select 'Q5', 'median_cv', commodity, version, median(cv) from q5 group by all union all select 'Q5', 'median_change_pct', commodity, version, 100 * median(avg_change) from q5 group by all)
select question, metric, commodity, version, round(value, 3) as value from r where value is not null"""

SQL = {
    "q2_suspect_low": with_steps("""s as (select * from flags where flag_persistent_low), k as (select state, district, market, commodity, variety, grade, count(*) as n from s group by all)
select s.state, s.district, s.market, s.commodity, count(*) as n_low, count(distinct arrival_date) as n_days, min(arrival_date) as first_date, max(arrival_date) as last_date, round(median(modal_price), 2) as median_price, round(median(state_median), 2) as median_usual, round(median(modal_price / state_median), 4) as median_ratio,
 arg_max(s.variety, s.variety) filter (where s.variety = t.variety) as main_variety, max(t.grade) as main_grade, round(max(t.n) / count(*), 4) as share_main
from s join (select * from k qualify row_number() over (partition by state, district, market, commodity order by n desc, variety, grade) = 1) t on t.state = s.state and t.district = s.district and t.market = s.market and t.commodity = s.commodity group by s.state, s.district, s.market, s.commodity""", "flags"),
    "q3_rate": with_steps("""select scenario, commodity, count(*) as n_market_days, round(count(*) filter (where has_opportunity) / count(*), 4) as market_day_rate, round(quantile_cont(best_opportunity_gain, 0.5), 4) as median_best_gain, round(sum(n_neighbors_reporting) / count(*), 4) as avg_neighbors,
 (select round(avg(is_opportunity::int), 4) from directed d where d.scenario = mday.scenario and d.commodity = mday.commodity) as single_rate from mday group by scenario, commodity""", "mday", "directed"),
    "q3_concentration": with_steps("""o as (select dest_market_key, count(*) as n from directed where scenario = 'mid' and is_opportunity group by all), l as (select list(n order by n desc, dest_market_key) as v from o),
c as (select unnest([{'slice': 'top 10', 'k': 10}, {'slice': 'top 5 %', 'k': ceil(len(v) * 0.05)}, {'slice': 'top 20 %', 'k': ceil(len(v) * 0.2)}], recursive := true), v from l where len(v) > 0)
select slice, round(list_sum(v[1:cast(k as int)]) / list_sum(v), 4) as share from c""", "directed"),
    "q3_seasonality": with_steps(f"{_SEASON} select * replace (round(median_price, 2) as median_price, round(price_index, 4) as price_index, round(drop_rate, 4) as drop_rate) from season", "ap", "drops"),
    "q3_seasonality_by_month": with_steps(f"{_SEASON} select commodity, mon, month_name, round(median(price_index), 4) as median_index, cast(sum(n_labelled) as bigint) as n_labelled, cast(sum(n_drops) as bigint) as n_drops, round(sum(n_drops) / sum(n_labelled), 4) as drop_rate from season group by all", "ap", "drops"),
    "q3_volatility": with_steps(f"{_VOL} select * replace (round(cv, 4) as cv, round(avg_change, 4) as avg_change, round(max_drawdown, 4) as max_drawdown) from vol", "ap"),
    "q3_volatility_by_commodity": with_steps(f"{_VOL} select commodity, category, count(*) as n_series_years, round(median(cv), 4) as median_cv, round(median(avg_change), 4) as median_avg_change, round(median(max_drawdown), 4) as median_max_drawdown from vol left join dim_commodity using (commodity) group by all", "ap"),
    "q3_district_access": with_steps(f"{_ACCESS} select * replace (round(price_index, 4) as price_index, round(opportunity_rate, 4) as opportunity_rate, round(opportunity_rate_precise, 4) as opportunity_rate_precise) from access", "ap", "markets", "mday"),
    "q3_access_summary": with_steps(f"""{_ACCESS} select commodity, count(*) as n_districts, sum(thin_and_low::int)::bigint as n_thin_and_low, sum((n_towns <= 2)::int)::bigint as n_thin, sum((price_index < 0.9)::int)::bigint as n_low, round(avg(case when thin_and_low then opportunity_rate end), 4) as rate_thin_and_low,
 round(avg(case when not thin_and_low then opportunity_rate end), 4) as rate_others from access group by all""", "ap", "markets", "mday"),
    "q4_cluster_features": with_steps(f"""k as (select market_key, commodity, count(*) as n_days, stddev_samp(modal_price) / avg(modal_price) as cv, count(*) / (max(date) - min(date) + 1) as freq, median(modal_price) as med, any_value(town_key) as town_key, any_value(latitude) as latitude, any_value(longitude) as longitude from ap group by all),
ix as (select market_key, commodity, avg(q) as price_index from (select market_key, commodity, modal_price / median(modal_price) over (partition by state, commodity, date) as q from ap) group by all),
am as (select market_key, commodity, max(m) - min(m) as swing from (select market_key, commodity, month(date), median(modal_price) as m from ap group by all) group by all),
dr as (select market_key, commodity, avg(is_drop::int) as r from drops where is_drop is not null group by all),
lo as (select distinct m.market_key, f.commodity from flags f join markets m on m.state = f.state and m.district = f.district and m.market = f.market where flag_persistent_low)
select k.market_key, k.commodity, n_days, round(cv, 4) as cv, round(freq, 4) as freq, round(price_index, 4) as price_index, round(swing / med, 4) as amplitude, round(coalesce(r, 0), 4) as drop_rate,
 (select count(distinct b.town_key) from k b where b.commodity = k.commodity and b.town_key <> k.town_key and {_KM(a='k', b='b')} <= {S.near_km}) as n_towns_near, exists (select 1 from lo where lo.market_key = k.market_key and lo.commodity = k.commodity) as is_suspect
from k join ix using (market_key, commodity) join am using (market_key, commodity) left join dr using (market_key, commodity) where n_days >= {S.series_min_days}""", "ap", "drops", "flags", "markets", s=_WITH_LOW),
    "sv_recent": with_steps("""l as (select max(date) - 90 as upto from ap) select market_key, commodity, 'day' as grain, date, modal_price, cast(1 as bigint) as n_days from ap where date > (select upto from l)
union all select market_key, commodity, 'month', cast(date_trunc('month', date) as date), median(modal_price), count(*) from ap where date <= (select upto from l) group by all""", "ap"),
    "d32_robustness": _twice(_ROBUST, "ap markets mday directed spread pairs vprices drops scen", "ap mday directed spread drops"),
}
