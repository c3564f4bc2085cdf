"""Steps of the price pipeline, checks, files and streams on small fixtures."""

import datetime as dt
import random
import re
import statistics
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haatgrid.operators import checks, clean, drops, features, pairs, quality, star
from haatgrid.operators.aliases import resolve_markets
from haatgrid.settings import Settings
from haatgrid.sources import files
from haatgrid.sources.pages import pages
from haatgrid.streaming import feed
from haatgrid.util import cut, small

D = dt.date(2024, 1, 1)
RAW = "raw_id long, state string, district string, market string, commodity string, variety string, grade string, arrival_date date, min_price double, max_price double, modal_price double, source string, ingested_at timestamp"


def raw(spark, rows):
    at = dt.datetime(2024, 6, 1)
    full = [(i, "S", "D", *r[:2], "v", "g", D + dt.timedelta(r[2]), *map(lambda x: None if x is None else float(x), r[3:6]), "src", at + dt.timedelta(r[6] if len(r) > 6 else 0)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RAW)


def known(spark, names):
    return spark.createDataFrame([("S", "D", n) for n in names], "state string, district string, market string")


def test_scope_and_repeats(spark):
    r = raw(spark, [("A", "Onion", 0, 1, 3, 2), ("A APMC", "Onion", 0, 1, 3, 5, 1), ("A", "Onion Green", 0, 1, 3, 2), ("A", "Onion", 1, 1, 3, None), (" ", "Onion", 1, 1, 3, 2), ("B", "Onion", 0, 1, 3, 2), ("A", "Onion", 700, 1, 3, 2)])
    s = clean.last_received(clean.mapped(clean.scope(r), known(spark, ["A"])))
    got = {(x["market"], x["arrival_date"], x["modal_price"], x["period"]) for x in s.collect()}
    assert got == {("A", D, 5.0, "main"), ("B", D, 2.0, "main"), ("A", D + dt.timedelta(700), 2.0, "post_format_change")}
    assert checks.unique_combination(s, clean.KEY).count() == 0
    assert clean.scope(r.limit(0)).count() == 0


def test_flags_and_daily_prices(spark):
    rows = [(m, "Onion", d, 90, 110, 100) for m in "ABC" for d in range(10)]
    rows += [("A", "Onion", 10, 0, 0, 100), ("B", "Onion", 10, 120, 110, 115), ("C", "Onion", 10, 900, 1100, 1000), ("A", "Onion", 11, 10, 30, 20), ("B", "Onion", 11, None, None, -5)]
    s = clean.mapped(clean.scope(raw(spark, rows)), known(spark, ["A", "B", "C"]))
    f = quality.flags(s)
    got = {(x["market"], (x["arrival_date"] - D).days): x for x in f.filter("arrival_date > date '2024-01-10'").collect()}
    assert got["A", 10]["is_valid"] and got["A", 10]["min_price"] is None and got["A", 10]["is_min_max_placeholder"]
    assert got["B", 10]["flag_order"] and not got["B", 10]["is_valid"]
    assert got["C", 10]["flag_outlier"] and got["A", 11]["flag_unit_suspect"] and got["B", 11]["flag_nonpositive"]
    # prices out of bounds are not in the baseline, so they have no history of their own on that day
    assert quality.flags(s, Settings(outlier_rule="temporal")).filter("flag_outlier").count() == 1
    d = quality.daily_prices(f)
    one = d.filter("market = 'A' and arrival_date = date '2024-01-11'").first()
    assert one["modal_price"] == 100 and one["min_price"] is None and one["source"] == "src"
    with pytest.raises(ValueError):
        Settings(outlier_rule="other")


def prices(spark, rows):
    return spark.createDataFrame([(m, "Onion", "S", D + dt.timedelta(d), float(p)) for m, d, p in rows], "market_key string, commodity string, state string, date date, modal_price double")


def test_drop_labels_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [("m", d, rnd.choice([100, 60, 100, 100])) for d in range(60) if rnd.random() < 0.7]
    s = Settings()
    got = {(x["date"] - D).days: x for x in drops.drop_labels(prices(spark, rows)).collect()}
    last = max(d for _, d, _ in rows)
    for _, d, _ in rows:
        back = sorted(p for _, e, p in rows if d - s.drop_lookback < e <= d)
        med = (back[(len(back) - 1) // 2] + back[len(back) // 2]) / 2
        ahead = [p for _, e, p in rows if d < e <= d + s.drop_horizon]
        want = None if len(back) < 5 or not ahead or d > last - s.drop_horizon else sum(p < 0.7 * med for p in ahead) >= 2
        assert (got[d]["lookback_median"], got[d]["n_future_obs"], got[d]["is_drop"]) == (med, len(ahead), want)


def test_features_do_not_look_ahead(spark):
    rnd = random.Random(3)
    rows = [(m, d, 1000 * rnd.uniform(0.8, 1.2)) for m in ("a", "b", "c") for d in range(120) if rnd.random() < 0.7]
    cut = 80
    shocked = [(m, d, p * 5 if d > cut else p) for m, d, p in rows]
    known_cols = [c for c in features.forecast_features(features.daily_grid(prices(spark, rows))).columns if c not in ("target", "price")]
    day = (D - dt.date(1970, 1, 1)).days + cut
    a, b = ({tuple(r) for r in features.forecast_features(features.daily_grid(prices(spark, x))).filter(F.col("day") <= day).select(known_cols).collect()} for x in (rows, shocked))
    assert a == b and a
    g = features.daily_grid(prices(spark, [("a", 0, 10), ("a", 9, 20)]))
    assert [x["lp"] is None for x in g.orderBy("day").collect()] == [False] * 4 + [True] * 5 + [False]


def test_conformal_rank_and_thresholds(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 10)], "k string, y double").withColumns({"lo": F.lit(100.0), "hi": F.lit(0.0)})
    w = features.conformal_width(df.withColumn("lo", F.lit(-100.0)), "y", "lo", "hi", ["k"]).first()
    assert (w["width"], w["n"]) == (8.0, 9)  # rank ceil(10 * 0.8)
    pr = features.precision_recall(spark.createDataFrame([("a", 0.9, True), ("a", 0.8, False), ("a", 0.7, True), ("a", 0.1, False)], "k string, s double, t boolean"), "s", "t", ["k"])
    assert features.alert_threshold(pr, ["k"]).first()["threshold"] == 0.7
    assert features.average_precision(pr, ["k"]).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_spreads_do_not_depend_on_order_and_costs_order_gains(spark):
    p = spark.createDataFrame([("k", "a", "b", "S", "S", 10.0, 13.0, "both_market", True)], "pair_key string, market_key_a string, market_key_b string, state_a string, state_b string, haversine_km double, road_km_est double, pair_precision string, is_same_state boolean")
    x = prices(spark, [("a", 0, 1000), ("b", 0, 1500), ("a", 1, 900)])
    s = pairs.spreads(x, p)
    assert [(r["abs_gap"], r["pct_gap"]) for r in s.collect()] == [(500.0, 0.5)]
    d = {(r["home_market_key"], r["scenario"]): r for r in pairs.directed(s).collect()}
    assert len(d) == 6 and d["a", "low"]["gain"] >= d["a", "mid"]["gain"] >= d["a", "high"]["gain"]
    assert d["a", "mid"]["gain"] == 1500 - 69.5 - 90 - 1000 and d["a", "mid"]["is_opportunity"] and not d["b", "mid"]["is_opportunity"]


def test_resolve_markets(spark):
    m = known(spark, ["Ambaganj", "Ambiganj", "Kolan (Main Yard)", "Kolan (Sub Yard)"])
    s = known(spark, ["Ambaganj", "AMBAGANJ, A.P.M.C.", "Ambagnaj", "Kolan S.Y.", "Main Yard, Kolan", "Unheard"]).unionByName(spark.createDataFrame([(None, None, None)], m.schema))
    ids = {r["market"]: r["market_id"] for r in resolve_markets(s, m).collect()}
    assert len(ids) == 7 and ids["Ambaganj"] == ids["AMBAGANJ, A.P.M.C."] == ids["Ambagnaj"]
    assert len({ids["Ambaganj"], ids["Kolan S.Y."], ids["Main Yard, Kolan"], ids["Unheard"]}) == 4
    assert resolve_markets(s.limit(0), m).count() == 0


def test_resolve_markets_broadcasts_nothing(spark):
    """The deletion neighbourhood has thirty rows a market, so its size can't be told from that of the table."""
    m, s = cut(known(spark, ["Ambaganj", "Kolan"])), cut(known(spark, ["Ambaganj", "Kolam"]))  # files, whose size the planner knows
    x = resolve_markets(s, m)
    assert x.count() == 2 and "BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString()


def test_spellings_meet_markets_of_near_districts_only(spark):
    """By state alone the candidates grow with the square of its names."""
    m = spark.createDataFrame([("S", d, "Ambaganj") for d in ("Duniravar", "Duniraval", "Goruluvar")], "state string, district string, market string")
    s = spark.createDataFrame([("S", "Duniravr", "Ambagnaj"), ("S", "Goruluvr", "Ambagnaj"), ("S", "Elsewhere", "Ambagnaj")], m.schema)
    x = resolve_markets(s, m)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(fs#\d+, kd#\d+, q#\d+, key#\d+", plan) and "first(" not in plan  # nor are candidates shuffled to tell repeats
    ids, known_ids = ({r["district"]: r["market_id"] for r in df.collect()} for df in (x, resolve_markets(m, m)))
    assert ids["Duniravr"] == known_ids["Duniravar"] and ids["Goruluvr"] == known_ids["Goruluvar"] and ids["Elsewhere"] not in known_ids.values()


def test_large_side_is_not_broadcast(spark):
    x, side = spark.range(5), spark.range(3)
    plan = lambda rows: x.join(small(side, rows), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(3) and "BroadcastHashJoin" not in plan(2)


def test_cut_frees_shuffle_files(spark):
    """At most a moment after a frame is stored, the shuffle files of its plan are gone."""
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    known_shuffles = lambda: tracker.shuffleStatuses().size()
    for _ in range(2):
        cut(spark.range(1))
        time.sleep(1)
    before = known_shuffles()
    x = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    time.sleep(1)
    assert known_shuffles() <= before and x.count() == 7


def test_dimension_counts_unlocated_markets_as_one_town(spark):
    s = known(spark, ["A", "B", "C", "E"]).withColumn("arrival_date", F.lit(D))
    geo = spark.createDataFrame([("S", "D", "A", 1.0, 2.0, "town"), ("S", "D", "B", 1.0, 2.0, "town")], "state string, district string, market string, latitude double, longitude double, geo_precision string")
    got = {r["market"]: r for r in star.market_dimension(s, s.filter("market <> 'E'"), star.merge_overrides(geo, geo.filter("market = 'B'"))).collect()}
    assert [got[m]["n_markets_in_town"] for m in "ABCE"] == [2, 2, 2, 2] and got["B"]["geo_precision"] == "manual" and not got["E"]["has_valid_data"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 3.0, 2.0), (1, "b", 1.0, 3.0, 4.0), (None, None, None, 3.0, 9.0)], "id int, k string, min_price double, max_price double, modal_price double")
    assert checks.unique_combination(df, ["id"]).count() == 1 and checks.expression_is_true(df, "id = 1").count() == 1 and checks.not_null(df, "k").count() == 1
    assert checks.accepted_values(df, "k", ["a"]).count() == 1 and checks.modal_between_bounds(df).count() == 1
    assert checks.relationships(df, "k", df.filter("k = 'a'"), "k").count() == 1
    assert checks.only_repeats_dropped(df, df.limit(2), ["k"]).count() == 1


def test_files(spark, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.createDataFrame([(1, "2024-01-01")], "p long, d string").write.parquet(a)
    spark.createDataFrame([(2.5, "x", 9)], "p double, d string, extra int").write.parquet(b)
    schema = T.StructType([T.StructField("p", T.DoubleType()), T.StructField("d", T.DateType()), T.StructField("q", T.StringType())])
    got = files.scan_parquet(spark, [a, b], schema).orderBy("p").collect()
    assert [(r["p"], r["d"], r["q"]) for r in got] == [(1.0, D, None), (2.5, None, None)]
    assert {r["format"] for r in files.inventory(spark, a).collect()} >= {"parquet"}
    t, log = str(tmp_path / "t"), str(tmp_path / "log")
    load = lambda n: (lambda: spark.range(n).withColumn("source", F.lit("s")))
    files.replace_source(spark, t, "s", load(3), log)
    files.replace_source(spark, t, "s", load(5), log)
    with pytest.raises(Exception):
        files.replace_source(spark, t, "s", lambda: spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), log)
    assert spark.read.parquet(f"{t}/source=s").count() == 5
    assert sorted(r["status"] for r in spark.read.parquet(log).collect()) == ["failed", "success", "success"]
    m = files.export({"x": spark.range(4)}, str(tmp_path / "out")).collect()
    assert {(r["format"], r["n_rows"]) for r in m} == {("parquet", 4), ("csv", 4)} and all(r["n_bytes"] > 0 for r in m)
    assert files.scan_csv(spark, str(tmp_path / "out/x.csv")).count() == 4


def test_pages():
    data, calls = list(range(25)), []

    def fetch(offset, size):
        calls.append(offset)
        if len(calls) == 2:
            return 503, []
        return 200, [{"x": v} for v in data[offset : offset + 7]]

    assert [r["x"] for r in pages(fetch, 10, wait=0)] == data
    with pytest.raises(OSError):
        list(pages(lambda o, s: (404, []), wait=0))
    with pytest.raises(OSError):
        list(pages(lambda o, s: (200, [{}]), most=3, wait=0))


def test_stream_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1 + i % 3, i % 24), "a" if i % 2 else "b", float(i)) for i in range(40)]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    got = feed.run_available(spark, feed.windowed_counts(s, "ts", ["k"], "v"), "complete")
    assert got.agg(F.sum("n"), F.sum("total")).first()[:] == (40, float(sum(range(40)))) and got.count() == 6


def test_core_does_not_need_llm():
    import re
    from pathlib import Path

    root = Path(checks.__file__).parent.parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", p.read_text(), re.M), p


def test_misspelt_steps_are_no_tables(spark):
    from haatgrid.plans.models import Pipeline

    with pytest.raises(AttributeError):
        Pipeline(spark, "/nowhere").stagged


def test_written_steps_can_be_released(spark):
    from haatgrid import util

    df = util.cut(spark.range(5))
    path = util._WRITTEN[-1]
    assert df.count() == 5 and util.exists(spark, path)
    util.release(spark)
    assert not util.exists(spark, path) and not util._WRITTEN


def test_a_cluster_must_name_its_shared_folder():
    from haatgrid import util

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        util.shared_dir(Session())


def test_series_and_districts_without_data(spark):
    from haatgrid.operators import analyses as A

    p = spark.createDataFrame([], "market_key string, commodity string, state string, district string, date date, modal_price double, town_key string, latitude double, longitude double, geo_precision string")
    d = spark.createDataFrame([], "market_key string, commodity string, state string, date date, is_drop boolean")
    c = spark.createDataFrame([("Onion", "Vegetable")], "commodity string, category string")
    assert A.seasonality(p, d, c).count() == 0 and A.series_features(p, d).count() == 0 and A.volatility(p).count() == 0 and A.near_towns(p).count() == 0


def test_spreads_of_a_day_need_no_pairs_and_one_shuffle(spark):
    rnd = random.Random(5)
    m = [(f"m{i}", rnd.choice("ST"), rnd.choice("DE"), rnd.choice(["manual", "district_centroid"]), f"t{i % 50}", 20 + rnd.random() * 2, rnd.choice([75 + rnd.random() * 2, 180.0, -180.0]), i % 9 > 0) for i in range(60)]
    m = spark.createDataFrame(m, "market_key string, state string, district string, geo_precision string, town_key string, latitude double, longitude double, has_valid_data boolean")
    x = prices(spark, [(f"m{i}", d, rnd.randint(500, 2500)) for i in range(60) for d in range(4) if rnd.random() < 0.7])
    s = pairs.day_spreads(x, F.broadcast(m))
    want = pairs.spreads(x, pairs.market_pairs(m))
    cols = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df.select(cols).collect()))
    assert sorted(s.columns) == cols and rows(s) == rows(want) and want.count() > 100
    plan = pairs.market_days(pairs.directed(s)).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(commodity") <= 2 and "Exchange hashpartitioning(home_market_key" not in plan.split("HashAggregate", 3)[-1] and "Union" not in plan


def near_towns(spark, n=40):
    rnd = random.Random(8)
    m = [(f"m{i:02}", "S", "D", rnd.choice(["manual", "district_centroid"]), f"t{i % 30}", 20 + rnd.random(), 75 + rnd.random(), i % 9 > 0) for i in range(n)]
    m = spark.createDataFrame(m, "market_key string, state string, district string, geo_precision string, town_key string, latitude double, longitude double, has_valid_data boolean")
    return m, prices(spark, [(f"m{i:02}", d, rnd.randint(500, 2500)) for i in range(n) for d in range(4) if rnd.random() < 0.7])


def test_near_prices_lists_no_pairs(spark):
    m, x = near_towns(spark)
    near = pairs.market_pairs(m).filter("haversine_km <= 50").select("market_key_a", "market_key_b").collect()
    price = {(r["market_key"], r["date"]): r["modal_price"] for r in x.collect()}
    others = {}
    for a, b in near:
        others.setdefault(a, []).append(b)
        others.setdefault(b, []).append(a)
    want = {}
    for home, day in price:
        seen = [(o, k, price[o, day + dt.timedelta(k)]) for o in others.get(home, []) for k in (-1, 0, 1) if (o, day + dt.timedelta(k)) in price]
        if seen:
            want[home, day] = (statistics.median([p for _, k, p in seen if k == 0] or [p for _, _, p in seen]), len({o for o, _, _ in seen}))
    got = pairs.near_prices(x, F.broadcast(m))
    assert {(r["home"], r["date"]): (r["neighbour_median"], r["n"]) for r in got.collect()} == want and len(want) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(commodity" in plan and "hashpartitioning(market_key_" not in plan and "hashpartitioning(home" not in plan  # what meets stays where it is


def test_gap_figures_count_pairs_apart(spark):
    m, x = near_towns(spark)
    s = pairs.day_spreads(x, F.broadcast(m))
    got = pairs.gap_figures(s, m)
    assert [r["n_pairs"] for r in got.collect()] == [r["n"] for r in s.groupBy("commodity").agg(F.countDistinct("pair_key").alias("n")).collect()]
    assert "md5" not in got._jdf.queryExecution().executedPlan().toString()  # no names of pairs are made or shuffled


def test_finished_shuffles_are_deleted_and_flags_shuffle_rows_once(spark):
    s = clean.mapped(clean.scope(raw(spark, [(m, "Onion", d, 90, 110, 100) for m in "ABC" for d in range(10)])), known(spark, ["A", "B", "C"]))
    plan = quality.flags(cut(s))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning" not in s._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d22_same_variety", "q3_same_variety_days"])
def test_variety_spreads_make_no_list_of_pairs(spark, name, monkeypatch):
    from haatgrid.plans import models, registry

    monkeypatch.setattr(models.Pipeline, "_stored", lambda self, step, made=models.Pipeline._stored: pytest.fail("pairs are listed") if step in ("pairs", "spread") else made(self, step))
    registry.queries()[name](spark, "/root/testdata/sf0.001").collect()


@pytest.mark.parametrize("km", [5.0, 30.0, 100.0])
def test_only_near_cubes_of_a_day_are_compared(spark, km):
    m, x = near_towns(spark, 60)
    s = Settings(spread_km=km)
    got, cols = pairs.day_spreads(x, F.broadcast(m), s), ["pair_key", "date", "price_a", "price_b", "road_km_est", "pct_gap"]
    rows = lambda df: sorted(map(tuple, df.select(cols).collect()))
    want = rows(pairs.spreads(x, pairs.market_pairs(m, s), s))
    assert rows(got) == want and want
    plan = got._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join [commodity" in line)
    assert all(f"cell_{c}" in join for c in "xyz") and plan.count("Exchange hashpartitioning") <= 2


def test_costs_are_whole_numbers_rounded_half_up(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rnd = random.Random(9)
    rows = [(str(i), dt.date(2024, 1, 1), "Onion", "a", "b", round(rnd.random() * 100, 2), "both_market", round(rnd.random() * 9000 + 50, rnd.choice([0, 1, 2, 3, 4])), rnd.choice([1000.125, 833.25, 62.5, 20000.0])) for i in range(400)]
    s = spark.createDataFrame(rows, "pair_key string, date date, commodity string, market_key_a string, market_key_b string, road_km_est double, pair_precision string, price_a double, price_b double")
    cents = lambda v: float(v.quantize(Decimal("0.01"), ROUND_HALF_UP))
    d, of, costs = pairs.directed(s), {r[0]: r for r in rows}, Settings().scenarios
    got = d.collect()
    assert len(got) == 2400
    for r in got:
        per_km, fixed, fee = (Decimal(str(v)) for v in costs[r["scenario"]])
        assert r["transport_cost"] == cents(Decimal(str(of[r["pair_key"]][5])) * per_km + fixed) and r["fee_cost"] == cents(Decimal(str(r["price_dest"])) * fee)
        assert r["gain"] == r["price_dest"] - r["transport_cost"] - r["fee_cost"] - r["price_home"]
    assert "decimal" not in d._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q3_concentration", "q3_gain_histogram"])
def test_one_scenario_is_compared_where_one_is_asked_for(spark, name):
    from haatgrid.plans import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "[mid," in plan and "low," not in plan and "high," not in plan
