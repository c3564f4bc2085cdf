"""Units and spikes on made series, and their edge cases."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from haatgrid.operators import units
from haatgrid.operators.spikes import implausible, spike_flags, stuck_flags
from haatgrid.operators.units import UNITS, anchors, narrow, other_units
from haatgrid.util import cut

SCHEMA = "raw_id long, state string, district string, market string, commodity string, variety string, grade string, arrival_date date, min_price double, max_price double, modal_price double, remarks string"
FACTOR = dict(zip(UNITS, (1, 0.01, 0.2, 0.4, 0.5, 10)))


def made(seed=3, days=120):
    """Rows of six sources, and which are in another unit or planted as spikes or stuck."""
    rnd, rows, unit, bad, n = random.Random(seed), [], {}, set(), 0
    for s in range(6):
        level = 1500 + 200 * s
        for d in range(days):
            n += 1
            level *= 1 + rnd.gauss(0, 0.01)
            price = round(level * (1 + rnd.gauss(0, 0.03)))
            u = "quintal"
            if s == 1 and 40 <= d < 70:
                u = "kg"
            if s == 2 and d in (50, 51):
                u = "20kg"
            if s == 3 and d >= 60:
                u = "tonne"
            lo, hi = round(price * 0.9), round(price * 1.1)
            if s == 4 and d in (20, 80):
                price, _ = price * 5 + 1, bad.add(n)
            if s == 4 and d == 30:
                price = 99999999
                bad.add(n)
            if s == 5 and 60 <= d < 70:
                price = 2501
                bad.add(n)
            f = FACTOR[u]
            if u == "kg":
                q = lambda x: float(round(x / 100 * 20) / 20)
            else:
                q = lambda x: float(round(x * f, 2))
            if u != "quintal":
                unit[n] = u
            rows.append((n, "S", "D", "M" if s < 3 else "N", "Onion", f"v{s}", "FAQ", dt.date(2024, 1, 1) + dt.timedelta(d), q(lo), q(hi), q(price), "per 20 kg" if u == "20kg" else None))
    return rows, unit, bad


def prepared(spark, rows):
    p = spark.createDataFrame(rows, SCHEMA)
    ids = p.select("state", "district", "market").distinct().withColumn("market_id", F.xxhash64("state", "district", "market"))
    return cut(narrow(p, ids, anchors(p)))


def test_units_and_spikes_of_made_series(spark):
    rows, unit, bad = made()
    n = prepared(spark, rows)
    assert {r["raw_id"]: r["unit"] for r in other_units(n).collect()} == unit
    assert {r["raw_id"] for r in implausible(n).collect()} == bad


def test_repeats_get_their_own_results(spark):
    rows, unit, bad = made()
    twice = rows + [(r[0] + 100_000, *r[1:]) for r in rows]
    n = prepared(spark, twice)
    assert {r["raw_id"] for r in other_units(n).collect()} == {*unit, *(i + 100_000 for i in unit)}
    assert {r["raw_id"] for r in implausible(n).collect()} == {*bad, *(i + 100_000 for i in bad)}


def decode_one(prices, remark=0, low=None, high=None, digits=None, anchor=np.nan):
    """Units of one source with a report a day."""
    n, x = len(prices), np.array(prices, float)
    m = units.UnitModel() if digits is None else units.UnitModel(digits=digits)
    b = [np.full(n, np.nan) if v is None else np.array(v, float) for v in (low, high)]
    codes = np.zeros(n, np.int8) if np.isscalar(remark) else np.array(remark, np.int8)
    return [UNITS[u] for u in units.decode_units(np.array([0]), np.arange(n), x, *b, codes, np.zeros(n, np.int8), np.full(n, anchor), np.ones(n, bool), m)]


def test_stuck_round_prices_stay_quintals():
    rnd = random.Random(1)
    around = [float(round(1766 * (1 + rnd.gauss(0, 0.04)))) for _ in range(120)]
    for stuck in (4390, 4391, 2640, 2641, 5000):
        prices = around[:60] + [stuck] * 17 + around[60:]
        for digits in (None, 0):
            assert set(decode_one(prices, digits=digits, anchor=np.log(1900))) == {"quintal"}, stuck


def test_price_rises_and_round_sources_stay_quintals():
    rnd = random.Random(2)
    walk, level = [], 1200.0
    for d in range(300):
        level *= 1.025 if 100 <= d < 170 else (0.975 if 170 <= d < 240 else 1 + rnd.gauss(0, 0.01))
        walk.append(float(round(level * (1 + rnd.gauss(0, 0.03)))))
    assert max(walk) > 5 * min(walk)
    for to in (1, 2, 5, 10, 50):
        assert set(decode_one([round(x / to) * to for x in walk])) == {"quintal"}, to


def test_untold_units_of_a_source_are_found_without_digits():
    rnd = random.Random(3)
    base = [round(1500 * (1 + rnd.gauss(0, 0.04))) for _ in range(200)]
    for u in ("kg", "20kg", "tonne"):
        prices = [round(p * FACTOR[u], 2) if 80 <= i < 120 else float(p) for i, p in enumerate(base)]
        for digits in (None, 0):
            assert decode_one(prices, digits=digits) == ["quintal"] * 80 + [u] * 40 + ["quintal"] * 80


def test_a_quintal_remark_weighs_against_another_unit():
    prices = [1500.0, 1520.0, 1490.0, 1510.0] * 10 + [15000.0, 15100.0, 14900.0] + [1500.0] * 5
    told = [0] * 40 + [1] * 3 + [0] * 5
    assert set(decode_one(prices, remark=told, digits=0)) == {"quintal"}
    assert decode_one(prices, remark=[0] * 40 + [6] * 3 + [0] * 5, digits=0)[40:43] == ["tonne"] * 3


def test_any_number_of_copies_gets_its_results(spark):
    rows, unit, bad = made()
    many = [(r[0] + 100_000 * k, *r[1:]) for r in rows for k in range(1 + r[0] % 6)]
    n = prepared(spark, many)
    want = {(r[0], unit[r[0] % 100_000]) for r in many if r[0] % 100_000 in unit}
    got = [(r["raw_id"], r["unit"]) for r in other_units(n).collect()]
    assert set(got) == want and len(got) == len(want)
    got = [r["raw_id"] for r in implausible(n).collect()]
    assert sorted(got) == sorted(r[0] for r in many if r[0] % 100_000 in bad)


def test_long_stuck_run_of_a_hot_source(spark, tmp_path):
    from haatgrid.plans import problems

    rnd, rows = random.Random(6), []
    for d in range(700):
        price = 2501.0 if 150 <= d < 550 else float(round(2500 * (1 + rnd.gauss(0, 0.03))))
        rows.append((d, "S", "D", "M", "Onion", "v", "FAQ", dt.date(2022, 1, 1) + dt.timedelta(d), None, None, price, None))
    p = spark.createDataFrame(rows, SCHEMA).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1999)))).withColumn("raw_id", F.col("copy") * 1000 + F.col("raw_id")).drop("copy")
    p.write.parquet(f"{tmp_path}/mandi_prices.parquet")
    m = p.select("state", "district", "market").distinct()
    m.write.parquet(f"{tmp_path}/market_names.parquet")
    m.write.parquet(f"{tmp_path}/dim_market.parquet")
    got = problems.p3_flags(spark, str(tmp_path)).filter("kind = 'stuck'").agg(F.count("*").alias("n"), F.min(F.col("raw_id") % 1000).alias("a"), F.max(F.col("raw_id") % 1000).alias("b")).first()
    assert tuple(got) == (400 * 2000, 150, 549)


def test_nulls_and_empty(spark):
    rows = [(1, "S", "D", None, "Onion", None, None, None, None, None, None, None), (2, None, None, None, None, None, None, None, 0.0, 0.0, -1.0, ""), (3, "S", "D", "M", "Onion", "v", "FAQ", dt.date(2024, 1, 1), None, None, float("nan"), "x" * 5000)]
    n = prepared(spark, rows)
    assert other_units(n).count() == 0
    assert [(r["raw_id"], r["kind"]) for r in implausible(n).collect()] == [(2, "limit")]
    e = prepared(spark, [rows[0]]).limit(0)
    assert other_units(e).count() == 0 and implausible(e).count() == 0


def test_the_autoregression_decides(monkeypatch):
    """Excursions of a source whose residuals last are expected by the fitted coefficient; without it they are spikes."""
    from haatgrid.operators import spikes

    rng, x = np.random.default_rng(4), np.zeros(600)
    for i in range(1, 600):
        x[i] = 0.35 * x[i - 1] + rng.normal(0, 0.27)
    x[[100, 300]] += 2.0
    value, group, anchor = 7 + x, np.zeros(600, np.int64), np.full(600, np.nan)
    at = np.array([200, 201, 202, 400, 401, 402])
    value[at] = 7 + np.array([0.8, 1.4, 0.8] * 2)
    fitted = set(np.flatnonzero(spike_flags(value, group, anchor)[0]))
    assert {100, 300} <= fitted and not fitted & set(at)
    fit = spikes.fit_autoregression
    monkeypatch.setattr(spikes, "fit_autoregression", lambda *a: spikes.Autoregression(fit(*a).phi * 0, fit(*a).sigma, fit(*a).clip))
    without = set(np.flatnonzero(spike_flags(value, group, anchor)[0]))
    assert {201, 401} <= without and {100, 300} <= without


def test_spikes_in_a_row_are_no_shift():
    for k in (1, 2, 3):
        x = np.full(40, 8.0)
        x[20 : 20 + k] += np.log(5)
        spike, _ = spike_flags(x, np.zeros(40, np.int64), np.full(40, np.nan))
        assert np.flatnonzero(spike).tolist() == list(range(20, 20 + k))


def test_level_shift_is_no_spike():
    x = np.log(np.array([100.0] * 10 + [450.0] * 10))
    spike, _ = spike_flags(x, np.zeros(20, np.int64), np.full(20, np.nan))
    assert not spike.any()
    x[4] += np.log(5)
    spike, _ = spike_flags(x, np.zeros(20, np.int64), np.full(20, np.nan))
    assert np.flatnonzero(spike).tolist() == [4]


def test_sources_that_move_rarely_are_not_stuck():
    p = np.repeat(np.arange(12.0), 9)
    assert not stuck_flags(p, np.zeros(len(p), np.int64)).any()
    q = np.r_[np.arange(20.0), np.full(8, 99.0), np.arange(20.0) + 0.5]
    assert np.flatnonzero(stuck_flags(q, np.zeros(len(q), np.int64))).tolist() == list(range(20, 28))


def test_clues(spark):
    told = {"Rs/kg": "kg", "per 20 kg": "20kg", "rate per maund of 40 kilo": "40kg", "bag rate (50kg)": "50kg", "Rs. per metric ton": "tonne", "Rs/Qtl": "quintal", "per 100 kg": "quintal", "arrival 350 kg only": None, "12 trucks of 9 tonne each arrived": None, "sold in 50 kg bags, see rate board": None, "new crop": None}
    df = spark.createDataFrame([(k,) for k in told], "t string").select("t", units.clue(F.col("t")).alias("c"))
    assert {r["t"]: ([None, *UNITS][r["c"]]) for r in df.collect()} == told
    v = spark.createDataFrame([("Other [kg rate]",), ("Bold /20Kg",), ("Nasal Lal - per Kg",), ("White (Rs/kg)",), ("Lot (A)",), (None,)], "v string").select(units.plain_variety(F.col("v")).alias("p"))
    assert [r["p"] for r in v.collect()] == ["Other", "Bold", "Nasal Lal", "White", "Lot (A)", None]


def test_ids_of_markets_are_joined_as_numbers(spark):
    """A broadcast of the names themselves takes eight times the driver's memory."""
    rows, *_ = made(days=3)
    p = spark.createDataFrame(rows, SCHEMA)
    ids = p.select("state", "district", "market").distinct().withColumn("market_id", F.xxhash64("market"))
    plan = narrow(p, F.broadcast(ids), anchors(p))._jdf.queryExecution().executedPlan().toString()
    assert "HashedRelationBroadcastMode(List(input[0, bigint" in plan and "k_market" not in plan
