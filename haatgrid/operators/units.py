"""Quantities recorded in different units: a hidden Markov model per source decodes the unit of every report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runs import group_median, starts, whole_groups
from ..util import cut, small

#: Units in the order of their codes, and the price in them of one rupee a quintal.
UNITS = ("quintal", "kg", "20kg", "40kg", "50kg", "tonne")
FACTORS = np.array([1.0, 0.01, 0.2, 0.4, 0.5, 10.0])
_LOG_F = np.log(FACTORS)
_FAR = [0, 1, 2, 5]  # units that the size of a price alone can tell apart

#: How units are written in remarks and names of varieties, tried in this order. A number of kilograms
#: counts only as a rate ("per 20 kg", "50kg bag rate"), not as an amount of goods ("350 kg only").
CLUES = (
    ("none", r"\b(arrivals?|unsold|stock|trucks?|sold in|see rate)\b"),
    ("quintal", r"(qtl|quintal|per 100 ?kg|क्विंटल)"),
    ("tonne", r"(tonne|metric ton|/ ?mt\b|\bmt\b|/ ?t\b|1000 ?kg)"),
    ("20kg", r"(20 ?k|twenty)"),
    ("40kg", r"(40 ?k|maund)"),
    ("50kg", r"(50 ?k|fifty)"),
    ("kg", r"(kg|kilo|किलो)"),
)
#: Endings of a variety that give a unit, after a blank and a bracket, slash or dash.
VARIETY_UNIT = r"\s*(?:\[[^\]]*\]|\([^)]*\)|/[^/]*|-\s*per\b.*|/.*)$"

_C = ("none", *UNITS)


def clue(text: Column) -> Column:
    """Code of the unit a text speaks of: 0 none, else 1 + the unit's code."""
    t, out = F.lower(text), F.when(text.isNull(), 0)
    for name, pattern in CLUES:
        out = out.when(t.rlike(pattern), _C.index(name))
    return out.otherwise(0).cast("byte")


def plain_variety(variety: Column) -> Column:
    """Variety without an ending that gives a unit."""
    ending = F.regexp_extract(variety, VARIETY_UNIT, 0)
    return F.when(variety.isNull() | (ending == "") | (clue(ending) == 0), variety).otherwise(F.regexp_replace(variety, VARIETY_UNIT, ""))


@dataclass(frozen=True)
class UnitModel:
    """Costs are negative log likelihoods."""

    enter: float = 7.2  #: to go from quintals to one of the other units between two reports
    leave: float = 2.6  #: to go back to quintals
    swap: float = 9.0  #: between two other units
    sigma: float = 0.09  #: spread of a report about the level of its source
    sigma_mixed: float = 0.3  #: the same where variety or grade are missing, so a source mixes several
    sigma_weight: float = 4.0  #: steps between reports that these count as; they are the least taken
    drift: float = 0.012  #: further spread per root of a day since the report before
    spike: float = 7.5  #: most that a report costs that is more than three times off the level
    off: float = 11.0  #: most that a report between the spread and three times costs
    shift: float = 0.7  #: that it costs to follow the last report instead of the level
    anchor_sigma: float = 0.35  #: spread of a source's level about the prices of its state
    anchor_weight: float = 0.06  #: weight of that in each report
    anchor_first: float = 0.6  #: and in a source's first report
    gain: float = 0.3  #: of the level's update
    digits: float = 0.5  #: weight of how often prices end in tens, fives or even rupees; 0 leaves that out
    fraction: float = 7.0  #: cost of a fraction of a rupee a quintal
    endings: tuple[float, ...] = (0.02, 0.02, 0.16, 0.15, 0.35, 0.3)  #: shares of ENDINGS where a source has few prices
    endings_weight: float = 10.0  #: prices that these shares count as


def _changed(x: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Where a value is given that is not that of the report before in the same source."""
    new = ~np.isnan(x)
    new[1:] &= (source[1:] != source[:-1]) | (x[1:] != x[:-1])
    return new


#: Endings of whole rupees that sources may prefer, and how many of a hundred numbers have each.
ENDINGS = ("hundreds", "other fifties", "other tens", "other fives", "other even", "other odd")
_OF_HUNDRED = np.array([1, 1, 8, 10, 40, 40])


_HUNDRED = np.arange(100)
_PLACE = np.select([_HUNDRED == 0, _HUNDRED % 50 == 0, _HUNDRED % 10 == 0, _HUNDRED % 5 == 0, _HUNDRED % 2 == 0], range(5), 5)


def _ending(rupees: np.ndarray) -> np.ndarray:
    """Place in ENDINGS."""
    return _PLACE[rupees.astype(np.int64) % 100]


def digit_costs(first: np.ndarray, prices: list[np.ndarray], y: np.ndarray, anchor: np.ndarray, m: UnitModel) -> tuple[np.ndarray, np.ndarray]:
    """Cost of the digits of each report's prices in each unit, and their cost if the price is wrong and so doesn't follow the source's rounding.

    Prices per quintal are taken as whole rupees, so a price in another unit is a whole number times the unit's factor: of the prices near a level
    each unit allows some only, and the fewer it allows, the more one that fits tells (its probability is one over the number of rupees). How often a source
    rounds to tens, fives or even rupees is learned from its own prices, each taken in the unit that brings it nearest to the usual one. A price that repeats the report before
    tells nothing new.
    """
    n, k = len(y), len(ENDINGS)
    source = np.zeros(n, np.int64)
    source[first[1:]] = 1
    source = np.cumsum(source)
    off = np.abs(y[:, None] - _LOG_F[_FAR] - anchor[:, None])
    off[:, 0] -= 1.0  # quintals unless clearly something else
    guess = FACTORS[_FAR][np.where(np.isnan(off), 9.0, off).argmin(1)]
    tells = [_changed(x, source) for x in prices]
    seen = np.tile(np.array(m.endings) * m.endings_weight, (len(first), 1))
    for x, at in zip(prices, tells):
        rupees = x[at] / guess[at]
        whole = np.abs(rupees - np.round(rupees)) < 1e-3
        seen += np.bincount(source[at][whole] * k + _ending(np.round(rupees[whole])), minlength=k * len(first)).reshape(-1, k)
    density = m.digits * np.log(seen / seen.sum(1, keepdims=True) * 100 / _OF_HUNDRED)
    right, wrong = np.zeros((n, len(UNITS))), np.zeros((n, len(UNITS)))
    for x, at in zip(prices, tells):
        known = density[source[at]]
        for u, f in enumerate(FACTORS):
            rupees = x[at] / f
            near = np.round(rupees)
            fits = np.abs(rupees - near) < 1e-3
            plain = m.digits * np.log(rupees) + np.where(fits, 0, m.fraction)
            wrong[at, u] += plain
            right[at, u] += plain - np.where(fits, known[np.arange(len(near)), _ending(near)], 0)
    return right, wrong


def _spread(first: np.ndarray, y: np.ndarray, named: np.ndarray, m: UnitModel) -> np.ndarray:
    """Spread of each source's reports about its level, from the median step between them; units change too seldom to matter."""
    n = len(y)
    source = np.zeros(n, np.int64)
    source[first[1:]] = 1
    source = np.cumsum(source)
    step = np.abs(np.diff(y))
    ok = (source[1:] == source[:-1]) & ~np.isnan(step)
    median, count = group_median(step[ok], source[1:][ok], len(first))
    prior = np.where(named[first], m.sigma, m.sigma_mixed)
    return np.maximum(prior, (median * 1.05 * count + prior * m.sigma_weight) / (count + m.sigma_weight))




def _clue_costs(remark: np.ndarray, variety: np.ndarray) -> np.ndarray:
    k = len(UNITS)
    told, ending = np.full((k, k + 1), 0.003), np.full((k, k + 1), 1e-4)
    told[0, 2:], told[0, 0], told[0, 1] = 0.003, 0.76, 0.22
    told[1:, 0], told[1:, 1] = 0.76, 0.015  # silence tells nothing, however long
    ending[:, 0] = 0.9
    for u in range(1, k):
        told[u, u + 1], ending[u, u + 1] = 0.35, 0.1
    return (-np.log(told)).T[remark] + (-np.log(ending)).T[variety]


def quote(modal: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The log price to judge the unit by: the modal price, or the middle of minimum and maximum where the modal price is missing,
    impossible or far outside of them."""
    with np.errstate(invalid="ignore", divide="ignore"):
        low, high = np.where(low > 0, low, np.nan), np.where(high > 0, high, np.nan)
        mid = np.sqrt(np.where(np.isnan(low), high, low) * np.where(np.isnan(high), low, high))
        good = (modal > 0) & (modal < 1e6)
        odd = good & ((modal < 0.7 * low) | (modal > 1.4 * high))
        return np.log(np.where(good & ~odd, modal, mid))


def decode_units(first: np.ndarray, day: np.ndarray, modal: np.ndarray, low: np.ndarray, high: np.ndarray, remark: np.ndarray, variety: np.ndarray, anchor: np.ndarray, named: np.ndarray, m: UnitModel = UnitModel()) -> np.ndarray:
    """Viterbi paths of the units of many sources at once.

    ``first`` has where each source begins; rows are in order of day. The hidden state is the unit. Every
    survivor path carries the level of its source, a smoothed log price per quintal, and its last report; a report is judged by its
    jump from the level, or from the last report if that had left the level (a shift), weakly by ``anchor`` (the usual log price of the place and time), by the
    digits of its price and by what its remark and variety say. Sources are advanced together, a report at a time.
    """
    n, k = len(day), len(UNITS)
    size = np.diff(np.append(first, n))
    order = np.argsort(-size, kind="stable")
    y = quote(modal, low, high)
    seen = ~np.isnan(y)
    emit = _clue_costs(remark, variety)
    spread = _spread(first, y, named, m)[order]
    with np.errstate(invalid="ignore"):
        right, wrong = digit_costs(first, [np.where((x > 0) & (x < 1e6), x, np.nan) for x in (modal, low, high)], y, anchor, m)
    first, size = first[order], size[order]
    move = np.full((k, k), m.swap)
    move[0, 1:], move[1:, 0] = m.enter, m.leave
    np.fill_diagonal(move, 0.02)
    s = len(first)
    cost, level, recent, last = np.zeros((s, k)), np.full((s, k), np.nan), np.full((s, k), np.nan), day[first].astype(float)
    back = np.zeros((n, k), np.int8)
    has_anchor = ~np.isnan(anchor)
    cost[:, 1:] = 2.5
    for t in range(size[0] if s else 0):
        a = int(np.searchsorted(-size, -t, side="left"))  # sources with a report t
        at = first[:a] + t
        if t:
            step = cost[:a, :, None] + move[None]
            lv = level[:a]
        else:
            step = np.where(np.eye(k, dtype=bool)[None], cost[:a, :, None], 1e9)
            lv = level[:a]
        v = y[at][:, None] - _LOG_F[None]  # a, state
        gap = np.maximum(day[at] - last[:a], 0)
        sigma = spread[:a, None]
        sd = np.sqrt(sigma**2 + m.drift**2 * gap[:, None])[:, None]
        jump = v[:, None, :] - lv[:, :, None]
        new = np.isnan(jump)
        jump = np.where(new, 0, jump)
        again = np.abs(np.where(new, 0, v[:, None, :] - recent[:a][:, :, None]))
        away = np.abs(jump)
        fit = np.minimum(0.5 * (away / sd) ** 2, np.where(away > 1.1, np.inf, m.off))
        fit = np.minimum(fit, 0.5 * (again / sd) ** 2 + m.shift) + right[at][:, None, :]
        fit = np.minimum(fit, np.where(away > 1.1, m.spike, np.inf) + wrong[at][:, None, :])
        away = np.minimum(0.5 * ((v - np.nan_to_num(anchor[at])[:, None]) / m.anchor_sigma) ** 2, 8.0)
        here = np.where(has_anchor[at][:, None], away, 0)
        here = here * np.where(new[:, 0, :], m.anchor_first, m.anchor_weight)
        fit = np.where(seen[at][:, None, None], fit + np.nan_to_num(here)[:, None, :], 0)
        total = step + fit
        came = total.argmin(1)
        back[at] = came
        took = np.take_along_axis(total, came[:, None, :], 1)[:, 0, :] + emit[at]
        was = np.take_along_axis(lv, came, 1)
        off, close = v - was, np.abs(v - np.take_along_axis(recent[:a], came, 1))
        moved = np.where(np.isnan(was) | ((close < 3 * sigma) & (np.abs(off) > 3 * sigma)), v, was + np.where(np.abs(off) > 0.5, 0.02 * np.sign(off), m.gain * off))
        recent[:a] = np.where(seen[at][:, None], v, np.take_along_axis(recent[:a], came, 1))
        level[:a] = np.where(seen[at][:, None], moved, was)
        last[:a] = np.where(seen[at], day[at], last[:a])
        cost[:a] = took - took.min(1, keepdims=True)
    unit = np.zeros(n, np.int8)
    state = cost.argmin(1) if s else np.zeros(0, int)
    for t in range(size[0] - 1 if s else -1, -1, -1):
        a = int(np.searchsorted(-size, -t, side="left"))
        at = first[:a] + t
        unit[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return unit


#: Columns of the narrow rows that units and spikes are found in, in the order of ``narrow``.
NARROW = ("source", "day", "raw_id", "modal", "low", "high", "remark", "variety_clue", "anchor", "named")
#: Those that two rows of one report have in common.
CONTENT = tuple(c for c in NARROW if c != "raw_id")


def anchors(prices: DataFrame) -> DataFrame:
    """Usual log price of a commodity in a state and month: ``state, commodity, month, anchor``; of places with few reports the country's.

    Each is a median to a relative rank error of 1 in 500; rows in other units are too few to matter. The result has a row per state,
    commodity and month at most.
    """
    p = prices.filter((F.col("modal_price") > 0) & (F.col("modal_price") < 1e6)).select("state", "commodity", F.trunc("arrival_date", "month").alias("month"), F.ln("modal_price").cast("float").alias("y"))
    by = p.groupBy("commodity", "month", "state").agg(F.percentile_approx("y", 0.5, 500).alias("med"), F.count("*").alias("n"))
    land = by.groupBy("commodity", "month").agg(F.percentile(F.col("med"), F.lit(0.5), F.col("n")).alias("land"))
    out = by.join(land, ["commodity", "month"])
    return out.select("state", "commodity", "month", F.when(F.col("n") >= 60, F.col("med")).otherwise((F.col("med") * F.col("n") + F.col("land") * 20) / (F.col("n") + 20)).cast("double").alias("anchor"))


def narrow(prices: DataFrame, market_ids: DataFrame, anchor: DataFrame) -> DataFrame:
    """Price rows as NARROW, one per row.

    ``source`` is a hash of the market under all its spellings, commodity, variety without unit endings and grade. ``market_ids`` (state,
    district, market, market_id; a row per name) is joined by a 64-bit hash of the name, so that a broadcast of it holds two numbers a name; it and ``anchor`` are
    joined as they are marked or the planner sees fit."""
    p = prices.select(
        "raw_id", "state", "district", "market", "commodity", plain_variety(F.col("variety")).alias("pv"), "grade", F.trunc("arrival_date", "month").alias("month"),
        F.unix_date("arrival_date").alias("day"), F.col("modal_price").alias("modal"), F.col("min_price").alias("low"), F.col("max_price").alias("high"),
        clue(F.col("remarks")).alias("remark"), F.when(F.col("variety").isNull(), F.lit(0).cast("byte")).otherwise(clue(F.regexp_extract("variety", VARIETY_UNIT, 0))).alias("variety_clue"),
        (F.col("variety").isNotNull() & F.col("grade").isNotNull()).alias("named"),
    )
    names = ["state", "district", "market"]
    name = F.xxhash64(*(F.coalesce(c, F.lit("\0")) for c in names))
    p = p.withColumn("name", name).join(market_ids.select(name.alias("name"), "market_id"), "name", "left")
    p = p.join(anchor, ["state", "commodity", "month"], "left")
    p = p.withColumns({"source": F.xxhash64(F.coalesce("market_id", F.xxhash64(*names)), "commodity", F.coalesce("pv", F.lit("\0")), F.coalesce("grade", F.lit("\0"))), "day": F.coalesce("day", F.lit(-1_000_000))})
    return p.select(*NARROW)


def by_source(rows: DataFrame) -> DataFrame:
    """Different reports, those of a source together and in order of day and last receipt.

    Repeated rows are collapsed, within tasks first and then spread over their whole content, before a source is brought together: a source is sorted in one task, but as
    a calendar of reports and their corrections, not as rows. ``first_id``, ``raw_id`` (the last one), ``ids_xor`` and ``copies`` stand for the rows of a report.
    They are stored in between, so that the files of the two shuffles are never on disk together.
    """
    once = rows.groupBy(*CONTENT).agg(F.min("raw_id").alias("first_id"), F.max("raw_id").alias("raw_id"), F.bit_xor("raw_id").alias("ids_xor"), F.count("*").alias("copies"))
    return cut(once).repartition("source").sortWithinPartitions("source", "day", "raw_id")


def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Whole sources of reports by ``by_source``."""
    return whole_groups(batches, ["source"])


_KEPT = ("source", "day", "modal", "low", "high", "remark", "variety_clue", "first_id", "raw_id", "ids_xor", "copies")
KEPT_SCHEMA = "source long, day int, modal double, low double, high double, remark byte, variety_clue byte, first_id long, raw_id long, ids_xor long, copies long"


def kept(c: dict[str, np.ndarray], at: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    """What ``of_all_rows`` needs of the reports ``at``, and what was found of them."""
    return pa.RecordBatch.from_pydict({**{k: _null(c[k][at]) for k in _KEPT}, **more})


def of_all_rows(found: DataFrame, rows: DataFrame) -> DataFrame:
    """Findings about reports (by ``kept``) as one row for each of their ``rows``.

    First, last and the exclusive or of the ids give up to three of them; rows of reports that were received more often are looked up by content.
    """
    found = cut(found)
    more = [c for c in found.columns if c not in _KEPT]
    ids = F.when(F.col("copies") == 1, F.array("raw_id")).when(F.col("copies") == 2, F.array("first_id", "raw_id"))
    ids = ids.otherwise(F.array("first_id", "raw_id", F.col("ids_xor").bitwiseXOR(F.col("first_id")).bitwiseXOR(F.col("raw_id"))))
    few = found.filter("copies <= 3").select(F.explode(ids).alias("raw_id"), *more)
    many = found.filter("copies > 3").select(*(F.col(c).alias(f"k_{c}") for c in _KEPT[:7]), *more)
    if many.isEmpty():
        return few
    return few.unionByName(rows.join(small(many), reduce(and_, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in _KEPT[:7]])).select("raw_id", *more))


def decoded(c: dict[str, np.ndarray], model: UnitModel = UnitModel()) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the sources and the unit codes of a run of whole sources."""
    first = starts(c["source"])
    unit = decode_units(first, c["day"], c["modal"], c["low"], c["high"], c["remark"], c["variety_clue"], c["anchor"], c["named"], model)
    return first, unit


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array(UNITS)
    for c in reports(batches):
        _, unit = decoded(c)
        at = np.flatnonzero(unit)
        f = FACTORS[unit[at]]
        yield kept(c, at, unit=names.take(pa.array(unit[at].astype(np.int32))), **{f"{out}_price": _null(c[k][at] / f) for k, out in (("modal", "modal"), ("low", "min"), ("high", "max"))})


def _null(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=np.isnan(x) if x.dtype.kind == "f" else None)


def other_units(rows: DataFrame) -> DataFrame:
    """Rows recorded in another unit than rupees per quintal: ``raw_id, unit`` and ``modal_price, min_price, max_price`` in
    rupees per quintal.

    ``rows`` is NARROW. Missing prices stay missing; a row without any usable price has the unit of the reports about it; a row
    without a date comes before the dated ones of its source; repeated rows count once and get one result each. An empty input gives no rows.
    """
    return of_all_rows(by_source(rows).mapInArrow(_units, f"{KEPT_SCHEMA}, unit string, modal_price double, min_price double, max_price double"), rows)
