"""Implausible measurements: spikes against a source's own level, stuck runs, and physical limits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.runs import group_median, starts
from .units import KEPT_SCHEMA, FACTORS, by_source, decoded, kept, of_all_rows, reports

KINDS = ("limit", "spike", "stuck")


@dataclass(frozen=True)
class SpikeModel:
    ratio: float = 3.0  #: times above or below the level that make a spike
    side: int = 5  #: reports on either side that give the level
    rounds: int = 4  #: rounds of the search for outliers
    significance: float = 4.0  #: spreads of the innovations that an outlier must exceed
    shift: float = 0.8  #: share of the squared innovations that a level shift must explain
    sigma: float = 0.09  #: spread of a source with few reports; a quarter of it is the least taken
    prior: float = 10.0  #: reports that this spread counts as
    stuck: int = 8  #: equal reports in a row that make a stuck run
    seldom: float = 0.25  #: share of repeated prices, outside of a stuck run, up to which a source seldom repeats its price
    evidence: int = 4  #: pairs of reports outside of the run that are needed to tell
    upper: float = 1e6  #: prices from here on are impossible, as are those up to zero


def _neighbours(x: np.ndarray, group: np.ndarray, side: int) -> np.ndarray:
    """For each element the ``side`` usable elements before and after it in its group (nan: left out), missing ones as nan.

    The usable ones are ranked first, so that outliers taken out don't leave holes."""
    n = len(x)
    use = ~np.isnan(x)
    idx = np.flatnonzero(use)
    before = np.cumsum(use) - use  # usable elements before each
    out = np.full((n, 2 * side), np.nan)
    if not len(idx):
        return out
    for j in range(side):
        a = before - 1 - j
        ok = a >= 0
        i = idx[np.maximum(a, 0)]
        out[:, j] = np.where(ok & (group[i] == group), x[i], np.nan)
        b = before + use + j
        ok = b < len(idx)
        i = idx[np.minimum(b, len(idx) - 1)]
        out[:, side + j] = np.where(ok & (group[i] == group), x[i], np.nan)
    return out


def _median(rows: np.ndarray) -> np.ndarray:
    """Median of each row without its nans; nan of an empty one."""
    s = np.sort(rows, axis=1)  # nan last
    k = (~np.isnan(s)).sum(1)
    at = np.arange(len(s))
    lo, hi = s[at, np.maximum((k - 1) // 2, 0)], s[at, np.minimum(k // 2, s.shape[1] - 1)]
    return np.where(k > 0, (lo + hi) / 2, np.nan)


def _group_median(x: np.ndarray, group: np.ndarray, groups: int, prior: float, weight: float) -> np.ndarray:
    """Median of the usable elements (from 0, taken as below 1) of each group, drawn towards ``prior`` as if that were ``weight`` elements more."""
    median, count = group_median(x, group, groups)
    return (median * count + prior * weight) / (count + weight)


@dataclass(frozen=True)
class Autoregression:
    """First-order autoregression of the residuals of each series, fitted without weight on outliers."""

    phi: np.ndarray  #: coefficient of each group
    sigma: np.ndarray  #: robust spread of its innovations
    clip: np.ndarray  #: how far a residual may be carried on to its neighbours


def fit_autoregression(res: np.ndarray, group: np.ndarray, groups: int, m: SpikeModel) -> Autoregression:
    """Residuals beyond three robust spreads count as three; unusable ones are nan."""
    if not len(res):
        return Autoregression(np.zeros(groups), np.full(groups, m.sigma), np.full(groups, 3 * m.sigma))
    clip = 3 * np.maximum(1.4826 * _group_median(np.abs(res), group, groups, m.sigma / 1.4826, m.prior), m.sigma / 4)
    r = np.clip(res, -clip[group], clip[group])
    same = (group[1:] == group[:-1]) & ~np.isnan(r[1:]) & ~np.isnan(r[:-1])
    a, b, g = r[:-1][same], r[1:][same], group[1:][same]
    cross, own = np.bincount(g, a * b, groups), np.bincount(g, a * a, groups)
    phi = np.clip(cross / (own + m.prior * m.sigma**2), 0, 0.95)
    sigma = np.maximum(1.4826 * _group_median(np.abs(b - phi[g] * a), g, groups, m.sigma / 1.4826, m.prior), m.sigma / 4)
    return Autoregression(phi, sigma, clip)


def _shift_share(head: np.ndarray, later: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """How much of the sum of squared innovations of an element and those beyond it a level shift at the element explains. ``head`` is the element's
    distance from the level on its other side, ``later`` those of the elements beyond from the same level, nan where there is none; 0 where these are fewer than three."""
    before = np.column_stack([head, later[:, :-1]])
    step = later - phi[:, None] * before
    has = ~np.isnan(step)
    k, step = has.sum(1), np.where(has, step, 0)
    gain = (head + (1 - phi) * step.sum(1)) ** 2 / (1 + k * (1 - phi) ** 2)
    return np.where(k >= 3, np.nan_to_num(gain / (head**2 + (step**2).sum(1))), 0)


def spike_flags(value: np.ndarray, group: np.ndarray, anchor: np.ndarray, m: SpikeModel = SpikeModel()) -> tuple[np.ndarray, np.ndarray]:
    """Spikes among the log values of many series, and the level each element was held against.

    The level is the median of the nearest usable elements, and what is left of each series a robust autoregression of first order. In each round an
    element is tested as an additive outlier, by its distance from what the autoregression expects of its neighbours' residuals (the size must
    be that of a spike, and ``significance`` spreads of the innovations), and as the first or last element of a level shift, by the share of
    the innovations that a shift explains. It is a spike if it is an outlier and no shift. Outliers are left out of the
    next round's level and fit, until none is found or cleared. Where there are fewer than three neighbours, ``anchor``
    (the usual log value there) counts as one more.
    """
    limit, n, k = np.log(m.ratio), len(value), m.side
    groups = int(group[-1]) + 1 if n else 0
    spike, level = np.zeros(n, bool), np.full(n, np.nan)
    for _ in range(m.rounds if n else 0):
        near = _neighbours(np.where(spike, np.nan, value), group, k)
        few = (~np.isnan(near)).sum(1) < 3
        level = _median(np.column_stack([near, np.where(few, anchor, np.nan)]))
        res = value - level
        ar = fit_autoregression(np.where(spike, np.nan, res), group, groups, m)
        phi, sigma, clip = ar.phi[group], ar.sigma[group], ar.clip[group]
        beside = _neighbours(np.where(spike, np.nan, res), group, 1)
        has = ~np.isnan(beside)
        carried = np.where(has, np.clip(beside, -clip[:, None], clip[:, None]), 0).sum(1)
        size = res - phi * carried / np.where(has.all(1), 1 + phi**2, 1)
        scale = np.where(has.all(1), np.sqrt(1 + phi**2), 1)
        with np.errstate(invalid="ignore"):
            outlier = (np.abs(size) > limit) & (np.abs(size) * scale > m.significance * sigma)
        at = np.flatnonzero(outlier)
        before, after = near[at, :k], near[at, k:]
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.maximum(*(_shift_share(value[at] - side, other - side[:, None], phi[at]) for side, other in ((_median(before), after), (_median(after), before))))
        new = outlier.copy()
        new[at] = share < m.shift
        with np.errstate(invalid="ignore"):
            cleared = spike & ~(np.abs(res) > limit)
        if not (new & ~spike).any() and not cleared.any():
            break
        spike = (spike | new) & ~cleared
    return spike, level


def stuck_flags(price: np.ndarray, group: np.ndarray, m: SpikeModel = SpikeModel()) -> np.ndarray:
    """Elements in runs of at least ``stuck`` equal values of a series that seldom repeats its value outside of that run.

    A series must have ``evidence`` pairs of consecutive reports outside of the run to tell."""
    n = len(price)
    if not n:
        return np.zeros(0, bool)
    head = np.ones(n, bool)
    head[1:] = (group[1:] != group[:-1]) | (price[1:] != price[:-1])
    run = np.cumsum(head) - 1
    length = np.bincount(run)
    groups = int(group[-1]) + 1
    own = length - 1  # repeats within each run
    pairs = np.bincount(group, minlength=groups) - 1
    repeats = pairs - (np.bincount(group, head, groups) - 1)
    others = pairs[group] - own[run]
    share = (repeats[group] - own[run]) / np.maximum(others, 1)
    return (length[run] >= m.stuck) & (others >= m.evidence) & (share <= m.seldom)


def judge(c: dict[str, np.ndarray], m: SpikeModel = SpikeModel()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind (0 none, else 1 + its place in KINDS), price per quintal and level of each row of a run of whole sources.

    Several rows of one source and day are one report: its price is that of the last row received whose price is possible."""
    first, unit = decoded(c)
    n = len(c["day"])
    price = c["modal"] / FACTORS[unit]
    with np.errstate(invalid="ignore"):
        limit = (price <= 0) | (price >= m.upper)
        good = (price > 0) & (price < m.upper) & c["named"]
    group = np.zeros(n, np.int64)
    group[first] = 1
    group = np.cumsum(group) - 1
    day_first = starts(group, c["day"])
    rep = np.zeros(n, np.int64)
    rep[day_first] = 1
    rep = np.cumsum(rep) - 1  # report of each row
    last = np.full(len(day_first), -1)
    np.maximum.at(last, rep[good], np.flatnonzero(good))
    used = last >= 0
    at = last[used]
    number = np.full(len(day_first), -1)
    number[used] = np.arange(len(at))
    g = group[at]
    with np.errstate(invalid="ignore", divide="ignore"):
        y = np.log(np.where(good, price, np.nan))
    spike_r, level_r = spike_flags(y[at], _dense(g), c["anchor"][at], m)
    stuck_r = stuck_flags(c["modal"][at], _dense(g), m)
    of = number[rep]
    has = good & (of >= 0)
    level = np.where(has, level_r[np.maximum(of, 0)] if len(at) else np.nan, np.nan)
    same = has & (np.abs(y - (y[at][np.maximum(of, 0)] if len(at) else 0)) < 1e-9)
    with np.errstate(invalid="ignore"):
        spike = np.where(same, spike_r[np.maximum(of, 0)] if len(at) else False, has & (np.abs(y - level) > np.log(m.ratio)))
    stuck = same & (stuck_r[np.maximum(of, 0)] if len(at) else False)
    return np.where(limit, 1, np.where(spike, 2, np.where(stuck, 3, 0))), price, np.exp(level)


def _dense(group: np.ndarray) -> np.ndarray:
    """Group numbers without gaps."""
    if not len(group):
        return group
    return np.cumsum(np.append(0, (group[1:] != group[:-1]).astype(np.int64)))


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array(KINDS)
    for c in reports(batches):
        kind, price, level = judge(c)
        at = np.flatnonzero(kind)
        yield kept(c, at, kind=names.take(pa.array((kind[at] - 1).astype(np.int32))), price=pa.array(price[at]), level=pa.array(level[at], mask=np.isnan(level[at])))


def implausible(rows: DataFrame) -> DataFrame:
    """Rows whose price can't be true: ``raw_id, kind`` (limit, spike, stuck), ``price`` in rupees per quintal and the ``level`` of the
    source at that time.

    ``rows`` is NARROW (see units); units are decoded first, so a row in another unit is not flagged for that. Rows without a price are not
    flagged; rows without variety or grade belong to no source and are only held against the limits. Repeated rows get
    one result each. An empty input gives no rows.
    """
    return of_all_rows(by_source(rows).mapInArrow(_flags, f"{KEPT_SCHEMA}, kind string, price double, level double"), rows)
