"""Whole groups out of a sorted stream of Arrow batches, as numpy columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 60_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of at least ``rows`` rows that end where a group ends; the batches are sorted by ``keys``.

    Only the last, unfinished group is held over, so memory is that of ``rows`` rows or of the largest group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        at = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            at |= x[1:] != x[:-1]
        cuts = np.flatnonzero(at)
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield _columns(t.slice(0, cut))
            t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
        rows = max(rows, n * 2) if n >= rows else rows
    if n:
        yield _columns(pa.Table.from_batches(held))


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy(zero_copy_only=False) for c in t.column_names}


def starts(*keys: np.ndarray) -> np.ndarray:
    """Index of the first row of each group, in sorted columns."""
    at = np.ones(len(keys[0]), bool)
    at[1:] = False
    for k in keys:
        at[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(at)


def group_median(x: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Median (0 of an empty group) and number of the usable elements of each group; elements are at least 0 and count as below 1."""
    use = ~np.isnan(x)
    of = group[use]
    v = np.sort(of + np.minimum(x[use], 0.999999))
    count = np.bincount(of, minlength=groups)
    if not len(v):
        return np.zeros(groups), count
    at = np.cumsum(count) - count + count // 2
    return np.where(count > 0, v[np.minimum(at, len(v) - 1)] - np.arange(groups), 0), count
