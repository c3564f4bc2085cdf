"""Percentiles of very large numeric columns by mergeable relative-error sketches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a section of a compactor. With it, the rank of an item of rank r from the protected end is off by about 2.5 / K of r at most (three
#: standard deviations, see ``rank_error``).
K = 50


def rank_error(k: int = K) -> float:
    """Bound of the relative rank error at three standard deviations, for a sketch of section size ``k``."""
    return min(1.0, 3 * 0.0512 ** 0.5 * 4 / k + 3 * 0.084 / k)


class Sketch:
    """Relative compactors: level h holds items of weight 2**h. A full level is sorted, its items nearest to the protected end stay, and of the
    rest every other one moves up. How many stay follows from the number of compactions so far (its trailing
    ones), so items near the protected end are compacted rarely and keep their rank to a factor.

    The protected end is the upper one (``high``) or the lower one. Merging adds the levels and joins the compaction counts; the
    bound holds for any order of merges. Coins are drawn from the counts, so equal input gives equal sketches."""

    __slots__ = ("k", "high", "n", "items", "counts", "sections", "width")

    def __init__(self, k: int = K, high: bool = True) -> None:
        self.k, self.high, self.n = k, high, 0
        self.items: list[np.ndarray] = []
        self.counts: list[int] = []
        self.sections: list[int] = []
        self.width: list[float] = []

    def _level(self) -> None:
        self.items.append(np.empty(0))
        self.counts.append(0)
        self.sections.append(3)
        self.width.append(float(self.k))

    def _capacity(self, h: int) -> int:
        return 2 * self.sections[h] * self._even(self.width[h])

    @staticmethod
    def _even(x: float) -> int:
        return max(4, 2 * round(x / 2))

    def add(self, values: np.ndarray) -> "Sketch":
        """Add finite or infinite values; nan must be left out before."""
        if len(values):
            if not self.items:
                self._level()
            step = 16 * self._capacity(0)
            for a in range(0, len(values), step):
                part = values[a : a + step]
                self.n += len(part)
                self.items[0] = np.concatenate([self.items[0], part])
                self._compress()
        return self

    def merge(self, other: "Sketch") -> "Sketch":
        self.n += other.n
        for h, x in enumerate(other.items):
            if h == len(self.items):
                self._level()
            self.items[h] = np.concatenate([self.items[h], x])
            self.counts[h] |= other.counts[h]
            if other.sections[h] > self.sections[h]:
                self.sections[h], self.width[h] = other.sections[h], other.width[h]
        self._compress()
        return self

    def _compress(self) -> None:
        h = 0
        while h < len(self.items):
            while len(self.items[h]) >= self._capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        if self.counts[h] >= 1 << (self.sections[h] - 1) and self.width[h] / 2**0.5 >= 4:
            self.width[h] /= 2**0.5
            self.sections[h] *= 2
            if len(self.items[h]) < self._capacity(h):
                return
        c, sections = self.counts[h], self.sections[h]
        ones = (~c & (c + 1)).bit_length() - 1
        stay = self._capacity(h) // 2 + (sections - min(ones + 1, sections)) * self._even(self.width[h])
        x = np.sort(self.items[h])
        if self.high:
            x = x[::-1]
        stay += (len(x) - stay) & 1
        rest = x[stay:]
        coin = bin((c * 0x9E3779B1 ^ h * 0x85EBCA6B ^ self.n * 0xC2B2AE35) & 0xFFFFFFFF).count("1") & 1
        if h + 1 == len(self.items):
            self._level()
        self.items[h + 1] = np.concatenate([self.items[h + 1], rest[coin::2]])
        self.items[h] = x[:stay].copy()
        self.counts[h] += 1

    def quantiles(self, q: list[float]) -> list[float]:
        """Items whose rank is the first to reach each share of the weight; nan for an empty sketch."""
        if not self.n:
            return [float("nan")] * len(q)
        x = np.concatenate(self.items)
        w = np.concatenate([np.full(len(v), 1 << h, np.int64) for h, v in enumerate(self.items)])
        order = np.argsort(x, kind="stable")
        rank = np.cumsum(w[order])
        at = np.searchsorted(rank, np.ceil(np.array(q) * rank[-1] - 1e-9).clip(1))
        return x[order][np.minimum(at, len(x) - 1)].tolist()

    def dump(self) -> bytes:
        head = struct.pack("<IBQB", self.k, self.high, self.n, len(self.items))
        levels = [struct.pack("<QIdI", c, s, w, len(x)) for c, s, w, x in zip(self.counts, self.sections, self.width, self.items)]
        return b"".join([head, *levels, *(np.asarray(x, "<f8").tobytes() for x in self.items)])

    @classmethod
    def load(cls, b: bytes) -> "Sketch":
        k, high, n, levels = struct.unpack_from("<IBQB", b)
        s, at, sizes = cls(k, bool(high)), 14, []
        s.n = n
        for _ in range(levels):
            c, sec, w, m = struct.unpack_from("<QIdI", b, at)
            s.counts.append(c), s.sections.append(sec), s.width.append(w), sizes.append(m)
            at += 24
        for m in sizes:
            s.items.append(np.frombuffer(b, "<f8", m, at).copy())
            at += 8 * m
        return s


class Ends:
    """Two sketches of the same values, one protected at either end, so that every share has a bound relative to its nearer end. As long as nothing
    is compacted both would hold all values, and only the upper one is kept."""

    __slots__ = ("high", "low")

    def __init__(self, k: int = K) -> None:
        self.high, self.low = Sketch(k), None

    @property
    def n(self) -> int:
        return self.high.n

    def add(self, values: np.ndarray) -> "Ends":
        low = self._low()
        self.high.add(values)
        return self._keep(low.add(values))

    def merge(self, other: "Ends") -> "Ends":
        low = self._low()
        self.high.merge(other.high)
        return self._keep(low.merge(other._low()))

    def _low(self) -> Sketch:
        if self.low is not None:
            return self.low
        low = Sketch(self.high.k, False)
        return low.add(self.high.items[0]) if self.high.items else low

    def _keep(self, low: Sketch) -> "Ends":
        self.low = low if len(low.items) > 1 or len(self.high.items) > 1 else None
        return self

    def quantiles(self, q: list[float]) -> list[float]:
        """As of a sketch; shares below a half are read from the one protected at the lower end."""
        if self.low is None:
            return self.high.quantiles(q)
        return [(self.low if x < 0.5 else self.high).quantiles([x])[0] for x in q]

    def errors(self, q: list[float]) -> list[float]:
        """Bound of the rank error of each share, as a share of all values; 0 where nothing was compacted."""
        return [0.0 if self.low is None else rank_error(self.high.k) * min(x, 1 - x) for x in q]

    def dump(self) -> bytes:
        high = self.high.dump()
        return struct.pack("<II", self.high.k, len(high)) + high + (b"" if self.low is None else self.low.dump())

    @classmethod
    def load(cls, b: bytes) -> "Ends":
        k, size = struct.unpack_from("<II", b)
        s = cls(k)
        s.high = Sketch.load(b[8 : 8 + size])
        s.low = Sketch.load(b[8 + size :]) if len(b) > 8 + size else None
        return s


#: Rows sketched together before the parts are given on.
_ROWS = 400_000


def _schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])


def _parts(keys: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            codes = np.zeros(t.num_rows, np.int64)
            for c in keys:
                d = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
                d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
                _, codes = np.unique(codes * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)
            x = t.column("value").to_numpy()
            order = np.argsort(codes, kind="stable")
            codes, x = codes[order], x[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            ends = np.r_[first[1:], len(codes)]
            rows = t.take(pa.array(order[first])).select(keys)
            sketches = [Ends(k).add(x[a:b]).dump() for a, b in zip(first, ends)]
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in rows.columns), pa.array(ends - first), pa.array(sketches, pa.binary())], names=[*keys, "n", "sketch"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n >= _ROWS:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    return run


def _merged(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, acc, rows = None, None, []

        def flush() -> pa.RecordBatch:
            names = [*keys, "n", "sketch"]
            return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], type=types[c]) for i, c in enumerate(names)})

        types: dict = {}
        for b in batches:
            if not types:
                types = {f.name: f.type for f in b.schema}
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in keys]
            for i, s in enumerate(b.column(b.schema.get_field_index("sketch")).to_pylist()):
                key = tuple(c[i] for c in cols)
                if key != now:
                    if acc is not None:
                        rows.append((*now, acc.n, acc.dump()))
                        if len(rows) >= 5000:
                            yield flush()
                            rows = []
                    now, acc = key, Ends.load(s)
                else:
                    acc.merge(Ends.load(s))
        if acc is not None:
            rows.append((*now, acc.n, acc.dump()))
        if rows:
            yield flush()

    return run


def sketch_groups(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """One pair of sketches (see Ends) per group: ``keys``, ``n`` and ``sketch``.

    Every task sketches its own rows by group first, so of a group that holds a large part of the rows only its tasks' sketches are
    shuffled and merged. Null and nan values are left out; a group without values gives no row; null keys form groups.
    """
    x = df.select(*keys, F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    schema = _schema(x, keys)
    return merge_sketches(x.mapInArrow(_parts(keys, k), schema), keys)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of the groups of ``keys``, merged from finer ones (days into months) or partial ones. One sketch is held at a time, of a
    size that grows with the logarithm of the rows."""
    x = sketches.select(*keys, "n", "sketch")
    return x.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merged(keys), _schema(x, keys))


def percentiles(sketches: DataFrame, keys: list[str], q: tuple[float, ...] = (0.01, 0.1, 0.5, 0.9, 0.99)) -> DataFrame:
    """``keys``, ``n`` and ``p1, p10, ...`` of each sketch, with ``rank_error``, the bound of the rank error relative to the rank from the nearer end, and
    ``p1_error, p10_error, ...``, that of each percentile as a share of ``n``."""
    shares = list(q)
    read = F.pandas_udf(lambda s: pd.Series([e.quantiles(shares) + e.errors(shares) for e in map(Ends.load, s)]), T.ArrayType(T.DoubleType()))
    out = sketches.withColumn("q", read("sketch"))
    k = F.pandas_udf(lambda s: pd.Series([rank_error(struct.unpack_from("<I", b)[0]) for b in s], dtype="float64"), T.DoubleType())
    names = [f"p{100 * x:g}".replace(".", "_") for x in shares]
    return out.select(*keys, "n", *(F.col("q")[i].alias(c) for i, c in enumerate(names)), k("sketch").alias("rank_error"), *(F.col("q")[len(names) + i].alias(f"{c}_error") for i, c in enumerate(names)))
