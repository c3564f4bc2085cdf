"""Points near other points: cell codes on a space-filling curve, covers of discs, a range join, exact refinement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius in km.
EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def on_globe(lat: Column, lon: Column) -> Column:
    """True for coordinates that can be meant: both given, in range, not 0/0."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0)) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def _spread_bits(x: Column) -> Column:
    """A zero bit before each bit: the binary digits read to base four."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def morton(row: Column, col: Column) -> Column:
    """Code of a cell on the Z curve."""
    return F.shiftleft(_spread_bits(row), 1).bitwiseOR(_spread_bits(col))


def _grid(km: float) -> float:
    """Degrees of latitude per row: a radius, but no less than keeps the row number in 22 bits."""
    return max(math.degrees(km / EARTH_KM) * 1.0000001, 180 / 2**22)


def _squeeze(row: Column, step: float) -> Column:
    """Length of a degree of longitude against one of latitude, at the row's edge nearest the equator; columns of a row
    are as wide on the ground as rows are high, so a disc covers few cells at any latitude."""
    low = row * step - 90
    nearest = F.when((low <= 0) & (low + step >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + step)))
    return F.greatest(F.cos(F.radians(nearest)), F.lit(1e-9))


def cell_code(lat: Column, lon: Column, km: float) -> Column:
    """Curve code of the cell a point lies in, for cells about ``km`` wide."""
    step = _grid(km)
    row = F.floor((lat + 90) / step)
    return morton(row, F.floor((lon + 180) * _squeeze(row, step) / step))


def disc_ranges(lat: Column, lon: Column, km: float) -> Column:
    """Array of struct(lo, hi): the curve ranges whose cells cover the disc of radius ``km`` round a point.

    Longitudes wrap at 180 degrees, and a disc that holds a pole takes whole rows."""
    step, ang = _grid(km), km / EARTH_KM
    deg = math.degrees(ang)
    first = F.floor((F.greatest(lat - deg, F.lit(-90.0)) + 90) / step)
    last = F.floor((F.least(lat + deg, F.lit(90.0)) + 90) / step)
    ratio = F.lit(math.sin(ang)) / F.cos(F.radians(lat))
    wide = F.when((F.abs(lat) + deg >= 90) | (ratio >= 1), F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + 1e-9)

    def cells(row: Column) -> Column:
        q = _squeeze(row, step) / step
        span = lambda a, b: F.transform(F.sequence(F.floor((a + 180) * q), F.floor((b + 180) * q)), lambda col: morton(row, col))
        lo, hi = lon - wide, lon + wide
        empty = F.array().cast("array<bigint>")
        return F.when(wide >= 180, span(F.lit(-180.0), F.lit(180.0))).otherwise(
            F.concat(
                span(F.greatest(lo, F.lit(-180.0)), F.least(hi, F.lit(180.0))),
                F.when(lo <= -180, span(lo + 360, F.lit(180.0))).otherwise(empty),
                F.when(hi >= 180, span(F.lit(-180.0), hi - 360)).otherwise(empty),
            )
        )

    codes = F.array_sort(F.array_distinct(F.flatten(F.transform(F.sequence(first, last), cells))))
    kind = "array<struct<lo:bigint,hi:bigint>>"
    joined = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["hi"] == x - 1),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["lo"].alias("lo"), x.alias("hi")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x.alias("lo"), x.alias("hi")))))
    return F.aggregate(codes, F.array().cast(kind), lambda acc, x: joined(acc, x).cast(kind))


#: Bits of the code left out of the key that the range join meets on: ranges are cut at blocks of 4**2 cells.
_BLOCK_BITS = 4


def near_pairs(points: DataFrame, id_col: str, lat: str, lon: str, km: float) -> DataFrame:
    """All pairs of points at most ``km`` apart: ``id_a`` < ``id_b`` and ``km`` of each pair.

    Rows with a missing or impossible coordinate, or 0/0, are in no pair; repeated ids count once per
    coordinate. Points on one spot are collapsed to the spot before the join, so a spot that holds a
    large part of the points costs one row in it; each spot's disc is covered by ranges of the curve, ranges and codes
    meet by block of the curve and the range's bounds, and the exact distance decides. The pairs
    asked for are spelled out only after that.
    """
    p = points.select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    p = p.filter(on_globe(F.col("lat"), F.col("lon")) & F.col("id").isNotNull()).withColumn("lon", F.when(F.col("lon") == 180, F.lit(-180.0)).otherwise(F.col("lon"))).distinct()
    spots = p.select("lat", "lon").distinct()
    right = spots.select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell_code(F.col("lat"), F.col("lon"), km).alias("code")).withColumn("block", F.shiftright("code", _BLOCK_BITS))
    left = spots.withColumn("r", F.explode(disc_ranges(F.col("lat"), F.col("lon"), km))).select("lat", "lon", "r.lo", "r.hi")
    left = left.withColumn("block", F.explode(F.sequence(F.shiftright("lo", _BLOCK_BITS), F.shiftright("hi", _BLOCK_BITS))))
    near = left.join(right, (left["block"] == right["block"]) & right["code"].between(left["lo"], left["hi"]) & ((left["lat"] < right["lat2"]) | ((left["lat"] == right["lat2"]) & (left["lon"] <= right["lon2"]))))
    near = near.select("lat", "lon", "lat2", "lon2", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")).filter(F.col("km") <= km)
    a = p.select(F.col("id").alias("a"), "lat", "lon")
    b = p.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = near.join(a, ["lat", "lon"]).join(b, ["lat2", "lon2"])
    same = (F.col("lat") == F.col("lat2")) & (F.col("lon") == F.col("lon2"))
    pairs = pairs.filter((F.col("a") != F.col("b")) & (~same | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "km")


def near_join(places: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """Each of ``places`` (``place``, lat, lon) with each of ``points`` (``point``, lat, lon) at most ``km`` away: ``place, point, km``.

    As in ``near_pairs``, discs about the places meet the points by block and code of the curve. Missing or impossible coordinates are near nothing.
    """
    ok = lambda df, name: df.select(F.col(name), F.col("lat").cast("double"), F.when(F.col("lon") == 180, F.lit(-180.0)).otherwise(F.col("lon")).cast("double").alias("lon")).filter(on_globe(F.col("lat"), F.col("lon"))).distinct()
    right = ok(points, "point").select("point", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell_code(F.col("lat"), F.col("lon"), km).alias("code")).withColumn("block", F.shiftright("code", _BLOCK_BITS))
    left = ok(places, "place").withColumn("r", F.explode(disc_ranges(F.col("lat"), F.col("lon"), km))).select("place", "lat", "lon", "r.lo", "r.hi")
    left = left.withColumn("block", F.explode(F.sequence(F.shiftright("lo", _BLOCK_BITS), F.shiftright("hi", _BLOCK_BITS))))
    near = left.join(right, (left["block"] == right["block"]) & right["code"].between(left["lo"], left["hi"]))
    return near.select("place", "point", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")).filter(F.col("km") <= km).distinct()
