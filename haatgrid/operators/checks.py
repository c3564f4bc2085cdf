"""Checks that return the rows which break a rule; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _where(df: DataFrame, where: str | None) -> DataFrame:
    return df.filter(where) if where else df


def unique_combination(df: DataFrame, columns: list[str], where: str | None = None) -> DataFrame:
    """Combinations that occur more than once, with their number; nulls are equal."""
    return _where(df, where).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def expression_is_true(df: DataFrame, expression: str, where: str | None = None) -> DataFrame:
    """Rows for which the expression is false or null."""
    return _where(df, where).filter(~F.coalesce(F.expr(expression), F.lit(False)))


def not_null(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    return _where(df, where).filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: list, where: str | None = None) -> DataFrame:
    """Values that are not accepted, with their number; null is not judged."""
    return _where(df, where).filter(F.col(column).isNotNull() & ~F.col(column).isin(values)).groupBy(column).agg(F.count("*").alias("n"))


def relationships(df: DataFrame, column: str, to: DataFrame, to_column: str, where: str | None = None) -> DataFrame:
    """Rows whose value has no counterpart; null is not judged."""
    keys = to.select(F.col(to_column).alias("_key")).distinct()
    return _where(df, where).filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def modal_between_bounds(df: DataFrame) -> DataFrame:
    """Rows whose modal price lies outside of bounds that are both given."""
    return df.filter(F.col("min_price").isNotNull() & F.col("max_price").isNotNull() & ~F.coalesce(F.col("modal_price").between(F.col("min_price"), F.col("max_price")), F.lit(False)))


def one_coordinate_per_market(df: DataFrame) -> DataFrame:
    pair = F.struct(F.coalesce("latitude", F.lit(-999.0)), F.coalesce("longitude", F.lit(-999.0)))
    return df.groupBy("state", "district", "market").agg(F.countDistinct(pair).alias("n")).filter("n > 1")


def only_repeats_dropped(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row with both counts if ``after`` has not exactly one row per key of ``before``."""
    a = before.select(*keys).distinct().agg(F.count("*").alias("n_keys"))
    b = after.agg(F.count("*").alias("n_rows"))
    return a.crossJoin(b).filter("n_keys <> n_rows")  # one row each


def canonical_market(mapped: DataFrame) -> DataFrame:
    """Rows of cleaned records that have come out without a canonical state, district or market."""
    blank = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("state", "district", "market")]
    return mapped.filter(blank[0] | blank[1] | blank[2])
