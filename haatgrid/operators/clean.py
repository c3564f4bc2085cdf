"""Scope, cleaning of names, aliases and removal of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import Settings
from ..util import cut, small

KEY = ["arrival_date", "state", "district", "market", "commodity", "variety", "grade"]


def squeeze(c: Column) -> Column:
    """Trimmed, runs of blanks as one."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def match_key(c: Column) -> Column:
    """Letters and digits in lower case, entities resolved, without a trailing market word."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.replace(c, F.lit("&amp;"), F.lit("&"))), "[^a-z0-9]+", ""), "apmc$", "")


def scope(raw: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Records of the commodities and states asked for, from the start on, with a date, place and modal price, tagged by period. Null or
    blank places, null dates and null prices are rejected."""
    keep = F.col("commodity").isin(*s.commodities) & ~F.col("commodity").isin(*s.look_alikes) & (F.col("arrival_date") >= F.lit(s.start).cast("date")) & F.col("modal_price").isNotNull()
    for c in ("state", "district", "market"):
        keep &= F.trim(F.coalesce(c, F.lit(""))) != ""
    if s.states:
        keep &= F.col("state").isin(*s.states)
    return raw.filter(keep).withColumn("period", F.when(F.col("arrival_date") <= F.lit(s.main_end).cast("date"), "main").otherwise("post_format_change"))


def mapped(scoped: DataFrame, markets: DataFrame) -> DataFrame:
    """Cleaned records with canonical names. ``markets`` has the canonical state, district and market; a spelling with the same
    match keys is replaced by it, others are only squeezed. Null variety and grade count as empty. Remarks are left out."""
    known = markets.select(F.col("state").alias("k_state"), match_key(F.col("district")).alias("k_district"), match_key(F.col("market")).alias("k_market"), "district", "market")
    known = small(cut(known.groupBy("k_state", "k_district", "k_market").agg(F.min(F.struct("market", "district")).alias("canon"))))
    c = scoped.drop("remarks").withColumns({"market_raw": F.col("market"), "district_raw": F.col("district"), "state": squeeze(F.col("state")), "commodity": squeeze(F.col("commodity")), **{x: squeeze(F.coalesce(x, F.lit(""))) for x in ("variety", "grade")}})
    on = (c["state"] == known["k_state"]) & (match_key(c["district"]) == known["k_district"]) & (match_key(c["market"]) == known["k_market"])
    c = c.join(known, on, "left").withColumns({"district": F.coalesce("canon.district", squeeze(F.col("district"))), "market": F.coalesce("canon.market", squeeze(F.col("market")))}).drop("canon", "k_state", "k_district", "k_market")
    return c


def last_received(records: DataFrame) -> DataFrame:
    """One record per KEY: the last received one; ties of receipt go to the higher raw_id."""
    last = Window.partitionBy(*KEY).orderBy(F.desc("ingested_at"), F.desc("raw_id"))
    return records.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")
