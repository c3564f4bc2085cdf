"""Spellings of markets resolved to the rows of a market dimension."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import folded_name, name_parts, neighbourhood
from ..util import cut

NAME = ["state", "district", "market"]


def _parts(df: DataFrame) -> DataFrame:
    """One row per distinct (state, district, market) with its normal forms."""
    return df.select(*NAME).distinct().withColumns({"p": name_parts("market"), "fd": folded_name("district"), "fs": folded_name("state")})


def resolve_markets(spellings: DataFrame, markets: DataFrame, most_edits: int = 3) -> DataFrame:
    """For each distinct spelling (state, district, market) the ``market_id`` it is taken for.

    ``markets`` has the known markets under the same three columns. A spelling whose place, qualifier and
    district have the same normal form as a market's is that market. The others are looked up by the
    deletion neighbourhood of the place, within state and qualifier, and take the market with the fewest
    edits of place and district together, at most ``most_edits`` of each; ties go to the
    alphabetically first. What is left is a market of its own. ``market_id`` is a 64-bit hash of
    the known market's state, district and market or, if none fits, of the spelling's
    normal form. Null names count as empty; an empty input gives no rows.

    Spellings meet the markets of the districts within ``most_edits`` of theirs only, as no other may be taken: by state alone the candidates would grow with the square of its names.
    The joins shuffle: the deletion neighbourhood has about thirty rows a market, which the planner doesn't count when it decides what to broadcast.
    """
    forms = [F.col("fs"), F.col("fd"), F.col("p.folded").alias("fp"), F.col("p.qualifier").alias("q")]
    known = _parts(markets)
    known = cut(known.select(*forms, F.xxhash64(*NAME).alias("id"), F.concat_ws("|", *NAME).alias("name")))
    first = Window.partitionBy("fs", "fd", "fp", "q").orderBy("name")
    exact = known.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("fs", "fd", "fp", "q", F.col("id").alias("exact_id"))
    s = _parts(spellings)
    s = cut(s.select(*NAME, *forms).join(exact.hint("merge"), ["fs", "fd", "fp", "q"], "left"))
    rest = s.filter(F.col("exact_id").isNull())
    k = known.select("fs", F.col("fd").alias("kd"), "q", F.explode(neighbourhood("fp")).alias("key"), F.col("fp").alias("kp"), "id", "name")
    near = rest.select("fs", "fd").distinct().join(known.select("fs", F.col("fd").alias("kd")).distinct().hint("merge"), "fs").withColumn("dd", F.levenshtein("fd", "kd")).filter(F.col("dd") <= most_edits)
    c = rest.join(near.hint("merge"), ["fs", "fd"]).select(*NAME, "fs", "kd", "q", "fp", "dd", F.explode(neighbourhood("fp")).alias("key")).join(k.hint("merge"), ["fs", "kd", "q", "key"])
    c = c.withColumn("dp", F.levenshtein("fp", "kp")).filter(F.col("dp") <= F.least(F.lit(most_edits), F.floor(F.length("kp") / 3)))
    best = c.withColumn("rn", F.row_number().over(Window.partitionBy(*NAME).orderBy(F.col("dp") + F.col("dd"), "dp", "name"))).filter("rn = 1").select(*(F.col(n).alias(f"b_{n}") for n in NAME), F.col("id").alias("near_id"))
    eq = [F.col(n).eqNullSafe(F.col(f"b_{n}")) for n in NAME]
    return s.join(best.hint("merge"), reduce(and_, eq), "left").select(*NAME, F.coalesce("exact_id", "near_id", F.xxhash64("fs", "fd", "fp", "q")).alias("market_id"))
