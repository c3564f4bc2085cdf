"""Queries of the text problems and of the algorithms for large corpora."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..util import cut, table
from .leaks import leaked
from .mixing import mix, mix_shares, tempered_targets, token_counter
from .names import link_names, same_entity_pairs
from .quantiles import merge_sketches, percentiles, rank_error, sketch_groups
from .subjects import SHARE, subject_shares

_SHARES = {"p1": 0.01, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}
_READ = [*_SHARES, "rank_error", *(f"{c}_error" for c in _SHARES)]
_SERIES = ["state", "commodity"]


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of single days."""
    return sketch_groups(table(spark, sf_dir, "mandi_prices").select(*_SERIES, "arrival_date", "modal_price"), [*_SERIES, "arrival_date"], "modal_price")


def _months(days: DataFrame) -> DataFrame:
    return merge_sketches(days.withColumn("month", F.trunc("arrival_date", "month")), [*_SERIES, "month"])


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per state and commodity by day, by month (merged from the days) and over all (merged from the months): ``period`` and ``start`` tell
    which, ``p1_error, ...`` the bound of each percentile's rank error as a share of ``n``."""
    days = cut(_days(spark, sf_dir))
    months = cut(_months(days))
    one = lambda x, period, start: percentiles(x, [c for c in x.columns if c not in ("n", "sketch")]).select(*_SERIES, F.lit(period).alias("period"), start.alias("start"), "n", *_READ)
    whole = one(merge_sketches(months, _SERIES), "all", F.lit(None).cast("date"))
    return one(months, "month", F.col("month")).unionByName(one(days, "day", F.col("arrival_date"))).unionByName(whole)


def p2_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per state, commodity and day; days are small enough to be exact, so the error of each percentile is not told."""
    x = percentiles(_days(spark, sf_dir), [*_SERIES, "arrival_date"])
    return x.drop(*(c for c in x.columns if c.endswith("_error") and c != "rank_error"))


def p2_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per state, commodity and month, from the merged sketches of the days."""
    return percentiles(_months(_days(spark, sf_dir)), [*_SERIES, "month"])


def p2_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per state and commodity, from the merged sketches of the months of the rows."""
    p = table(spark, sf_dir, "mandi_prices").select(*_SERIES, F.trunc("arrival_date", "month").alias("month"), "modal_price")
    return percentiles(merge_sketches(sketch_groups(p, [*_SERIES, "month"], "modal_price"), _SERIES), _SERIES)


def _ranks(spark: SparkSession, sf_dir: str, read: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and percentile whether the exact rank of what the sketch gave lies within the error told, by counting the rows below and up to it."""
    p = table(spark, sf_dir, "mandi_prices").withColumn("month", F.trunc("arrival_date", "month")).filter(F.col("modal_price").isNotNull() & ~F.isnan("modal_price"))
    x = p.select(*keys, "modal_price").groupBy(*keys, "modal_price").agg(F.count("*").alias("times"))
    r = read.select(*(F.col(c).alias(f"g_{c}") for c in keys), "n", *_READ)
    j = x.join(r, reduce(and_, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in keys]))
    sums = [F.sum(F.when(F.col("modal_price") < F.col(c), F.col("times")).otherwise(0)).alias(f"{c}_below") for c in _SHARES] + [F.sum(F.when(F.col("modal_price") <= F.col(c), F.col("times")).otherwise(0)).alias(f"{c}_upto") for c in _SHARES]
    g = j.groupBy(*keys, "n").agg(*sums, *(F.first(f"{c}_error").alias(f"{c}_error") for c in _SHARES))
    each = [F.struct(F.lit(c).alias("percentile"), ((F.col(f"{c}_below") + 1 - F.ceil(q * F.col("n")) <= F.col(f"{c}_error") * F.col("n") + 1) & (F.ceil(q * F.col("n")) - F.col(f"{c}_upto") <= F.col(f"{c}_error") * F.col("n") + 1)).alias("within")) for c, q in _SHARES.items()]
    return g.select(*keys, "n", F.inline(F.array(*each)))


def p2_ranks_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, p2_months(spark, sf_dir), [*_SERIES, "month"])


def p2_ranks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranks(spark, sf_dir, p2_all(spark, sf_dir), _SERIES)


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "mandi_prices").filter(F.col("variety").isNotNull() & F.col("grade").isNotNull() & F.col("modal_price").isNotNull())
    reports = told.select("state", "district", "market", F.struct("commodity", "variety", "grade").alias("series"), F.col("arrival_date").alias("day"))
    return link_names(table(spark, sf_dir, "market_names"), table(spark, sf_dir, "dim_market"), reports)


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name with the market it is taken for, as the class, and the number of other names of that market."""
    x = _linked(spark, sf_dir)
    return x.join(x.groupBy("entity").agg((F.count("*") - 1).alias("n_links")), "entity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_entity_pairs(_linked(spark, sf_dir)).select(F.col("id_a").alias("name_id_a"), F.col("id_b").alias("name_id_b")).distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return x.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "own_words", "score")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(table(spark, sf_dir, "documents").select("doc_id", "source", token_counter()("text").alias("n_tokens")))


def _listed(docs: DataFrame, targets: DataFrame, size: str = "n_tokens") -> float:
    """Size of the listed sources together."""
    return float(docs.join(F.broadcast(targets.select("source")), "source").agg(F.sum(size).alias("n")).first()["n"] or 0)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their repeats in a mix as large as the listed sources together. The exponent is bisected to the least one at which no source is
    repeated more than it may be, so the shares are the targets or as near as the limits let them."""
    targets, docs = table(spark, sf_dir, "mix_targets"), _sized(spark, sf_dir)
    x = mix(docs, "doc_id", "source", "n_tokens", targets, _listed(docs, targets))
    return x.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "repeats")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares aimed at and reached by ``p9_mix``."""
    targets, docs = table(spark, sf_dir, "mix_targets"), _sized(spark, sf_dir)
    return mix_shares(mix(docs, "doc_id", "source", "n_tokens", targets, _listed(docs, targets)), targets)


def p9_mix_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their repeats in the largest mix that meets the targets."""
    x = mix(_sized(spark, sf_dir), "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"))
    return x.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "repeats")


def p9_shares_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_shares(mix(_sized(spark, sf_dir), "doc_id", "source", "n_tokens", targets), targets)


def p9_shares_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mix whose weights are the sources' own token shares, tempered to the entropy of the targets."""
    targets, docs = table(spark, sf_dir, "mix_targets"), _sized(spark, sf_dir)
    own = tempered_targets(docs, "source", "n_tokens", targets)
    return mix_shares(mix(docs, "doc_id", "source", "n_tokens", own), own)


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the largest mix that meets the targets keeps to its plan, with sizes in characters so that SQL can tell what the plan is: per source its budget in
    thousands, whether its records come to that budget less one record at most, and whether none is repeated too often."""
    docs, targets = cut(table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").cast("long").alias("size"))), table(spark, sf_dir, "mix_targets")
    got = mix(docs, "doc_id", "source", "size", targets).groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("got"), F.max("repeats").alias("most"))
    per = docs.filter("size is not null").groupBy("source").agg(F.sum("size").alias("has"), F.max("size").alias("longest")).filter("has > 0").join(F.broadcast(targets.filter("target_share > 0 and max_repeats > 0")), "source")
    room = per.crossJoin(F.broadcast(per.agg(F.sum("target_share").alias("t"), F.sum("has").alias("s")))).withColumn("w", F.col("target_share") / F.col("t"))  # one row
    room = room.crossJoin(F.broadcast(room.agg(F.min(F.col("max_repeats") * F.col("has") / F.col("w")).alias("total")))).withColumn("budget", F.col("w") * F.col("total"))  # one row
    x = room.join(F.broadcast(got), "source", "left")
    off = F.col("budget") - F.coalesce("got", F.lit(0))
    return x.select("source", F.round(F.col("budget") / 1000, 1).alias("budget_k"), ((off > -2) & (off < F.col("longest") + 2)).alias("within_a_record"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each page text's prose sentences by subject."""
    docs = table(spark, sf_dir, "documents").filter("ns = 0")
    return subject_shares(docs, "doc_id", "text", table(spark, sf_dir, "subject_labels"), "doc_id", "subject", table(spark, sf_dir, "eval_items"), "text").withColumnRenamed("doc", "doc_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_shares(spark, sf_dir).filter(F.col("share") >= SHARE).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose sentences of the corpus by subject."""
    x = p10_shares(spark, sf_dir).groupBy("subject").agg(F.sum(F.round(F.col("share") * F.col("n_sentences"))).cast("long").alias("sentences"), F.sum((F.col("share") >= SHARE).cast("long")).alias("documents"))
    return x


QUERIES = {f.__name__: f for f in (
    p2_percentiles, p2_days, p2_months, p2_all, p2_ranks_months, p2_ranks_all, p4_found, p4_links, p8_found, p8_leaks,
    p9_mix, p9_shares, p9_mix_exact, p9_shares_exact, p9_shares_tempered, p9_limits, p10_found, p10_shares, p10_composition,
)}
# Groups of a day hold fewer values than a sketch's first level, so their percentiles are exact: the value at rank ceil(q n).
_Q = ", ".join(f"v[cast(greatest(1, ceil({q} * n - 1e-9)) as bigint)] as {c}" for c, q in _SHARES.items())
SQL: dict[str, str] = {
    "p2_days": f"""with g as (select state, commodity, arrival_date, count(*) as n, list_sort(list(modal_price)) as v from mandi_prices where modal_price is not null group by all)
select state, commodity, arrival_date, n, {_Q}, {rank_error()!r} as rank_error from g""",
    "p2_ranks_months": f"with g as (select state, commodity, cast(date_trunc('month', arrival_date) as date) as month, count(*) as n from mandi_prices where modal_price is not null group by all) select g.*, unnest(['p1', 'p10', 'p50', 'p90', 'p99']) as percentile, true as within from g",
    "p2_ranks_all": "with g as (select state, commodity, count(*) as n from mandi_prices where modal_price is not null group by all) select g.*, unnest(['p1', 'p10', 'p50', 'p90', 'p99']) as percentile, true as within from g",
    "p9_limits": """with d as (select source, sum(length(text)) as has from documents where source is not null and text is not null group by source having has > 0),
x as (select source, has, max_repeats, target_share / sum(target_share) over () as w from d join mix_targets using (source) where target_share > 0 and max_repeats > 0)
select source, round(w * (select min(max_repeats * has / w) from x) / 1000, 1) as budget_k, true as within_a_record, true as within_repeats from x""",
}
