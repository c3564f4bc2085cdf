"""Records of several sources mixed to target weights."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks a source's records are dealt into by hash; only the block in which the budget ends is put in order.
BLOCKS = 1024


def token_counter(path: str | None = None, pattern: str | None = None):
    """A column function that counts tokens of a byte-level BPE vocabulary file (lines of base64 token and rank). Null has none."""

    def encoding():
        import base64

        import tiktoken

        file, pat = path, pattern
        if file is None or pat is None:
            import public_tokenizers

            file, pat = file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pat or public_tokenizers.PATTERN
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})

    held: list = []

    def count(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(encoding())
        return pd.Series([len(held[0].encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def temper(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised: 1 leaves them, 0 makes them equal."""
    p = {k: v**exponent for k, v in shares.items() if v > 0}
    return {k: v / sum(p.values()) for k, v in p.items()}


def exponent_for_entropy(shares: dict[str, float], target: float, rounds: int = 60) -> float:
    """The exponent between 0 and 1 at which the tempered shares have the target entropy, or the nearer end."""
    lo, hi = 0.0, 1.0  # entropy falls from lo to hi
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(temper(shares, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def plan_mix(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None, rounds: int = 60) -> tuple[dict[str, float], float, float]:
    """Weights, budget in tokens and exponent of a mix.

    ``tokens`` has each source's size and ``targets`` its share and most repeats; sources without either take no part and the shares
    are made to add up to one again. Without a budget, it is the largest at which the targets are met exactly within
    the repetition limits. With one, the weights are target * (size / target) ** exponent, normalised, which
    leads from the targets (0) to the sizes as they are (1), and the exponent is bisected to the least one
    within the limits; a budget that not even the sizes allow is cut to what the limits allow.
    """
    use = {k: t for k, t in targets.items() if tokens.get(k, 0) > 0 and t[0] > 0 and t[1] > 0}
    if not use:
        return {}, 0.0, 0.0
    want = {k: t[0] / sum(x[0] for x in use.values()) for k, t in use.items()}
    size = {k: tokens[k] / sum(tokens[x] for x in use) for k in use}

    def weights(e: float) -> dict[str, float]:
        p = {k: want[k] * (size[k] / want[k]) ** e for k in use}
        return {k: v / sum(p.values()) for k, v in p.items()}

    room = lambda e: min(use[k][1] * tokens[k] / w for k, w in weights(e).items())
    if budget is None:
        return weights(0.0), room(0.0), 0.0
    if room(0.0) >= budget:
        return weights(0.0), budget, 0.0
    if room(1.0) < budget:
        return weights(1.0), room(1.0), 1.0
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if room(mid) >= budget else (mid, hi)
    return weights(hi), budget, hi


def mix(docs: DataFrame, id_col: str, source: str, size: str, targets: DataFrame, budget: float | None = None, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """Records chosen for the mix: ``id, source, size, repeats``.

    ``docs`` is stored, with a size in tokens per record; ``targets`` has source, target_share and max_repeats, one row per source. The
    sizes by source, one number each, are planned on the driver. A source whose budget is some times its size gives all of its records so often;
    the rest of its budget is taken from a random permutation: records are dealt into blocks by hash, whole blocks are taken in order, and only
    the block in which the budget ends is put in order itself. Records without a source, of no listed source, of null size, or
    beyond the budget are left out; an empty input or none of the sources gives no rows. Of records repeated with the same id each counts.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("size")).filter(F.col("source").isNotNull() & F.col("size").isNotNull())
    d = d.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)))
    t = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).collect()}
    per_block = d.filter(F.col("source").isin(list(t))).groupBy("source", "block").agg(F.sum("size").alias("tokens"))
    tokens = {r["source"]: r["tokens"] for r in per_block.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    weights, total, _ = plan_mix(tokens, t, budget)
    rows = [(k, int(w * total // tokens[k]), int(w * total) - int(w * total // tokens[k]) * tokens[k]) for k, w in weights.items()]
    plan = docs.sparkSession.createDataFrame(rows, "source string, passes long, rest long")
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cuts = per_block.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    d = d.join(F.broadcast(plan), "source").join(F.broadcast(cuts), ["source", "block"])  # at most blocks rows per source
    whole = F.col("before") + F.col("tokens") <= F.col("rest")
    cut_block = ~whole & (F.col("before") < F.col("rest"))
    easy = d.filter(~cut_block).select("id", "source", "size", (F.col("passes") + whole.cast("long")).alias("repeats"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").rowsBetween(Window.unboundedPreceding, 0))
    ending = d.filter(cut_block).withColumn("fits", (F.col("before") + run <= F.col("rest")).cast("long"))
    last = ending.select("id", "source", "size", (F.col("passes") + F.col("fits")).alias("repeats"))
    return easy.unionByName(last).filter(F.col("repeats") > 0)


def tempered_targets(docs: DataFrame, source: str, size: str, targets: DataFrame) -> DataFrame:
    """``targets`` with the listed sources' own shares of the size, tempered to the entropy of the target shares, in their place.

    A source without records keeps no share. The sizes by source, one number each, are looked at on the driver.
    """
    t = {r["source"]: r for r in targets.filter(F.col("source").isNotNull() & (F.col("target_share") > 0)).collect()}
    has = {r["s"]: r["n"] for r in docs.filter(F.col(source).isin(list(t))).groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("n")).collect() if r["n"]}
    total, want = sum(has.values()), sum(t[k]["target_share"] for k in has)
    own = {k: v / total for k, v in has.items()}
    own = temper(own, exponent_for_entropy(own, entropy({k: t[k]["target_share"] / want for k in has}))) if own else {}
    rows = [(k, float(own.get(k, 0.0)), int(r["max_repeats"])) for k, r in t.items()]
    return docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source the share aimed at and the one reached: ``source, target_share, share, tokens, records, most_repeats``."""
    got = mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("tokens"), F.count("*").alias("records"), F.max("repeats").alias("most_repeats"))
    total = got.agg(F.sum("tokens").alias("total"))
    x = targets.select("source", "target_share").join(got, "source", "left").crossJoin(F.broadcast(total))  # one row
    return x.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), F.col("total")), F.lit(0.0)).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
