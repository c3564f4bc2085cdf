"""Passages of held-out test items inside a corpus, whole, in part or edited."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..util import cut, small
from .text import streams, wording

#: Words of a seed, and the most items that may share one.
SEED, SEED_ITEMS = 4, 3
#: Words of a run that is wording of many items if at least so many have it.
SHARED, SHARED_ITEMS = 5, 4
#: Costs in matched words of a changed word and of one added or dropped.
CHANGED, MOVED = 2.5, 2.5
#: Score by own word spanned from which an alignment counts though another scores more.
DENSE = 0.5
#: Words beyond an item's length about the first and last seed of a window that are aligned, and positions whose seeds share a window.
MARGIN, WINDOW = 40, 512
#: Documents whose words are given on together.
_SLICE = 500


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(texts: pd.Series) -> pd.Series:
    return pd.Series([wording(t) for t in texts])


def _streams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), _SLICE):
            g = f.iloc[at : at + _SLICE]
            rows = [(rep, h, k, w) for rep, h, t in zip(g["rep"], g["h"], g["text"]) for k, w in enumerate(streams(t)) if len(w) >= SEED]
            yield pd.DataFrame(rows, columns=["rep", "h", "run", "words"])


def _explode_grams(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Rows (id, pos, gram), one per run of n words."""
    hashed = df.select(F.col(id_col).alias("id"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")).filter(F.size("h") >= n)
    x = hashed.select("id", F.posexplode(F.arrays_zip(*(F.slice("h", k + 1, F.greatest(F.size("h") - n + 1, F.lit(0))).alias(f"w{k}") for k in range(n)))).alias("pos", "g"))
    return x.select("id", "pos", F.xxhash64(*(F.col(f"g.w{k}") for k in range(n))).alias("gram"))


def align_many(items: list[np.ndarray], own: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman alignments of many pairs of word-number sequences at once, diagonal by diagonal.

    A match of an item's own word counts one, of a shared one nothing; changed, added and dropped words cost. Returns for each pair the best
    score and the most of the item's own words that are spanned by the alignment of that score or by another, ending in a match, whose score is
    at least DENSE of what it spans: a piece with changes may be longer than one without that scores more."""
    b = len(items)
    n, m = max(map(len, items), default=0), max(map(len, texts), default=0)
    if not b or not n or not m:
        return np.zeros(b), np.zeros(b, int)
    a, o, t = np.full((b, n), -1, np.int64), np.zeros((b, n), np.int16), np.full((b, m), -2, np.int64)
    for k in range(b):
        a[k, : len(items[k])], o[k, : len(items[k])], t[k, : len(texts[k])] = items[k], own[k], texts[k]
    best, at_best, long = np.zeros(b), np.zeros(b, int), np.zeros(b, int)
    # h1, h2: scores of the two diagonals before, by item position + 1; c1, c2: own words spanned
    h1, h2 = np.zeros((b, n + 1), np.float32), np.zeros((b, n + 1), np.float32)
    c1, c2 = np.zeros((b, n + 1), np.int16), np.zeros((b, n + 1), np.int16)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(lo, hi + 1)
        match = a[:, lo : hi + 1] == t[:, d - i]
        ow = o[:, lo : hi + 1]
        diag = h2[:, lo : hi + 1] + np.where(match, ow, np.float32(-CHANGED))
        up, left = h1[:, lo : hi + 1] - MOVED, h1[:, lo + 1 : hi + 2] - MOVED
        h = np.maximum(np.maximum(diag, up), np.maximum(left, 0))
        c = np.where(h <= 0, 0, np.where(h == diag, c2[:, lo : hi + 1] + ow, np.where(h == up, c1[:, lo : hi + 1] + ow, c1[:, lo + 1 : hi + 2])))
        k = h.argmax(1)
        top = h[np.arange(b), k]
        better = top > best
        best = np.where(better, top, best)
        at_best = np.where(better, c[np.arange(b), k], at_best)
        long = np.maximum(long, np.where(match & (h >= DENSE * c), c, 0).max(1))
        h2, c2 = h1, c1
        h1, c1 = np.zeros_like(h1), np.zeros_like(c1)
        h1[:, lo + 1 : hi + 2], c1[:, lo + 1 : hi + 2] = h, c
    return best, np.maximum(at_best, long)


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        f = f.iloc[np.argsort(f["passage"].str.len().to_numpy(), kind="stable")]
        for at in range(0, len(f), 128):
            g = f.iloc[at : at + 128]
            number: dict[str, int] = {}
            code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
            score, span = align_many([code(x) for x in g["item_words"]], [np.asarray(x, np.int16) for x in g["own"]], [code(x) for x in g["passage"]])
            yield pd.DataFrame({"doc": g["doc"].to_numpy(), "item": g["item"].to_numpy(), "score": score, "own_words": span.astype("int64")})


def leaked(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, least: int = 15) -> DataFrame:
    """Documents that carry at least ``least`` words in a row of an item's own wording: ``doc, item, own_words, score``.

    Words are compared without case, punctuation and markup; what references, templates, comments and captions say is searched on its own and in its
    place, the text about it with and without it (see ``text.streams``). Runs of SEED words that at most SEED_ITEMS items share are the
    seeds; each pair of a document and an item with a common seed is aligned about its seeds (Smith-Waterman), window by window of WINDOW words so that no alignment grows
    with its document, where words may be changed, added or dropped. Words in runs that at least SHARED_ITEMS items have (instructions) are not an item's own and do not count. All documents are
    searched whole; equal texts are searched once. Null and empty texts leak nothing; a repeated id counts as one
    document or item.
    """
    it = items.select(F.col(item_id).alias("item"), _words(item_text).alias("words")).filter(F.size("words") > 0).dropDuplicates(["item"])
    it = cut(it)
    grams = _explode_grams(it, "item", SEED).select(F.col("id").alias("item"), "gram", F.col("pos").alias("item_pos"))
    seeds = grams.join(grams.groupBy("gram").agg(F.countDistinct("item").alias("n")).filter(F.col("n") <= SEED_ITEMS), "gram").select("item", "gram").distinct()
    runs = _explode_grams(it, "item", SHARED)
    common = runs.join(runs.groupBy("gram").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= SHARED_ITEMS), "gram").groupBy(F.col("id").alias("item")).agg(F.collect_set("pos").alias("common"))
    it = it.join(common, "item", "left").withColumn(
        "own", F.transform("words", lambda w, i: F.when(F.coalesce(F.exists("common", lambda p: i.between(p, p + SHARED - 1)), F.lit(False)), 0).otherwise(1))
    ).select("item", F.col("words").alias("item_words"), "own")
    it, seeds = cut(it), cut(seeds)

    d = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).filter(F.length("text") > 0).withColumn("h", F.md5("text"))
    one = d.groupBy("h").agg(F.min("doc").alias("rep"), F.min("text").alias("text"))
    one = cut(one.select("rep", "h", "text").mapInPandas(_streams, "rep long, h string, run int, words array<string>"))
    grams = _explode_grams(one.withColumn("part", F.struct("rep", "run")), "part", SEED)
    window = F.floor(F.col("pos") / WINDOW)
    hits = grams.join(small(seeds), "gram").groupBy(F.col("id.rep").alias("rep"), F.col("id.run").alias("run"), "item", window.alias("window")).agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    pairs = hits.join(one.select("rep", "run", "words"), ["rep", "run"]).join(small(it), "item")
    n = F.size("item_words")
    begin = F.greatest(F.col("a") - n - MARGIN, F.lit(0))
    about = pairs.select(F.col("rep").alias("doc"), "item", "item_words", "own", F.slice("words", begin + 1, F.col("b") + SEED + n + MARGIN - begin).alias("passage"), begin.alias("begin"))
    found = about.repartition("doc", "item", "begin").mapInPandas(_aligned, "doc long, item long, score double, own_words long").filter(F.col("own_words") >= least)
    found = found.groupBy(F.col("doc").alias("rep"), "item").agg(F.max(F.struct("own_words", "score")).alias("best")).select("rep", "item", "best.own_words", "best.score")
    same = d.join(one.select("rep", "h").distinct(), "h")  # every document with the one that stands for its text
    return found.join(same.select("doc", "rep"), "rep").select("doc", "item", "own_words", F.round("score", 1).alias("score")).distinct()
