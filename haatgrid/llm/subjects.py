"""Subject areas of documents, by interpolated n-gram language models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..util import cut
from .text import sentences, tokens, wording

#: Most labelled documents a model is fitted on, and most characters of them; beyond it, those with the smallest hash of their id.
TRAIN_DOCS, TRAIN_CHARS = 5000, 60_000_000
#: One in so many of them is held out to calibrate the margin of acceptance.
HELD_OUT = 5
#: Different runs of words of test items up to which they are sent to the scorers; beyond it, sentences are compared with them by a join.
ITEM_RUNS = 2_000_000
#: Occurrences in training that give a word a number of its own.
VOCABULARY_MIN = 4
#: Lead that a document's label has over other subjects in training, as a log probability.
LABEL = 2.0
#: Words of the runs by which sentences taken from test items are known, and the share of a sentence they must cover.
RUN, RUN_SHARE = 4, 0.4
#: Share of a text's prose sentences from which a subject counts.
SHARE = 0.25

_UNKNOWN, _START = 0, 1
_BITS = 21


@dataclass
class SubjectModel:
    """Interpolated trigram models of each subject and of the background, as tables of log probability ratios' parts.

    ``grams[n]`` are the sorted codes of the n-grams seen, ``counts[n]`` their counts by class and ``context[n]`` those of
    their contexts; the background is the last class."""

    subjects: list[str]
    words: dict[str, int]
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    counts: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    context_counts: dict[int, np.ndarray] = field(default_factory=dict)
    context_kinds: dict[int, np.ndarray] = field(default_factory=dict)
    telling: np.ndarray | None = None
    margin: float = 0.0

    def numbers(self, sents: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of sentences in a row, the two words before each, and the sentence of each."""
        w, s = [], []
        get = self.words.get
        for k, x in enumerate(sents):
            t = [get(v, _UNKNOWN) for v in tokens(x)]
            w += [_START, _START, *t]
            s += [k] * (len(t) + 2)
        w, s = np.array(w, np.int64), np.array(s, np.int64)
        keep = np.flatnonzero(w != _START)
        return w[keep], w[keep - 1], w[keep - 2], s[keep]

    def fit(self, w: np.ndarray, v: np.ndarray, u: np.ndarray, share: np.ndarray, s: np.ndarray) -> None:
        """``share`` has for each sentence how much it counts for each class, and ``s`` the sentence of each word. Longer runs seen once are
        left out, their contexts' totals not."""
        k = share.shape[1]
        for n, code in ((1, w), (2, v << _BITS | w), (3, (u << 2 * _BITS) | v << _BITS | w)):
            grams, inv, times = np.unique(code, return_inverse=True, return_counts=True)
            c = np.stack([np.bincount(inv, share[s, j], len(grams)) for j in range(k)], 1).astype(np.float32)
            ctx = grams >> _BITS if n > 1 else np.zeros(len(grams), np.int64)
            contexts, cinv = np.unique(ctx, return_inverse=True)
            total = np.stack([np.bincount(cinv, c[:, j], len(contexts)) for j in range(k)], 1).astype(np.float32)
            kinds = np.stack([np.bincount(cinv, c[:, j] > 0.5, len(contexts)) for j in range(k)], 1).astype(np.float32)
            keep = times > (1 if n > 1 else 0)
            often = np.bincount(cinv, times, len(contexts)) > 1
            self.grams[n], self.counts[n] = grams[keep], c[keep]
            self.contexts[n], self.context_counts[n], self.context_kinds[n] = contexts[often], total[often], kinds[often]

    def log_prob(self, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Log probability of each word in each class: each order interpolated with the one below by the number of kinds that follow its context."""
        p = np.full((len(w), len(self.subjects) + 1), 1.0 / (len(self.words) + 2), np.float32)
        for n, code in ((1, w), (2, v << _BITS | w), (3, (u << 2 * _BITS) | v << _BITS | w)):
            at, hit = _find(self.grams[n], code)
            c = np.where(hit[:, None], self.counts[n][at], 0)
            ctx = code >> _BITS if n > 1 else np.zeros(len(code), np.int64)
            at, hit = _find(self.contexts[n], ctx)
            total, kinds = np.where(hit[:, None], self.context_counts[n][at], 0), np.where(hit[:, None], self.context_kinds[n][at], 0)
            p = (c + (kinds + 0.5) * p) / (total + kinds + 0.5)
        return np.log(p)

    def gains(self, w: np.ndarray, v: np.ndarray, u: np.ndarray, s: np.ndarray, n: int, step: int = 50_000) -> np.ndarray:
        """Per sentence and subject the gain in log probability over the background, words weighted by how telling they are."""
        out = np.zeros((n, len(self.subjects)))
        for a in range(0, len(w), step):
            x = slice(a, a + step)
            lp = self.log_prob(w[x], v[x], u[x])
            np.add.at(out, s[x], (lp[:, :-1] - lp[:, -1:]) * self.telling[w[x]][:, None])
        return out

    def score(self, sents: list[str]) -> np.ndarray:
        return self.gains(*self.numbers(sents), len(sents)) if sents else np.zeros((0, len(self.subjects)))

    def belong(self, sents: list[str]) -> np.ndarray:
        """Subject of each sentence, -1 for none."""
        if not sents:
            return np.zeros(0, int)
        g = self.score(sents)
        k = g.argmax(1)
        return np.where(g[np.arange(len(g)), k] > self.margin, k, -1)


def _telling(w: np.ndarray, label: np.ndarray, words: int, k: int) -> np.ndarray:
    """How much each word tells of the subject, from 0 to 1: the divergence of its labels from the usual ones, less what chance gives.

    Cross-entropies are compared with these weights, so words of all subjects do not add up to one by chance."""
    c = np.zeros((words, k))
    np.add.at(c, (w, label), 1)
    usual = c.sum(0) / c.sum()
    n = c.sum(1)
    p = (c + usual) / (n + 1)[:, None]
    div = (p * np.log(p / np.maximum(usual, 1e-9))).sum(1) - (k - 1) / (2 * np.maximum(n, 1))
    out = np.clip(div / 0.3, 0, 1)
    out[_UNKNOWN] = 0
    return out


def _find(table: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, code), max(len(table) - 1, 0))
    return at, (table[at] == code) if len(table) else np.zeros(len(code), bool)


def train(texts: list[str], labels: list[str], rounds: int = 4) -> SubjectModel:
    """Models from documents that carry one label each, though they may be about two subjects or wrongly labelled.

    At first every sentence counts for its document's label and for the background. Then each sentence is given to the label, or to another subject
    as far as that explains it better by more than LABEL, and the models are fitted anew; the background always has all
    sentences. Sentences about nothing in particular stay with the label, so that every model knows them and none gains by them. One document in HELD_OUT takes no part in
    this: on these the margin of acceptance is calibrated, as the one at which labels are met most and the fewest others are accepted. A last fit has all documents.
    """
    subjects = sorted(set(labels))
    number = {s: k for k, s in enumerate(subjects)}
    sents, label, doc = [], [], []
    for d, (t, s) in enumerate(zip(texts, labels)):
        x = sentences(t)
        sents += x
        label += [number[s]] * len(x)
        doc += [d] * len(x)
    freq: dict[str, int] = {}
    for x in sents:
        for t in tokens(x):
            freq[t] = freq.get(t, 0) + 1
    m = SubjectModel(subjects, {t: k + 2 for k, t in enumerate(sorted(t for t, c in freq.items() if c >= VOCABULARY_MIN))})
    k = len(subjects)
    if not sents:
        for n in (1, 2, 3):
            m.grams[n] = m.contexts[n] = np.zeros(0, np.int64)
            m.counts[n] = m.context_counts[n] = m.context_kinds[n] = np.zeros((0, k + 1), np.float32)
        m.telling = np.zeros(len(m.words) + 2)
        return m
    label, doc = np.array(label), np.array(doc)
    w, v, u, s = m.numbers(sents)
    m.telling = _telling(w, label[s], len(m.words) + 2, k)
    share = np.zeros((len(sents), k + 1), np.float32)
    share[np.arange(len(sents)), label] = 1
    share[:, k] = 1
    held = doc % HELD_OUT == HELD_OUT - 1 if doc[-1] >= 20 * HELD_OUT else np.zeros(len(sents), bool)
    part = ~held[s]
    for r in range(rounds):
        m.fit(w[part], v[part], u[part], share, s[part])
        gain = m.gains(w, v, u, s, len(sents)) if r == rounds - 1 else m.gains(w[part], v[part], u[part], s[part], len(sents))
        g = gain.copy()
        g[np.arange(len(sents)), label] += LABEL
        g = np.exp(g - g.max(1, keepdims=True))
        share[:, :k] = g / g.sum(1, keepdims=True)
    judged = held if held.any() else ~held
    best, top = gain.argmax(1), gain.max(1)
    n = np.bincount(doc[judged], minlength=len(texts))
    told = np.array([number[x] for x in labels])
    scores = []
    for margin in np.arange(3, 21) / 10:
        hit = np.zeros((len(texts), k))
        ok = judged & (top > margin)
        np.add.at(hit, (doc[ok], best[ok]), 1)
        accepted = (hit >= SHARE * np.maximum(n, 1)[:, None]) & (hit > 0)
        met = accepted[np.arange(len(texts)), told][n > 0].mean() if (n > 0).any() else 0
        scores.append((met - 0.1 * accepted.sum(1)[n > 0].mean(), -margin))
    m.margin = float(-max(scores)[1])
    m.fit(w, v, u, share, s)
    return m


def run_hashes(words: list[str]) -> np.ndarray:
    """Hashes of the runs of RUN words, in order."""
    return np.array([xxhash.xxh3_64_intdigest(" ".join(words[k : k + RUN])) >> 1 for k in range(len(words) - RUN + 1)], np.int64)


def _covered(at: np.ndarray) -> int:
    """Words that runs beginning at the given places cover."""
    return len(np.unique((at[:, None] + np.arange(RUN)[None]).ravel()))


def taken_over(sents: list[str], runs: np.ndarray) -> list[bool]:
    """Whether a sentence is from a test item: runs of the items' words, by their sorted hashes, cover much of it."""
    out = []
    for x in sents:
        w = wording(x)
        at = np.flatnonzero(_find(runs, run_hashes(w))[1])
        out.append(bool(len(at)) and _covered(at) >= RUN_SHARE * len(w))
    return out


def _item_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for t in f["text"]:
            yield pd.DataFrame({"run": np.unique(run_hashes(wording(t)))})


def _sentence_runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for i, h, t in zip(f["doc"], f["h"], f["text"]):
            rows = [(k, len(w), run_hashes(w)) for k, w in enumerate(map(wording, sentences(t)))]
            if rows:
                size = [len(r) for _, _, r in rows]
                at = np.concatenate([np.arange(z) for z in size])
                yield pd.DataFrame({"doc": i, "h": h, "sent": np.repeat([k for k, _, _ in rows], size), "n": np.repeat([n for _, n, _ in rows], size), "at": at, "run": np.concatenate([r for _, _, r in rows])})


def _marked(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with ``skip``, the numbers of their sentences that are from test items, told by a join with the items' runs."""
    d = docs.withColumn("h", F.md5("text"))
    hits = d.mapInPandas(_sentence_runs, "doc long, h string, sent long, n long, at long, run long").join(runs, "run")
    words = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda a: F.sequence(a, a + RUN - 1))))
    sents = hits.groupBy("doc", "h", "sent", "n").agg(F.size(words).alias("covered")).filter(F.col("covered") >= RUN_SHARE * F.col("n"))
    return d.join(sents.groupBy("doc", "h").agg(F.collect_set("sent").alias("skip")), ["doc", "h"], "left").select("doc", "text", "skip")


def subject_shares(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, subject: str, items: DataFrame | None = None, item_text: str = "text", train_docs: int = TRAIN_DOCS, item_runs: int = ITEM_RUNS) -> DataFrame:
    """Share of each document's prose sentences that belong to each subject: ``doc, subject, share, n_sentences``.

    The models are fitted on at most ``train_docs`` labelled documents of TRAIN_CHARS characters in all, a bounded sample by the hash of their id, and sent to all
    executors; every document is then scored whole. Sentences taken from ``items`` do not count: up to ``item_runs`` different runs of their words are sent along, more
    are joined, with the same result. Null and
    empty texts, redirects and texts without prose give no rows; so does everything if there are no labels. Documents with several labels
    are trained on once per label; repeated ids give repeated rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).filter(F.length("text") > 0)
    runs, sent_along = None, np.zeros(0, np.int64)
    if items is not None:
        runs = cut(items.select(F.col(item_text).alias("text")).filter(F.length("text") > 0).mapInPandas(_item_runs, "run long").distinct())
        if runs.limit(item_runs + 1).count() <= item_runs:
            sent_along, runs = np.sort(runs.toPandas()["run"].to_numpy(np.int64)), None
    if runs is not None:
        texts = _marked(texts, runs)
    else:
        texts = texts.withColumn("skip", F.lit(None).cast("array<long>"))
    lab = labels.select(F.col(label_id).alias("doc"), F.col(subject).alias("subject")).filter(F.col("subject").isNotNull()).distinct()
    lab = lab.orderBy(F.xxhash64("doc"), "doc", "subject").limit(train_docs)
    sizes = texts.join(F.broadcast(lab), "doc").select("doc", "subject", F.length("text").alias("n")).orderBy(F.xxhash64("doc"), "doc", "subject").toPandas()
    chosen = sizes[sizes["n"].cumsum() <= max(TRAIN_CHARS, sizes["n"].iloc[0] if len(sizes) else 0)][["doc", "subject"]].drop_duplicates()
    model = None
    if len(chosen):
        few = spark.createDataFrame([(int(d), x) for d, x in zip(chosen["doc"], chosen["subject"])], "doc long, subject string")
        known = texts.join(F.broadcast(few), "doc").orderBy("doc", "subject").toPandas()
        model = train([_own(t, sent_along, k) for t, k in zip(known["text"], known["skip"])], known["subject"].tolist())
    sent = spark.sparkContext.broadcast((model, sent_along))

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, along = sent.value
        for f in (g.iloc[a : a + 500] for g in frames for a in range(0, len(g), 500)):
            ids, subs, shares, ns = [], [], [], []
            sents, spans = [], []
            for i, t, k in zip(f["doc"], f["text"], f["skip"]):
                x = _prose(t, along, k)
                spans.append((i, len(sents), len(sents) + len(x)))
                sents += x
            got = m.belong(sents) if m is not None else np.full(len(sents), -1)
            for i, a, b in spans:
                if b > a:
                    k, c = np.unique(got[a:b][got[a:b] >= 0], return_counts=True)
                    ids += [i] * len(k)
                    subs += [m.subjects[j] for j in k]
                    shares += (c / (b - a)).tolist()
                    ns += [b - a] * len(k)
            yield pd.DataFrame({"doc": np.array(ids, "int64"), "subject": pd.Series(subs, dtype=object), "share": np.array(shares, "float64"), "n_sentences": np.array(ns, "int64")})

    return texts.mapInPandas(score, "doc long, subject string, share double, n_sentences long")


def _prose(text: str, runs: np.ndarray, skip: np.ndarray | None) -> list[str]:
    """Prose sentences of a text that are not from test items."""
    x = sentences(text)
    if skip is not None:
        gone = set(skip)
        return [a for k, a in enumerate(x) if k not in gone]
    return [a for a, b in zip(x, taken_over(x, runs)) if not b] if len(runs) else x


def _own(text: str, runs: np.ndarray, skip: np.ndarray | None) -> str:
    """Prose of a text without sentences from test items, a sentence a line."""
    return "\n".join(_prose(text, runs, skip))
