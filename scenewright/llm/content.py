"""Abusive, hateful or sexual content: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import sorted_unique
from .canonical import LOOKALIKES

# Digits and signs that stand for letters inside words.
LEET = str.maketrans("013457@$!|", "oieastasii")
CLEAN = "clean"

#: n-grams, size of the hashed feature space, sentences that a gram must be in, and labelled documents of either
#: kind that a model is fitted on.
GRAMS = (3, 4, 5, 6)
DIMENSIONS = 1 << 20
MIN_SENTENCES = 3
THRESHOLD = 0.7
MAX_LABELLED = 4000
#: Longest stretch scored as one sentence, and what two stretches of a longer one share.
STRETCH, OVERLAP = 400, 60

_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_COMBINING = re.compile("[\u0300-\u036f]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’“)]*\s+|\n+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_·]{1,3}){2,}[^\W_](?![^\W_])")
_WITHIN = re.compile(r"\w*[^\W\d_](?:[\w@$*]|[!|](?=\w))*")
#: A digit or sign that stands beside others of a word: without one there is nothing to replace.
_REPLACED = re.compile(r"(?<=[\w@$*])(?:[013457@$]|[!|](?=\w))|[013457](?=[\w@$*])")
_LONG = re.compile(r"(\w)\1{2,}")


def _joined(m: re.Match) -> str:
    return re.sub(r"[ .\-·]", "", m.group()).replace("_", " ")


def plain(text: str) -> str:
    """A sentence without its disguises: look-alikes, invisible signs, spaced, stretched or replaced letters, accents."""
    if text.isascii():
        t = text.lower()
    else:
        t = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(LOOKALIKES).casefold()
        t = _COMBINING.sub("", unicodedata.normalize("NFD", t))
    t = _SPACED.sub(_joined, t)
    t = re.sub(r"\b\d+\b", "0", t)
    if _REPLACED.search(t):
        t = _WITHIN.sub(lambda m: m.group().translate(LEET), t)
    t = _LONG.sub(r"\1", t)
    return " " + " ".join(re.sub(r"[^\w*]+", " ", t).split()) + " "


def sentences(text: str) -> list[str]:
    """The plain sentences of a whole text; what is longer than ``STRETCH`` comes in overlapping stretches."""
    out = []
    for s in _SENTENCE.split(text):
        s = plain(s) if s else ""
        if len(s) <= STRETCH:
            if len(s) > 3:
                out.append(s)
        else:
            out += [s[i : i + STRETCH] for i in range(0, len(s) - OVERLAP, STRETCH - OVERLAP)]
    return out


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    length = np.array([len(t) for t in texts], dtype=np.int64)
    end = np.repeat(np.cumsum(length), length)
    owner = np.repeat(np.arange(len(texts)), length)
    at = np.arange(len(codes))
    h, ids, own = codes.copy(), [], []
    with np.errstate(over="ignore"):
        for n in range(2, max(GRAMS) + 1):
            h = h[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1 :]
            if n in GRAMS:
                ok = at[: len(h)] + n <= end[: len(h)]
                mixed = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                ids.append((mixed >> np.uint64(40)).astype(np.int64) % DIMENSIONS)
                own.append(owner[: len(h)][ok])
    key = sorted_unique(np.concatenate(own) * DIMENSIONS + np.concatenate(ids))
    return (key % DIMENSIONS).astype(np.int32), np.bincount(key // DIMENSIONS, minlength=len(texts))


def features(texts: list[str], chunk: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after another, and how many each text has; each gram once a text."""
    ids, n, own, size = [], [], [], 0
    for k, t in enumerate(texts):
        own.append(t)
        size += len(t)
        if size >= chunk or k == len(texts) - 1:
            a, b = _features(own)
            ids.append(a)
            n.append(b)
            own, size = [], 0
    if not ids:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate(ids), np.concatenate(n)


def _dot(w: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(w[ids], dtype=np.float64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """Of each text, the score of its worst sentence; a text without sentences is as clean as can be."""
        parts = [sentences(t) if t else [] for t in texts]
        flat = [s for p in parts for s in p]
        out = np.full(len(texts), -np.inf)
        if flat:
            ids, n = features(flat)
            known = np.bincount(np.repeat(np.arange(len(n)), n), weights=self.weights[ids] != 0, minlength=len(n)) + 1
            s = _dot(self.weights, ids, n) / np.sqrt(known) + self.bias
            np.maximum.at(out, np.repeat(np.arange(len(texts)), [len(p) for p in parts]), s)
        return out


def _fit(at: np.ndarray, n: np.ndarray, y: np.ndarray, width: int, strength: float = 1e-4, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression on features scaled by r = log ratio of their smoothed shares in either class.

    Feature 0 is held by every row and stands for the bias. Gives the weights and r, both by feature.
    """
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    pos = np.bincount(at, weights=y[row], minlength=width) + 1.0
    neg = np.bincount(at, weights=~y[row], minlength=width) + 1.0
    r = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    scale = 1.0 / np.sqrt(n)
    x = (r[at] * scale[row]).astype(np.float32)
    start = np.cumsum(n) - n
    r[0] = 1.0
    x[start] = 1.0
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1))
    w, m, v = (np.zeros(width) for _ in range(3))
    for t in range(1, steps + 1):
        z = np.add.reduceat(w.astype(np.float32)[at] * x, start)
        g = share * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y)
        gw = np.bincount(at, weights=g.astype(np.float32)[row] * x, minlength=width)
        gw[1:] += strength * w[1:]
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        w -= 0.07 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    return w, r


def fit(texts: list[str], bad: list[bool], rounds: int = 2) -> Model:
    """A model of sentences from labels of whole texts.

    All sentences of clean texts are clean. Of a bad text only the sentence that scores worst is taken for
    bad (at first all its sentences are), with others that score bad; the rest of it is left out, and so is
    a bad text none of whose sentences scores bad in the end: a reviewer's slip.
    """
    parts = [sentences(t) if t else [] for t in texts]
    flat = [s for p in parts for s in p]
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    y = np.array(bad, dtype=bool)[doc] if len(flat) else np.zeros(0, dtype=bool)
    if not y.any() or y.all():
        return Model(np.zeros(DIMENSIONS), -1.0 if not y.any() else 1.0)
    ids, n = features(flat)
    often = np.bincount(ids, minlength=DIMENSIONS) >= MIN_SENTENCES
    number = np.zeros(DIMENSIONS, dtype=np.int32)
    known = np.flatnonzero(often)
    number[known] = np.arange(1, len(known) + 1)
    kept = often[ids]
    row = np.repeat(np.arange(len(n)), n)[kept]
    n = np.bincount(row, minlength=len(n)) + 1
    at = np.zeros(n.sum(), dtype=np.int32)
    first = np.cumsum(n) - n
    free = np.ones(len(at), dtype=bool)
    free[first] = False
    at[free] = number[ids[kept]]
    of_bad = y.copy()
    keep = np.ones(len(y), dtype=bool)
    for k in range(rounds + 1):
        chosen = np.repeat(keep, n)
        w, r = _fit(at[chosen], n[keep], y[keep], len(known) + 1)
        if k == rounds:
            break
        value = w * r
        s = np.add.reduceat(value[at], first)
        s = (s - value[0]) / np.sqrt(n) + value[0]
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, s)
        y = of_bad & ((s == worst[doc]) | (s > 1.0)) & ((s > 0.0) if k else True)
        keep = ~of_bad | y
        if not y.any():
            break
    weights = np.zeros(DIMENSIONS, dtype=np.float32)
    weights[known] = (w * r)[1:]
    return Model(weights, float(w[0]))


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, bad: documents whose reviewers agree by majority; ties, blank and unknown labels have no say."""
    word = F.lower(F.trim("label"))
    votes = labels.where("doc_id is not null").select("doc_id", word.alias("l")).where(F.col("l").isin(CLEAN, "abusive", "hateful", "sexual"))
    votes = votes.groupBy("doc_id").agg(F.sum(F.when(F.col("l") == CLEAN, -1).otherwise(1)).alias("v")).where("v <> 0")
    texts = documents.where("text is not null").select("doc_id", "text")
    return texts.join(votes.select("doc_id", (F.col("v") > 0).alias("bad")), "doc_id")


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model fitted on at most ``max_labelled`` documents labelled bad and as many labelled clean.

    Both samples are plain ones, drawn by hash; the training is the same whatever the number of labels.
    """
    d = labelled(documents, labels).dropDuplicates(["doc_id"]).cache()
    try:
        draw = lambda bad: d.where(F.col("bad") == bad).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("text", "bad").toPandas()
        rows = pd.concat([draw(True), draw(False)])
        return fit(rows["text"].tolist(), rows["bad"].tolist())
    finally:
        d.unpersist()


def scored(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``logit`` and ``score`` in 0..1 of its worst sentence; null and empty texts score 0."""
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def logit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(*sent.value)
        for b in batches:
            texts = [None if t is None else t for t in b]
            out = np.empty(len(texts))
            i = 0
            while i < len(texts):  # a bounded number of characters at once
                j, size = i, 0
                while j < len(texts) and (j == i or size < 300_000):
                    size += len(texts[j] or "")
                    j += 1
                out[i:j] = m.logits(texts[i:j])
                i = j
            yield pd.Series(np.maximum(out, -60.0))

    return documents.withColumn("logit", logit(F.col(text))).withColumn("score", F.when(F.col("logit") > -60, 1 / (1 + F.exp(-F.col("logit")))).otherwise(0.0))


def scored_documents(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, source, score, flagged for every document, null and empty texts included (score 0).

    The model is trained on the labelled documents; without usable labels of both kinds nothing is flagged.
    Repeated rows are scored each; the target side of a pair does not count.
    """
    model = train(documents, labels, max_labelled)
    out = scored(documents.select("doc_id", "source", "text"), model)
    return out.select("doc_id", "source", "score", (F.col("score") > threshold).alias("flagged"))


def rates(scores: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones, their rate and the mean score."""
    flagged = F.count(F.when(F.col("flagged"), 1))
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_flagged"), (flagged / F.count(F.lit(1))).alias("rate"), F.avg("score").alias("mean_score"))
