"""Toxicity: words as bags of subword vectors, averaged into a linear softmax and trained jointly in numpy."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .labelled import fold, id_sample, texts_of

BUCKETS = 1 << 20
#: A run of more than 200 characters (words joined by underscores, scripts without spaces) counts as several words, one after another.
WORDS = re.compile(r"\w{1,200}")
#: Words per window, each distinct one counted once, and the least number a window's sum is divided by (one word alone is no evidence of a share).
WINDOW, LEAST = 64, 16


def subwords(word: str, shortest: int = 3, longest: int = 5) -> list[int]:
    """Buckets of the word and of its character n-grams with borders: a misspelling shares most of them."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in range(shortest, longest + 1) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode()) & (BUCKETS - 1) for g in sorted({f"={word}", *grams})]


@dataclass
class Model:
    """``weights``: each bucket's vector times the difference of the two output rows. A word counts as the mean of its buckets."""

    weights: np.ndarray
    bias: float
    #: The score of a text without words: the share of toxic labels.
    share: float = 0.0

    def word(self, word: str) -> float:
        return float(self.weights[subwords(word)].mean())


class WordScores(dict):
    """Scores of words met so far, one cache per task, forgotten beyond ``limit`` words."""

    def __init__(self, model: Model, limit: int = 500_000):
        super().__init__()
        self.model, self.limit = model, limit

    def __missing__(self, word: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        score = self[word] = self.model.word(word)
        return score

    def score(self, text: str) -> float:
        """The largest window's probability; without words the share of toxic labels."""
        words = WORDS.findall(text.lower())
        if not words:
            return self.model.share
        bags = (set(words[at : at + WINDOW]) for at in range(0, len(words), WINDOW))
        top = self.model.bias + max(math.fsum(map(self.__getitem__, bag)) / max(len(bag), LEAST) for bag in bags)
        return float(1 / (1 + np.exp(-np.clip(top, -30, 30))))


def fit(texts: list[str], labels: np.ndarray, dims: int = 8, warm: int = 4, epochs: int = 6, rate: float = 0.5, batch: int = 128, least_docs: int = 5, decay: float = 3e-3, power: float = 0.3, updates: int = 600, seed: int = 1) -> Model:
    """Bucket vectors and the two output rows together, by Adagrad on the log loss.

    A row of the input is the bag of distinct words of a 64-word window, with the label of its text. After ``warm`` epochs a toxic
    text is its most toxic window only, since a label speaks of the whole text. Toxic rows weigh the class ratio to
    the power ``power``; buckets of fewer than ``least_docs`` texts stay zero. Few texts are gone over
    more often, so that there are at least ``updates`` steps.
    """
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():  # one class or none: its share, whatever the text
        p = np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99)
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(p / (1 - p))), float(p))
    vocabulary: dict[str, int] = {}
    owner, windows = [], []
    for doc, text in enumerate(texts):
        words = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORDS.findall(text.lower())], dtype=np.int64)
        for at in range(0, len(words), WINDOW):
            owner.append(doc)
            windows.append(np.unique(words[at : at + WINDOW]))
    owner = np.array(owner)
    buckets = [np.array(subwords(w)) for w in vocabulary]
    spread_over = np.zeros(BUCKETS, dtype=np.int64)
    for doc in range(len(texts)):
        mine = [windows[r] for r in np.flatnonzero(owner == doc)]
        if mine:
            spread_over[np.unique(np.concatenate([buckets[w] for w in np.unique(np.concatenate(mine))]))] += 1
    common = spread_over >= least_docs
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, dims))
    out, bias = rng.normal(0, 1.0, (2, dims)), np.zeros(2)
    seen_v, seen_o, seen_b = np.full(BUCKETS, 1e-3), np.full_like(out, 1e-3), np.full(2, 1e-3)

    def pooled(rows: np.ndarray):
        """Mean vectors of some windows, and what leads from them back to the buckets."""
        sizes = np.array([len(windows[r]) for r in rows])
        words, at = np.unique(np.concatenate([windows[r] for r in rows]), return_inverse=True)
        parts = [buckets[w] for w in words]
        lengths = np.array([len(p) for p in parts])
        flat = np.concatenate(parts)
        word_vectors = np.add.reduceat(vectors[flat], np.concatenate(([0], np.cumsum(lengths)[:-1]))) / lengths[:, None]
        mean = np.add.reduceat(word_vectors[at], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / np.maximum(sizes, LEAST)[:, None]
        return mean, sizes, at, lengths, flat

    def logits(rows: np.ndarray) -> np.ndarray:
        return np.concatenate([pooled(part)[0] @ out.T + bias for part in np.array_split(rows, max(1, len(rows) // 2048))])

    again = max(1, math.ceil(updates / (epochs * max(1, len(owner) / batch))))
    warm, epochs = warm * again, epochs * again
    toxic = labels[owner] == 1
    for epoch in range(epochs):
        use = np.arange(len(owner))
        if epoch >= warm:
            score = np.full(len(owner), -np.inf)
            score[toxic] = (lambda z: z[:, 1] - z[:, 0])(logits(np.flatnonzero(toxic)))
            best = np.lexsort((score, owner))
            last = best[np.append(owner[best][1:] != owner[best][:-1], True)]
            use = np.concatenate((np.flatnonzero(~toxic), last[toxic[last]]))
        weight = np.where(toxic, ((~toxic[use]).sum() / max(1, toxic[use].sum())) ** power, 1.0)
        for rows in np.array_split(rng.permutation(use), max(1, len(use) // batch)):
            mean, sizes, at, lengths, flat = pooled(rows)
            z = mean @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), toxic[rows].astype(int)] -= 1
            p *= weight[rows][:, None]
            g_out, g_bias = p.T @ mean, p.sum(axis=0)
            g_mean = (p @ out) / np.maximum(sizes, LEAST)[:, None]
            per_token = np.repeat(g_mean, sizes, axis=0)
            per_word = np.stack([np.bincount(at, per_token[:, k], minlength=len(lengths)) for k in range(dims)], axis=1) / lengths[:, None]
            hit, where = np.unique(flat, return_inverse=True)
            spread = np.repeat(per_word, lengths, axis=0)
            g_vec = np.stack([np.bincount(where, spread[:, k], minlength=len(hit)) for k in range(dims)], axis=1)
            seen_v[hit] += (g_vec**2).mean(axis=1)
            vectors[hit] -= rate * (g_vec / np.sqrt(seen_v[hit])[:, None] + decay * vectors[hit]) * common[hit][:, None]
            seen_o += g_out**2
            out -= rate * g_out / np.sqrt(seen_o)
            seen_b += g_bias**2
            bias -= rate * g_bias / np.sqrt(seen_b)
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def calibrate(model: Model, texts: list[str], labels: np.ndarray, least: int = 30) -> Model:
    """Scale and shift of the logit by logistic regression on texts the fit has not seen, given ``least`` of either class."""
    labels = np.asarray(labels, dtype=np.float64)
    if min((labels == 0).sum(), (labels == 1).sum()) < least:
        return model
    scores = WordScores(model)
    p = np.clip([scores.score(t) for t in texts], 1e-12, 1 - 1e-12)
    x = np.stack((np.log(p / (1 - p)), np.ones(len(p))), axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(30):  # Newton, with a small ridge towards the model as it is
        q = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (q - labels) + 0.5 * (line - [1.0, 0.0])
        line = line - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(2), slope)
    scale = max(float(line[0]), 0.05)
    return Model((model.weights * scale).astype(np.float32), model.bias * scale + float(line[1]))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 1, folds: int = 3, rows: int = 1500, max_bytes: int = 32_768) -> Model:
    """Fit on at most ``rows`` labelled texts of either class, of at most ``max_bytes``, outside the held-out fold.

    The bound keeps what the driver receives and the time to fit the same for any number of labels. Labels
    other than 0 and 1 are ignored; of several labels of one id the largest counts.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sides = [texts_of(docs, id_sample(known.filter(F.col("toxic") == c).select("doc_id"), rows), max_bytes) for c in (0, 1)]
    texts, toxic = [*sides[0]["text"], *sides[1]["text"]], np.repeat([0, 1], [len(s) for s in sides])
    apart = np.arange(len(texts)) % 5 == 4  # every fifth text calibrates
    model = fit([t for t, a in zip(texts, apart) if not a], toxic[~apart])
    model = calibrate(model, [t for t, a in zip(texts, apart) if a], toxic[apart])
    model.share = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, score, predicted. Reads the text alone, whole.

    The broadcast model has a fixed number of buckets (4 MB). Empty and null texts, and others without words, get the share of toxic labels. Repeated rows
    stay; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = WordScores(shared.value)
        for texts in batches:
            yield pd.Series([scores.score(t) for t in texts], dtype="float64")

    rows = docs.select(F.col(id_col).alias("id"), toxic(F.coalesce(F.col(text_col), F.lit(""))).alias("score"))
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
