"""Quality by positive-unlabelled learning: non-negative unbiased risk with an estimated class prior, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .labelled import fold, id_sample

SIGNS = b"!?.,;:'\"()[]{}<>#*$%&|@/\\_-+=~^`"


def features(text: str) -> np.ndarray:
    """Shares of character kinds and signs, and how long, varied and repetitive words and lines are. All of the text counts."""
    data = text.encode()
    words = data.split()
    if not words:
        return np.zeros(len(SIGNS) + 14)
    count = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n, chars = len(words), len(data) - count[[9, 10, 11, 12, 13, 32]].sum()
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = len(set(zip(words, words[1:], words[2:])))
    upper, lower, digit = count[65:91].sum(), count[97:123].sum(), count[48:58].sum()
    return np.concatenate((np.sqrt(count[list(SIGNS)] / n), [
        1.0, np.log1p(n), np.log1p(chars / n), np.log1p(n / len(lines)), upper / chars, lower / chars, digit / chars,
        count[128:192].sum() / chars, count[192:].sum() / chars, upper / max(1, upper + lower), len(set(words)) / n,
        windows / max(1, n - 2), len(set(lines)) / len(lines), sum(len(w) == 1 for w in words) / n,
    ]))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.ready(x) @ self.hidden) @ self.out[:-1] + self.out[-1]

    def ready(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((x, np.ones((len(x), 1))), axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(p: np.ndarray, u: np.ndarray, slopes, units: int, steps: int, rate: float, seed: int) -> Model:
    """A tanh layer trained by Adam; ``slopes(zp, zu)`` gives the risk's derivatives by the logits of positives and unlabelled rows."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((p, u))
    model = Model(both.mean(axis=0), both.std(axis=0) + 1e-3, rng.normal(0, 0.2, (p.shape[1] + 1, units)), np.zeros(units + 1), 0.0)
    model.out[:-1] = rng.normal(0, 0.2, units)
    x = model.ready(both)
    moments = [np.zeros_like(w) for w in (model.hidden, model.out, model.hidden, model.out)]
    for t in range(1, steps + 1):
        h = np.tanh(x @ model.hidden)
        z = h @ model.out[:-1] + model.out[-1]
        g = np.concatenate(slopes(z[: len(p)], z[len(p) :]))
        grads = [x.T @ (g[:, None] * model.out[None, :-1] * (1 - h**2)) + 1e-4 * model.hidden, np.append(h.T @ g, g.sum()) + 1e-4 * model.out]
        for k, (w, d) in enumerate(zip((model.hidden, model.out), grads)):
            moments[k] = 0.9 * moments[k] + 0.1 * d
            moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * d**2
            w -= rate * (moments[k] / (1 - 0.9**t)) / (np.sqrt(moments[k + 2] / (1 - 0.999**t)) + 1e-8)
    return model


def non_negative_slopes(prior: float):
    """Of prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) with the logistic loss l.

    Where the estimated risk of the negatives falls below zero, the step goes up that part instead, so the
    model can't win by calling known positives negative.
    """

    def slopes(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss_n = lambda z: np.logaddexp(0, z)  # noqa: E731  (the loss of calling z negative)
        negative = loss_n(zu).mean() - prior * loss_n(zp).mean()
        up_p, up_u = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if negative < 0:
            return -up_p, -up_u
        return prior * (sigmoid(zp) - 1) / len(zp) + up_p, up_u

    return slopes


def estimate_prior(p: np.ndarray, u: np.ndarray, seed: int = 1) -> float:
    """Share of positives among the unlabelled: the least ratio of the two sides' top tails.

    A model that tells positives from unlabelled rows is fitted on one half. On the other half, the tail above
    any cut holds at least prior times the positives' tail, and nearly only that where negatives are rare.
    """
    halves = [(x[::2], x[1::2]) for x in (p, u)]
    (p1, p2), (u1, u2) = halves
    if min(map(len, (p1, p2, u1, u2))) < 10:
        return 0.5
    plain = lambda zp, zu: ((sigmoid(zp) - 1) / len(zp), sigmoid(zu) / len(zu))
    model = descend(p1, u1, plain, 8, 150, 0.02, seed)
    zp, zu = np.sort(model.logit(p2)), np.sort(model.logit(u2))
    cuts = np.quantile(zp, np.linspace(0.02, 0.7, 60))
    of_p, of_u = (1 - np.searchsorted(z, cuts) / len(z) for z in (zp, zu))
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(zp)) + 1 / np.sqrt(len(zu)))
    best = int(np.argmin((of_u + slack) / np.maximum(of_p, 1e-6)))
    return float(np.clip(of_u[best] / of_p[best], 0.05, 0.95))


def fit(p: np.ndarray, u: np.ndarray, units: int = 16, steps: int = 400, rate: float = 0.02, seed: int = 1) -> Model:
    if len(p) < 2 or len(u) < 2:  # nothing to compare: every text is as likely good as not
        width = len(SIGNS) + 14
        return Model(np.zeros(width), np.ones(width), np.zeros((width + 1, 1)), np.zeros(2), 0.5)
    prior = estimate_prior(p, u, seed)
    model = descend(p, u, non_negative_slopes(prior), units, steps, rate, seed)
    model.prior = prior
    return model


def feature_rows(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """The features of the texts with the given ids, by id. Whole texts are read in the tasks; the driver gets a fixed number of numbers per id."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in text])

    found = texts.select("doc_id", measured("text").alias("x")).toPandas().sort_values("doc_id")["x"]
    return np.stack(found.tolist()) if len(found) else np.zeros((0, len(SIGNS) + 14))


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, rows: int = 3000) -> Model:
    """Fit on at most ``rows`` trusted positives outside the held-out fold, and on ``rows`` of all other documents as the unlabelled side.

    The unlabelled side is drawn without a look at the labels 0 or at those of the held-out fold, so it does not matter how many rows have one. The bounds keep what the driver receives
    the same for any number of rows; texts count whole. Labels 0 are never read. Without two trusted texts there is nothing to learn
    from: every text then scores .5. With fewer than 20 texts on a side the class prior is taken as .5.
    """
    trusted = labels.filter((F.col("quality") == 1) & (fold("doc_id", folds) != held_out)).select("doc_id")
    others = docs.select("doc_id").join(trusted, "doc_id", "left_anti")
    return fit(*(feature_rows(docs, id_sample(ids, rows)) for ids in (trusted, others)))


def quality_of(spark: SparkSession, model: Model):
    """A function of a text column: the model's score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = [features(t) for t in texts]
            yield pd.Series(shared.value.score(np.stack(rows)) if rows else [], dtype="float64")

    return lambda text: quality(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, score, predicted. Reads the text alone, whole.

    Empty and null texts have features of zero and a score like any other. Repeated rows stay; an empty table gives no
    rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), quality_of(docs.sparkSession, model)(F.col(text_col)).alias("score"))
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their own columns."""
    rows = docs.select(F.struct("*").alias("row"), quality_of(docs.sparkSession, model)(F.col(text_col)).alias("score"))
    return rows.filter(F.col("score") >= threshold).select("row.*")
