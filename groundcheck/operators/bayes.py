"""Multinomial naive Bayes on TF-IDF weights: sums per term, then scores inside each text's row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.proba import argmax, softmax
from ..schema import LABELS, id_to_label
from .tfidf import unrolled


def bayes_fit(rows: DataFrame, size: int, alpha: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """``(term_idx, theta)`` with one log-likelihood per label for each of the ``size`` terms, and the one-row log priors.

    ``rows`` is ``tfidf_rows`` with the label. The prior is not smoothed; a label without rows gets minus infinity.
    """
    per_label = [F.when(F.col("label") == name, F.col("tfidf")).otherwise(0.0) for name in LABELS]
    sums = unrolled(rows.select("label", "term_idx", "tfidf"), "term_idx", "tfidf").groupBy("term_idx").agg(
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(per_label)])
    # a vocabulary term may be unseen only if the rows were filtered: keep the vocabulary whole
    terms = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("term_idx"))
    sums = terms.join(sums, "term_idx", "left").fillna(0.0)
    totals = sums.agg(
        F.count(F.lit(1)).alias("v"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(len(LABELS))]
    )
    total = totals.select(F.struct("*").alias("t")).scalar()
    theta = F.array(*[
        F.log((F.col(f"s{i}") + alpha) / (total[f"t{i}"] + alpha * total["v"])) for i in range(len(LABELS))
    ])
    n = F.count(F.lit(1))
    priors = rows.agg(F.array(*[
        F.coalesce(F.log(F.sum((F.col("label") == name).cast("double")) / n), F.lit(float("-inf"))) for name in LABELS
    ]).alias("prior"))
    return sums.select("term_idx", theta.alias("theta")), priors


def bayes_predict(rows: DataFrame, theta: DataFrame, priors: DataFrame) -> DataFrame:
    """``(id, *keep, score, proba, predict_label)`` for every row of ``tfidf_rows``.

    ``theta`` has one row per vocabulary term, as many as the vocabulary that the tasks held for the weights; it is held in the same way.
    """
    keys = [c for c in rows.columns if c not in ("term_idx", "tfidf")]
    table = theta.orderBy("term_idx").toArrow()
    held = rows.sparkSession.sparkContext.broadcast(table.column("theta").combine_chunks().flatten().to_numpy().reshape(-1, len(LABELS)))
    schema = T.StructType([*rows.select(*keys).schema, T.StructField("_s", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = held.value.shape[1]
        for batch in batches:
            index, weight = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("term_idx", "tfidf"))
            place = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("term_idx")).to_numpy(zero_copy_only=False))
            sums = np.stack([np.bincount(place, weight * held.value[index, i], minlength=batch.num_rows) for i in range(k)], axis=1)
            scores = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * k, pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], scores], [*keys, "_s"])

    prior = priors.scalar()
    score = F.array(*[F.get("_s", F.lit(i)) + prior[i] for i in range(len(LABELS))])
    out = rows.select(*keys, "term_idx", "tfidf").mapInArrow(run, schema).select(*keys, score.alias("score"))
    return out.select("*", softmax(F.col("score")).alias("proba"), id_to_label(argmax(F.col("score"))).alias("predict_label"))
