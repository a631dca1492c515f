"""Bounded samples of labelled rows for the driver to fit a model on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def fold(doc_id: str, folds: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def id_sample(ids: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` ids with the least hashes. Only ids are sorted."""
    return ids.filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def texts_of(docs: DataFrame, ids: DataFrame, max_bytes: int) -> pd.DataFrame:
    """(doc_id, text) of the sampled ids, by id: at most as many rows as the sample has, of at most ``max_bytes`` each, one per id."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    found = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.toPandas().sort_values("doc_id", ignore_index=True)
