"""Vector columns: which rows hold a usable vector, and one length for all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True for vectors with at least one entry and only finite ones; false, never null, for the others."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The entries of each vector, 0 for an empty table. Vectors of several lengths are an error that names the least and the largest."""
    low, high = vectors.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high:
        raise ValueError(f"vectors of one length are needed; {column!r} holds {low} to {high} entries")
    return low or 0
