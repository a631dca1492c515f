"""Order statistics without one task seeing all rows.

A window with no partition, or one partitioned by a label that holds a third of the rows, sends
those rows to one task. These helpers first count equal values (so copies collapse before the
shuffle), then cut the value range into slices of about equal size and order each slice alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: Distinct values one task puts in order.
SLICE_ROWS = 1_000_000


def top_rows(df: DataFrame, k: int, value: str, tiebreak: str) -> DataFrame:
    """The k rows with the largest integer ``value``; ties by ``tiebreak`` ascending.

    A plain ``orderBy.limit`` keeps k rows per partition and merges all of them in one task.
    Here a histogram of the values gives the k-th largest value first; only rows that reach it
    (k of them, plus ties) are sorted. ``df`` is stored, since it is read twice.
    """
    df = materialize(df)
    hist = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = running_before(materialize(hist.withColumn("_down", -F.col(value))), "_down", ["_rows"])
    cut = ranked.filter(F.col("_rows_before") + F.col("_rows") >= k).agg(F.max(value).alias("cut"))
    kept = df.filter(F.col(value) >= F.coalesce(cut.scalar(), F.col(value)))
    return kept.orderBy(F.desc(value), F.asc(tiebreak)).limit(k)


def running_before(
    counts: DataFrame, value: str, weights: list[str], by: list[str] | None = None, slices: int | None = None
) -> DataFrame:
    """Add ``{w}_before``: the sum of ``w`` over all smaller values of the same ``by`` group.

    ``counts`` holds one row per (by, value) and should be stored or small: it is read again for the slices. Spark's range partitioning cuts it
    into ``slices`` by value (without the parameter one per ``SLICE_ROWS`` rows, so tasks keep their size as the table grows).
    The slice is stored with the rows. Only one row per slice and group passes through the window that adds up whole slices.
    """
    by = by or []
    slices = slices or max(1, -(-counts.count() // SLICE_ROWS))
    cut = materialize(counts.repartitionByRange(slices, *by, value).withColumn("_slice", F.spark_partition_id()))

    ahead = lambda order: Window.partitionBy(*by, *order[:-1]).orderBy(order[-1]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = cut.groupBy(*by, "_slice").agg(*[F.sum(w).alias(w) for w in weights])
    offsets = totals.select(
        *by, "_slice", *[F.coalesce(F.sum(w).over(ahead(["_slice"])), F.lit(0)).alias(f"_{w}_off") for w in weights]
    )
    inside = cut.select(
        "*",
        *[F.coalesce(F.sum(w).over(ahead(["_slice", value])), F.lit(0)).alias(f"_{w}_in") for w in weights],
    )
    out = inside.join(offsets, [*by, "_slice"])
    return out.select(
        *counts.columns, *[(F.col(f"_{w}_off") + F.col(f"_{w}_in")).alias(f"{w}_before") for w in weights]
    )


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``(*by, value, n)``, stored: what the order statistics below read instead of the table."""
    return materialize(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles(counts: DataFrame, value: str, quantiles: dict[str, float], by: list[str]) -> DataFrame:
    """Quantiles with linear interpolation from ``value_counts``, one row per group of the small domain ``by``."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    ranked = running_before(counts, value, ["n"], by).join(totals, by)

    def at(rank: Column) -> Column:
        hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    def interpolate(q: float) -> Column:
        place = F.lit(q) * (F.col("_total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        step = F.max(place - F.floor(place))
        return low + step * (high - low)

    return ranked.groupBy(*by).agg(*[interpolate(q).alias(name) for name, q in quantiles.items()])
