"""Distributions and descriptive statistics. All pre-aggregate before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..schema import EDA_LABEL_ORDER, LABEL, NEGATION_CUES
from .ordering import exact_quantiles, value_counts


def label_dim(df: DataFrame, order: list[str]) -> DataFrame:
    """The label domain as a table (position, label)."""
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(x).alias("label")) for i, x in enumerate(order)])
    return df.sparkSession.range(1).select(F.inline(rows))


def label_distribution(df: DataFrame, order: list[str] = EDA_LABEL_ORDER, label: str = LABEL) -> DataFrame:
    """Count and share per label in fixed order; absent labels are kept with 0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    known = label_dim(df, order).join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = known.agg(F.sum("n").alias("total")).scalar()
    share = F.when(total == 0, 0.0).otherwise(F.col("n") / total)
    return known.select("position", "label", "n", share.alias("share")).orderBy("position")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: count, mean, sample deviation, min, quartiles (linear interpolation), max."""
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    ).filter(F.col("value").isNotNull())
    counts = value_counts(long, "value", ["column"])
    n, x = F.col("n"), F.col("value")
    means = counts.groupBy("column").agg(
        F.sum("n").alias("count"), (F.sum(n * x) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    squares = counts.join(means, "column").groupBy("column").agg(
        F.sum(n * (x - F.col("mean")) * (x - F.col("mean"))).alias("squares")
    )
    quartiles = exact_quantiles(counts, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column"])
    std = F.when(F.col("count") > 1, F.sqrt(F.col("squares") / (F.col("count") - 1)))
    return means.join(squares, "column").join(quartiles, "column").select(
        "column", "count", "mean", std.alias("std"), "min", "q25", "q50", "q75", "max"
    )


def length_histogram(df: DataFrame, column: str, bins: int = 30, label: str = LABEL) -> DataFrame:
    """Equal-width histogram per label over that label's own range; the last bin is closed.

    ``column`` holds integers, so the bin is found in whole numbers and no edge is lost to rounding.
    """
    counts = df.groupBy(F.col(label).alias("label"), F.col(column).cast("long").alias("x")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ranges = counts.groupBy("label").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    # a label with one value only gets the range of width 1 around it
    offset = F.when(F.col("high") == F.col("low"), bins // 2).otherwise(
        F.least(F.expr(f"((x - low) * {bins}) div greatest(high - low, 1)"), F.lit(bins - 1))
    )
    return (
        counts.join(ranges, "label").select("label", offset.cast("long").alias("bin"), "n")
        .groupBy("label", "bin").agg(F.sum("n").alias("n"))
    )


def box_stats(df: DataFrame, column: str, label: str = LABEL, order: list[str] = EDA_LABEL_ORDER) -> DataFrame:
    """Box-plot numbers per label: quartiles, whiskers at the last values within 1.5 IQR, outliers."""
    known = df.filter(F.col(label).isin(order)).select(
        F.col(label).alias("label"), F.col(column).cast("double").alias("value")
    )
    counts = value_counts(known, "value", ["label"])
    quartiles = exact_quantiles(counts, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["label"])
    fenced = counts.join(quartiles, "label").withColumn("_reach", 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col("value").between(F.col("q1") - F.col("_reach"), F.col("q3") + F.col("_reach"))
    return fenced.groupBy("label").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
    )


def negation_rate(df: DataFrame, cues: list[str] = NEGATION_CUES, label: str = LABEL) -> DataFrame:
    """Share of rows with a negation cue, per label and text column."""
    columns = ("context", "prompt", "response")
    return df.groupBy(F.col(label).alias("label")).agg(
        *[F.avg(tx.contains_any(tx.fill_text(F.col(c)), cues)).alias(f"{c}_rate") for c in columns]
    )


def prediction_distribution(df: DataFrame, column: str = "predict_label") -> DataFrame:
    """Value counts, most frequent first."""
    return (
        df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("label"))
    )
