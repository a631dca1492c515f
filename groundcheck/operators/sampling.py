"""Exact, repeatable samples and splits.

Every row gets the key md5(seed:id); the rows with the smallest keys are drawn. The n-th smallest
key of a class is found from a histogram of key prefixes: only the rows of the one prefix that
holds the n-th key are ever sorted. Drawing is then a comparison per row, with no shuffle of the
table. Row ids must be unique, as everywhere in this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .ordering import SLICE_ROWS, running_before

PREFIX = 4  # hex digits, so 65,536 prefixes per class


def draw_key(row_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def class_quotas(df: DataFrame, label: str, draws) -> DataFrame:
    """Rows to draw per class so that they sum to the wanted total: largest remainders first.

    ``draws(total, classes)`` gives the wanted total from the table's row and class counts. The
    result has one row per class; null is a class like any other. Totals are plain sums and the largest remainders come from a running count over
    slices, so a label column of any size is ordered by many tasks.
    """
    counts = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    # two numbers, whatever the classes
    total, classes = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    wanted = counts.withColumn("_draws", draws(F.lit(total).cast("long"), F.lit(classes).cast("long")).cast("long"))
    shares = wanted.select(
        label, "_draws", F.expr(f"(_n * _draws) div {total or 1}").alias("_base"), F.expr(f"(_n * _draws) % {total or 1}").alias("_rest"), F.lit(1).alias("_one"),
    ).withColumn("_order", F.struct(-F.col("_rest"), F.col(label)))
    left = F.col("_draws") - shares.agg(F.sum("_base")).scalar()
    ranked = running_before(shares, "_order", ["_one"], slices=-(-max(classes, 1) // SLICE_ROWS))
    return ranked.select(label, (F.col("_base") + (F.col("_one_before") < left).cast("long")).alias("quota"))


def _by_class(df: DataFrame, classes: DataFrame, label: str, *more: str, how: str = "inner") -> DataFrame:
    """Join a table with one row per class, and per ``more``; null meets null. Spark sees its size and picks the join."""
    right = classes.withColumnRenamed(label, "_class").withColumnsRenamed({c: f"_class{c}" for c in more})
    same = F.col(label).eqNullSafe(F.col("_class"))
    for c in more:
        same = same & (F.col(c) == F.col(f"_class{c}"))
    return df.join(right, same, how).drop("_class", *[f"_class{c}" for c in more])


def _mark(df: DataFrame, label: str, quotas: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Add the boolean ``_drawn``. ``quotas`` has one row per class."""
    keyed = df.select(label, F.col(row_id).alias("_id"), draw_key(row_id, seed).alias("_key"))
    keyed = keyed.withColumn("_prefix", F.substring("_key", 1, PREFIX))
    hist = keyed.groupBy(label, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    upto = hist.withColumn("_upto", F.sum("_n").over(Window.partitionBy(label).orderBy("_prefix")))
    edge = (
        _by_class(upto, quotas, label)
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
        .select(label, "_prefix", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    order = Window.partitionBy(label).orderBy("_key", "_id")
    # one row per class, stored: whoever reads the result compares with it and finds it no second time
    last = materialize(
        _by_class(keyed, edge, label, "_prefix")
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == F.col("_take"))
        .select(label, F.col("_key").alias("_last_key"), F.col("_id").alias("_last_id"))
    )
    key = draw_key(row_id, seed)
    drawn = (key < F.col("_last_key")) | ((key == F.col("_last_key")) & (F.col(row_id) <= F.col("_last_id")))
    return (
        _by_class(df, last, label, how="left")
        .withColumn("_drawn", F.coalesce(drawn, F.lit(False)))
        .drop("_last_key", "_last_id")
    )


def random_sample(df: DataFrame, n: int, seed: int = 0, row_id: str = "id", clamp: bool = True) -> DataFrame:
    """Exactly n rows; all rows for n <= 0. More rows than there are: all, or an error without clamp."""
    if n <= 0:
        return df
    one = df.withColumn("_all", F.lit(1))

    def draws(total: Column, classes: Column) -> Column:
        if clamp:
            return F.least(F.lit(n), total)
        return F.when(total < n, F.raise_error(F.lit(f"cannot draw {n} rows: the table has fewer"))).otherwise(n)

    marked = _mark(one, "_all", class_quotas(one, "_all", draws), row_id, seed)
    return marked.filter("_drawn").drop("_all", "_drawn")


def stratified_sample(df: DataFrame, n: int, seed: int = 42, label: str = "label", row_id: str = "id") -> DataFrame:
    """Exactly n rows in the class proportions; the whole table for n <= 0 or n >= its size."""
    if n <= 0:
        return df

    def draws(total: Column, classes: Column) -> Column:
        message = F.concat(F.lit("sample size must be at least "), classes.cast("string"))
        return (
            F.when(total <= n, total)
            .when(classes > n, F.raise_error(message).cast("long"))
            .otherwise(F.lit(n).cast("long"))
        )

    return _mark(df, label, class_quotas(df, label, draws), row_id, seed).filter("_drawn").drop("_drawn")


def stratified_split(
    df: DataFrame, valid_size: float = 0.15, seed: int = 42, label: str = "label", row_id: str = "id"
) -> DataFrame:
    """Add ``split`` (train / valid): exact sizes, exact class quotas."""
    quotas = class_quotas(df, label, lambda total, classes: F.ceil(F.lit(valid_size) * total))
    marked = _mark(df, label, quotas, row_id, seed)
    return marked.withColumn("split", F.when(F.col("_drawn"), "valid").otherwise("train")).drop("_drawn")
