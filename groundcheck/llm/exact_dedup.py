"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import seen_in


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False
) -> DataFrame:
    """One row per document: ``id_col``, keep_id, group_size, kept, text_sha256.

    Only byte lengths that occur twice go on to the prefix hash, and only (length, prefix) pairs that
    occur twice go on to the full hash; each step shuffles a few numbers per row and counts map-side, so
    a group of copies that holds a third of the rows is a few rows after its scan. The scan of the last step
    tests a bit map of fixed size (``seen_in``) and hashes whole texts only where it says maybe;
    ``digest_all`` fills text_sha256 for the others too.

    Of equal texts the row with the largest id stays. A null text counts as empty. Null ids lose to any
    other; a group of nulls keeps all of them. Rows that repeat id and text count in group_size and are
    all kept (one document). An empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        "id", "text", F.octet_length("text").alias("len"), F.xxhash64(F.substring("text", 1, prefix)).alias("head")
    )
    thin = materialize(rows.select("len", "head"))
    lengths = materialize(thin.groupBy("len").count().filter("count > 1").select("len"))
    heads = materialize(thin.join(lengths, "len").groupBy("len", "head").count().filter("count > 1").select("len", "head"))

    live = seen_in(heads, ["len", "head"])
    hashed = materialize(rows.select(
        "id", "len", live.alias("live"), F.when(live | F.lit(digest_all), F.sha2("text", 256)).alias("sha")
    ))
    groups = materialize(
        hashed.filter("live").groupBy("len", "sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return hashed.join(groups, ["len", "sha"], "left").select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )
