"""Semantic entropy of sampled answers: greedy clusters of embeddings, then the entropy of their sizes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as vec
from ..session import materialize
from .claims import collect_samples

BLOCK = 128  # samples of one prompt folded in one row
TILE = 4096  # samples compared with as many others in one task


def _fold_heads(samples: DataFrame, tau: float, block: int) -> DataFrame:
    """``(id, idx, center, more)``: per prompt its first ``block`` samples, the position of each one's center, and whether more may follow.

    The rank is cut per task before the shuffle (window group limit), so no prompt is gathered whole.
    """
    first = Window.partitionBy("id").orderBy("sample_idx")
    heads = samples.withColumn("_n", F.rank().over(first)).filter(F.col("_n") <= block).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", "embedding", "norm"))).alias("s")
    )
    folded = heads.withColumn("center", vec.greedy_centers(F.col("s"), tau))
    return folded.select("id", F.col("s.sample_idx").alias("idx"), "center", (F.size("s") >= block).alias("more"))


def _pairs(folded: DataFrame) -> DataFrame:
    """``(id, sample_idx, center_idx)`` of folded heads."""
    center = lambda i: F.get(F.col("idx"), F.get(F.col("center"), i))
    return folded.select("id", F.inline(F.transform("idx", lambda s, i: F.struct(s.alias("sample_idx"), center(i).alias("center_idx")))))


def first_matches(left: DataFrame, right: DataFrame, tau: float, tile: int = TILE) -> DataFrame:
    """``(id, sample_idx, match)``: of each sample in ``left`` the smallest earlier ``sample_idx`` in ``right`` with cosine >= tau, if there is one.

    Both are (id, sample_idx, embedding, norm). A prompt's two sides are cut into tiles, and each pair of tiles meets in a task of its own, which hands
    on one row per sample: a prompt of any size is spread, and no pair of samples becomes a row.
    """
    tiles = lambda df, name: df.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    sizes = materialize(tiles(left, "nl").join(tiles(right, "nr"), "id"))
    own = lambda n: F.pmod(F.xxhash64("sample_idx"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["sample_idx", "embedding", "norm"]
    dealt = left.join(sizes, "id").select("id", own("nl").alias("l"), every("nr").alias("r"), F.lit(0).alias("side"), *columns).unionByName(
        right.join(sizes, "id").select("id", every("nl").alias("l"), own("nr").alias("r"), F.lit(1).alias("side"), *columns))
    kind = left.schema["id"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        a, b = (rows.filter(pc.field("side") == s).sort_by("sample_idx").combine_chunks() for s in (0, 1))
        place, before = (t.column("sample_idx").to_numpy().astype(np.int64) for t in (a, b))
        found = np.full(len(a), -1, dtype=np.int64)
        if len(a) and len(b):
            lengths = lambda t: np.where((n := t.column("norm").to_numpy()) > 0, n, 1.0)[:, None]
            x, y = (t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1) / lengths(t) for t in (a, b))
            for at in range(0, len(a), 512):
                near = (x[at : at + 512] @ y.T >= tau) & (before < place[at : at + 512, None])
                found[at : at + 512] = np.where(near.any(axis=1), before[near.argmax(axis=1)], -1)
        hit = found >= 0
        return pa.table({"id": a.column("id").filter(pa.array(hit)), "sample_idx": place[hit], "match": found[hit]})

    met = dealt.groupBy("id", "l", "r").applyInArrow(run, f"id {kind}, sample_idx long, match long")
    return met.groupBy("id", "sample_idx").agg(F.min("match").alias("match"))


def _large_centers(samples: DataFrame, tau: float, block: int, tile: int) -> DataFrame:
    """``(id, sample_idx, embedding, norm)`` of the centers of prompts with many samples.

    A sample that no earlier open sample matches is a center, whatever the others turn out to be; so are the centers among a prompt's first open
    samples, which are folded in order. All samples that a new center matches are closed, and the rest goes on. Samples in no
    particular order are settled in about as many rounds as their number has digits; a chain made to defeat this loses ``block`` a round.
    """
    centers, open_ = [], samples
    while not open_.isEmpty():
        blocked = first_matches(open_, open_, tau, tile)
        folded = _pairs(_fold_heads(open_, tau, block)).filter(F.col("sample_idx") == F.col("center_idx")).select("id", "sample_idx", F.lit(True).alias("first"))
        judged = open_.join(blocked, ["id", "sample_idx"], "left").join(folded.distinct(), ["id", "sample_idx"], "left")
        judged = materialize(judged.withColumn("center", F.col("match").isNull() | F.col("first").isNotNull()).drop("match", "first"))
        new = judged.filter("center").drop("center")
        centers.append(new)
        rest = judged.filter("not center").drop("center")
        open_ = materialize(rest.join(first_matches(rest, new, tau, tile).select("id", "sample_idx"), ["id", "sample_idx"], "left_anti"))
    return reduce(DataFrame.unionByName, centers)


def greedy_cluster(samples: DataFrame, tau: float = 0.8, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``(id, sample_idx, center_idx)``: in sample order, the first center with cosine >= tau, else itself.

    A center is a cluster's first member and never moves. Prompts of less than ``block`` samples, the usual case, are folded in one row each. Of larger
    ones the centers are found in rounds over tiles of samples (``_large_centers``), and each other sample then joins its
    first center: what the sequential rule gives. ``sample_idx`` numbers the samples of a prompt.
    """
    ready = samples.select("id", "sample_idx", "embedding", vec.norm(F.col("embedding")).alias("norm"))
    folded = materialize(_fold_heads(ready, tau, block))
    large = folded.filter("more").select("id")
    if large.isEmpty():
        return _pairs(folded)
    many = materialize(ready.join(large, "id", "left_semi"))
    centers = materialize(_large_centers(many, tau, block, tile))
    others = many.join(centers.select("id", "sample_idx"), ["id", "sample_idx"], "left_anti")
    kind = many.schema["sample_idx"].dataType
    joined = first_matches(others, centers, tau, tile).select("id", F.col("sample_idx").cast(kind), F.col("match").cast(kind).alias("center_idx"))
    own = centers.select("id", "sample_idx", F.col("sample_idx").alias("center_idx"))
    return _pairs(folded.filter("not more")).unionByName(joined).unionByName(own)


def semantic_entropy(samples: DataFrame, tau: float = 0.8, block: int = BLOCK) -> DataFrame:
    """``(id, n_samples, n_clusters, semantic_entropy)``."""
    sizes = greedy_cluster(samples, tau, block).groupBy("id", "center_idx").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("id").agg(F.sum("n").alias("n_samples"))
    share = F.col("n") / F.col("n_samples")
    return sizes.join(totals, "id").groupBy("id").agg(
        F.first("n_samples").alias("n_samples"), F.count(F.lit(1)).alias("n_clusters"),
        F.sum(-share * F.log(share + 1e-9)).alias("semantic_entropy"),
    )


def semantic_entropy_report(source: DataFrame, samples: DataFrame, tau: float = 0.8) -> DataFrame:
    """One row per source row: texts, label (``unknown`` if none), the answers, their entropy (0 for none)."""
    label = F.coalesce(F.col("label"), F.lit("unknown")) if "label" in source.columns else F.lit("unknown")
    answers = collect_samples(samples)
    none = F.expr("cast(array() as array<string>)")
    return (
        source.join(semantic_entropy(samples, tau).select("id", "semantic_entropy"), "id", "left")
        .join(answers, "id", "left")
        .select(
            "id", "context", "prompt", F.col("response").alias("original_response"), label.alias("true_label"),
            F.coalesce("generated_responses", none).alias("generated_responses"),
            F.coalesce("semantic_entropy", F.lit(0.0)).alias("semantic_entropy"),
        )
    )


def entropy_by_label(report: DataFrame) -> DataFrame:
    """Mean, sample deviation and count of the entropy per label."""
    return report.groupBy("true_label").agg(
        F.avg("semantic_entropy").alias("mean"), F.stddev_samp("semantic_entropy").alias("std"),
        F.count("semantic_entropy").alias("count"),
    )


def overall_entropy(report: DataFrame) -> DataFrame:
    """One row ``(mean, std, count)`` over all rows, for reports with one label or none."""
    return report.agg(
        F.avg("semantic_entropy").alias("mean"), F.stddev_samp("semantic_entropy").alias("std"),
        F.count("semantic_entropy").alias("count"),
    )


def mean_pool(tokens: DataFrame) -> DataFrame:
    """``(id, embedding)``: mean of the token vectors under the mask, denominator at least 1e-9.

    ``tokens`` is ``(id, mask, embedding)``. Vectors are summed map-side, so a very long text does
    not travel token by token.
    """
    masked = F.transform("embedding", lambda v: v.cast("double") * F.col("mask"))
    sums = tokens.select("id", "mask", array_to_vector(masked).alias("_v")).groupBy("id").agg(
        Summarizer.metrics("sum").summary(F.col("_v")).alias("_s"), F.sum("mask").alias("_m")
    )
    total = F.greatest(F.col("_m").cast("double"), F.lit(1e-9))
    return sums.select("id", "_m", vector_to_array("_s.sum").alias("_a"), total.alias("_t")).select(
        "id", F.transform("_a", lambda v: v / F.col("_t")).alias("embedding")
    )
