"""Blending of probability tables and the fit of the blend weights."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.proba import argmax_label, blend as blend_arrays
from ..schema import DEFAULT_BLEND, LABELS
from .evaluate import scores_of_cells

SOURCES = ["classical", "transformer", "rule"]


def join_sources(tables: dict[str, DataFrame], row_id: str = "id", how: str = "inner") -> DataFrame:
    """``(id, classical, transformer, rule)``: one probability array per source, joined on the id."""
    sides = [tables[s].select(row_id, F.col("proba").alias(s)) for s in SOURCES]
    return reduce(lambda a, b: a.join(b, row_id, how), sides)


def unmatched(tables: dict[str, DataFrame], row_id: str = "id") -> DataFrame:
    """Rows per combination of sources that lacks one; empty when every id has all three."""
    joined = join_sources(tables, row_id, "full")
    flags = [F.col(s).isNotNull().cast("int").alias(f"has_{s}") for s in SOURCES]
    missing = joined.select(*flags).filter(" or ".join(f"has_{s} = 0" for s in SOURCES))
    return missing.groupBy(*[f"has_{s}" for s in SOURCES]).agg(F.count(F.lit(1)).alias("n"))


def blend(sources: DataFrame, weights: tuple[float, float, float] | DataFrame = DEFAULT_BLEND) -> DataFrame:
    """Add ``proba``: the weighted sum. ``weights`` are numbers, or a one-row table of the fit."""
    if isinstance(weights, DataFrame):
        w = weights.select(F.struct(*SOURCES).alias("w")).scalar()
        parts = [w[s] for s in SOURCES]
    else:
        parts = list(weights)
    return sources.withColumn("proba", blend_arrays([F.col(s) for s in SOURCES], parts))


def blend_predict(sources: DataFrame, weights: tuple[float, float, float] | DataFrame = DEFAULT_BLEND) -> DataFrame:
    return blend(sources, weights).withColumn("predict_label", argmax_label(F.col("proba")))


def weight_grid(steps: int, start: tuple[float, float, float] = DEFAULT_BLEND) -> np.ndarray:
    """Points x sources: the start point, scaled to sum to 1, then the points of the weight simplex in rising order."""
    rest = [(i / steps, j / steps, (steps - i - j) / steps) for i in range(steps + 1) for j in range(steps + 1 - i)]
    return np.array([[w / sum(start) for w in start], *rest])


def grid_counts(sources: DataFrame, grid: np.ndarray, cells: int = 1 << 20) -> DataFrame:
    """``(point, y, p, n)``: for each point of ``grid``, rows per label and blended prediction.

    A batch is scored against all points at once, as a product of rows x sources by sources x points, about ``cells`` values at a time. Rows are
    never multiplied by points: a task hands on at most points x 9 counts.
    """
    names = pa.array(LABELS)
    k = len(LABELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(grid), k + 1, k), dtype=np.int64)  # the last row is for labels outside the domain
        for batch in batches:
            y = pc.fill_null(pc.index_in(batch.column("label"), value_set=names), k).to_numpy(zero_copy_only=False)
            parts = [batch.column(s).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for s in SOURCES]
            step = max(1, cells // (len(grid) * k))
            for at in range(0, len(y), step):
                # summed source by source, in their order, as in a single row's blend: ties fall alike
                scores = sum(grid[:, None, None, i] * part[None, at : at + step] for i, part in enumerate(parts))
                best = scores.argmax(axis=2)
                cell = (np.arange(len(grid))[:, None] * (k + 1) + y[None, at : at + step]) * k + best
                total += np.bincount(cell.ravel(), minlength=total.size).reshape(total.shape)
        point, label, vote = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({
            "point": point.astype(np.int32), "y": pa.array([*LABELS, None]).take(pa.array(label)), "p": names.take(pa.array(vote)), "n": total[point, label, vote]})

    found = sources.select("label", *SOURCES).mapInArrow(run, "point int, y string, p string, n long")
    return found.groupBy("point", "y", "p").agg(F.sum("n").alias("n"))


def blend_scores(sources: DataFrame, steps: int = 20, start: tuple[float, float, float] = DEFAULT_BLEND) -> DataFrame:
    """Macro-F1 and accuracy of every grid point on the rows of ``sources`` (which has ``label``), with ``ord``: 0 for the start point, else 1."""
    grid = weight_grid(steps, start)
    points = F.array(*[F.struct(*[F.lit(float(w)).alias(f"w_{s}") for s, w in zip(SOURCES, row)]) for row in grid])
    scored = scores_of_cells(grid_counts(sources, grid), ["point"]).withColumn("_w", F.get(points, F.col("point")))
    return scored.select(F.when(F.col("point") == 0, 0).otherwise(1).alias("ord"), "_w.*", "macro_f1", "weighted_f1", "accuracy", "n")


def fit_blend_weights(sources: DataFrame, steps: int = 20, start: tuple[float, float, float] = DEFAULT_BLEND) -> DataFrame:
    """One row ``(classical, transformer, rule, macro_f1, accuracy)``: the best grid point.

    Ties: the start point first, then the smaller weights in order.
    """
    weights = [f"w_{s}" for s in SOURCES]
    best = blend_scores(sources, steps, start).orderBy(F.desc(F.round("macro_f1", 12)), "ord", *weights).limit(1)
    return best.select(*[F.col(f"w_{s}").alias(s) for s in SOURCES], "macro_f1", "accuracy")
