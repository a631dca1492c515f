"""Embedding whitening: exact sums, a distributed centred covariance, its leading components, one broadcast projection.

Only matrices whose size is the vectors' length squared reach the driver, whatever the number of rows. Each pass over the
rows adds up inside its task and hands on one entry per pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .eigen import leading_pairs
from .vectors import common_length, usable

#: Entries at or beyond this size have no grid value: sums of them would leave 64 bits.
LARGEST = 2.0**30
#: Components that hold less of the variance than this are rounding errors and are left out.
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """A fitted projection. ``sums`` are the exact column sums of the ``n`` grid vectors; ``values`` and ``vectors`` fall by variance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def grid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): floor(64 c) + 1000000 of every entry of the usable vectors. Entries of 2^30 or more are an error."""
    entry = lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * 64)).otherwise(F.raise_error(F.lit("a vector entry is 2^30 or larger"))) + 1_000_000
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("c")).filter(usable(F.col("c")))
    return rows.select("id", F.transform(F.col("c").cast("array<double>"), entry).alias("x"))


def matrix_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact in 64 bits; an error where it does not fit."""
    if n * float(np.abs(x - sums // max(n, 1)).max(initial=0)) >= 2.0**62:
        raise OverflowError("n * x - S leaves 64 bits")
    return n * (x - sums // n) - sums % n


def added_up(vectors: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all batches of ``part(matrix)``, a matrix of fixed shape: within a task first, then per entry over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = part(matrix_of(batch, d))
            total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "v": total.ravel()})

    entries = vectors.select("x").mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((entries["i"].max() + 1, entries["j"].max() + 1), dtype=entries["v"].dtype)
    out[entries["i"], entries["j"]] = entries["v"]
    return out


def fit(vectors: DataFrame, d: int, k: int) -> Whitening:
    """The projection of the rows of ``grid``. The sums are exact integers; entries are centred before they are multiplied."""
    first = added_up(vectors, d, lambda x: np.append(x.sum(0), len(x)).reshape(1, -1), "long")[0]
    n, sums = int(first[-1]), first[:-1].astype(np.int64)

    def products(x: np.ndarray) -> np.ndarray:
        c = deviations(x, n, sums) / n
        return c.T @ c

    covariance = added_up(vectors, d, products, "double") / n
    covariance = (covariance + covariance.T) / 2
    values, components = leading_pairs(covariance, k)
    total = float(np.trace(covariance))
    real = values > NO_VARIANCE * total
    return Whitening(n, sums, values[real], components[:, real], total)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened rows, less the identity: measured over all rows, not derived."""
    n, sums, projection, k = model.n, model.sums, model.projection, len(model.values)

    def products(x: np.ndarray) -> np.ndarray:
        w = (deviations(x, n, sums) / n) @ projection
        return np.vstack([w.T @ w, w.sum(0)])

    found = added_up(vectors, len(sums), products, "double") / n
    return float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())


def whiten(df: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each usable vector in up to ``k`` components.

    Usable vectors are those with at least one entry and only finite ones; all others (null, empty, with null, NaN or infinite entries) are
    dropped. Repeated rows and rows without an id count and are returned like any. Vectors of several lengths, entries of
    2^30 or more and sums beyond 64 bits are errors. Components without variance (constant columns, fewer rows than dimensions) are left
    out, so equal rows alone, like an empty table, give no rows. Of further columns only ``id_col`` is kept.
    """
    vectors = grid(df, id_col, vector_col)
    schema = df.select(F.col(id_col).alias(id_col)).schema
    d = common_length(vectors, "x")
    model = fit(vectors, d, k) if d else Whitening(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    error = identity_error(vectors, model) if len(model.values) else 0.0
    n, sums = model.n, model.sums
    projection = df.sparkSession.sparkContext.broadcast(model.projection)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = deviations(matrix_of(batch, d), n, sums)
            if (c.astype(float) ** 2).sum(1).max(initial=0) >= 2.0**63:
                raise OverflowError("the sum of (n * x - S)^2 leaves 64 bits")
            w = (c / n) @ projection.value
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((c * c).sum(1)), lists], ["id", "deviation", "w"])

    kind = schema[0].dataType.simpleString()
    rows = vectors.mapInArrow(run, f"id {kind}, deviation long, w array<double>") if len(model.values) else vectors.limit(0).select(
        "id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w"))
    shares = F.array(*[F.lit(float(v / model.total)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    long_ = rows.select("id", "deviation", F.posexplode("w").alias("p", "whitened"))
    return long_.select(
        F.col("id").alias(id_col), (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"),
    )
