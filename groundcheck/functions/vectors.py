"""Embedding arithmetic and the greedy clustering fold."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a vector has no length. Pass norms where they are known."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length == 0.0, 0.0).otherwise(dot(a, b) / length)


def greedy_centers(samples: Column, tau: float) -> Column:
    """Center of each sample under first-match clustering in array order.

    ``samples`` is an ordered array of ``struct(embedding, norm)``. A sample joins the first
    center, in order of creation, it is similar to, else becomes a center. The fold keeps only
    indices: element i of its state is the 0-based index of sample i's center, so a sample is
    a center where state[i] = i.
    """
    empty = F.expr("cast(array() as array<int>)")

    def step(state: Column, sample: Column) -> Column:
        position = F.size(state)
        matches = F.filter(
            F.array_distinct(state),
            lambda c: cosine(
                sample["embedding"], F.get(samples, c)["embedding"],
                sample["norm"], F.get(samples, c)["norm"],
            ) >= tau,
        )
        return F.concat(state, F.array(F.coalesce(F.get(matches, F.lit(0)), position)))

    return F.aggregate(samples, empty, step)
