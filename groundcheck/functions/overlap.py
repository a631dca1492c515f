"""Set overlap of token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

GLUE = "\u0001"


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B| of two token arrays, 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def ngrams(tokens: Column, n: int, glue: str = GLUE) -> Column:
    """All n-grams of a token array, glued to strings; empty when there are fewer than n tokens."""
    if n == 1:
        return tokens
    count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    grams = F.slice(tokens, F.lit(1), count)
    for k in range(1, n):
        grams = F.zip_with(
            grams, F.slice(tokens, F.lit(k + 1), count), lambda x, y: F.concat(x, F.lit(glue), y)
        )
    return grams


def containment(a: Column, b: Column, n: int) -> Column:
    """Share of b's distinct n-grams that occur in a; 0 if either has fewer than n tokens."""
    ga, gb = ngrams(a, n), ngrams(b, n)
    return F.when((F.size(a) < n) | (F.size(b) < n), 0.0).otherwise(
        F.size(F.array_intersect(ga, gb)) / F.size(F.array_distinct(gb))
    )
