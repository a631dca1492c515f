"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed: the white space that parts words, U+0020 and U+0009 to U+000D.
SPACES = [" ", "\t", "\n", "\x0b", "\f", "\r"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` reads it."""
    return F.transform(F.array(value), body)[0]


def without(text: Column, marks: list[str]) -> Column:
    """``text`` without the given characters: byte searches, no pattern."""
    for mark in marks:
        text = F.replace(text, F.lit(mark))
    return text


def space_words(text: Column) -> Column:
    """The maximal runs of other characters than ``SPACES``."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def seen_in(keys: DataFrame, columns: list[str], bits: int = 1 << 22) -> Column:
    """A test for rows whose ``columns`` may stand in ``keys``: never false for one that does.

    The keys set bits in a map of ``bits`` bits (512 KB by default, whatever the table holds), which a
    scan can test without a shuffle. A fuller map lets more rows through, so an exact join follows.
    """
    slot = F.pmod(F.xxhash64(*columns), F.lit(bits))
    words = keys.select(slot.alias("_slot")).groupBy(F.expr("_slot div 64").alias("_word")).agg(
        F.bit_or(shift_left(F.lit(1).cast("long"), (F.col("_slot") % 64).cast("int"))).alias("_bits")
    )
    whole = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("_word"), "left")
    row = whole.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_bits", F.lit(0).cast("long")).alias("b")))).alias("a"))
    bitmap = row.select(F.col("a.b").alias("bitmap")).scalar()
    hit = shift_right(F.get(bitmap, F.expr(f"cast(pmod(xxhash64({', '.join(columns)}), {bits}) div 64 as int)")), (slot % 64).cast("int"))
    return hit.bitwiseAND(F.lit(1).cast("long")) == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the smallest node it reaches.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the smallest. The edges
    are stored after each round, so lineage stays short; rounds grow with the logarithm of the longest path. A hub's
    edges are only joined with one row per node and counted map-side, so they may be split over tasks.
    """
    from ..session import materialize

    ordered = lambda df: df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    edges = materialize(ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = materialize(ordered(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))))
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(ordered(small.unionByName(least.select("u", F.col("m").alias("v")))))
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
