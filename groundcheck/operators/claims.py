"""Claims of a response, their evidence, and the texts handed to a reader model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import materialize

NO_EVIDENCE = "No external evidence found."
#: Tools per claim, members per ensemble, samples per prompt: a list of more is taken for a fault in the data.
MOST_PER_KEY = 10_000


def segment_claims(df: DataFrame, column: str = "response", row_id: str = "id") -> DataFrame:
    """``(id, claim_idx, claim)``: the non-empty pieces between full stops, in order."""
    return df.select(row_id, F.posexplode(tx.claims(F.col(column))).alias("claim_idx", "claim"))


def gather_evidence(claims: DataFrame, evidence: DataFrame, most: int = MOST_PER_KEY) -> DataFrame:
    """Add ``evidence``: ``[tool] result`` joined by `` | `` in tool order.

    ``evidence`` is ``(claim, tool_ord, tool, result)``. It is folded to one row per claim first (as
    many pieces as there are tools, at most ``most``; more are an error), so the join cannot multiply rows. The folded table is stored:
    the join then has a plain exchange on both sides, which is the form whose skewed partitions AQE
    splits (a claim that a third of all responses repeat), and a small table is broadcast.
    """
    said = evidence.filter(F.coalesce(F.col("result"), F.lit("")) != "").select(
        "claim", "tool_ord", F.concat(F.lit("["), F.col("tool"), F.lit("] "), F.col("result")).alias("text"))
    lists = collect_ordered(said, "claim", "tool_ord", "text", "found", most)
    found = materialize(lists.select("claim", F.array_join("found", " | ").alias("evidence")))
    return claims.join(found, "claim", "left").withColumn("evidence", F.coalesce("evidence", F.lit(NO_EVIDENCE)))


def detect_claims(df: DataFrame, evidence: DataFrame, column: str = "response", row_id: str = "id") -> DataFrame:
    """``(id, claim_idx, claim, evidence, reflection_prompt)``, one row per claim."""
    out = gather_evidence(segment_claims(df, column, row_id), evidence)
    return out.select(
        row_id, "claim_idx", "claim", "evidence",
        tx.reflection_prompt(F.col("claim"), F.col("evidence")).alias("reflection_prompt"),
    )


def first_rows(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """``df`` with at most ``most`` + 1 rows per key, in order. Spark cuts to that many in each task before it shuffles (window group
    limit), so a key that holds a third of the table never gathers in one place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_place", place).filter(F.col("_place") <= most + 1).drop("_place")


def bounded(items: Column, key: str, most: int) -> Column:
    """``items`` (an array), or an error that names the key if there are more than ``most``: nothing is dropped in silence."""
    message = F.concat(F.lit(f"more than {most} rows of {key} "), F.col(key).cast("string"))
    return F.when(F.size(items) > most, F.raise_error(message)).otherwise(items)


def collect_ordered(df: DataFrame, key: str, order: str, text: str, out: str, most: int = MOST_PER_KEY) -> DataFrame:
    """One ordered list of texts per key (the members of an ensemble, or samples of a prompt), at most ``most``; more are an error."""
    lists = first_rows(df, key, order, most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l"))
    return lists.select(key, bounded(F.col(f"_l.{text}"), key, most).alias(out))


def collect_ensemble(generations: DataFrame) -> DataFrame:
    """``(prompt_id, generated_texts)`` in member order."""
    return collect_ordered(generations, "prompt_id", "member_idx", "text", "generated_texts")


def collect_samples(samples: DataFrame) -> DataFrame:
    """``(id, generated_responses)`` in sample order; a blank answer becomes one space."""
    stripped = tx.strip_ws(tx.fill_text(F.col("response")))
    filled = samples.withColumn("response", F.when(stripped == "", " ").otherwise(stripped))
    return collect_ordered(filled, "id", "sample_idx", "response", "generated_responses")
