"""Tables of training runs: grid, memo of finished runs, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import resolve_text_mode, run_name

# Model types that reserve two positions, and the statuses that carry scores.
OFFSET_TYPES = ["roberta", "xlm-roberta"]
FINISHED = ["done", "skipped"]


def supported_length(model_type: Column, positions: Column) -> Column:
    return F.when(F.lower(model_type).isin(OFFSET_TYPES), positions - 2).otherwise(positions)


def run_grid(models: DataFrame, lengths: list[int], text_mode: str = "auto") -> DataFrame:
    """Every model with every length: name, text mode, status (``unsupported`` if too long) and error.

    ``models`` is ``(model_name, model_type, max_position_embeddings)``; a null limit supports all.
    """
    grid = models.withColumn("max_length", F.explode(F.array(*[F.lit(n) for n in lengths])))
    limit = supported_length(F.col("model_type"), F.col("max_position_embeddings"))
    too_long = F.coalesce(F.col("max_length") > limit, F.lit(False))
    error = F.concat(
        F.lit("length "), F.col("max_length").cast("string"), F.lit(" is over the limit of "), F.col("model_name"),
        F.lit(" ("), limit.cast("string"), F.lit(")"),
    )
    return grid.select(
        run_name(F.col("model_name"), F.col("max_length")).alias("run_name"), "model_name", "max_length",
        resolve_text_mode(F.col("model_name"), text_mode).alias("text_mode"),
        F.when(too_long, "unsupported").otherwise("running").alias("status"),
        F.when(too_long, error).alias("error"),
        F.when(too_long, 0.0).alias("elapsed_minutes"),
    )


def skip_done(grid: DataFrame, scores: DataFrame) -> DataFrame:
    """Runs whose scores are stored become ``skipped`` and take them over.

    ``scores`` is ``(run_name, macro_f1, accuracy, elapsed_minutes)``.
    """
    stored = scores.select("run_name", "macro_f1", "accuracy", F.col("elapsed_minutes").alias("_minutes"), F.lit(True).alias("_stored"))
    joined = grid.join(stored, "run_name", "left")
    skip = (F.col("status") == "running") & F.col("_stored").isNotNull()
    return joined.select(
        "run_name", "model_name", "max_length", "text_mode",
        F.when(skip, "skipped").otherwise(F.col("status")).alias("status"),
        F.when(skip, F.col("macro_f1")).alias("macro_f1"),
        F.when(skip, F.col("accuracy")).alias("accuracy"),
        F.when(skip, F.coalesce("_minutes", F.lit(0.0))).otherwise(F.col("elapsed_minutes")).alias("elapsed_minutes"),
        "error",
    )


def runs_to_do(grid: DataFrame, scores: DataFrame) -> DataFrame:
    return grid.filter(F.col("status") == "running").join(scores.select("run_name"), "run_name", "left_anti")


def leaderboard(runs: DataFrame) -> DataFrame:
    """Finished runs by falling macro-F1, ties by name."""
    return (
        runs.filter(F.col("status").isin(FINISHED)).select("run_name", "macro_f1", "accuracy", "elapsed_minutes")
        .orderBy(F.desc("macro_f1"), F.asc("run_name"))
    )


def best_run(runs: DataFrame) -> DataFrame:
    """The finished run with the highest macro-F1 and its own metrics, ties by name."""
    return leaderboard(runs).limit(1)


def best_checkpoint(history: DataFrame, score: str = "val_f1_macro") -> DataFrame:
    """Per run the epoch with the highest score, the first on ties, with that epoch's own metrics.

    An aggregate with a map-side part, not a window: a run's rows are never gathered.
    """
    row = F.struct(*history.columns)
    best = history.groupBy("run_name").agg(F.max_by(row, F.struct(F.col(score), -F.col("epoch"))).alias("_best"))
    return best.select("_best.*")
