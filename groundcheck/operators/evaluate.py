"""Classification scores. Everything is derived from the label x prediction counts (at most a few
rows), so the data is read once and shuffled only as partial counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.proba import argmax_label, softmax
from ..schema import LABELS
from ..session import materialize
from .eda import label_dim
from .ordering import running_before


def cell_counts(df: DataFrame, truth: str = "label", pred: str = "predict_label", by: list[str] | None = None) -> DataFrame:
    """``(*by, y, p, n)``: rows per true and predicted label."""
    return df.groupBy(*(by or []), F.col(truth).alias("y"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(*by, label, support, predicted, tp)`` for every label seen as truth or prediction."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), zero.alias("predicted"), hit.alias("tp")),
        F.struct(F.col("p").alias("label"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp")),
    )
    return cells.select(*(by or []), F.inline(sides)).groupBy(*(by or []), "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _class_scores(classes: DataFrame) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return classes.withColumns({
        "precision": _ratio(tp, predicted), "recall": _ratio(tp, support), "f1": _ratio(2 * tp, support + predicted),
    })


def scores(df: DataFrame, truth: str = "label", pred: str = "predict_label", by: list[str] | None = None) -> DataFrame:
    """``(*by, macro_f1, weighted_f1, accuracy, n)`` over the labels seen as truth or prediction."""
    return scores_of_cells(cell_counts(df, truth, pred, by), by)


def scores_of_cells(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    classes = _class_scores(class_counts(cells, by))
    return classes.groupBy(*(by or [])).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("n"),
    )


def confusion_matrix(df: DataFrame, truth: str = "label", pred: str = "predict_label", order: list[str] = LABELS) -> DataFrame:
    """One row per true label, one column per predicted label, all labels present."""
    counts = df.groupBy(F.col(truth).alias("label")).agg(
        *[F.sum((F.col(pred) == name).cast("long")).alias(f"pred_{name}") for name in order]
    )
    return label_dim(df, order).drop("position").join(counts, "label", "left").fillna(0)


def classification_report(df: DataFrame, truth: str = "label", pred: str = "predict_label", order: list[str] = LABELS) -> DataFrame:
    """``(row, precision, recall, f1, support)``: the labels in order, accuracy, macro and weighted mean."""
    seen = class_counts(cell_counts(df, truth, pred))
    known = label_dim(df, order).join(seen, "label", "left").fillna(0, ["support", "predicted", "tp"])
    classes = _class_scores(known)
    support = F.col("support")
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * support), total)

    accuracy = _ratio(F.sum("tp"), total)
    line = lambda name, p, r, f: F.struct(
        F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), total.alias("support")
    )
    summary = classes.agg(F.array(
        line("accuracy", accuracy, accuracy, accuracy),
        line("macro avg", F.avg("precision"), F.avg("recall"), F.avg("f1")),
        line("weighted avg", weighted("precision"), weighted("recall"), weighted("f1")),
    ).alias("lines")).select(F.inline("lines"))
    per_class = classes.select(F.col("label").alias("row"), "precision", "recall", "f1", "support")
    return per_class.union(summary)


def auc_roc(df: DataFrame, score: str, positive: str, slices: int | None = None) -> DataFrame:
    """One row ``(auc, n_pos, n_neg)``: rank AUC, ties count half; NULL if one class is absent.

    Rows with equal scores are counted first; the running count of negatives is taken slice by
    slice over the score range, so no task ranks the whole table.
    """
    counts = materialize(df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.col(positive).cast("long")).alias("pos"), F.sum(1 - F.col(positive).cast("long")).alias("neg")
    ))
    ranked = running_before(counts, "s", ["neg"], slices=slices)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(
        F.when(pairs > 0, wins / pairs).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")
    )


def evaluate_logits(logits: DataFrame, truth: DataFrame, row_id: str = "id") -> DataFrame:
    """``(id, label, proba, predict_label)`` of a logits table, joined to the truth by id."""
    joined = truth.select(row_id, "label").join(logits.select(row_id, "logits"), row_id)
    out = joined.select(row_id, "label", softmax(F.col("logits")).alias("proba"))
    return out.withColumn("predict_label", argmax_label(F.col("proba")))


def run_metadata(split: DataFrame, config: dict[str, object], valid_size: float) -> DataFrame:
    """One row: the run's configuration, train and valid row counts, the split size."""
    counts = split.agg(
        F.sum((F.col("split") == "train").cast("long")).alias("train_rows"),
        F.sum((F.col("split") == "valid").cast("long")).alias("valid_rows"),
    )
    return counts.select(
        *[F.lit(v).alias(k) for k, v in config.items()], "train_rows", "valid_rows", F.lit(valid_size).alias("valid_size")
    )
