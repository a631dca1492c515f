"""Writers. Data-sized tables keep their partitions; only reports of a few rows go to one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.preprocess import preprocess_stats
from ..schema import ID, PREDICTED, TEXT_COLUMNS
from .tables import CSV_OPTIONS

_CSV = {**CSV_OPTIONS, "quoteAll": True, "emptyValue": ""}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_any_csv`` reads back unchanged; array and struct columns become JSON text."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").options(**_CSV).csv(path)


def write_preprocessed(df: DataFrame, path: str) -> None:
    write_csv(df, path)


def write_preprocess_stats(df: DataFrame, path: str, n: int = 3) -> None:
    write_report(preprocess_stats(df, n), path)


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines of a small tidy table: scores, report, weights, metadata."""
    rows.coalesce(1).write.mode("overwrite").json(path)


write_scores = write_report


def write_valid_artifacts(df: DataFrame, path: str) -> None:
    """``(id, label_id, proba, pred)`` of a run's validation rows, keyed by id."""
    df.select(ID, "label_id", "proba", "pred").write.mode("overwrite").parquet(path)


def write_submission(df: DataFrame, path: str) -> None:
    write_csv(df.select(ID, *TEXT_COLUMNS, PREDICTED), path)


def write_label_submission(df: DataFrame, path: str) -> None:
    """The short form ``id, label``; ``id`` only where the table has one."""
    columns = [c for c in (ID,) if c in df.columns]
    write_csv(df.select(*columns, F.col(PREDICTED).alias("label")), path)


def write_entropy_results(report: DataFrame, path: str) -> None:
    """JSON details that keep the answers as an array, and CSV of the results from them: the report is computed once."""
    report.write.mode("overwrite").json(f"{path}/details_json")
    write_csv(report.sparkSession.read.schema(report.schema).json(f"{path}/details_json"), f"{path}/results_csv")


def write_run_summary(runs: DataFrame, path: str) -> None:
    write_csv(runs.coalesce(1), f"{path}/summary_csv")
    write_report(runs, f"{path}/summary_json")
