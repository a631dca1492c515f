"""Table contracts: required columns, label domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import LABEL, LABELS, TEXT_COLUMNS, id_to_label, label_to_id
from ..functions.text import fill_text as fill
from ..session import materialize
from .ordering import running_before


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail listing every missing column. Looks at the schema only, no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def present_text_columns(df: DataFrame) -> list[str]:
    found = [c for c in TEXT_COLUMNS if c in df.columns]
    if not found:
        raise ValueError("No text columns found (expected context, prompt or response)")
    return found


def check_label_domain(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Labels outside the domain with their row counts; a null label is reported as ``nan``."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("nan"))
    return (
        df.select(text.alias("label")).filter(~F.col("label").isin(LABELS))
        .groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")
    )


def require_known_labels(df: DataFrame, label: str = LABEL, listed: int = 100) -> DataFrame:
    """Fail with the sorted list of all labels outside the domain; of more than ``listed`` the first ones, and that there are more.

    One aggregation over the label column alone, when the table is read: a check inside a column would vanish with the column.
    """
    unknown = [row["label"] for row in check_label_domain(df, label).limit(listed + 1).collect()]
    if unknown:
        more = " and more" if len(unknown) > listed else ""
        raise ValueError(f"Unknown labels found: {unknown[:listed]}{more}")
    return df


def require_partners(df: DataFrame, other: DataFrame, name: str, row_id: str = "id") -> DataFrame:
    """Fail with the number of rows of ``df`` whose id ``other`` lacks. Only the ids are read and shuffled."""
    lost = df.select(row_id).join(other.select(row_id), row_id, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows have no partner in {name}")
    return df


def fill_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: fill(F.col(c)) for c in columns or TEXT_COLUMNS})


def with_label_id(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add ``label_id``; a label outside the domain fails the job that reads the column (all of them: ``require_known_labels``)."""
    text = F.coalesce(F.col(label).cast("string"), F.lit("nan"))
    unknown = F.raise_error(F.concat(F.lit("Unknown labels found: "), text)).cast("int")
    return df.withColumns({label: text, "label_id": F.coalesce(label_to_id(text), unknown)})


def label_encode(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Add ``label_id`` (domain order), ``label_rank`` (alphabetical order of the labels that occur)
    and ``label_decoded``. A null label has none of them."""
    classes = materialize(df.filter(F.col(label).isNotNull()).select(F.col(label).alias("_class")).distinct().withColumn("_one", F.lit(1)))
    ranks = running_before(classes, "_class", ["_one"]).select("_class", F.col("_one_before").cast("int").alias("label_rank"))
    ranked = df.withColumn("label_id", label_to_id(F.col(label))).join(ranks, F.col(label) == F.col("_class"), "left").drop("_class")
    return ranked.withColumn("label_decoded", id_to_label(F.col("label_id")))
