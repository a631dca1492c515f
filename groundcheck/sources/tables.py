"""Readers of triplet tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import fill_text
from ..operators.contracts import require_columns, require_known_labels, with_label_id
from ..operators.preprocess import serialize
from ..schema import ID, LABEL, NA_STRINGS, PREDICTED, TEXT_COLUMNS
from .csv_records import read_records

# RFC 4180 quoting; texts hold line breaks, and blanks at the ends are data.
CSV_OPTIONS = {
    "header": True, "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_any_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """All columns as text, by the header's names, so that the column order is free.

    The files of one folder share one header; a file with another header is an error, never read by position. Files with different
    column orders are given as a list of paths: each is read by its own header and they meet by name. Files are split, also where texts hold line
    breaks (``csv_records``); quotes must then stand as RFC 4180 has them. ``multi_line=False`` saves the scan that counts the quotes.
    """
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multi_line, enforceSchema=False)
    paths = [path] if isinstance(path, str) else path
    if not multi_line:
        return reduce(DataFrame.unionByName, [reader.csv(p) for p in paths])
    # the columns come from the first record alone
    return reduce(DataFrame.unionByName, [read_records(spark, p, reader.csv(p).columns, CSV_OPTIONS) for p in paths])


def _is_parquet(path: str | list[str]) -> bool:
    return isinstance(path, str) and path.rstrip("/").endswith(".parquet")


def read_table(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Parquet by its suffix, else CSV, whose missing markers in the text and label columns become null."""
    if _is_parquet(path):
        return spark.read.parquet(path)
    df = read_any_csv(spark, path, multi_line)
    return _missing_to_null(df, [c for c in (*TEXT_COLUMNS, LABEL) if c in df.columns])


def _missing_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.col(c).cast("string").isin(NA_STRINGS), F.col(c)) for c in columns})


def as_train(df: DataFrame, text_mode: str = "raw", lexicon: DataFrame | None = None) -> DataFrame:
    """The training contract on any table: texts filled, label checked, ``label_id``, ``serialized_text``."""
    require_columns(df, [ID, *TEXT_COLUMNS, LABEL])
    known = with_label_id(require_known_labels(df).withColumns({c: fill_text(F.col(c)) for c in TEXT_COLUMNS}))
    return serialize(known, text_mode, lexicon)


def as_test(df: DataFrame, text_mode: str = "raw", lexicon: DataFrame | None = None) -> DataFrame:
    require_columns(df, [ID, *TEXT_COLUMNS])
    out = df.withColumns({c: fill_text(F.col(c)) for c in TEXT_COLUMNS})
    if PREDICTED not in out.columns:
        out = out.withColumn(PREDICTED, F.lit(""))
    return serialize(out, text_mode, lexicon)


def read_train(spark: SparkSession, path: str | list[str], text_mode: str = "raw", lexicon: DataFrame | None = None, multi_line: bool = True) -> DataFrame:
    df = require_columns(read_table(spark, path, multi_line), [ID, *TEXT_COLUMNS, LABEL])
    return as_train(df, text_mode, lexicon)


def read_test(spark: SparkSession, path: str | list[str], text_mode: str = "raw", lexicon: DataFrame | None = None, multi_line: bool = True) -> DataFrame:
    df = require_columns(read_table(spark, path, multi_line), [ID, *TEXT_COLUMNS])
    return as_test(df, text_mode, lexicon)
