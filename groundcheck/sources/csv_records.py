"""CSV files with line breaks inside quotes, read by many tasks.

A reader that meets a split in the middle of a file cannot tell whether it stands inside quotes. It follows from how many quotes
come before: a first scan counts the quotes of every split, one number each, and their running sum per file gives each split its parity. A
second scan then cuts each split into whole records. What a record leaves in the next split is joined to it: at most two pieces per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

RECORD, HEAD, TAIL, MIDDLE = range(4)  # whole; the end of an earlier one; the beginning of one; all of the split, inside one
PIECES = "file long, start long, place long, kind int, text string"


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines in order within each split. A line is what stands between two line feeds."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def open_splits(lines: DataFrame, quote: str) -> dict[tuple[int, int], bool]:
    """The splits that begin inside quotes: one number per split is collected."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote)))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    odd = counts.withColumn("odd", F.coalesce(before, F.lit(0)) % 2 == 1).filter("odd")
    return {(r.file, r.start): True for r in odd.select("file", "start").collect()}


def pieces(lines: DataFrame, inside: dict[tuple[int, int], bool], quote: str) -> DataFrame:
    """``PIECES``: the records of each split, and what it holds of records that reach over its borders."""
    held = lines.sparkSession.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, opened, entered, place = None, False, False, 0
        waiting: list[str] = []
        rows: list[tuple] = []

        def close(kind: int) -> None:
            nonlocal waiting, place
            rows.append((*split, place, kind, "\n".join(waiting)))
            waiting, place = [], place + 1

        def end() -> None:
            if split is not None and waiting:
                close(MIDDLE if entered else TAIL)

        for batch in batches:
            odd = pc.equal(pc.bit_wise_and(pc.count_substring(batch.column("value"), quote), 1), 1).to_pylist()
            for file, start, value, flips in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), odd):
                if (file, start) != split:
                    end()
                    split, place = (file, start), 0
                    opened = entered = held.value.get(split, False)
                waiting.append(value)
                opened ^= flips
                if not opened:
                    close(HEAD if entered else RECORD)
                    entered = False
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(
                (("file", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("text", pa.string())))})
            rows = []
        end()
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(
            (("file", pa.int64()), ("start", pa.int64()), ("place", pa.int64()), ("kind", pa.int32()), ("text", pa.string())))})

    return lines.mapInArrow(run, PIECES)


def joined(parts: DataFrame) -> DataFrame:
    """(text, first): whole records, those over borders put together; ``first`` marks the first record of a file.

    The pieces at borders are at most two per split; only they are shuffled.
    """
    own = Window.partitionBy("file").orderBy("start", "place")
    border = parts.filter(F.col("kind") != RECORD).withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(own))
    over = border.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "place", "text"))).alias("p"))
    over = over.select(F.array_join("p.text", "\n").alias("text"), ((F.col("p")[0]["start"] == 0) & (F.col("p")[0]["place"] == 0)).alias("first"))
    whole = parts.filter(F.col("kind") == RECORD).select("text", ((F.col("start") == 0) & (F.col("place") == 0)).alias("first"))
    return whole.unionByName(over)


def read_records(spark: SparkSession, path: str, columns: list[str], options: dict[str, object]) -> DataFrame:
    """All columns as text. Every file under ``path`` must begin with the header ``columns``; empty lines are skipped."""
    lines = split_lines(spark, path)
    quote = str(options["quote"])
    records = joined(pieces(lines, open_splits(lines, quote), quote))
    text = F.regexp_replace("text", "\r$", "")
    names = [f"_c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # from_csv reads one record; within it line breaks are kept as they are
    parse = {k: str(v) for k, v in options.items() if k not in ("header", "enforceSchema")} | {"multiLine": "true", "mode": "PERMISSIVE"}
    rows = records.select("first", text.alias("text")).filter(F.col("text") != "").select("first", F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), parse).alias("row"))
    header: Column = F.array(*[F.lit(c) for c in columns])
    fits = F.array(*[F.coalesce(F.col("row")[n], F.lit("")) for n in names]) == header
    message = F.concat(F.lit("CSV header does not conform to "), F.array_join(header, ","))
    data = rows.filter(~F.when(F.col("first") & ~fits, F.raise_error(message).cast("boolean")).otherwise(F.col("first")))
    return data.select(*[F.col("row")[n].alias(c) for n, c in zip(names, columns)])
