"""Token vocabulary and id sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import ws_tokenize
from .ordering import top_rows

MAX_SIZE = 20_000
#: A vocabulary is held by every task; larger ones are refused.
MOST_TOKENS = 2_000_000
#: Texts whose tokens are counted or looked up at once, whatever a batch holds.
TEXTS_AT_ONCE = 1_024

# The two reserved entries.
PAD, UNK = ("<PAD>", 0), ("<UNK>", 1)


def token_counts(df: DataFrame, column: str) -> DataFrame:
    """``(token, n)``: equal tokens of a batch are counted before any row is made of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                yield pa.RecordBatch.from_arrays(batch.column("t").slice(at, TEXTS_AT_ONCE).flatten().value_counts().flatten(), ["token", "n"])

    found = df.select(ws_tokenize(F.col(column)).alias("t")).mapInArrow(run, "token string, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def build_vocab(df: DataFrame, column: str, max_size: int = MAX_SIZE, min_freq: int = 2) -> DataFrame:
    """``(token, token_id)``: the most frequent tokens from id 2 on, ties by token, plus PAD and UNK."""
    if max_size > MOST_TOKENS:
        raise ValueError(f"max_size is {max_size}; at most {MOST_TOKENS} tokens are numbered")
    top = top_rows(token_counts(df, column).filter(F.col("n") >= min_freq), max_size - 2, "n", "token")
    # at most max_size rows are numbered in one place
    place = F.row_number().over(Window.orderBy(F.desc("n"), F.asc("token")))
    reserved = df.sparkSession.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(i).alias("token_id")) for t, i in (PAD, UNK)]))
    )
    return top.select("token", (place + 1).alias("token_id")).union(reserved)


def encode_sequence(df: DataFrame, column: str, vocab: DataFrame, max_len: int = 256, row_id: str = "id") -> DataFrame:
    """``(id, token_ids)``: ids of the first max_len tokens, unknown as 1, padded with 0 on the right.

    The vocabulary (at most ``MOST_TOKENS`` rows) is held by the tasks and looked up for a whole batch at once: no join, no shuffle.
    """
    table = vocab.filter(F.col("token_id") > UNK[1]).limit(MOST_TOKENS + 1).select("token", "token_id").toArrow().combine_chunks()
    if len(table) > MOST_TOKENS:
        raise ValueError(f"the vocabulary holds more than {MOST_TOKENS} tokens")
    held = df.sparkSession.sparkContext.broadcast((pa.array(table.column("token").to_pylist(), pa.string()), table.column("token_id").to_numpy().astype(np.int32)))

    def some(tokens: pa.Array) -> pa.Array:
        names, numbers = held.value
        at = pc.index_in(tokens.flatten(), value_set=names)
        found = np.append(numbers, UNK[1])[pc.fill_null(at, len(numbers)).to_numpy(zero_copy_only=False)]
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        out = np.full((len(tokens), max_len), PAD[1], dtype=np.int32)
        out[np.arange(max_len) < sizes[:, None]] = found
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * max_len), pa.array(out.ravel()))

    def encode(tokens: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(tokens.slice(i, TEXTS_AT_ONCE)) for i in range(0, max(len(tokens), 1), TEXTS_AT_ONCE)])

    first = F.slice(ws_tokenize(F.col(column)), 1, max_len)
    return df.select(row_id, F.arrow_udf(encode, "array<int>")(first).alias("token_ids"))
