"""Token counts by a map-side two-tier lookup of pre-token lengths. Nothing is shuffled."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .pretokens import END_OF_TEXT, PIECES, UNSURE, library


def frequent_lengths(path: str) -> dict[str, int]:
    """Pre-token -> number of tokens, for the strings the vocabulary itself was built from: the first tier.

    A byte-pair vocabulary is the list of its training text's frequent strings. Each one that is a
    whole pre-token is encoded once, on the driver. The table has at most one row per vocabulary
    entry (50,257), whatever the data, so it can be broadcast.
    """
    tokenizer = library(path)
    texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size(with_added_tokens=False))]
    whole = sorted({t for t in texts if t and "�" not in t and not UNSURE.search(t) and PIECES.fullmatch(t) and PIECES.findall(t) == [t]})
    return dict(zip(whole, (len(e.ids) for e in tokenizer.encode_batch(whole, add_special_tokens=False))))


class Lengths(dict):
    """Second tier, one per task: lengths met so far, encoded on a miss, and forgotten beyond ``limit`` entries."""

    def __init__(self, table: dict[str, int], path: str, limit: int):
        super().__init__(table)
        self.table, self.limit, self.encode = table, limit, library(path).encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.update(self.table)
        n = self[piece] = len(self.encode(piece, add_special_tokens=False).ids)
        return n

    def count(self, text: str) -> int:
        if UNSURE.search(text):
            return len(self.encode(text, add_special_tokens=False).ids)
        if END_OF_TEXT in text:  # one token, and a border for pre-tokens
            parts = text.split(END_OF_TEXT)
            return len(parts) - 1 + sum(map(self.count, parts))
        return sum(map(self.__getitem__, PIECES.findall(text)))


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, cache: int = 600_000
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``path``: a byte-level BPE file of the tokenizers library. A worker holds the broadcast table and at
    most ``cache`` lengths. Counts equal the library's for any text; a null text counts as empty, repeated
    rows stay, an empty table gives no rows, and other columns are not read.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lengths = Lengths(table.value, path, cache)
        for texts in batches:
            yield pd.Series([lengths.count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
