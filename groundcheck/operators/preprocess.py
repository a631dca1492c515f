"""Cleaning, tokens, lengths and word segmentation of a triplet table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..schema import METHODS, PROMPTING_METHODS, SEGMENTING_METHODS
from .contracts import present_text_columns

LONGEST_COMPOUND = 4  # words of the compounds that the test fixtures list
#: The lexicon is held by every task as a trie; larger ones are refused.
MOST_COMPOUNDS = 2_000_000
TEXTS_AT_ONCE = 256
END = ""  # marks a trie node at which a compound ends; no word is empty


def compound_trie(compounds: Iterable[str]) -> dict:
    """Nested maps, word by word. Entries of one word join nothing and are left out."""
    trie: dict = {}
    for compound in compounds:
        words = compound.split(" ")
        if len(words) > 1:
            node = trie
            for word in words:
                node = node.setdefault(word, {})
            node[END] = {}
    return trie


def join_compounds(text: str, trie: dict) -> str:
    """The words of ``text`` (single spaces) with known compounds joined by ``_``, leftmost and longest first: one walk over the words."""
    words, out, i = text.split(" "), [], 0
    while i < len(words):
        node, end, j = trie.get(words[i]), i + 1, i + 1
        while node is not None:
            if END in node:
                end = j
            node, j = (node.get(words[j]) if j < len(words) else None), j + 1
        out.append(words[i] if end == i + 1 else "_".join(words[i:end]))
        i = end
    return " ".join(out)


def segmenter(lexicon: DataFrame | None) -> Callable[[Column], Column]:
    """A column function that joins the words of known compounds by ``_``; without a lexicon it collapses white space.

    ``lexicon`` has one column ``compound`` (two or more words, single spaces). It is read once, here, and held by the tasks, so each text is
    segmented in its own row: no join, no shuffle, and any number of columns in one pass over the batch.
    """
    if lexicon is None:
        return lambda text: tx.collapse_ws(tx.fill_text(text))
    table = lexicon.select("compound").filter("compound is not null").limit(MOST_COMPOUNDS + 1).toArrow()
    if len(table) > MOST_COMPOUNDS:
        raise ValueError(f"the lexicon holds more than {MOST_COMPOUNDS} compounds")
    held = lexicon.sparkSession.sparkContext.broadcast(compound_trie(table.column("compound").to_pylist()))

    def segment(texts: pa.Array) -> pa.Array:
        trie = held.value
        # few texts are Python strings at a time, whatever a batch holds
        parts = [pa.array([join_compounds(t, trie) for t in texts.slice(i, TEXTS_AT_ONCE).to_pylist()], pa.string()) for i in range(0, len(texts), TEXTS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return lambda text: F.arrow_udf(segment, T.StringType())(tx.collapse_ws(tx.fill_text(text)))


def segment_words(df: DataFrame, column: str, out: str, lexicon: DataFrame | None) -> DataFrame:
    """``df`` with ``out``: the text of ``column`` segmented by ``segmenter``."""
    return df.withColumn(out, segmenter(lexicon)(F.col(column)))


def remove_stopwords(tokens: Column, stopwords: Column | list[str]) -> Column:
    """Drop tokens whose lower case is in the list; an empty list drops none. The texts stay in place."""
    if isinstance(stopwords, list):
        return F.filter(tokens, lambda t: ~F.lower(t).isin(stopwords)) if stopwords else tokens
    return F.filter(tokens, lambda t: ~F.array_contains(stopwords, F.lower(t)))


def drop_stopwords(df: DataFrame, columns: dict[str, str], stopwords: DataFrame | list[str]) -> DataFrame:
    """``df`` with, for each ``out: column``, the tokens of ``column`` that are no stop words, joined by spaces.

    A stop list may be a table with one column ``word``: the query reads it as one array when it runs, without a join.
    """
    if isinstance(stopwords, DataFrame):
        words = F.coalesce(stopwords.agg(F.collect_set("word")).scalar(), F.array().cast("array<string>"))
        df, listed = df.withColumn("_stop", words), F.col("_stop")
    else:
        listed = stopwords
    out = df.withColumns({o: F.array_join(remove_stopwords(tx.ws_tokenize(F.col(c)), listed), " ") for o, c in columns.items()})
    return out.drop("_stop") if isinstance(stopwords, DataFrame) else out


def preprocess(
    df: DataFrame, method: str = "baseline", lexicon: DataFrame | None = None, stopwords: DataFrame | list[str] | None = None,
) -> DataFrame:
    """Add ``{c}_clean, {c}_tok, {c}_char_len, {c}_token_len`` per text column, and the judge prompt: one projection over the scan.

    Methods that segment lower the clean text, join the compounds of ``lexicon`` and drop ``stopwords``, if given.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    columns = present_text_columns(df)
    out = df.withColumns({f"{c}_clean": tx.clean_text(F.col(c)) for c in columns})
    tokens = {c: F.col(f"{c}_clean") for c in columns}
    if method in SEGMENTING_METHODS:
        tokens = {c: F.lower(t) for c, t in tokens.items()}
        if lexicon is not None:
            segment = segmenter(lexicon)
            tokens = {c: segment(t) for c, t in tokens.items()}
    out = out.withColumns({f"{c}_tok": t for c, t in tokens.items()})
    if method in SEGMENTING_METHODS and stopwords is not None:
        out = drop_stopwords(out, {f"{c}_tok": f"{c}_tok" for c in columns}, stopwords)
    lengths = {}
    for c in columns:
        lengths[f"{c}_char_len"] = F.length(f"{c}_clean")
        lengths[f"{c}_token_len"] = tx.clean_token_len(F.col(f"{c}_tok"))
    out = out.withColumns(lengths)
    if method in PROMPTING_METHODS:
        parts = [F.col(f"{c}_clean") if c in columns else F.lit("") for c in ("context", "prompt", "response")]
        out = out.withColumn("llm_prompt", tx.judge_prompt(*parts))
    return out


def serialize(df: DataFrame, text_mode: str = "raw", lexicon: DataFrame | None = None) -> DataFrame:
    """Add ``serialized_text`` from the normalised (or segmented) texts."""
    parts = {c: tx.normalize_ws(F.col(c)) for c in ("context", "prompt", "response")}
    if text_mode == "word_segmented":
        segment = segmenter(lexicon)
        parts = {c: segment(p) for c, p in parts.items()}
    elif text_mode != "raw":
        raise ValueError(f"unknown text mode {text_mode!r}")
    names = {c: f"_{c}" for c in parts}
    out = df.withColumns({names[c]: p for c, p in parts.items()})
    joined = tx.serialize_triplet(*[F.col(n) for n in names.values()])
    return out.withColumn("serialized_text", joined).drop(*names.values())


def combine_texts(df: DataFrame) -> DataFrame:
    """The four text combinations the vectorisers take."""
    c, p, r = F.col("context_clean"), F.col("prompt_clean"), F.col("response_clean")
    return df.withColumns({
        "text_all": F.concat_ws(" ", c, p, r),
        "text_pr": F.concat_ws(" ", p, r),
        "text_cr": F.concat_ws(" ", c, r),
        "text_response": r,
    })


def preprocess_stats(df: DataFrame, n: int = 3, row_id: str = "id") -> DataFrame:
    """One row: row count, column count, the first n records in id order."""
    head = df.orderBy(row_id).limit(n).agg(
        F.array_sort(F.collect_list(F.struct(row_id, *[c for c in df.columns if c != row_id]))).alias("s")
    )
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"), head.scalar().alias("sample_rows")
    )
