"""TF-IDF kept as one row per text.

``term_rows`` counts the terms of each text inside its row, so nothing is exploded and nothing is shuffled by id. The one exchange is the
count per term for the vocabulary, which partial aggregation shrinks first. Weights, row norms and ML vectors are then computed
inside the row as well, against the vocabulary held by each task: its size is the parameter ``max_features``, at most ``MOST_FEATURES``.
Long tables ``(id, term, ...)`` are unrolled from the rows where they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.overlap import ngrams
from ..functions.text import fill_text, words
from .ordering import top_rows

MAX_FEATURES = 120_000
#: The vocabulary is held by every task; larger ones are refused (2 million terms are about 60 MB).
MOST_FEATURES = 2_000_000
#: Words of which the counts are worked out at once, whatever the length of a batch's texts.
SLICE_WORDS = 200_000


def tfidf_terms(text: Column, lowercase: bool = False) -> Column:
    """Words of at least two characters, and the bigrams of that word list joined by a space."""
    tokens = words(F.lower(text) if lowercase else text, 2)
    return F.concat(tokens, ngrams(tokens, 2, " "))


def lists(values: pa.Array | np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Consecutive runs of ``values`` of the given sizes, one list each."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values)


def count_terms(tokens: pa.ListArray) -> tuple[pa.ListArray, pa.ListArray]:
    """(terms, tf): the distinct words and bigrams of each list. Strings are built only for distinct terms."""
    n = len(tokens)
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many = max(len(names), 1)
    row = np.repeat(np.arange(n), sizes)
    single, single_tf = np.unique(row * many + code, return_counts=True)
    inside = row[1:] == row[:-1]
    pairs, pair = np.unique(code[:-1][inside] * many + code[1:][inside], return_inverse=True)
    width = max(len(pairs), 1)
    double, double_tf = np.unique(row[1:][inside] * width + pair, return_counts=True)
    bigrams = pc.binary_join_element_wise(names.take(pa.array(pairs // many)), names.take(pa.array(pairs % many)), " ")
    of = np.concatenate([single // many, double // width])
    term = np.concatenate([single % many, len(names) + double % width])
    order = np.argsort(of, kind="stable")
    found = pa.concat_arrays([names, bigrams.cast(names.type)]).take(pa.array(term[order]))
    counts = np.bincount(of, minlength=n)
    return lists(found, counts), lists(np.concatenate([single_tf, double_tf])[order].astype(np.int32), counts)


def _slices(batch: pa.RecordBatch, column: str, most: int = SLICE_WORDS) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose lists in ``column`` hold about ``most`` values; a longer row is a piece of its own."""
    ends = np.cumsum(pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def term_rows(df: DataFrame, column: str, lowercase: bool = False, row_id: str = "id", keep: list[str] | None = None) -> DataFrame:
    """``(id, *keep, terms, tf)``: one row per text with its distinct terms. ``keep`` carries row attributes (label, split) along."""
    keys = [row_id, *(keep or [])]
    text = fill_text(F.col(column))
    rows = df.select(*keys, words(F.lower(text) if lowercase else text, 2).alias("_w"))
    schema = T.StructType([*rows.select(*keys).schema, T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "_w"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *count_terms(part.column("_w"))], [*keys, "terms", "tf"])

    return rows.mapInArrow(run, schema)


def unrolled(rows: DataFrame, *arrays: str) -> DataFrame:
    """The other columns with one row per place of the parallel ``arrays``."""
    others = [c for c in rows.columns if c not in arrays]
    return rows.select(*others, F.inline(F.arrays_zip(*arrays)))


def term_counts(rows: DataFrame) -> DataFrame:
    """``(id, *keep, term, tf)`` of ``term_rows``."""
    return unrolled(rows, "terms", "tf").withColumnRenamed("terms", "term")


def tfidf_vocab(rows: DataFrame, min_df: int = 2, max_df: float = 1.0, max_features: int = MAX_FEATURES) -> DataFrame:
    """``(term, df, cf, idf)`` of the fitted texts: document-frequency filter, then the most frequent. Ties by term."""
    if max_features > MOST_FEATURES:
        raise ValueError(f"max_features is {max_features}; at most {MOST_FEATURES} terms are held by a task")
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    stats = unrolled(rows.select("terms", "tf"), "terms", "tf").groupBy(F.col("terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    usable = stats.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n))
    kept = top_rows(usable, max_features, "cf", "term")
    return kept.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1.0)


@dataclass
class Vocabulary:
    """A vocabulary held by tasks: the terms in order, which numbers them, and their idf."""

    terms: pa.Array
    idf: np.ndarray

    def __len__(self) -> int:
        return len(self.terms)


def hold(vocab: DataFrame) -> Broadcast:
    """The table ``vocab`` as a broadcast ``Vocabulary``; its terms are numbered alphabetically."""
    table = vocab.select("term", "idf").orderBy("term").limit(MOST_FEATURES + 1).toArrow().combine_chunks()
    if len(table) > MOST_FEATURES:
        raise ValueError(f"the vocabulary holds more than {MOST_FEATURES} terms")
    terms = table.column("term").combine_chunks() if len(table) else pa.array([], pa.string())
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    return vocab.sparkSession.sparkContext.broadcast(Vocabulary(terms, table.column("idf").to_numpy()))


def weigh(vocabulary: Vocabulary, terms: pa.ListArray, tf: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, index, tf, weight) of the known terms of each list, by place and index: (1 + ln tf) idf, scaled to unit length per place."""
    at = pc.index_in(terms.flatten(), value_set=vocabulary.terms)
    known = pc.is_valid(at).to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))[known]
    index = pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[known]
    count = tf.flatten().to_numpy(zero_copy_only=False)[known]
    order = np.lexsort((index, place))
    place, index, count = place[order], index[order], count[order]
    weight = (1.0 + np.log(count)) * vocabulary.idf[index]
    length = np.sqrt(np.bincount(place, weight * weight, minlength=len(terms)))
    return place, index, count, weight / length[place]


def _weighted(rows: DataFrame, held: Broadcast, fields: list[T.StructField], build) -> DataFrame:
    """``rows`` with their term columns replaced by what ``build(vocabulary, n, place, index, tf, weight)`` makes of them."""
    keys = [c for c in rows.columns if c not in ("terms", "tf")]
    schema = T.StructType([*rows.select(*keys).schema, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "terms"):
                made = build(held.value, part.num_rows, *weigh(held.value, part.column("terms"), part.column("tf")))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keys] + made, [*keys, *[f.name for f in fields]])

    return rows.select(*keys, "terms", "tf").mapInArrow(run, schema)


def tfidf_rows(rows: DataFrame, held: Broadcast) -> DataFrame:
    """``(id, *keep, term_idx, tfidf)``: the numbers of a text's known terms, rising, and their weights. Texts without any keep empty lists."""
    def build(_, n, place, index, count, weight):
        sizes = np.bincount(place, minlength=n)
        return [lists(index.astype(np.int32), sizes), lists(weight, sizes)]

    return _weighted(rows, held, [T.StructField("term_idx", T.ArrayType(T.IntegerType())), T.StructField("tfidf", T.ArrayType(T.DoubleType()))], build)


def tfidf_weights(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(id, *keep, term, tf, tfidf)``: one row per known term of a text."""
    def build(vocabulary, n, place, index, count, weight):
        sizes = np.bincount(place, minlength=n)
        return [lists(vocabulary.terms.take(pa.array(index)), sizes), lists(count, sizes), lists(weight, sizes)]

    kinds = {"term": T.StringType(), "tf": T.IntegerType(), "tfidf": T.DoubleType()}
    return unrolled(_weighted(rows, hold(vocab), [T.StructField(c, T.ArrayType(t)) for c, t in kinds.items()], build), *kinds)


def tfidf_vectors(rows: DataFrame, held: Broadcast) -> DataFrame:
    """``(id, *keep, features)``: one sparse ML vector per text; texts without known terms get zeros."""
    size = len(held.value)

    def build(_, n, place, index, count, weight):
        sizes = np.bincount(place, minlength=n)
        parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), lists(index.astype(np.int32), sizes), lists(weight, sizes)]
        return [pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])]

    return _weighted(rows, held, [T.StructField("features", VectorUDT())], build)
