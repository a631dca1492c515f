"""Ranked lexical search: one automaton of all items' terms reads the documents, which are never indexed.

The items (queries) are the small side: their distinct terms become an Aho-Corasick automaton in which every term is guarded by a
blank at either end, so that a hit is a whole term. A first scan counts what the weights need (documents, terms, document
frequencies), a second one scores each document where it is read and keeps the best rows of each item inside the task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

#: Fixed: the characters of a term, with only A-Z lower-cased before.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: UTF-8 byte to byte: A-Z lower-cased, bytes outside terms to blanks. Bytes of other characters stand as they are.
FOLD = bytes(b + 32 if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
DOCS, TERMS = -1, -2


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): the terms of each row of ``items``, numbered by the row (equal rows are items of their own)."""
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = rows.select("item", "item_id", F.explode(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    return words.groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))


class Scanner:
    """The automaton of a list of terms, over UTF-8 bytes. A term's number is its place in the list."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def read(self, text: bytes | None) -> tuple[int, dict[int, int]]:
        """(all terms of the text with repeats, times each listed term occurs)."""
        if not text:
            return 0, {}
        folded = text.translate(FOLD)
        hits = Counter(i for _, i in self.automaton.iter(f" {folded.decode('latin-1')} "))
        return len(folded.split()), hits


@lru_cache(maxsize=2)
def _scanner(terms: tuple[str, ...]) -> Scanner:
    return Scanner(list(terms))


def count_frequencies(docs: DataFrame, terms: Broadcast) -> tuple[int, int, np.ndarray]:
    """(documents with a term, their terms, document frequency of each listed term) over all ``docs`` (id, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, found, total = _scanner(terms.value), Counter(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                n, hits = scanner.read(text.as_py())
                total[DOCS] += n > 0
                total[TERMS] += n
                found.update(hits.keys())
        both = [*total.items(), *found.items()]
        yield pa.RecordBatch.from_pydict({"term": pa.array([t for t, _ in both], pa.int32()), "n": pa.array([int(n) for _, n in both], pa.int64())})

    sums = {r.term: r.n for r in docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return sums.get(DOCS, 0), sums.get(TERMS, 0), np.array([sums.get(i, 0) for i in range(len(terms.value))], dtype=np.int64)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)


class Best:
    """The highest ``k`` scores of each item so far: falling score, then rising id (rows without an id last)."""

    def __init__(self, k: int, items: int):
        self.k, self.least = k, np.zeros(items, dtype=np.int64)
        self.rows = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        near = (score > 0) & (score >= self.least[item])
        item, score, doc = (np.concatenate([a, b[near]]) for a, b in zip(self.rows, (item, score, doc)))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1]))) if len(item) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
        keep = place < self.k
        self.rows = item[keep], score[keep], doc[keep]
        last = place == self.k - 1
        self.least[item[last]] = score[last]


NO_ID = np.iinfo(np.int64).max


def best_documents(docs: DataFrame, terms: Broadcast, table: Broadcast, stats: tuple[int, int, np.ndarray], k: int, items: int, cells: int = 1 << 22) -> DataFrame:
    """(item, doc, score): at most ``k`` rows of each item from each task. ``table``: items of each term, as (start, item, times) arrays."""
    n_docs, n_terms, df = stats
    weight = weights(n_docs, df)

    def scores(rows: list[tuple[int, int, dict[int, int]]], best: Best) -> None:
        start, item_of, times = table.value
        sizes = [len(h) for *_, h in rows]
        doc = np.repeat(np.arange(len(rows)), sizes)
        term = np.fromiter((t for *_, h in rows for t in h), np.int64, len(doc))
        tf = np.fromiter((c for *_, h in rows for c in h.values()), np.int64, len(doc))
        m = np.array([25 + 75 * n * n_docs // n_terms for _, n, _ in rows], dtype=np.int64)
        part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        count = start[term + 1] - start[term]
        at = np.repeat(start[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
        total = np.zeros(len(rows) * items, dtype=np.int64)
        np.add.at(total, np.repeat(doc, count) * items + item_of[at], np.repeat(part, count) * times[at])
        hit = np.flatnonzero(total)
        ids = np.array([i for i, *_ in rows], dtype=np.int64)
        best.add(hit % items, total[hit], ids[hit // items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, best, rows = _scanner(terms.value), Best(k, items), []
        for batch in batches:
            for i, text in zip(batch.column("id"), batch.column("text")):
                n, hits = scanner.read(text.as_py())
                if hits:
                    rows.append((NO_ID if (i := i.as_py()) is None else i, n, hits))
                if len(rows) * items >= cells:
                    scores(rows, best)
                    rows = []
        if rows:
            scores(rows, best)
        item, score, doc = best.rows
        yield pa.RecordBatch.from_pydict({"item": item, "doc": pa.array(doc, mask=doc == NO_ID), "score": score})

    return docs.mapInArrow(run, "item long, doc long, score long")


def parts_of(found: DataFrame, terms_per_scan: int) -> list[list]:
    """The items with their terms, in parts of at most ``terms_per_scan`` (item, term) rows; a larger item is a part of its own."""
    out, held = [[]], 0
    rows = sorted(found.groupBy("item", "item_id").agg(F.collect_list(F.struct("term", "times")).alias("terms")).collect(), key=lambda r: r.item)
    for row in rows:
        if out[-1] and held + len(row.terms) > terms_per_scan:
            out.append([])
            held = 0
        out[-1].append(row)
        held += len(row.terms)
    return [p for p in out if p]


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", terms_per_scan: int = 500_000, most_terms: int = 5_000_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case; null texts have none. Every row of
    ``items`` is an item (rows that repeat an id are ranked apart) and every row of ``docs`` a document; equal scores are ranked by rising id, rows
    without an id last. Items without terms and empty tables give no rows. ``items`` is the side that is held in memory: its (item, term) rows
    are read by the driver and broadcast in parts of ``terms_per_scan``, each with its own two scans; more than ``most_terms`` are an error.
    """
    spark = docs.sparkSession
    found = item_terms(items, item_col, item_text_col)
    schema = items.select(F.col(item_col).alias("item_id")).schema[0].dataType
    if (many := found.count()) > most_terms:
        raise ValueError(f"{many} terms of items; {most_terms} are allowed")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    out = spark.createDataFrame([], f"item_id {schema.simpleString()}, rank int, {id_col} long, score long")
    for part in parts_of(found, terms_per_scan) if many else []:
        names = sorted({t.term for row in part for t in row.terms})
        number = {t: i for i, t in enumerate(names)}
        entries = sorted((number[t.term], j, t.times) for j, row in enumerate(part) for t in row.terms)
        of = np.array([e[0] for e in entries])
        start = np.searchsorted(of, np.arange(len(names) + 1))
        terms = spark.sparkContext.broadcast(tuple(names))
        table = spark.sparkContext.broadcast((start, np.array([e[1] for e in entries]), np.array([e[2] for e in entries])))
        stats = count_frequencies(texts.select("text"), terms)
        if not stats[0]:
            continue
        top = best_documents(texts, terms, table, stats, k, len(part))
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        ranked = top.select("*", F.row_number().over(best).alias("rank")).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(j, row.item_id) for j, row in enumerate(part)], f"item long, item_id {schema.simpleString()}")
        out = out.unionByName(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", F.col("doc").alias(id_col), "score"))
    return out
