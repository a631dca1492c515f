"""Ranked lexical search against a plain count over all texts, and over awkward tables."""

import collections
import math
import re

import pytest

pytest.importorskip("public_tokenizers")

from groundcheck.llm import lexical_search  # noqa: E402

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "id item term n tf score rank doc m w".split()


def terms_of(text):
    return TERM.findall((text or "").translate(ASCII))


def plain_search(docs, items, k=10):
    bags = [(i, terms_of(t)) for i, t in docs]
    n = sum(1 for _, t in bags if t)
    length = sum(len(t) for _, t in bags)
    df = collections.Counter(x for _, t in bags for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for doc, words in bags:
            tf, score = collections.Counter(words), 0
            for x in terms_of(text):
                if tf[x]:
                    m = 100 - 75 + (75 * len(words) * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m))
            if score > 0:
                scored.append((-score, doc if doc is not None else 1 << 62))
        out += [(item, rank, doc if doc < 1 << 62 else None, -score) for rank, (score, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [
    (1, None), (2, ""), (3, "--- !!! \x00"), (4, "Alpha beta ALPHA alpha_beta"), (5, "alpha" * 3000 + " alpha"), (6, "alpha beta gamma delta " * 5000),
    (7, "ÄPFEL äpfel Äpfel \x85 漢字 \U0001f600 x y"), (8, "beta"), (8, "beta"), (9, "beta"), (None, "beta beta gamma"), (None, None), (10, "alphabet alph a"),
]
ITEMS = [(1, "alpha beta"), (1, "alpha beta"), (2, "Äpfel äpfel"), (3, None), (4, "!!"), (None, "beta beta beta"), (5, "x y 漢字 \U0001f600"), (6, "nowhere"), (7, "a")]


def frames(spark, docs=DOCS, items=ITEMS):
    extra = "".join(f", `{c}` string" for c in EXTRA)
    d = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in docs], "doc_id long, text string" + extra)
    i = spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in items], "item_id long, text string" + extra)
    return d, i


def test_awkward_texts(spark):
    docs, items = frames(spark)
    want = plain_search(DOCS, ITEMS)
    assert found(lexical_search.search(docs.repartition(4), items)) == want and len(want) > 15
    assert found(lexical_search.search(docs, items, terms_per_scan=2)) == want  # an automaton and two scans for each part
    assert found(lexical_search.search(docs, items, k=2)) == plain_search(DOCS, ITEMS, 2)


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert found(lexical_search.search(docs.limit(0), items)) == [] == found(lexical_search.search(docs, items.limit(0)))
    assert found(lexical_search.search(docs.filter("doc_id <= 3"), items)) == []
    with pytest.raises(ValueError, match="are allowed"):
        lexical_search.search(docs, items, most_terms=3)


def test_whole_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(lexical_search.search(docs.repartition(8), items)) == want


def test_best_rows_of_a_task():
    import numpy as np

    best = lexical_search.Best(2, 3)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 5, 5, 0]), np.array([9, 3, 4, 1]))
    best.add(np.array([0, 2, 0]), np.array([5, 1, 6]), np.array([2, 8, 7]))
    assert [x.tolist() for x in best.rows] == [[0, 0, 2], [6, 5, 1], [7, 2, 8]]
