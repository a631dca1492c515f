"""The two classifiers against plain arithmetic, their fits over awkward labels, and the whole pipeline over odd tables."""

import math
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from groundcheck.llm import quality_pu, toxicity  # noqa: E402
from groundcheck.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"
LONG = "one more plain line of words that is long enough to stay and to count here\n" * 6
DOCS = [
    (None, "no id at all"), (1, None), (2, ""), (3, " \n\t"), (4, "x" * 100_000), (5, LONG), (5, LONG), (6, LONG + "moron"), (7, "!!! ### $$$"),
    (8, "the and of to a in is it that for on was with as be at by " * 20), (9, LONG.replace("plain", "other")), (None, None),
]


def documents(spark, rows):
    extra = "toxic quality text2 x score row id n words _text".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["x"] * len(extra)) for i, t in rows], schema)


def labels(spark, rows):
    return spark.createDataFrame([(i, q, t, "x") for i, q, t in rows], "doc_id long, quality int, toxic int, text string")


AWKWARD = {
    "none": [], "nulls": [(None, 1, 1), (5, None, None), (6, None, 1), (None, None, None)], "repeated": [(5, 1, 0), (5, 0, 1), (5, 1, 0), (6, 1, 1)],
    "one class": [(i, 1, 0) for i in range(1, 10)], "other values": [(i, 7, -1) for i in range(1, 10)], "unknown ids": [(i, i % 2, i % 2) for i in range(500, 600)],
    "both": [(i, i % 2, (i + 1) % 2) for i in range(1, 10)],
}


@pytest.mark.parametrize("name", sorted(AWKWARD))
def test_fits_over_awkward_labels(spark, name):
    docs, marks = documents(spark, DOCS), labels(spark, AWKWARD[name])
    for kind in (toxicity, quality_pu):
        model = kind.train(docs, marks)
        got = kind.score(docs, model).collect()
        assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert kind.score(docs.limit(0), model).collect() == []
        kind.train(docs.limit(0), marks)
    kept = quality_pu.keep_good(docs, quality_pu.train(docs, marks))
    assert kept.columns == docs.columns and kept.count() <= len(DOCS)


def test_quality_when_every_document_has_a_label(spark):
    """The unlabelled side does not depend on which rows have a label: all documents labelled, and the poor ones are still found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    only = docs.join(known.select("doc_id"), "doc_id", "left_semi")
    out = quality_pu.score(only, quality_pu.train(only, known)).join(known, "doc_id").collect()
    poor = [r.predicted for r in out if r.quality == 0]
    good = [r.predicted for r in out if r.quality == 1]
    assert sum(poor) < 0.2 * len(poor) and sum(good) > 0.9 * len(good)


def test_risk_slopes_match_differences():
    """The derivatives of the non-negative risk, where it is positive, and of its correction where it is not."""
    r = np.random.default_rng(1)
    for prior, shift in ((0.3, 0.0), (0.9, 3.0)):
        zp, zu = r.normal(shift, 1, 7), r.normal(-shift, 1, 9)
        calls = lambda z, sign: np.logaddexp(0, -sign * z).mean()
        negative = lambda p, u: calls(u, -1) - prior * calls(p, -1)
        risk = (lambda p, u: prior * calls(p, 1) + negative(p, u)) if negative(zp, zu) >= 0 else (lambda p, u: -negative(p, u))
        assert (negative(zp, zu) < 0) == (shift > 0)
        gp, gu = quality_pu.non_negative_slopes(prior)(zp, zu)
        for z, g, at in ((zp, gp, 2), (zu, gu, 4)):
            e = np.zeros(len(z))
            e[at] = 1e-6
            up, down = (risk(zp + s * e, zu) if z is zp else risk(zp, zu + s * e) for s in (1, -1))
            assert math.isclose(g[at], (up - down) / 2e-6, rel_tol=1e-4, abs_tol=1e-7)


def plain_toxicity(model, text):
    """The score of a fitted model, window by window, with no cache."""
    words = re.findall(r"\w{1,200}", text.lower())
    if not words:
        return model.share
    best = -math.inf
    for at in range(0, len(words), toxicity.WINDOW):
        bag = set(words[at : at + toxicity.WINDOW])
        total = 0.0
        for w in bag:
            buckets = toxicity.subwords(w)
            total += sum(float(model.weights[b]) for b in buckets) / len(buckets)
        best = max(best, total / max(len(bag), toxicity.LEAST))
    return 1 / (1 + math.exp(-(best + model.bias)))


def test_toxicity_scores_match_the_plain_form(spark):
    r = np.random.default_rng(2)
    model = toxicity.Model(r.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.3, 0.1)
    texts = [t for _, t in DOCS] + [" ".join(f"w{i % 90}" for i in range(400)), "neutral_" * 60 + "moron"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in toxicity.score(frame, model).collect():
        assert math.isclose(row.score, plain_toxicity(model, texts[row.doc_id] or ""), rel_tol=1e-5)


def test_a_word_counts_wherever_it_stands_in_a_run():
    """Of a run without spaces not only the first 200 characters count."""
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, dtype=np.float32), -3.0)
    model.weights[toxicity.subwords("moron")] = 200.0
    score = toxicity.WordScores(model).score
    assert score("_" * 400 + "moron") > 0.9 > 0.1 > score("_" * 400 + "marble")


def test_toxicity_query(spark):
    out = QUERIES["op1_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    clean = [r for r in out if r.toxic == 0 and r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out) and sum(r.predicted for r in clean) <= 0.05 * len(clean)
    learnt = [r for r in out if r.toxic == 1 and not r.held_out]
    assert sum(r.predicted for r in learnt) >= 0.5 * len(learnt)


@pytest.mark.parametrize("rows", [DOCS, []], ids=["odd", "empty"])
def test_the_whole_pipeline_over_odd_tables(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, AWKWARD["both"] if rows else []).write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    assert {r.doc_id for r in got} <= {i for i, _ in rows}
    for i in {r.doc_id for r in got if r.doc_id is not None}:
        pieces = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]) if b)
