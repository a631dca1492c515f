import random

import pytest
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from groundcheck.functions import overlap as ov, text as tx
from groundcheck.operators import preprocess as pp

PIECES = [
    "a", "Bc", "x_1", " ", "  ", "\t", "\n", "\r\n", " ", "　", "\x1c", "\x85", "<", ">", "<b>", "</p >", "@", ".com", ".vn", ".", "user@site.org",
    "http://", "https://a.b/c", "www.", "Không", unicodedata.normalize("NFD", "Không có gì"), "é", "Å", "가", "日本", "!", "\U0001f600", "_", "≮", "?",
]


def texts(n=600):
    rng = random.Random(5)
    return [""] + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def run(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def want_normal(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", t or "").strip())


def want_clean(t):
    t = (t or "").replace("\r", " ").replace("\n", " ")
    for pattern in (r"<[^>]+>", r"https?://\S+|www\.\S+", r"\S+@\S+\.(?:com|net|org|edu|vn|io|gov|info)"):
        t = re.sub(pattern, " ", t)
    return want_normal(t)


def test_white_space_class_is_pythons(spark):
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and (chr(c).isspace() or c < 0x3100)]
    got = run(spark, [chr(c) for c in points], F.col("x").rlike(tx.WS))
    assert [c for c, g in zip(points, got) if g] == [c for c in points if chr(c).isspace()]
    assert sorted(tx.WS_CHARS) == sorted(chr(c) for c in points if chr(c).isspace())


def test_normalize_clean_and_tokens_match_python(spark):
    values = texts()
    assert run(spark, values, tx.normalize_ws(F.col("x"))) == [want_normal(t) for t in values]
    assert run(spark, values, tx.clean_text(F.col("x"))) == [want_clean(t) for t in values]
    assert run(spark, values, tx.simple_tokenize(F.col("x"))) == [re.findall(r"\w+", want_normal(t).lower()) for t in values]
    assert run(spark, values, tx.ws_tokenize(F.col("x"))) == [t.split() for t in values]
    cleaned = tx.clean_text(F.col("x"))
    assert run(spark, values, tx.clean_token_len(cleaned)) == [len(want_clean(t).split()) for t in values]
    assert run(spark, values, tx.claims(F.col("x"))) == [[s.strip() for s in t.split(".") if s.strip()] for t in values]


def test_null_and_composed_forms(spark):
    same = ["Không có gì", unicodedata.normalize("NFD", "Không có gì")]
    assert len(set(run(spark, same, tx.normalize_ws(F.col("x"))))) == 1
    assert run(spark, [None], tx.clean_text(F.col("x"))) == [""]
    assert run(spark, ["<b></b>"], tx.clean_text(F.col("x"))) == [""]
    assert run(spark, ["see http://a.b me@x.org now"], tx.clean_text(F.col("x"))) == ["see now"]
    assert run(spark, ["a.b.. c ."], tx.claims(F.col("x"))) == [["a", "b", "c"]]


def test_long_hostile_texts_take_linear_time(spark):
    n = 200_000
    hostile = ["<" * n, "@" * n, "a" * n, "<a" * n, " " * n]
    got = run(spark, hostile, F.length(tx.clean_text(F.col("x"))))
    assert got == [n, n, n, 2 * n, 0]


def test_cues_are_substrings_and_not_composed(spark):
    cues = ["khỏi"]
    values = ["xKHỎIx", "nothing", unicodedata.normalize("NFD", "khỏi")]
    assert run(spark, values, tx.contains_any(F.col("x"), cues)) == [1, 0, 0]


def test_overlap_bounds_and_definition(spark):
    rng = random.Random(1)
    rows = [(i, rng.choices("abcd", k=rng.randint(0, 6)), rng.choices("abcd", k=rng.randint(0, 6))) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    out = df.select("a", "b", ov.jaccard(F.col("a"), F.col("b")).alias("j"), ov.containment(F.col("a"), F.col("b"), 2).alias("c")).collect()
    for r in out:
        a, b = set(r.a), set(r.b)
        assert r.j == (len(a & b) / len(a | b) if a and b else 0.0)
        ga, gb = set(zip(r.a, r.a[1:])), set(zip(r.b, r.b[1:]))
        assert r.c == (len(ga & gb) / len(gb) if ga and gb else 0.0)


def segment(tokens, compounds):
    out, i = [], 0
    while i < len(tokens):
        n = next((n for n in (4, 3, 2) if i + n <= len(tokens) and " ".join(tokens[i:i + n]) in compounds), 1)
        out.append("_".join(tokens[i:i + n]))
        i += n
    return " ".join(out)


def test_segmentation_is_leftmost_longest(spark):
    rng = random.Random(3)
    compounds = {"a b", "b c", "a b c", "c d a b", "d d"}
    rows = [(str(i), " ".join(rng.choices("abcd", k=rng.randint(0, 12)))) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, x string")
    lexicon = spark.createDataFrame([(c,) for c in compounds], "compound string")
    got = {r.id: r.y for r in pp.segment_words(df, "x", "y", lexicon).collect()}
    assert got == {i: segment(t.split(), compounds) for i, t in rows}
    assert {r.id: r.y for r in pp.segment_words(df, "x", "y", None).collect()} == dict(rows)


def test_stop_lists_of_both_kinds_agree(spark):
    df = spark.createDataFrame([("1", "The cat The dog"), ("2", "the"), ("3", "")], "id string, x string")
    stop = spark.createDataFrame([("the",), ("dog",)], "word string")
    table = {r.id: r.y for r in pp.drop_stopwords(df, {"y": "x"}, stop).collect()}
    listed = {r.id: r.y for r in pp.drop_stopwords(df, {"y": "x"}, ["the", "dog"]).collect()}
    assert table == listed == {"1": "cat", "2": "", "3": ""}
    assert {r.y for r in pp.drop_stopwords(df, {"y": "x"}, stop.limit(0)).collect()} == {"The cat The dog", "the", ""}


def test_all_steps_of_preprocessing(spark):
    df = spark.createDataFrame([("1", "New  York the city", None, "of New York City <b>")], "id string, context string, prompt string, response string")
    lexicon = spark.createDataFrame([("new york",), ("new york city",), ("alone",), (None,)], "compound string")
    row = pp.preprocess(df, "hybrid", lexicon, spark.createDataFrame([("the",), ("of",)], "word string")).first()
    assert (row.context_tok, row.prompt_tok, row.response_tok) == ("new_york city", "", "new_york_city")
    assert (row.context_token_len, row.prompt_token_len, row.response_token_len) == (2, 0, 1)
    assert pp.serialize(df, "word_segmented", lexicon).first().serialized_text == "[CLS] New York the city [SEP]  [SEP] of New York City <b> [SEP]"
    plan = pp.preprocess(df, "hybrid", lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_lexicon_bound(spark, monkeypatch):
    monkeypatch.setattr(pp, "MOST_COMPOUNDS", 1)
    with pytest.raises(ValueError, match="more than 1"):
        pp.segmenter(spark.createDataFrame([("a b",), ("c d",)], "compound string"))


def test_methods(spark):
    df = spark.createDataFrame([("1", "A  B", "Q?", "C")], "id string, context string, prompt string, response string")
    base, chat = pp.preprocess(df, "baseline").first(), pp.preprocess(df, "llm").first()
    assert (base.context_tok, chat.context_tok, base.context_token_len, base.context_char_len) == ("a b", "A B", 2, 3)
    assert "llm_prompt" not in base.asDict() and chat.llm_prompt.startswith("Context: A B\nQuestion: Q?\nModel Answer: C\n")


def test_filters_go_below_normalisation(spark):
    df = spark.createDataFrame([("e\u0301", "fr"), ("abc", "en"), (None, "fr")], "x string, lang string")
    out = df.select("lang", tx.normalize_ws(F.col("x")).alias("n")).filter("lang = 'fr'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")
    assert sorted(r.n for r in out.collect()) == ["", "\u00e9"]


def test_slices_of_a_batch_meet_without_loss(spark):
    from groundcheck.operators import preprocess as pp, vocab

    assert pp.TEXTS_AT_ONCE < 2_500 > vocab.TEXTS_AT_ONCE
    df = spark.range(0, 2_500, 1, 1).selectExpr("id", "concat('aa bb é', id % 7) AS t")
    lexicon = spark.createDataFrame([("aa bb",)], "compound string")
    assert {(r.id, r.s) for r in pp.segment_words(df, "t", "s", lexicon).collect()} == {(i, f"aa_bb é{i % 7}") for i in range(2_500)}
    names = vocab.build_vocab(df, "t", 100)
    ids = {r.token: r.token_id for r in names.collect()}
    assert {(r.id, *r.token_ids) for r in vocab.encode_sequence(df, "t", names, 4).collect()} == {(i, ids["aa"], ids["bb"], ids[f"é{i % 7}"], 0) for i in range(2_500)}
