"""Text functions, row features, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import overlap as ov, proba as pr, text as tx
from ..operators import contracts, features as ft, preprocess as pp
from ..schema import HANDCRAFTED_FEATURES, RULE_FEATURES
from ..sources import fixtures as fx
from . import oracle as o
from .oracle import sql, texts_sql
from .registry import big, joined, query, r6

SEP = "chr(9247)"


@query("normalize_ws", f"SELECT doc_id, {o.norm('text')} AS text FROM documents")
def normalize_ws(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.normalize_ws(F.col("text")).alias("text"))


@query("serialize_triplet", texts_sql(["serialized"], "SELECT id, serialized_text FROM serialized"))
def serialize_triplet(spark, sf):
    return pp.serialize(fx.texts(spark, sf)).select("id", "serialized_text")


@query("clean_text", f"SELECT page_id, {o.clean('html')} AS text FROM pages UNION ALL SELECT -1 - doc_id, {o.clean('text')} FROM documents")
def clean_text(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", tx.clean_text(F.col("html")).alias("text"))
    docs = fx.table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("page_id"), tx.clean_text(F.col("text")).alias("text"))
    return pages.union(docs)


@query("lower_text", "SELECT doc_id, lower(text) AS text FROM documents")
def lower_text(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))


@query("simple_tokenize", f"SELECT doc_id, array_to_string({o.tokens('text')}, {SEP}) AS tokens FROM documents")
def simple_tokenize(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", joined(tx.simple_tokenize(F.col("text")), "tokens"))


@query("ws_tokenize", f"SELECT doc_id, array_to_string({o.ws_tokens('text')}, {SEP}) AS tokens FROM documents")
def ws_tokenize(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", joined(tx.ws_tokenize(F.col("text")), "tokens"))


def segment_ctes(name, source, text):
    """``{name}`` (id, text): the texts of ``source`` with the compounds of ``lexicon`` joined, by a walk over the hits of each text."""
    grams = " UNION ALL ".join(
        f"SELECT id, unnest(range(0, len(t) - {n} + 1)) AS pos, {n} AS n, unnest({o.ngrams('t', n, chr(39) + ' ' + chr(39))}) AS compound FROM {name}_words"
        for n in (2, 3, 4))
    return [
        f"{name}_words AS (SELECT id, {o.ws_tokens(text)} AS t FROM {source})",
        f"{name}_grams AS ({grams})",
        f"{name}_hits AS (SELECT id, pos, max(n) AS n FROM {name}_grams JOIN lexicon USING (compound) GROUP BY id, pos)",
        f"""{name}_spans AS (
  SELECT id, min(pos) AS pos, arg_min(n, pos) AS n FROM {name}_hits GROUP BY id
  UNION ALL
  SELECT h.id, min(h.pos), arg_min(h.n, h.pos) FROM {name}_spans s JOIN {name}_hits h ON h.id = s.id AND h.pos >= s.pos + s.n GROUP BY h.id)""",
        f"{name}_glued AS (SELECT DISTINCT id, unnest(range(pos + 1, pos + n)) AS i FROM {name}_spans)",
        f"{name}_tokens AS (SELECT id, unnest(range(0, len(t))) AS i, unnest(t) AS token FROM {name}_words)",
        f"""{name} AS (
  SELECT w.id, coalesce(x.text, '') AS text FROM {name}_words w LEFT JOIN (
    SELECT t.id, string_agg(CASE WHEN t.i = 0 THEN '' WHEN g.i IS NOT NULL THEN '_' ELSE ' ' END || t.token, '' ORDER BY t.i) AS text
    FROM {name}_tokens t LEFT JOIN {name}_glued g ON g.id = t.id AND g.i = t.i GROUP BY t.id) x ON x.id = w.id)""",
    ]


@query("segment_words", texts_sql(["triplets", "lexicon"], "SELECT id, text FROM seg", segment_ctes("seg", "triplets", o.norm("context")), recursive=True))
def segment_words(spark, sf):
    df = fx.texts(spark, sf).withColumn("context", tx.normalize_ws(F.col("context")))
    return pp.segment_words(df, "context", "text", fx.lexicon(spark, sf)).select("id", "text")


COLUMNS = ("context", "prompt", "response")
SEGMENTED = [x for c in COLUMNS for x in segment_ctes(f"seg_{c}", "triplets", o.norm(c))]


@query("serialize_segmented", texts_sql(["triplets", "lexicon"], """
SELECT c.id, '[CLS] ' || c.text || ' [SEP] ' || p.text || ' [SEP] ' || r.text || ' [SEP]' AS serialized_text
FROM seg_context c JOIN seg_prompt p ON p.id = c.id JOIN seg_response r ON r.id = c.id""", SEGMENTED, recursive=True))
def serialize_segmented(spark, sf):
    return pp.serialize(fx.texts(spark, sf), "word_segmented", fx.lexicon(spark, sf)).select("id", "serialized_text")


STOP_SQL = f"""stop AS (
  SELECT word FROM (SELECT DISTINCT item_id, unnest({o.ws_tokens('lower(text)')}) AS word FROM benchmark)
  GROUP BY word HAVING count(*) * 5 >= (SELECT count(*) FROM benchmark))"""


def _full_columns():
    kept = "list_filter(string_split({0}.text, ' '), lambda t: t <> '' AND NOT list_contains(s.words, lower(t)))"
    return ", ".join(f"array_to_string({kept.format(c[0])}, ' ') AS {c}_tok, CAST(len({kept.format(c[0])}) AS BIGINT) AS {c}_token_len" for c in COLUMNS)


@query("preprocess_full", texts_sql(["cleaned", "lexicon"], f"""
SELECT c.id, {_full_columns()} FROM full_context c JOIN full_prompt p ON p.id = c.id JOIN full_response r ON r.id = c.id, (SELECT list(word) AS words FROM stop) s""",
    [x for c in COLUMNS for x in segment_ctes(f"full_{c}", "cleaned", f"lower({c}_clean)")] + [STOP_SQL], recursive=True))
def preprocess_full(spark, sf):
    """All steps at once: clean, lower, join the compounds of a lexicon, drop the words of a stop list."""
    df = pp.preprocess(fx.texts(spark, sf), "baseline", fx.lexicon(spark, sf), fx.stopwords(spark, sf))
    return df.select("id", *[x for c in COLUMNS for x in (f"{c}_tok", big(f"{c}_token_len"))])


@query("resolve_text_mode", sql(["models"], """
SELECT model_name, CASE WHEN contains(lower(model_name), 'phobert') THEN 'word_segmented' ELSE 'raw' END AS text_mode FROM models"""))
def resolve_text_mode(spark, sf):
    return fx.models(spark, sf).select("model_name", tx.resolve_text_mode(F.col("model_name")).alias("text_mode"))


@query("remove_stopwords", f"""
WITH w AS (SELECT doc_id, {o.ws_tokens('text')} AS t FROM documents),
{STOP_SQL}
SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY i) FILTER (lower(token) NOT IN (SELECT word FROM stop)), '') AS text
FROM (SELECT doc_id, unnest(range(0, len(t))) AS i, unnest(t) AS token FROM w) GROUP BY doc_id""")
def remove_stopwords(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return pp.drop_stopwords(docs, {"text": "text"}, fx.stopwords(spark, sf))


@query("char_len", f"SELECT page_id, CAST(length({o.clean('html')}) AS BIGINT) AS n FROM pages")
def char_len(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", big(F.length(tx.clean_text(F.col("html"))), "n"))


@query("token_len", f"SELECT doc_id, CAST(len({o.ws_tokens('text')}) AS BIGINT) AS n FROM documents")
def token_len(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", big(F.size(tx.ws_tokenize(F.col("text"))), "n"))


def _length_columns():
    out = []
    for c in ("context", "prompt", "response"):
        out.append(f"{c}_clean, lower({c}_clean) AS {c}_tok, CAST(length({c}_clean) AS BIGINT) AS {c}_char_len")
        out.append(f"CAST(len({o.ws_tokens(c + '_clean')}) AS BIGINT) AS {c}_token_len")
    return ", ".join(out)


@query("preprocess", texts_sql(["cleaned"], f"SELECT id, {_length_columns()} FROM cleaned"))
def preprocess(spark, sf):
    df = pp.preprocess(fx.texts(spark, sf), "baseline")
    columns = []
    for c in ("context", "prompt", "response"):
        columns += [f"{c}_clean", f"{c}_tok", big(f"{c}_char_len"), big(f"{c}_token_len")]
    return df.select("id", *columns)


@query("judge_prompt", texts_sql(["cleaned"], """
SELECT id, 'Context: ' || context_clean || chr(10) || 'Question: ' || prompt_clean || chr(10) || 'Model Answer: ' || response_clean || chr(10)
  || 'Is the model answer hallucinated based on the context? (Yes/No):' AS llm_prompt FROM cleaned"""))
def judge_prompt(spark, sf):
    return pp.preprocess(fx.texts(spark, sf), "llm").select("id", "llm_prompt")


@query("answer_prompt", sql(["dialogues"], """
SELECT id, 'Context: ' || context || chr(10) || 'Question: ' || prompt || chr(10)
  || 'Answer the question based on the context. Keep your answer brief.' || chr(10) || 'Answer:' AS input_text FROM dialogues"""))
def answer_prompt(spark, sf):
    return fx.dialogue_triplets(spark, sf).select("id", tx.answer_prompt(F.col("context"), F.col("prompt")).alias("input_text"))


@query("combine_texts", texts_sql(["cleaned"], """
SELECT id, context_clean || ' ' || prompt_clean || ' ' || response_clean AS text_all, prompt_clean || ' ' || response_clean AS text_pr,
  context_clean || ' ' || response_clean AS text_cr, response_clean AS text_response FROM cleaned"""))
def combine_texts(spark, sf):
    df = pp.combine_texts(pp.preprocess(fx.texts(spark, sf), "llm"))
    return df.select("id", "text_all", "text_pr", "text_cr", "text_response")


@query("run_name", sql(["grid"], "SELECT model_name, CAST(max_length AS BIGINT) AS max_length, run_name FROM grid"))
def run_name(spark, sf):
    models = fx.models(spark, sf).withColumn("max_length", F.explode(F.array(F.lit(256), F.lit(512))))
    return models.select("model_name", big("max_length"), tx.run_name(F.col("model_name"), F.col("max_length")).alias("run_name"))


@query("token_jaccard", texts_sql(["triplets"], f"SELECT id, round({o.jaccard('c', 'r')}, 6) AS overlap FROM w", [
    f"w AS (SELECT id, {o.tokens('context')} AS c, {o.tokens('response')} AS r FROM triplets)"]))
def token_jaccard(spark, sf):
    t = fx.texts(spark, sf).select("id", tx.simple_tokenize(F.col("context")).alias("c"), tx.simple_tokenize(F.col("response")).alias("r"))
    return t.select("id", r6(ov.jaccard(F.col("c"), F.col("r")), "overlap"))


@query("ws_jaccard", sql(["dialogues"], f"SELECT id, round({o.jaccard('c', 'r')}, 6) AS overlap FROM w", [
    f"w AS (SELECT id, {o.ws_tokens('lower(prompt)')} AS c, {o.ws_tokens('lower(response)')} AS r FROM dialogues)"]))
def ws_jaccard(spark, sf):
    t = fx.dialogue_triplets(spark, sf).select(
        "id", tx.ws_tokenize(F.lower("prompt")).alias("c"), tx.ws_tokenize(F.lower("response")).alias("r")
    )
    return t.select("id", r6(ov.jaccard(F.col("c"), F.col("r")), "overlap"))


NGRAM_SQL_WORDS = f"w AS (SELECT id, label, {o.ws_tokens('context')} AS c, {o.ws_tokens('response')} AS r FROM triplets)"


@query("ngram_containment", texts_sql(["triplets"], f"""
SELECT id, round({o.containment('c', 'r', 1)}, 6) AS overlap_1gram, round({o.containment('c', 'r', 2)}, 6) AS overlap_2gram,
  round({o.containment('c', 'r', 3)}, 6) AS overlap_3gram FROM w""", [NGRAM_SQL_WORDS]))
def ngram_containment(spark, sf):
    t = fx.texts(spark, sf).select("id", tx.ws_tokenize(F.col("context")).alias("c"), tx.ws_tokenize(F.col("response")).alias("r"))
    return t.select("id", *[r6(ov.containment(F.col("c"), F.col("r"), n), f"overlap_{n}gram") for n in (1, 2, 3)])


@query("contains_any", f"SELECT doc_id, CAST({o.any_cue('text', fx.CUES)} AS BIGINT) AS found FROM documents")
def contains_any(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", big(tx.contains_any(F.col("text"), fx.CUES), "found"))


@query("negation_mismatch", texts_sql(["rules"], "SELECT id, CAST(neg_mismatch AS BIGINT) AS neg_mismatch FROM rules"))
def negation_mismatch(spark, sf):
    return ft.rule_features(fx.texts(spark, sf), fx.CUES, fx.HINTS).select("id", big("neg_mismatch"))


@query("extrinsic_hint", texts_sql(["rules"], "SELECT id, CAST(extrinsic_hint AS BIGINT) AS extrinsic_hint FROM rules"))
def extrinsic_hint(spark, sf):
    return ft.rule_features(fx.texts(spark, sf), fx.CUES, fx.HINTS).select("id", big("extrinsic_hint"))


@query("length_ratio", texts_sql(["rules"], "SELECT id, round(response_length_ratio, 6) AS ratio FROM rules"))
def length_ratio(spark, sf):
    return ft.rule_features(fx.texts(spark, sf), fx.CUES, fx.HINTS).select("id", r6("response_length_ratio", "ratio"))


@query("rule_features", texts_sql(["rules"], "SELECT id, " + ", ".join(f"round({c}, 6) AS {c}" for c in RULE_FEATURES) + " FROM rules"))
def rule_features(spark, sf):
    return ft.rule_features(fx.texts(spark, sf), fx.CUES, fx.HINTS).select("id", *[r6(c) for c in RULE_FEATURES])


WORD_COUNTS = ", ".join(f"CAST(len({o.ws_tokens(c + '_clean')}) AS BIGINT) AS {c}_word_count" for c in ("context", "prompt", "response"))
HAND_EXTRA = [
    f"hand_words AS (SELECT *, {WORD_COUNTS}, "
    + ", ".join(f"{o.ws_tokens('lower(' + c + '_clean)')} AS {c[0]}" for c in ("context", "prompt", "response"))
    + " FROM cleaned)",
    f"""hand AS (SELECT id, context_word_count, prompt_word_count, response_word_count,
  round(response_word_count / (context_word_count + 1), 6) AS resp_ctx_ratio,
  round(response_word_count / (prompt_word_count + 1), 6) AS resp_prompt_ratio,
  round({o.jaccard('r', 'c')}, 6) AS resp_ctx_overlap, round({o.jaccard('r', 'p')}, 6) AS resp_prompt_overlap,
  CAST(contains(prompt, '?') AS BIGINT) AS has_question,
  CAST(list_has_any(p, [{', '.join(o.quoted(w) for w in fx.WORDS)}]) AS BIGINT) AS has_neg_prompt
FROM hand_words)""",
]


def handcrafted(spark, sf):
    df = ft.handcrafted_features(pp.preprocess(fx.texts(spark, sf)), fx.WORDS)
    counts = [c for c in HANDCRAFTED_FEATURES if c.endswith("_count") or c.startswith("has_")]
    return df.select("id", *[big(c) if c in counts else r6(c) for c in HANDCRAFTED_FEATURES])


def _hand(name, columns):
    @query(name, texts_sql(["cleaned"], f"SELECT id, {', '.join(columns)} FROM hand", HAND_EXTRA))
    def run(spark, sf):
        return handcrafted(spark, sf).select("id", *columns)


_hand("word_counts", ["context_word_count", "prompt_word_count", "response_word_count"])
_hand("notebook_ratios", ["resp_ctx_ratio", "resp_prompt_ratio"])
_hand("has_question", ["has_question"])
_hand("has_neg_prompt", ["has_neg_prompt"])
_hand("handcrafted_features", HANDCRAFTED_FEATURES)


@query("rule_proba", texts_sql(["rule_scores"], "SELECT id, round(r0, 6) AS p_no, round(r1, 6) AS p_intrinsic, round(r2, 6) AS p_extrinsic FROM rule_scores"))
def rule_proba(spark, sf):
    p = ft.rule_proba(ft.rule_features(fx.texts(spark, sf), fx.CUES, fx.HINTS))
    return p.select("id", *[r6(F.col("proba")[i], f"p_{n}") for i, n in enumerate(("no", "intrinsic", "extrinsic"))])


@query("softmax", sql(["classical_scores"], "SELECT id, round(c0, 6) AS p0, round(c1, 6) AS p1, round(c2, 6) AS p2 FROM classical_scores"))
def softmax(spark, sf):
    z = fx.classical_logits(spark, sf).select("id", pr.softmax(F.col("logits")).alias("p"))
    return z.select("id", *[r6(F.col("p")[i], f"p{i}") for i in range(3)])


@query("argmax_label", sql(["classical_scores"], f"SELECT id, {o.label_name(o.first_max(['z0', 'z1', 'z2']))} AS predict_label FROM classical_z"))
def argmax_label(spark, sf):
    return fx.classical_logits(spark, sf).select("id", pr.argmax_label(F.col("logits")).alias("predict_label"))


@query("is_hallucinated", sql(["triplets"], "SELECT id, CAST(CASE WHEN label = 'no' THEN 0 ELSE 1 END AS BIGINT) AS hallucinated FROM triplets"))
def is_hallucinated(spark, sf):
    return fx.triplets(spark, sf).select("id", big(pr.is_hallucinated(F.col("label")), "hallucinated"))


@query("label_encode", sql(["triplets"], f"""
SELECT id, label, CAST({o.label_id('label')} AS BIGINT) AS label_id, dense_rank() OVER (ORDER BY label) - 1 AS label_rank,
  {o.label_name(o.label_id('label'))} AS label_decoded FROM triplets"""))
def label_encode(spark, sf):
    return contracts.label_encode(fx.triplets(spark, sf)).select("id", "label", big("label_id"), big("label_rank"), "label_decoded")
