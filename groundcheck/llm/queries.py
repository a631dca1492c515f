"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    exact_dedup, lexical_search, license_scan, line_dedup, ngram_join, packing, piece_codec, pivot_index, quality_pu, quality_rules,
    token_counts, toxicity, whitening,
)
from .labelled import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op3_quality_pu")
def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = quality_pu.score(docs, quality_pu.train(docs, labels(spark, sf_dir)))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query("op5_piece_codec")
def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids, comma-joined), round_trip (decoding gives the text back)."""
    path = tokenizer_path("piece_bpe_32k.model")
    rows = piece_codec.decode(piece_codec.encode(documents(spark, sf_dir).select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), digest_all=True)


def license_sql() -> str:
    anchors = ", ".join(
        f"('{a}', '{b}', {tid}, {i}, {len(t.grams())}, {t.phrase}, '{t.label}')"
        for tid, t in enumerate(license_scan.TEMPLATES) for i, a, b in t.grams()
    )
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT r, unnest(range(len(w) - 1)) AS pos, w FROM texts),
anchors(w1, w2, tid, tpos, votes, phrase, label) AS (VALUES {anchors}),
hits AS (
  SELECT r, tid, votes, phrase, label, pos, tpos, pos - tpos AS diag
  FROM (SELECT r, pos, w[pos + 1] AS w1, w[pos + 2] AS w2 FROM grams) JOIN anchors USING (w1, w2)),
parts AS (
  SELECT *, sum(new) OVER (PARTITION BY r, tid ORDER BY diag RANGE UNBOUNDED PRECEDING) AS part FROM (
    SELECT *, CASE WHEN step = 0 THEN 0 WHEN phrase OR coalesce(step, 99) > 3 THEN 1 ELSE 0 END AS new
    FROM (SELECT *, diag - lag(diag) OVER (PARTITION BY r, tid ORDER BY diag) AS step FROM hits))),
spans AS (
  SELECT r, label, phrase, count(DISTINCT tpos) / any_value(votes) AS share, min(pos) AS f, max(pos) + 1 AS l, any_value(votes) AS v
  FROM parts GROUP BY r, tid, label, phrase, part),
found AS (SELECT * FROM spans WHERE CASE WHEN phrase THEN share = 1 ELSE share >= 0.75 AND l - f <= 1.5 * v + 12 END)
SELECT doc_id, any_value(len(w)) AS n_words, count(*) FILTER (phrase) AS n_base,
       min(f) FILTER (phrase) AS first_word, max(f) FILTER (phrase) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0) AS score
FROM texts LEFT JOIN found USING (r) GROUP BY r, doc_id
"""


@query("op4_license_scan", license_sql())
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarize(license_scan.scan(documents(spark, sf_dir)))


@query("op6_ngram_join")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(documents(spark, sf_dir))


@query("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (left), n_exact, n_near (dropped), text_sha256 of the text that is left."""
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit("[^ \\t-\\r]")))
    return out.select(
        "doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.col("_exact").alias("n_exact"), F.col("_near").alias("n_near"), F.sha2("text", 256).alias("text_sha256")
    )


def rules_sql() -> str:
    def passed(r: quality_rules.Rule) -> str:
        value = r.top if r.bottom is None else f"coalesce({r.top} / nullif({r.bottom}, 0), 0)"
        return f"{value} >= {r.low}" + (f" AND {value} <= {r.high}" if r.high < float("inf") else "")

    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    ok = " AND ".join(f"({passed(r)})" for r in quality_rules.RULES)
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
windows AS (
  SELECT r, pos, count(*) OVER (PARTITION BY r, w1, w2, w3) AS n FROM (
    SELECT r, pos, w[pos + 1] AS w1, w[pos + 2] AS w2, w[pos + 3] AS w3 FROM (SELECT r, w, unnest(range(len(w) - 2)) AS pos FROM texts))),
repeats AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest([pos, pos + 1, pos + 2]) AS spot FROM windows WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '[!?]')) AS n_marks,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
         n_lines - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {ok} AS kept
FROM m
"""


@query("op8_quality_rules", rules_sql())
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(
        documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return packing.with_crc(pieces)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), 32)


SEARCH_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lexical_search.UPPER}', '{lexical_search.LOWER}'),
         '{lexical_search.TERM}') AS w FROM documents),
items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), '{lexical_search.UPPER}', '{lexical_search.LOWER}'),
         '{lexical_search.TERM}') AS w FROM benchmark),
wanted AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM items) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
totals AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs WHERE len(w) > 0),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n),
scored AS (
  SELECT i, r, sum(times * weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(docs.w) * n) // l)))) AS score
  FROM tf JOIN weight USING (term) JOIN wanted USING (term) JOIN docs USING (r), totals GROUP BY i, r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored JOIN docs USING (r) JOIN items USING (i) WHERE score > 0)
WHERE rank <= 10
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


EMBEDDINGS_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON a = vec_id
"""


@query("op12_pivot_index", EMBEDDINGS_SQL)
def op12_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(embeddings(spark, sf_dir))
