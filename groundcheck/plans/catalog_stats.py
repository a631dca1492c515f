"""Sampling, EDA, evaluation, blending, run tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import proba as pr, text as tx
from ..operators import blend as bl, eda, evaluate as ev, features as ft, models as md, preprocess as pp, runs, sampling, vocab
from ..session import materialize
from ..sources import fixtures as fx
from . import oracle as o
from .catalog_tables import KNOWN, RULE_REPORT, REPORT_SQL, rule_votes
from .oracle import sql, texts_sql
from .registry import big, query, r6


@query("random_sample", "SELECT doc_id, n_chars FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def random_sample(spark, sf):
    return sampling.random_sample(fx.table(spark, sf, "documents"), 100, seed=7, row_id="doc_id").select("doc_id", "n_chars")


@query("stratified_sample", sql(["triplets"], """
SELECT s.id, s.label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id), id) AS rn FROM triplets) s
JOIN quota q ON s.label = q.label WHERE s.rn <= q.quota""", ["""counts AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM triplets GROUP BY label)""",
    """base AS (SELECT label, (n * 50) // total AS base, (n * 50) % total AS rest FROM counts)""",
    """quota AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= 50 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM base)"""]))
def stratified_sample(spark, sf):
    return sampling.stratified_sample(fx.triplets(spark, sf), 50).select("id", "label")


@query("stratified_split", sql(["split15"], "SELECT id, label, split FROM split15"))
def stratified_split(spark, sf):
    return sampling.stratified_split(fx.triplets(spark, sf)).select("id", "label", "split")


@query("label_distribution", sql(["triplets"], """
SELECT CAST(i AS BIGINT) AS position, d.label, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM triplets), 6) AS share
FROM (VALUES (0, 'no'), (1, 'extrinsic'), (2, 'intrinsic')) d(i, label)
LEFT JOIN (SELECT label, count(*) AS n FROM triplets GROUP BY label) c ON c.label = d.label"""))
def label_distribution(spark, sf):
    return eda.label_distribution(fx.triplets(spark, sf)).select(big("position"), "label", "n", r6("share"))


def lengths(spark, sf):
    return fx.triplets(spark, sf).select(
        "id", "label", *[F.size(tx.ws_tokenize(F.col(c))).alias(f"{c}_token_len") for c in ("context", "prompt", "response")]
    )


LENGTHS = "lengths AS (SELECT id, label, " + ", ".join(
    f"CAST(len({o.ws_tokens(c)}) AS BIGINT) AS {c}_token_len" for c in ("context", "prompt", "response")) + " FROM triplets)"
OVERLAPS = [
    f"w AS (SELECT id, label, {o.ws_tokens('context')} AS c, {o.ws_tokens('response')} AS r FROM triplets)",
    f"overlap_rows AS (SELECT id, label, {o.containment('c', 'r', 1)} AS overlap_1gram, {o.containment('c', 'r', 2)} AS overlap_2gram FROM w)",
]


def _described(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
  round(CAST(min({column}) AS DOUBLE), 6) AS min, round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS q50,
  round(quantile_cont({column}, 0.75), 6) AS q75, round(CAST(max({column}) AS DOUBLE), 6) AS max FROM {source}"""


@query("describe", texts_sql(["triplets"], " UNION ALL ".join(
    [_described(f"{c}_token_len", "lengths") for c in ("context", "prompt", "response")]
    + [_described(f"overlap_{n}gram", "overlap_rows") for n in (1, 2)]), [LENGTHS, *OVERLAPS]))
def describe(spark, sf):
    t = ft.ngram_overlap(fx.texts(spark, sf)).withColumns(
        {f"{c}_token_len": F.size(tx.ws_tokenize(F.col(c))) for c in ("context", "prompt", "response")}
    )
    d = eda.describe(t, ["context_token_len", "prompt_token_len", "response_token_len", "overlap_1gram", "overlap_2gram"])
    return d.select("column", "count", *[r6(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("length_histogram", sql(["triplets"], """
SELECT label, CAST(CASE WHEN hi = lo THEN 15 ELSE least(((x - lo) * 30) // greatest(hi - lo, 1), 29) END AS BIGINT) AS bin, count(*) AS n
FROM (SELECT label, context_token_len AS x, min(context_token_len) OVER (PARTITION BY label) AS lo, max(context_token_len) OVER (PARTITION BY label) AS hi FROM lengths)
GROUP BY ALL""", [LENGTHS]))
def length_histogram(spark, sf):
    return eda.length_histogram(lengths(spark, sf), "context_token_len")


@query("overlap_box_stats", sql(["triplets"], """
SELECT label, round(min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low, round(max(q1), 6) AS q1,
  round(max(q2), 6) AS median, round(max(q3), 6) AS q3,
  round(max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT label, overlap_1gram AS x, quantile_cont(overlap_1gram, 0.25) OVER w AS q1, quantile_cont(overlap_1gram, 0.5) OVER w AS q2,
  quantile_cont(overlap_1gram, 0.75) OVER w AS q3 FROM overlap_rows WINDOW w AS (PARTITION BY label)) GROUP BY label""", OVERLAPS))
def overlap_box_stats(spark, sf):
    b = eda.box_stats(ft.ngram_overlap(fx.triplets(spark, sf)), "overlap_1gram")
    return b.select("label", *[r6(c) for c in ("whisker_low", "q1", "median", "q3", "whisker_high")], "outliers")


@query("negation_rate", sql(["triplets"], "SELECT label, " + ", ".join(
    f"round(avg({o.any_cue(c, fx.CUES)}), 6) AS {c}_rate" for c in ("context", "prompt", "response")) + " FROM triplets GROUP BY label"))
def negation_rate(spark, sf):
    n = eda.negation_rate(fx.triplets(spark, sf), fx.CUES)
    return n.select("label", *[r6(f"{c}_rate") for c in ("context", "prompt", "response")])


@query("prediction_distribution", sql(["rule_votes"], "SELECT predict_label AS label, count(*) AS n FROM rule_votes GROUP BY 1"))
def prediction_distribution(spark, sf):
    return eda.prediction_distribution(rule_votes(spark, sf))


# --- vocabulary -------------------------------------------------------------

ALL_TEXT = "context_clean || ' ' || prompt_clean || ' ' || response_clean"
VOCAB = f"""vocab_counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({o.ws_tokens(ALL_TEXT)}) AS token FROM cleaned) GROUP BY token),
vocab_top AS (SELECT token, n FROM vocab_counts WHERE n >= 2 ORDER BY n DESC, token LIMIT 19998),
vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM vocab_top UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1)"""


def _all_text(spark, sf):
    return pp.combine_texts(pp.preprocess(fx.texts(spark, sf), "llm")).select("id", "text_all")


@query("build_vocab", texts_sql(["cleaned"], "SELECT token, CAST(token_id AS BIGINT) AS token_id FROM vocab", [VOCAB]))
def build_vocab(spark, sf):
    return vocab.build_vocab(_all_text(spark, sf), "text_all").select("token", big("token_id"))


@query("encode_sequence", texts_sql(["cleaned"], """
SELECT c.id, array_to_string(list_concat(coalesce(l.ids, []), list_transform(range(0, 256 - coalesce(len(l.ids), 0)), lambda x: 0)), ' ') AS token_ids
FROM cleaned c LEFT JOIN (
  SELECT s.id, list(coalesce(v.token_id, 1) ORDER BY s.pos) AS ids FROM seq s LEFT JOIN vocab v ON v.token = s.token AND v.token_id > 1 GROUP BY s.id) l ON l.id = c.id""",
    [VOCAB, f"seq_words AS (SELECT id, ({o.ws_tokens(ALL_TEXT)})[1:256] AS t FROM cleaned)",
     "seq AS (SELECT id, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM seq_words)"]))
def encode_sequence(spark, sf):
    text = _all_text(spark, sf)
    ids = vocab.encode_sequence(text, "text_all", vocab.build_vocab(text, "text_all"))
    return ids.select("id", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), " ").alias("token_ids"))


# --- evaluation -------------------------------------------------------------

@query("class_weights", sql(["triplets"], """
SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM triplets GROUP BY label"""))
def class_weights(spark, sf):
    return md.class_weights(fx.triplets(spark, sf)).select("label", "n", r6("weight"))


@query("confusion_matrix", sql(["rule_votes"], "SELECT d.label, " + ", ".join(
    f"coalesce(count(*) FILTER (predict_label = '{p}'), 0) AS pred_{p}" for p in ("no", "intrinsic", "extrinsic"))
    + " FROM (SELECT unnest(['no', 'intrinsic', 'extrinsic']) AS label) d LEFT JOIN rule_votes v ON v.label = d.label GROUP BY d.label"))
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(rule_votes(spark, sf))


@query("accuracy", sql(["rule_votes"], "SELECT round(avg(CASE WHEN label = predict_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM rule_votes"))
def accuracy(spark, sf):
    return ev.scores(rule_votes(spark, sf)).select(r6("accuracy"), "n")


SCORE_COLUMNS = "round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(sum(tp) / sum(support), 6) AS accuracy"
SCORES = f"SELECT {SCORE_COLUMNS} FROM per_label"


@query("macro_f1", sql(["rule_votes"], SCORES, [o.scores_cte("per_label", "rule_votes")]))
def macro_f1(spark, sf):
    return ev.scores(rule_votes(spark, sf)).select(r6("macro_f1"), r6("weighted_f1"), r6("accuracy"))


@query("classification_report", RULE_REPORT)
def classification_report(spark, sf):
    return ev.classification_report(rule_votes(spark, sf)).select("row", r6("precision"), r6("recall"), r6("f1"), "support")


@query("auc_roc", sql(["rule_scores"], """
SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk
  FROM (SELECT CASE WHEN label = 'no' THEN 0 ELSE 1 END AS y, round(1 - r0, 9) AS s FROM rule_scores))"""))
def auc_roc(spark, sf):
    scored = rule_votes(spark, sf).select(F.round(1 - F.col("proba")[0], 9).alias("s"), pr.is_hallucinated(F.col("label")).alias("y"))
    return ev.auc_roc(scored, "s", "y").select(r6("auc"), "n_pos", "n_neg")


TRANSFORMER_VOTES = f"votes AS (SELECT id, label, {o.label_name(o.first_max(['t0', 't1', 't2']))} AS predict_label FROM transformer_scores)"


@query("evaluate_logits", sql(["transformer_scores", "split15"], f"""
SELECT {SCORE_COLUMNS}, (SELECT count(*) FROM split15 WHERE split = 'train') AS train_rows,
  (SELECT count(*) FROM split15 WHERE split = 'valid') AS valid_rows, 0.15::DOUBLE AS valid_size FROM per_label""", [
    TRANSFORMER_VOTES,
    "valid_votes AS (SELECT v.* FROM votes v JOIN split15 s ON s.id = v.id WHERE s.split = 'valid')",
    o.scores_cte("per_label", "valid_votes"),
]))
def evaluate_logits(spark, sf):
    split = sampling.stratified_split(fx.triplets(spark, sf))
    voted = ev.evaluate_logits(fx.transformer_logits(spark, sf), split.filter("split = 'valid'"))
    meta = ev.run_metadata(split, {"model_name": "transformer"}, 0.15).select(F.struct("train_rows", "valid_rows", "valid_size").alias("m")).scalar()
    return ev.scores(voted).select(
        r6("macro_f1"), r6("weighted_f1"), r6("accuracy"), meta["train_rows"].alias("train_rows"),
        meta["valid_rows"].alias("valid_rows"), meta["valid_size"].alias("valid_size"),
    )


# --- blending ---------------------------------------------------------------

def sources(spark, sf):
    proba = lambda logits: logits.select("id", pr.softmax(F.col("logits")).alias("proba"))
    return {
        "classical": proba(fx.classical_logits(spark, sf)), "transformer": proba(fx.transformer_logits(spark, sf)),
        "rule": rule_votes(spark, sf).select("id", "proba"),
    }


def labelled_sources(spark, sf):
    return bl.join_sources(sources(spark, sf)).join(fx.triplets(spark, sf).select("id", "label"), "id")


def _mix(w, j):
    return f"({w[0]} * c{j} + {w[1]} * t{j} + {w[2]} * r{j})"


W0 = ["0.4::DOUBLE", "0.5::DOUBLE", "0.1::DOUBLE"]


@query("blend", sql(["sources"], f"SELECT id, {', '.join(f'round({_mix(W0, j)}, 6) AS p{j}' for j in range(3))} FROM sources"))
def blend(spark, sf):
    b = bl.blend(bl.join_sources(sources(spark, sf)))
    return b.select("id", *[r6(F.col("proba")[j], f"p{j}") for j in range(3)])


@query("blend_predict", sql(["sources"], f"SELECT id, {o.label_name(o.first_max([_mix(W0, j) for j in range(3)]))} AS predict_label FROM sources"))
def blend_predict(spark, sf):
    return bl.blend_predict(bl.join_sources(sources(spark, sf))).select("id", "predict_label")


@query("blend_unmatched", sql(["triplets"], """
SELECT CAST(doc_id % 5 <> 0 AS BIGINT) AS has_classical, CAST(doc_id % 7 <> 0 AS BIGINT) AS has_transformer, CAST(1 AS BIGINT) AS has_rule, count(*) AS n
FROM triplets WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 GROUP BY ALL"""))
def blend_unmatched(spark, sf):
    s = sources(spark, sf)
    s["classical"] = s["classical"].filter(F.col("id").cast("long") % 5 != 0)
    s["transformer"] = s["transformer"].filter(F.col("id").cast("long") % 7 != 0)
    u = bl.unmatched(s)
    return u.select(big("has_classical"), big("has_transformer"), big("has_rule"), "n")


GW = ["wc", "wt", "wr"]
GRID = f"""points AS (
  SELECT 0 AS ord, 0.4::DOUBLE AS wc, 0.5::DOUBLE AS wt, 0.1::DOUBLE AS wr
  UNION ALL SELECT 1, i / 20, j / 20, (20 - i - j) / 20 FROM range(0, 21) a(i), range(0, 21) b(j) WHERE i + j <= 20),
votes AS (SELECT ord, wc, wt, wr, label AS y, {o.label_name(o.first_max([_mix(GW, j) for j in range(3)]))} AS p FROM sources, points),
cells AS (SELECT ord, wc, wt, wr, y, p, count(*) AS n FROM votes GROUP BY ALL),
sides AS (
  SELECT ord, wc, wt, wr, y AS l, n AS s, 0 AS q, CASE WHEN y = p THEN n ELSE 0 END AS t FROM cells
  UNION ALL SELECT ord, wc, wt, wr, p, 0, n, 0 FROM cells),
classes AS (SELECT ord, wc, wt, wr, l, sum(s) AS s, sum(t) AS t, 2 * sum(t) / (sum(s) + sum(q)) AS f1 FROM sides GROUP BY ALL),
fits AS (SELECT ord, wc, wt, wr, avg(f1) AS macro_f1, sum(t) / sum(s) AS accuracy FROM classes GROUP BY ALL)"""


@query("blend_scores", sql(["sources"], "SELECT round(wc, 6) AS w_classical, round(wt, 6) AS w_transformer, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM fits", [GRID]))
def blend_scores(spark, sf):
    b = bl.blend_scores(labelled_sources(spark, sf))
    return b.select(r6("w_classical"), r6("w_transformer"), r6("macro_f1"), r6("accuracy"))


BEST = "best AS (SELECT * FROM fits ORDER BY round(macro_f1, 12) DESC, ord, wc, wt, wr LIMIT 1)"


@query("fit_blend_weights", sql(["sources"], "SELECT round(wc, 6) AS classical, round(wt, 6) AS transformer, round(wr, 6) AS rule, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy FROM best", [GRID, BEST]))
def fit_blend_weights(spark, sf):
    w = bl.fit_blend_weights(labelled_sources(spark, sf))
    return w.select(*[r6(c) for c in ("classical", "transformer", "rule", "macro_f1", "accuracy")])


VALID_SOURCES = "valid_sources AS (SELECT s.* FROM sources s JOIN split15 v ON v.id = s.id WHERE v.split = 'valid')"


@query("hybrid_train", sql(["sources", "split15"], REPORT_SQL, [
    VALID_SOURCES, GRID.replace("FROM sources, points", "FROM valid_sources, points"), BEST,
    f"hybrid_votes AS (SELECT s.id, s.label, {o.label_name(o.first_max([_mix(['b.wc', 'b.wt', 'b.wr'], j) for j in range(3)]))} AS predict_label FROM valid_sources s, best b)",
    o.scores_cte("per_label", "hybrid_votes"), KNOWN]))
def hybrid_train(spark, sf):
    """Fit the weights on the validation rows, report the blend on the same rows."""
    valid = sampling.stratified_split(fx.triplets(spark, sf)).filter("split = 'valid'").select("id", "label")
    # the fit and the report both read these narrow rows: store them once
    rows = materialize(bl.join_sources(sources(spark, sf)).join(valid, "id"))
    voted = bl.blend_predict(rows, bl.fit_blend_weights(rows))
    return ev.classification_report(voted).select("row", r6("precision"), r6("recall"), r6("f1"), "support")


# --- runs -------------------------------------------------------------------

@query("run_grid", sql(["grid"], "SELECT run_name, text_mode, status, error, elapsed_minutes::DOUBLE AS elapsed_minutes FROM grid"))
def run_grid(spark, sf):
    return runs.run_grid(fx.models(spark, sf), [256, 512]).select("run_name", "text_mode", "status", "error", "elapsed_minutes")


@query("skip_done", sql(["run_rows"], "SELECT run_name, status, round(macro_f1, 6) AS macro_f1, round(elapsed_minutes::DOUBLE, 6) AS elapsed_minutes FROM run_rows"))
def skip_done(spark, sf):
    rows = runs.skip_done(runs.run_grid(fx.models(spark, sf), [256, 512]), fx.run_scores(spark, sf))
    return rows.select("run_name", "status", r6("macro_f1"), r6("elapsed_minutes"))


@query("runs_to_do", sql(["run_rows"], "SELECT run_name FROM run_rows WHERE status = 'running'"))
def runs_to_do(spark, sf):
    return runs.runs_to_do(runs.run_grid(fx.models(spark, sf), [256, 512]), fx.run_scores(spark, sf)).select("run_name")


FINISHED_SQL = "SELECT run_name, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, round(elapsed_minutes::DOUBLE, 6) AS elapsed_minutes FROM run_rows WHERE status IN ('done', 'skipped')"


def _board(spark, sf, fn):
    rows = runs.skip_done(runs.run_grid(fx.models(spark, sf), [256, 512]), fx.run_scores(spark, sf))
    return fn(rows).select("run_name", r6("macro_f1"), r6("accuracy"), r6("elapsed_minutes"))


@query("leaderboard", sql(["run_rows"], FINISHED_SQL))
def leaderboard(spark, sf):
    return _board(spark, sf, runs.leaderboard)


@query("best_run", sql(["run_rows"], FINISHED_SQL + " ORDER BY macro_f1 DESC, run_name LIMIT 1"))
def best_run(spark, sf):
    return _board(spark, sf, runs.best_run)


@query("best_checkpoint", """
SELECT run_name, epoch, val_f1_macro, val_acc FROM (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY val_f1_macro DESC, epoch) AS rn FROM (
    SELECT source AS run_name, doc_id % 5 AS epoch, round(avg(n_chars % 10) / 10, 1) AS val_f1_macro, round(avg(n_chars % 7) / 7, 6) AS val_acc
    FROM documents GROUP BY 1, 2)) WHERE rn = 1""")
def best_checkpoint(spark, sf):
    return runs.best_checkpoint(fx.history(spark, sf)).select("run_name", big("epoch"), "val_f1_macro", "val_acc")
