"""Sources, sinks and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import proba as pr
from ..operators import contracts, entropy as en, evaluate as ev, features as ft, models as md, preprocess as pp, runs, sampling
from ..schema import label_to_id
from ..session import scratch_path
from ..sources import fixtures as fx, sinks, tables
from .oracle import first_max, label_id, norm, scores_cte, sql, texts_sql
from .registry import big, query, r6


def rule_votes(spark, sf):
    """The flagship result: every labelled triplet with its rule prediction."""
    scored = ft.rule_proba(ft.rule_features(fx.triplets(spark, sf), fx.CUES, fx.HINTS))
    return scored.select("id", "label", "proba", pr.argmax_label(F.col("proba")).alias("predict_label"))


@query("read_train", sql(["serialized"], f"""
SELECT id, label, CAST({label_id('label')} AS BIGINT) AS label_id, serialized_text FROM serialized"""))
def read_train(spark, sf):
    path = scratch_path(spark, "train_csv")
    sinks.write_csv(fx.triplets(spark, sf), path)
    return tables.read_train(spark, path).select("id", "label", big("label_id"), "serialized_text")


@query("read_test", sql(["dialogues"], f"""
SELECT id, '' AS predict_label, '[CLS] ' || {norm('context')} || ' [SEP] ' || {norm('prompt')} || ' [SEP] ' || {norm('response')} || ' [SEP]' AS serialized_text
FROM dialogues"""))
def read_test(spark, sf):
    path = scratch_path(spark, "test_csv")
    sinks.write_csv(fx.dialogue_triplets(spark, sf), path)
    return tables.read_test(spark, path).select("id", "predict_label", "serialized_text")


@query("read_any_csv", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages")
def read_any_csv(spark, sf):
    path = scratch_path(spark, "pages_csv")
    sinks.write_csv(fx.table(spark, sf, "pages"), path)
    return tables.read_any_csv(spark, path).select("page_id", "url", "html")


@query("require_columns", sql(["triplets"], "SELECT id, label FROM triplets"))
def require_columns(spark, sf):
    df = contracts.require_columns(fx.triplets(spark, sf), ["id", "context", "prompt", "response", "label"])
    return df.select("id", "label")


@query("check_label_domain", sql(["triplets"], """
SELECT l AS label, count(*) AS n FROM (
  SELECT CASE WHEN doc_id % 11 = 0 THEN 'maybe' WHEN doc_id % 13 = 0 THEN 'nan' ELSE label END AS l FROM triplets)
WHERE l NOT IN ('no', 'intrinsic', 'extrinsic') GROUP BY l"""))
def check_label_domain(spark, sf):
    bad = F.when(F.col("doc_id") % 11 == 0, "maybe").when(F.col("doc_id") % 13 == 0, F.lit(None)).otherwise(F.col("label"))
    return contracts.check_label_domain(fx.labelled_triplets(spark, sf).withColumn("label", bad))


@query("fill_text", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS text FROM conversations")
def fill_text(spark, sf):
    turns = fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text")
    )
    return contracts.fill_text(turns, ["text"])


def text_votes(spark, sf):
    """Every document with the label that the rules give it."""
    scored = ft.rule_proba(ft.rule_features(fx.texts(spark, sf), fx.CUES, fx.HINTS))
    return scored.withColumn("predict_label", pr.argmax_label(F.col("proba")))


@query("write_preprocessed", texts_sql(["cleaned"], """
SELECT id, context_clean, lower(response_clean) AS response_tok, CAST(length(prompt_clean) AS BIGINT) AS prompt_char_len FROM cleaned"""))
def write_preprocessed(spark, sf):
    path = scratch_path(spark, "preprocessed")
    sinks.write_preprocessed(pp.preprocess(fx.texts(spark, sf)), path)
    return tables.read_any_csv(spark, path).select("id", "context_clean", "response_tok", big("prompt_char_len")).fillna("")


@query("preprocess_stats", texts_sql(["triplets"], """
SELECT (SELECT count(*) FROM triplets) AS rows, CAST(5 AS BIGINT) AS columns, id, context, prompt, response,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN label END AS label
FROM triplets ORDER BY id LIMIT 3"""))
def preprocess_stats(spark, sf):
    """Of every document with its label: all rows are counted, and the first records are shown with all their columns."""
    stats = pp.preprocess_stats(fx.all_triplets(spark, sf))
    return stats.select("rows", "columns", F.explode("sample_rows").alias("s")).select("rows", "columns", "s.*")


REPORT_SQL = """
SELECT l AS row, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM known
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM known
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM known
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM known"""
KNOWN = """known AS (
  SELECT d.l, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(precision, 0.0) AS precision,
    coalesce(recall, 0.0) AS recall, coalesce(f1, 0.0) AS f1
  FROM (SELECT unnest(['no', 'intrinsic', 'extrinsic']) AS l) d LEFT JOIN per_label p ON d.l = p.l)"""
RULE_REPORT = sql(["rule_votes"], REPORT_SQL, [scores_cte("per_label", "rule_votes"), KNOWN])


@query("write_report", RULE_REPORT)
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_report(ev.classification_report(rule_votes(spark, sf)), path)
    back = spark.read.schema("row string, precision double, recall double, f1 double, support long").json(path)
    return back.select("row", r6("precision"), r6("recall"), r6("f1"), "support")


@query("write_valid_artifacts", sql(["split15", "rule_scores"], f"""
SELECT v.id, CAST({label_id('v.label')} AS BIGINT) AS label_id, CAST({first_max(['r0', 'r1', 'r2'])} AS BIGINT) AS pred, round(r0, 6) AS p0, round(r2, 6) AS p2
FROM split15 v JOIN rule_scores r ON v.id = r.id WHERE v.split = 'valid'"""))
def write_valid_artifacts(spark, sf):
    valid = sampling.stratified_split(fx.triplets(spark, sf)).filter("split = 'valid'")
    scored = ft.rule_proba(ft.rule_features(valid, fx.CUES, fx.HINTS)).withColumns({
        "label_id": label_to_id(F.col("label")), "pred": pr.argmax(F.col("proba")),
    })
    path = scratch_path(spark, "valid")
    sinks.write_valid_artifacts(scored, path)
    return spark.read.parquet(path).select(
        "id", big("label_id"), big("pred"), r6(F.col("proba")[0], "p0"), r6(F.col("proba")[2], "p2")
    )


@query("save_load_model", sql(["triplets"], "SELECT id, true AS same FROM triplets"))
def save_load_model(spark, sf):
    """``same``: the loaded model gives each row the label and, but for rounding, the probabilities of the one that was saved."""
    train = pp.serialize(fx.triplets(spark, sf))
    path = scratch_path(spark, "model")
    model = md.ClassicalModel.fit(train)
    model.save(path)
    again = md.ClassicalModel.load(spark, path).predict(train).select("id", F.col("predict_label").alias("l"), F.col("proba").alias("q"))
    near = F.forall(F.arrays_zip("proba", "q"), lambda x: F.abs(x["proba"] - x["q"]) < 1e-9)
    return model.predict(train).join(again, "id").select("id", ((F.col("predict_label") == F.col("l")) & near).alias("same"))


@query("write_submission", texts_sql(["rule_votes"], """
SELECT t.id, context, prompt, response, predict_label FROM triplets t JOIN rule_votes v ON t.id = v.id"""))
def write_submission(spark, sf):
    path = scratch_path(spark, "submission")
    sinks.write_submission(text_votes(spark, sf), path)
    return tables.read_any_csv(spark, path).fillna("")


@query("write_label_submission", texts_sql(["rule_votes"], "SELECT id, predict_label AS label FROM rule_votes"))
def write_label_submission(spark, sf):
    path = scratch_path(spark, "label_submission")
    sinks.write_label_submission(text_votes(spark, sf), path)
    return tables.read_any_csv(spark, path)


@query("write_entropy_results", sql(["triplets"], """
SELECT t.id, t.label AS true_label, CAST(count(vec_id) AS BIGINT) AS n_answers
FROM triplets t LEFT JOIN embeddings e ON t.doc_id = e.vec_id // 5 GROUP BY ALL"""))
def write_entropy_results(spark, sf):
    path = scratch_path(spark, "entropy")
    sinks.write_entropy_results(en.semantic_entropy_report(fx.triplets(spark, sf), fx.answer_samples(spark, sf), 0.1), path)
    back = spark.read.schema("id string, true_label string, generated_responses array<string>").json(f"{path}/details_json")
    return back.select("id", "true_label", big(F.size("generated_responses"), "n_answers"))


@query("write_run_summary", sql(["run_rows"], """
SELECT run_name, status, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy, round(elapsed_minutes, 6) AS elapsed_minutes FROM run_rows"""))
def write_run_summary(spark, sf):
    grid = runs.run_grid(fx.models(spark, sf), [256, 512])
    path = scratch_path(spark, "summary")
    sinks.write_run_summary(runs.skip_done(grid, fx.run_scores(spark, sf)), path)
    back = spark.read.schema("run_name string, status string, macro_f1 double, accuracy double, elapsed_minutes double").json(f"{path}/summary_json")
    return back.select("run_name", "status", r6("macro_f1"), r6("accuracy"), r6("elapsed_minutes"))
