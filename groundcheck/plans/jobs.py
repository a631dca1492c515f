"""End-to-end jobs: tables in, tables out. Every step is keyed by the row id."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import proba as pr
from ..operators import blend as bl, contracts as ct, entropy as en, evaluate as ev, features as ft, models as md, preprocess as pp, runs, sampling
from ..schema import DEFAULT_BLEND, LABELS, label_to_id
from ..session import materialize
from ..sources import sinks, tables


def preprocess_job(
    spark: SparkSession, input_path: str, output_path: str, method: str = "baseline", sample: int = 0,
    lexicon: DataFrame | None = None, stopwords: DataFrame | list[str] | None = None, multi_line: bool = True,
) -> DataFrame:
    """Clean, tokenise, segment and sift a CSV or parquet table; the statistics go to ``preprocess_stats`` beside the output."""
    df = tables.read_table(spark, input_path, multi_line)
    df = sampling.random_sample(df, sample, seed=0, clamp=False)
    # the output and its statistics read the same stored rows
    out = materialize(pp.preprocess(df, method, lexicon, stopwords))
    sinks.write_preprocessed(out, output_path)
    sinks.write_preprocess_stats(out, os.path.join(os.path.dirname(output_path.rstrip("/")), "preprocess_stats"))
    return out


def _valid_rows(scored: DataFrame) -> DataFrame:
    """Validation rows in the stored form: ids of label and prediction, and the probabilities."""
    return scored.select(
        "id", "label", "proba", "predict_label", label_to_id(F.col("label")).alias("label_id"),
        label_to_id(F.col("predict_label")).alias("pred"),
    )


def _write_evaluation(scored: DataFrame, output_dir: str) -> DataFrame:
    """Write valid rows, scores and report of a run; returns the stored valid rows."""
    rows = _valid_rows(scored)
    sinks.write_valid_artifacts(rows, f"{output_dir}/valid")
    names = F.array(*[F.lit(x) for x in LABELS])
    stored = scored.sparkSession.read.parquet(f"{output_dir}/valid").withColumns({
        "label": F.get(names, F.col("label_id")), "predict_label": F.get(names, F.col("pred")),
    })
    sinks.write_scores(ev.scores(stored), f"{output_dir}/scores")
    sinks.write_report(ev.classification_report(stored), f"{output_dir}/report")
    return stored


def train_classical_job(
    spark: SparkSession, train_path: str, output_dir: str, valid_size: float = 0.15, seed: int = 42, max_iter: int = 2500,
    multi_line: bool = True,
) -> DataFrame:
    """Fit the classical model on the training rows, report it on the validation rows."""
    # the file is parsed once: the split's counts, the vocabulary and the vectors read the stored rows
    table = materialize(tables.read_train(spark, train_path, multi_line=multi_line).select("id", "label", "serialized_text"))
    df = materialize(sampling.stratified_split(table, valid_size, seed))
    model = md.ClassicalModel.fit(df.filter("split = 'train'"), max_iter=max_iter)
    model.save(f"{output_dir}/model")
    return _write_evaluation(model.predict(df.filter("split = 'valid'"), keep=["label"]), output_dir)


def evaluate_logits_job(
    spark: SparkSession, train_path: str, logits: DataFrame, output_dir: str, config: dict, valid_size: float = 0.15,
    seed: int = 42, sample_size: int = 0, multi_line: bool = True,
) -> DataFrame:
    """Report a model known by its logits ``(id, logits)``: the split is drawn here, the rows meet by id.

    A validation row without logits is an error that counts them, not a smaller report.
    """
    table = materialize(tables.read_train(spark, train_path, multi_line=multi_line).select("id", "label"))
    df = sampling.stratified_sample(table, sample_size, seed)
    split = materialize(sampling.stratified_split(df, valid_size, seed))
    sinks.write_report(ev.run_metadata(split, config, valid_size), f"{output_dir}/metadata")
    valid = ct.require_partners(split.filter("split = 'valid'"), logits, "the logits")
    return _write_evaluation(ev.evaluate_logits(logits, valid), output_dir)


def train_hybrid_job(
    spark: SparkSession, train_path: str, classical_dir: str, transformer_dir: str, output_dir: str,
    valid_size: float = 0.15, seed: int = 42, steps: int = 20, start: tuple[float, float, float] = DEFAULT_BLEND,
    multi_line: bool = True,
) -> DataFrame:
    """Fit the blend weights on the validation rows of two stored runs and the rules, report on the same rows.

    A validation row that a stored run lacks is an error that counts them.
    """
    table = materialize(tables.read_train(spark, train_path, multi_line=multi_line).drop("serialized_text"))
    split = sampling.stratified_split(table, valid_size, seed)
    rules = materialize(ft.rule_proba(ft.rule_features(split.filter("split = 'valid'"))).select("id", "label", "proba"))
    parts = {
        "classical": spark.read.parquet(f"{classical_dir}/valid"), "transformer": spark.read.parquet(f"{transformer_dir}/valid"),
        "rule": rules,
    }
    labels = rules.select("id", "label")
    for name in ("classical", "transformer"):
        ct.require_partners(labels, parts[name], f"the {name} run")
    rows = materialize(bl.join_sources(parts).join(labels, "id"))
    weights = materialize(bl.fit_blend_weights(rows, steps, start))
    sinks.write_report(weights.select(*bl.SOURCES), f"{output_dir}/weights")
    return _write_evaluation(bl.blend_predict(rows, weights), output_dir)


def predict_job(
    spark: SparkSession, test_path: str, output_path: str, model_type: str, classical_dir: str | None = None,
    logits: DataFrame | None = None, hybrid_dir: str | None = None, multi_line: bool = True,
) -> DataFrame:
    """Predict a test table with the classical model, a logits table, or the blend of both with the rules.

    Every test row is in the submission: one without logits is an error that counts them.
    """
    test = tables.read_test(spark, test_path, multi_line=multi_line)
    if model_type in ("transformer", "hybrid"):
        ct.require_partners(test, logits, "the logits")
    proba = {}
    if model_type in ("classical", "hybrid"):
        proba["classical"] = md.ClassicalModel.load(spark, f"{classical_dir}/model").predict(test).select("id", "proba")
    if model_type in ("transformer", "hybrid"):
        proba["transformer"] = logits.select("id", pr.softmax(F.col("logits")).alias("proba"))
    if model_type == "hybrid":
        proba["rule"] = ft.rule_proba(ft.rule_features(test)).select("id", "proba")
        weights = spark.read.schema(", ".join(f"{s} double" for s in bl.SOURCES)).json(f"{hybrid_dir}/weights")
        votes = bl.blend_predict(bl.join_sources(proba), weights)
    elif model_type in proba:
        votes = proba[model_type].withColumn("predict_label", pr.argmax_label(F.col("proba")))
    else:
        raise ValueError(f"unknown model type {model_type!r}")
    out = test.drop("predict_label").join(votes.select("id", "predict_label"), "id")
    sinks.write_submission(out, output_path)
    return out


def semantic_entropy_job(
    spark: SparkSession, input_path: str, samples: DataFrame, output_dir: str, tau: float = 0.8, sample_size: int = 0, seed: int = 42,
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Entropy of the sampled answers per row; returns the mean per label and the AUC of the known labels."""
    source = sampling.random_sample(tables.read_table(spark, input_path, multi_line), sample_size, seed)
    report = en.semantic_entropy_report(source, samples, tau)
    sinks.write_entropy_results(report, output_dir)
    stored = spark.read.schema(report.schema).json(f"{output_dir}/details_json").select("true_label", "semantic_entropy")
    known = stored.filter(F.col("true_label").isin(LABELS)).withColumn("y", pr.is_hallucinated(F.col("true_label")))
    return en.entropy_by_label(stored), ev.auc_roc(known, "semantic_entropy", "y")


def run_summary_job(models: DataFrame, scores: DataFrame, lengths: list[int], output_dir: str, text_mode: str = "auto") -> DataFrame:
    """The grid of runs with what is stored of them: writes the summary, returns the ranking."""
    rows = runs.skip_done(runs.run_grid(models, lengths, text_mode), scores)
    sinks.write_run_summary(rows, output_dir)
    return runs.leaderboard(rows)
