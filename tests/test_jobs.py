"""The jobs chained over CSV files made from the test tables."""

from pyspark.sql import functions as F

from groundcheck.plans import jobs
from groundcheck.sources import fixtures as fx, sinks, tables

SF_DIR = "/root/testdata/sf0.001"


def test_train_blend_predict(spark, tmp_path):
    out = str(tmp_path)
    sinks.write_csv(fx.triplets(spark, SF_DIR), f"{out}/train_csv")
    classical = jobs.train_classical_job(spark, f"{out}/train_csv", f"{out}/classical", max_iter=20)
    logits = fx.transformer_logits(spark, SF_DIR).select("id", "logits")
    transformer = jobs.evaluate_logits_job(spark, f"{out}/train_csv", logits, f"{out}/transformer", {"model_name": "m"})
    assert {r.id for r in classical.collect()} == {r.id for r in transformer.collect()}
    meta = spark.read.json(f"{out}/transformer/metadata").first()
    assert (meta.train_rows, meta.valid_rows) == (73, 14)
    hybrid = jobs.train_hybrid_job(spark, f"{out}/train_csv", f"{out}/classical", f"{out}/transformer", f"{out}/hybrid", steps=10)
    assert hybrid.count() == 14
    weights = spark.read.json(f"{out}/hybrid/weights").first()
    assert abs(weights.classical + weights.transformer + weights.rule - 1) < 1e-9
    for kind in ("classical", "transformer", "hybrid"):
        jobs.predict_job(spark, f"{out}/train_csv", f"{out}/submission_{kind}", kind, f"{out}/classical", logits, f"{out}/hybrid")
        back = tables.read_any_csv(spark, f"{out}/submission_{kind}")
        assert back.count() == 87 and back.columns == ["id", "context", "prompt", "response", "predict_label"]


def test_preprocess_entropy_and_runs(spark, tmp_path):
    out = str(tmp_path)
    sinks.write_csv(fx.triplets(spark, SF_DIR), f"{out}/train_csv")
    jobs.preprocess_job(spark, f"{out}/train_csv", f"{out}/prep/csv", "llm", sample=20)
    assert tables.read_any_csv(spark, f"{out}/prep/csv").filter(F.col("llm_prompt").isNotNull()).count() == 20
    stats = spark.read.json(f"{out}/prep/preprocess_stats").first()
    assert stats.rows == 20 and len(stats.sample_rows) == 3
    by_label, auc = jobs.semantic_entropy_job(spark, f"{out}/train_csv", fx.answer_samples(spark, SF_DIR), f"{out}/entropy", 0.1)
    assert sum(r["count"] for r in by_label.collect()) == 87
    assert 0 <= auc.first().auc <= 1
    board = jobs.run_summary_job(fx.models(spark, SF_DIR), fx.run_scores(spark, SF_DIR), [256, 512], f"{out}/runs")
    assert board.count() > 0
