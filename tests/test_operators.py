import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundcheck.functions import proba as pr
from groundcheck.operators import (
    blend as bl, claims as cl, contracts, eda, entropy as en, evaluate as ev, models as md, ordering, probes as pb,
    runs, sampling, tfidf, vocab,
)
from groundcheck.plans import jobs
from groundcheck.sources import sinks, tables


def labelled(spark, sizes, start=0):
    rows, i = [], start
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((str(i), label))
            i += 1
    return spark.createDataFrame(rows, "id string, label string")


def test_split_quotas_and_stability(spark):
    df = labelled(spark, {"no": 1001, "intrinsic": 7, "extrinsic": 300})
    split = sampling.stratified_split(df, 0.15)
    again = sampling.stratified_split(df.repartition(13, "label"), 0.15)
    rows = {r.id: r.split for r in split.collect()}
    assert rows == {r.id: r.split for r in again.collect()}
    total = math.ceil(0.15 * 1308)
    counts = {r.label: r["count"] for r in split.filter("split = 'valid'").groupBy("label").count().collect()}
    assert sum(counts.values()) == total
    for label, n in {"no": 1001, "intrinsic": 7, "extrinsic": 300}.items():
        assert abs(counts[label] - n * total / 1308) < 1
    assert split.count() == 1308


def test_samples(spark):
    df = labelled(spark, {"no": 90, "intrinsic": 6, "extrinsic": 4})
    assert sampling.random_sample(df, 17).count() == 17
    assert sampling.random_sample(df, 0).count() == 100
    assert sampling.random_sample(df, 500).count() == 100
    with pytest.raises(Exception, match="cannot draw"):
        sampling.random_sample(df, 500, clamp=False).collect()
    assert sampling.stratified_sample(df, 100).count() == 100
    got = {r.label: r["count"] for r in sampling.stratified_sample(df, 50).groupBy("label").count().collect()}
    assert got == {"no": 45, "intrinsic": 3, "extrinsic": 2}
    with pytest.raises(Exception, match="at least 3"):
        sampling.stratified_sample(df, 2).collect()


def test_quantiles_with_a_hot_value(spark):
    rng = random.Random(2)
    rows = [("a", float(rng.randint(0, 50))) for _ in range(900)] + [("a", 7.0)] * 1200 + [("b", rng.random()) for _ in range(501)] + [("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = ordering.exact_quantiles(ordering.value_counts(df, "v", ["g"]), "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}, ["g"])
    for r in got.collect():
        values = [v for g, v in rows if g == r.g]
        assert np.allclose([r.q1, r.q2, r.q9], np.quantile(values, [0.25, 0.5, 0.9]))


def test_top_rows_breaks_ties_by_name(spark):
    rows = [(f"t{i:03d}", 1 + (i % 4)) for i in range(200)]
    got = [r.t for r in ordering.top_rows(spark.createDataFrame(rows, "t string, n long"), 60, "n", "t").collect()]
    assert sorted(got) == sorted(t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:60])
    few = spark.createDataFrame(rows[:5], "t string, n long")
    assert ordering.top_rows(few, 60, "n", "t").count() == 5


def test_running_sums_do_not_depend_on_the_slices(spark):
    counts = ordering.value_counts(spark.range(1000).selectExpr("id % 97 AS v", "id % 2 AS g"), "v", ["g"])
    got = [
        sorted(map(tuple, ordering.running_before(counts, "v", ["n"], ["g"], slices=s).collect())) for s in (None, 1, 7, 64)
    ]
    assert got[0] == got[1] == got[2] == got[3]
    assert all(before == sum(n for g2, v2, n, _ in got[0] if g2 == g and v2 < v) for g, v, _, before in got[0])
    empty = spark.createDataFrame([], "v long, n long")
    assert ordering.running_before(empty, "v", ["n"]).count() == 0


def test_auc_matches_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.1, 0.2, 0.5, rng.random()]), rng.randint(0, 1)) for _ in range(300)]
    got = ev.auc_roc(spark.createDataFrame(rows, "s double, y int"), "s", "y", slices=5).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(got.auc, want)
    assert ev.auc_roc(spark.createDataFrame([(0.1, 1)], "s double, y int"), "s", "y").first().auc is None


def test_histogram_and_describe(spark):
    df = spark.createDataFrame([("no", 5)] * 3 + [("extrinsic", n) for n in (1, 2, 31)], "label string, n int")
    got = {(r.label, r.bin): r.n for r in eda.length_histogram(df, "n").collect()}
    assert got == {("no", 15): 3, ("extrinsic", 0): 1, ("extrinsic", 1): 1, ("extrinsic", 29): 1}
    d = eda.describe(df, ["n"]).first()
    values = [5, 5, 5, 1, 2, 31]
    assert (d["count"], d["min"], d["max"]) == (6, 1.0, 31.0)
    assert math.isclose(d["mean"], np.mean(values)) and math.isclose(d["std"], np.std(values, ddof=1))


def test_scores_golden(spark):
    pairs = [("no", "no"), ("no", "intrinsic"), ("intrinsic", "intrinsic"), ("no", "no")]
    df = spark.createDataFrame(pairs, "label string, predict_label string")
    s = ev.scores(df).first()
    assert math.isclose(s.macro_f1, (0.8 + 2 / 3) / 2) and s.accuracy == 0.75
    report = {r.row: r for r in ev.classification_report(df).collect()}
    assert list(report)[:0] == [] and report["extrinsic"].support == 0 and report["extrinsic"].f1 == 0.0
    assert math.isclose(report["macro avg"].f1, (0.8 + 2 / 3) / 3)
    cm = {r.label: (r.pred_no, r.pred_intrinsic, r.pred_extrinsic) for r in ev.confusion_matrix(df).collect()}
    assert cm == {"no": (2, 1, 0), "intrinsic": (0, 1, 0), "extrinsic": (0, 0, 0)}


def test_probabilities(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.5],), ([0.0, 800.0, 799.0],)], "z array<double>")
    rows = df.select(pr.softmax(F.col("z")).alias("p"), pr.argmax_label(F.col("z")).alias("l")).collect()
    assert [r.l for r in rows] == ["no", "intrinsic"]
    assert all(math.isclose(sum(r.p), 1.0) for r in rows)


def test_blend_fit_is_never_worse_than_its_start(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        label = ["no", "intrinsic", "extrinsic"][i % 3]
        ps = rng.dirichlet([1, 1, 1], size=3)
        ps[2][i % 3] += 1.0
        rows.append((str(i), label, *[[float(x) for x in p / p.sum()] for p in ps]))
    df = spark.createDataFrame(rows, "id string, label string, classical array<double>, transformer array<double>, rule array<double>")
    fit = bl.fit_blend_weights(df, steps=10)
    best = fit.first()
    start = ev.scores(bl.blend_predict(df)).first().macro_f1
    assert best.macro_f1 >= start and math.isclose(best.classical + best.transformer + best.rule, 1.0)
    assert math.isclose(ev.scores(bl.blend_predict(df, fit)).first().macro_f1, best.macro_f1)
    assert len(bl.weight_grid(10)) == 67
    # each point's counts are those of the blend with its weights
    board = bl.blend_scores(df, 4)
    for r in board.collect():
        assert math.isclose(r.macro_f1, ev.scores(bl.blend_predict(df, (r.w_classical, r.w_transformer, r.w_rule))).first().macro_f1)
    plan = bl.grid_counts(df, bl.weight_grid(4))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan


def greedy(vectors, tau):
    centers, out = [], []
    for i, v in enumerate(vectors):
        hit = next((c for c in centers if np.dot(v, vectors[c]) / (np.linalg.norm(v) * np.linalg.norm(vectors[c])) >= tau), i)
        if hit == i:
            centers.append(i)
        out.append(hit)
    return out


@pytest.mark.parametrize("limit", [512, 3])
def test_greedy_clusters_and_entropy(spark, limit):
    rng = np.random.default_rng(1)
    groups = {f"p{g}": rng.normal(size=(int(rng.integers(1, 14)), 3)) for g in range(12)}
    rows = [(g, i, [float(x) for x in v]) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "id string, sample_idx int, embedding array<double>").repartition(7)
    got = {(r.id, r.sample_idx): r.center_idx for r in en.greedy_cluster(df, 0.6, limit, tile=4).collect()}
    want = {(g, i): c for g, vs in groups.items() for i, c in enumerate(greedy(vs, 0.6))}
    assert got == want
    for r in en.semantic_entropy(df, 0.6, limit).collect():
        sizes = np.unique([c for (g, _), c in want.items() if g == r.id], return_counts=True)[1]
        p = sizes / sizes.sum()
        assert math.isclose(r.semantic_entropy, -np.sum(p * np.log(p + 1e-9)), abs_tol=1e-12)
        assert r.semantic_entropy <= math.log(len(groups[r.id])) + 1e-6


def test_large_prompts_are_settled_in_few_rounds(spark):
    """100,000 samples of which no two are alike, and 3,000 in a few clusters with a chain: the sequential rule's clusters."""
    rng = np.random.default_rng(4)
    many = spark.range(100_000).selectExpr("'one' AS id", "cast(id AS int) AS sample_idx", "transform(sequence(1, 12), i -> hash(id, i) / 2147483648D) AS embedding")
    assert en.greedy_cluster(many, 0.99999).filter("sample_idx = center_idx").count() == 100_000
    angles = np.concatenate([np.arange(400) * 0.3, rng.uniform(0, 6, 2600)])  # a chain: each matches its neighbours only
    vectors = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    rows = [("big", i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [("small", i, [1.0, float(i)]) for i in range(5)]
    got = {(r.id, r.sample_idx): r.center_idx for r in en.greedy_cluster(spark.createDataFrame(rows, "id string, sample_idx int, embedding array<double>"), 0.95, tile=700).collect()}
    assert [got["big", i] for i in range(3000)] == greedy(vectors, 0.95)
    assert [got["small", i] for i in range(5)] == greedy([v for g, _, v in rows if g == "small"], 0.95)


def test_report_without_answers_or_label(spark):
    source = spark.createDataFrame([("a", "c", "p", "r", None)], "id string, context string, prompt string, response string, label string")
    samples = spark.createDataFrame([("b", 0, "x", [1.0])], "id string, sample_idx int, response string, embedding array<double>")
    r = en.semantic_entropy_report(source, samples).first()
    assert (r.true_label, r.generated_responses, r.semantic_entropy) == ("unknown", [], 0.0)


def test_mean_pool_with_nothing_unmasked(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 3.0]), ("a", 1, [3.0, 5.0]), ("a", 0, [9.0, 9.0]), ("b", 0, [1.0, 1.0])], "id string, mask int, embedding array<double>")
    assert {r.id: r.embedding for r in en.mean_pool(df).collect()} == {"a": [2.0, 4.0], "b": [0.0, 0.0]}


def test_evidence_and_samples(spark):
    claims = cl.segment_claims(spark.createDataFrame([("1", "x. y. z")], "id string, response string"))
    evidence = spark.createDataFrame([("x", 1, "b", "two"), ("x", 0, "a", "one"), ("y", 0, "a", ""), ("z", 0, "a", None)], "claim string, tool_ord int, tool string, result string")
    got = {r.claim: r.evidence for r in cl.gather_evidence(claims, evidence).collect()}
    assert got == {"x": "[a] one | [b] two", "y": cl.NO_EVIDENCE, "z": cl.NO_EVIDENCE}
    samples = spark.createDataFrame([("1", 1, " b "), ("1", 0, None)], "id string, sample_idx int, response string")
    assert cl.collect_samples(samples).first().generated_responses == [" ", "b"]


def test_a_list_without_bound_is_an_error(spark):
    many = spark.range(1_000_000).selectExpr("'hot' AS claim", "cast(id AS int) AS tool_ord", "'t' AS tool", "'r' AS result", "'p' AS prompt_id", "cast(id AS int) AS member_idx", "'x' AS text")
    few = spark.createDataFrame([("cold", 0, "a", "one")], "claim string, tool_ord int, tool string, result string")
    cut = cl.first_rows(many, "claim", "tool_ord", 50)
    assert cut.count() == 51 and "WindowGroupLimit" in cut._jdf.queryExecution().executedPlan().toString()
    claims = spark.createDataFrame([("1", 0, "hot"), ("2", 0, "cold")], "id string, claim_idx int, claim string")
    with pytest.raises(Exception, match="more than 10000 rows of claim hot"):
        cl.gather_evidence(claims, many.select("claim", "tool_ord", "tool", "result").unionByName(few)).collect()
    with pytest.raises(Exception, match="more than 10000 rows of prompt_id p"):
        cl.collect_ensemble(many).collect()
    assert len(cl.collect_ensemble(many.filter("member_idx < 10000")).first().generated_texts) == 10_000


def test_quotas_over_many_classes(spark):
    r = random.Random(8)
    rows = [(str(i), f"c{r.randint(0, 400) ** 2 // 400:03d}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id string, label string")
    got = {x.label: x.quota for x in sampling.class_quotas(df, "label", lambda total, classes: F.ceil(F.lit(0.15) * total)).collect()}
    n = {}
    for _, c in rows:
        n[c] = n.get(c, 0) + 1
    base = {c: v * 750 // 5000 for c, v in n.items()}
    extra = sorted(n, key=lambda c: (-(n[c] * 750 % 5000), c))[: 750 - sum(base.values())]
    assert got == {c: base[c] + (c in extra) for c in n}


@pytest.mark.parametrize("alpha", [-1.0, 0.0, 0.5, 0.9, 1.0])
def test_neuron_selection(spark, alpha):
    w = np.random.default_rng(2).normal(size=(4, 9))
    rows = [(0, "init", o, i, float(w[o, i])) for o in range(4) for i in range(9)]
    got = [r.in_dim for r in pb.neuron_selection(spark.createDataFrame(rows, "layer int, step string, out_dim int, in_dim int, w double"), alpha).orderBy("rank").collect()]
    m = np.abs(w).mean(axis=0)
    order = np.argsort(-m)
    sums = np.cumsum(m[order] ** 2)
    reached = np.nonzero(sums >= min(max(alpha, 0), 1) * sums[-1] * (1 - 1e-12))[0]
    assert got == list(order[: reached[0] + 1])


@pytest.mark.parametrize("block", [4096, 2])
def test_probe_score(spark, block):
    rng = np.random.default_rng(3)
    w1, b1, w2, h = rng.normal(size=(3, 5)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=(7, 5))
    weights = spark.createDataFrame([(0, "init", o, i, float(w1[o, i])) for o in range(3) for i in range(5)], "layer int, step string, out_dim int, in_dim int, w double")
    outputs = spark.createDataFrame([(0, "init", o, float(b1[o]), float(w2[o])) for o in range(3)], "layer int, step string, out_dim int, b1 double, w2 double")
    bias = spark.createDataFrame([(0, "init", 0.25)], "layer int, step string, b2 double")
    states = spark.createDataFrame([(str(i), 0, "init", [float(x) for x in v]) for i, v in enumerate(h)], "id string, layer int, step string, h array<double>")
    got = {r.id: r.score for r in pb.probe_score(states, pb.pack_probes(weights, outputs), bias, block).collect()}
    want = 1 / (1 + np.exp(-(np.maximum(h @ w1.T + b1, 0) @ w2 + 0.25)))
    assert len(got) == 7 and all(math.isclose(got[str(i)], want[i]) for i in range(7))


def test_vocab_and_sequences(spark):
    df = spark.createDataFrame([("1", "b a b c"), ("2", "a b d d"), ("3", "")], "id string, t string")
    v = vocab.build_vocab(df, "t", max_size=4)
    assert {r.token: r.token_id for r in v.collect()} == {"<PAD>": 0, "<UNK>": 1, "b": 2, "a": 3}
    ids = {r.id: r.token_ids for r in vocab.encode_sequence(df, "t", v, max_len=3).collect()}
    assert ids == {"1": [2, 3, 2], "2": [3, 2, 1], "3": [0, 0, 0]}


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([("1", "aa bb aa"), ("2", "aa cc"), ("3", "zz")], "id string, t string")
    rows = tfidf.term_rows(df, "t")
    v = tfidf.tfidf_vocab(rows, min_df=1)
    lengths = tfidf.tfidf_weights(rows, v).groupBy("id").agg(F.sum(F.col("tfidf") ** 2).alias("l")).collect()
    assert all(math.isclose(r.l, 1.0) for r in lengths)
    assert {r.term: (r.df, r.cf) for r in v.collect()}["aa"] == (2, 3)
    unknown = spark.createDataFrame([("9", "qq rr")], "id string, t string")
    space = md.VectorSpace(v, False)
    assert space.vectors(unknown, "t").first().features.numNonzeros() == 0


def planted(spark, n=150):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        label = ["no", "no", "intrinsic", "extrinsic"][i % 4]
        rows.append((str(i), label, " ".join([label + "word"] * rng.randint(1, 3) + rng.choices(["aa", "bb", "cc"], k=5)), "train" if i % 5 else "valid"))
    return spark.createDataFrame(rows, "id string, label string, text string, split string")


def test_classical_model_learns_and_survives_storage(spark, tmp_path):
    df = planted(spark)
    model = md.ClassicalModel.fit(df.filter("split = 'train'"), "text", max_iter=50)
    out = model.predict(df.filter("split = 'valid'"), "text", keep=["label"])
    rows = out.collect()
    assert all(math.isclose(sum(r.proba), 1.0) for r in rows)
    assert sum(r.label == r.predict_label for r in rows) / len(rows) > 0.9
    model.save(str(tmp_path / "m"))
    again = md.ClassicalModel.load(spark, str(tmp_path / "m")).predict(df.filter("split = 'valid'"), "text")
    assert {r.id: r.predict_label for r in again.collect()} == {r.id: r.predict_label for r in rows}


def test_models_beat_the_majority(spark):
    train, valid, space = md.split_vectors(planted(spark), "text", 200)
    board = md.train_and_compare(train, valid, space.size, rf_trees=10, rf_depth=5, gbt_rounds=3, gbt_depth=2, mlp_hidden=(8,), mlp_iter=60).collect()
    assert len(board) == 6 and [r.f1_macro for r in board] == sorted((r.f1_macro for r in board), reverse=True)
    assert all(r.accuracy > 0.5 for r in board)


def test_tables_round_trip(spark, tmp_path):
    rows = [("1", 'a "q", b\nline two', " lead", "None", "no"), ("2", None, "", "x\\y", "extrinsic"), ("3", "NA", "p", "r", "intrinsic")]
    df = spark.createDataFrame(rows, "id string, context string, prompt string, response string, label string")
    sinks.write_csv(df.select("label", "id", "context", "prompt", "response"), str(tmp_path / "t"))
    got = {r.id: r for r in tables.read_train(spark, str(tmp_path / "t")).collect()}
    assert got["1"].context == rows[0][1] and got["1"].prompt == " lead" and got["1"].response == ""
    assert got["2"].context == "" and got["2"].response == "x\\y" and got["2"].label_id == 2 and got["3"].context == ""
    assert got["3"].serialized_text == "[CLS]  [SEP] p [SEP] r [SEP]"
    sinks.write_submission(tables.as_test(df.drop("label")), str(tmp_path / "s"))
    assert tables.read_any_csv(spark, str(tmp_path / "s")).columns == ["id", "context", "prompt", "response", "predict_label"]


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([("1", "c", "p", "r", None), ("2", "c", "p", "r", "bad")], "id string, context string, prompt string, response string, label string")
    assert [(r.label, r.n) for r in contracts.check_label_domain(df).collect()] == [("bad", 1), ("nan", 1)]
    with pytest.raises(ValueError, match="context.*label"):
        contracts.require_columns(df.select("id", "prompt", "response"), ["id", "context", "label"])
    with pytest.raises(Exception, match="Unknown labels found"):
        tables.as_train(df).collect()
    with pytest.raises(ValueError):
        contracts.present_text_columns(df.select("id"))


def test_run_tables(spark):
    models = spark.createDataFrame([("org/PhoBERT v2", "roberta", 258), ("m", "bert", None)], "model_name string, model_type string, max_position_embeddings int")
    grid = runs.run_grid(models, [256, 512])
    rows = {r.run_name: r for r in grid.collect()}
    assert set(rows) == {"org_PhoBERT_v2_len256", "org_PhoBERT_v2_len512", "m_len256", "m_len512"}
    assert rows["org_PhoBERT_v2_len512"].status == "unsupported" and rows["org_PhoBERT_v2_len512"].error == "length 512 is over the limit of org/PhoBERT v2 (256)"
    scores = spark.createDataFrame([("m_len256", 0.5, 0.6, None)], "run_name string, macro_f1 double, accuracy double, elapsed_minutes double")
    done = {r.run_name: r for r in runs.skip_done(grid, scores).collect()}
    assert done["m_len256"].status == "skipped" and done["m_len256"].elapsed_minutes == 0.0 and done["m_len512"].status == "running"
    assert sorted(r.run_name for r in runs.runs_to_do(grid, scores).collect()) == ["m_len512", "org_PhoBERT_v2_len256"]
    history = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("a", 3, 0.7)], "run_name string, epoch int, val_f1_macro double")
    assert runs.best_checkpoint(history).first().epoch == 2


def test_null_class_is_drawn(spark):
    df = spark.createDataFrame([(str(i), "a" if i % 2 else None) for i in range(40)], "id string, label string")
    assert sampling.stratified_sample(df, 10).groupBy("label").count().orderBy("label").collect() == [(None, 5), ("a", 5)]
    assert sampling.stratified_split(df, 0.5).filter("split = 'valid'").count() == 20


def test_absent_probe_coordinates_are_zeros(spark):
    w1 = np.array([[1.0, 0.0, 2.0], [0.0, 0.0, -3.0]])
    weights = spark.createDataFrame(
        [(0, "init", o, i, float(w1[o, i])) for o in range(2) for i in range(3) if w1[o, i]], "layer int, step string, out_dim int, in_dim int, w double")
    got = pb.neuron_selection(weights, 1.0).orderBy("rank").collect()
    assert [(r.in_dim, r.importance) for r in got] == [(2, 2.5), (0, 0.5)]
    outputs = spark.createDataFrame([(0, "init", o, 0.5, 1.0) for o in range(3)], "layer int, step string, out_dim int, b1 double, w2 double")
    bias = spark.createDataFrame([(0, "init", 0.25)], "layer int, step string, b2 double")
    schema = "id string, layer int, step string, h array<double>"
    states = spark.createDataFrame([("x", 0, "init", [1.0, 5.0, 2.0])], schema)
    probes = pb.pack_probes(weights, outputs)
    z = np.maximum(np.vstack([w1, np.zeros(3)]) @ np.array([1.0, 5.0, 2.0]) + 0.5, 0).sum() + 0.25
    assert math.isclose(pb.probe_score(states, probes, bias).first().score, 1 / (1 + np.exp(-z)))
    with pytest.raises(Exception, match="no probe for layer 7"):
        pb.probe_score(spark.createDataFrame([("x", 7, "init", [1.0])], schema), probes, bias).collect()


def test_column_orders_and_markers(spark, tmp_path):
    df = spark.createDataFrame([("1", "c", "None", "r", "no")], "id string, context string, prompt string, response string, label string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_csv(df, a)
    sinks.write_csv(df.select("label", "response", "prompt", "context", "id"), b)
    rows = tables.read_any_csv(spark, [a, b]).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].id == "1"
    (tmp_path / "mixed").mkdir()
    for i, folder in enumerate((a, b)):
        part = next(p for p in (tmp_path / folder).iterdir() if p.suffix == ".csv")
        (tmp_path / "mixed" / f"{i}.csv").write_bytes(part.read_bytes())
    with pytest.raises(Exception, match="CSV header does not conform"):
        tables.read_any_csv(spark, str(tmp_path / "mixed")).collect()
    df.write.parquet(str(tmp_path / "p.parquet"))
    assert tables.read_train(spark, str(tmp_path / "p.parquet")).first().prompt == "None"
    assert tables.read_train(spark, a).first().prompt == ""


def test_jobs_refuse_unknown_labels_and_missing_logits(spark, tmp_path):
    rows = [(str(i), "c", "p", "r", "no" if i % 2 else "bad" if i else "Worse") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, context string, prompt string, response string, label string")
    sinks.write_csv(df, str(tmp_path / "t"))
    with pytest.raises(ValueError, match=r"Unknown labels found: \['Worse', 'bad'\]"):
        jobs.train_classical_job(spark, str(tmp_path / "t"), str(tmp_path / "out"))
    sinks.write_csv(df.drop("label"), str(tmp_path / "s"))
    logits = df.filter("id <> '3'").select("id", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("logits"))
    with pytest.raises(ValueError, match="1 rows have no partner in the logits"):
        jobs.predict_job(spark, str(tmp_path / "s"), str(tmp_path / "sub"), "transformer", logits=logits)


def test_statistics_read_all_documents_with_their_labels(spark, tmp_path):
    from groundcheck.plans.catalog import QUERIES

    spark.createDataFrame([(1, "a. b", "de", "s", 4), (2, "c", "de", "s", 1), (3, "d", "de", "s", 1), (4, "e", "de", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r.rows, r.columns, r.id, r.context, r.prompt, r.response, r.label) for r in QUERIES["preprocess_stats"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(4, 5, "1", "a. b", "a", "b", "extrinsic"), (4, 5, "2", "c", "c", "c", None), (4, 5, "3", "d", "d", "d", "no")]


def test_probe_score_holds_tiles(spark):
    import tracemalloc

    r = np.random.default_rng(2)
    inputs, weights, b1, w2 = r.normal(size=(5_000, 8)), r.normal(size=(6_000, 8)), r.normal(size=6_000), r.normal(size=6_000)
    tracemalloc.start()
    z = pb.hidden_sums(inputs, weights, b1, w2)
    assert tracemalloc.get_traced_memory()[1] < 100e6  # all pairs at once take 240 MB
    tracemalloc.stop()
    assert np.allclose(z[::97], np.maximum(inputs[::97] @ weights.T + b1, 0) @ w2)
