"""TF-IDF, naive Bayes and the Spark ML classifiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from ..functions import proba as pr
from ..operators import bayes, blend as bl, boosting, evaluate as ev, features as ft, models as md, preprocess as pp, replay, sampling, tfidf
from ..schema import LABELS, id_to_label
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from . import oracle as o
from .catalog_stats import SCORE_COLUMNS
from .oracle import sql, texts_sql
from .registry import big, query, r6

# the two vectoriser settings in use: case kept on the serialized text, lower case on the joined clean text
SERIALIZED_SPLIT = f"rows AS (SELECT s.id, s.label, s.split, {o.norm('s.context')} AS c, {o.norm('s.prompt')} AS p, {o.norm('s.response')} AS r FROM split15 s)," \
    "\ntexts AS (SELECT id, label, split, '[CLS] ' || c || ' [SEP] ' || p || ' [SEP] ' || r || ' [SEP]' AS text FROM rows)"
CLEAN_SPLIT = f"rows AS (SELECT s.id, s.label, s.split, {o.clean('s.context')} AS c, {o.clean('s.prompt')} AS p, {o.clean('s.response')} AS r FROM split20 s)," \
    "\ntexts AS (SELECT id, label, split, c || ' ' || p || ' ' || r AS text FROM rows)"
LIBRARY = [SERIALIZED_SPLIT, o.tfidf_ctes("t", "texts", "text", False, 1.0, 120_000, "split = 'train'")]
NOTEBOOK = [CLEAN_SPLIT, o.tfidf_ctes("t", "texts", "text", True, 0.95, 10_000, "split = 'train'")]


def serialized(spark, sf):
    """Library setting: 15 % validation rows, serialized text. Stored: train and valid rows are filtered from clean texts."""
    df = pp.serialize(sampling.stratified_split(fx.triplets(spark, sf), 0.15))
    return materialize(df.select("id", "label", "split", F.col("serialized_text").alias("text")))


def combined(spark, sf):
    """Notebook setting: 20 % validation rows, the three clean texts joined. Stored as above."""
    df = pp.combine_texts(pp.preprocess(sampling.stratified_split(fx.triplets(spark, sf), 0.2), "llm"))
    return materialize(df.select("id", "label", "split", F.col("text_all").alias("text")))


def fitted(df, lowercase, max_df, max_features):
    """Stored terms of all rows, and the vocabulary of the training rows."""
    rows = materialize(tfidf.term_rows(df, "text", lowercase, keep=["label", "split"]))
    return rows, materialize(tfidf.tfidf_vocab(rows.filter("split = 'train'"), 2, max_df, max_features))


@query("tfidf_terms", sql(["split15"], "SELECT id, term, tf FROM t_counts", LIBRARY))
def tfidf_terms(spark, sf):
    return tfidf.term_counts(tfidf.term_rows(serialized(spark, sf), "text", False)).select("id", "term", big("tf"))


@query("tfidf_vocab", sql(["split15"], "SELECT term, df, CAST(cf AS BIGINT) AS cf, round(idf, 6) AS idf FROM t_vocab", LIBRARY))
def tfidf_vocab(spark, sf):
    _, vocab = fitted(serialized(spark, sf), False, 1.0, 120_000)
    return vocab.select("term", "df", "cf", r6("idf"))


@query("tfidf_vocab_capped", sql(["split20"], "SELECT term, df, CAST(cf AS BIGINT) AS cf, round(idf, 6) AS idf FROM t_vocab",
    [CLEAN_SPLIT, o.tfidf_ctes("t", "texts", "text", True, 0.5, 1_000, "split = 'train'")]))
def tfidf_vocab_capped(spark, sf):
    _, vocab = fitted(combined(spark, sf), True, 0.5, 1_000)
    return vocab.select("term", "df", "cf", r6("idf"))


@query("tfidf_fit_transform", sql(["split15"], "SELECT id, term, round(tfidf, 6) AS tfidf FROM t WHERE split = 'train'", LIBRARY))
def tfidf_fit_transform(spark, sf):
    rows, vocab = fitted(serialized(spark, sf), False, 1.0, 120_000)
    return tfidf.tfidf_weights(rows.filter("split = 'train'"), vocab).select("id", "term", r6("tfidf"))


@query("tfidf_transform", sql(["split20"], "SELECT id, term, round(tfidf, 6) AS tfidf FROM t WHERE split = 'valid'", NOTEBOOK))
def tfidf_transform(spark, sf):
    rows, vocab = fitted(combined(spark, sf), True, 0.95, 10_000)
    return tfidf.tfidf_weights(rows.filter("split = 'valid'"), vocab).select("id", "term", r6("tfidf"))


@query("tfidf_vectors", sql(["split20"], """
SELECT x.id, count(t.term) AS n_terms, CAST((SELECT count(*) FROM t_vocab) AS BIGINT) AS size, round(coalesce(max(t.tfidf), 0.0), 6) AS top
FROM texts x LEFT JOIN t ON t.id = x.id GROUP BY x.id""", NOTEBOOK))
def tfidf_vectors(spark, sf):
    rows, vocab = fitted(combined(spark, sf), True, 0.95, 10_000)
    dense = tfidf.tfidf_vectors(rows, tfidf.hold(vocab)).select("id", vector_to_array("features").alias("v"))
    return dense.select(
        "id", big(F.size(F.filter("v", lambda x: x != 0)), "n_terms"), big(F.size("v"), "size"), r6(F.array_max("v"), "top")
    )


BAYES = NOTEBOOK + [
    "bayes_sums AS (SELECT v.term, " + ", ".join(
        f"coalesce(sum(t.tfidf) FILTER (t.label = '{name}' AND t.split = 'train'), 0) AS s{i}" for i, name in enumerate(LABELS))
    + " FROM t_vocab v LEFT JOIN t ON t.term = v.term GROUP BY v.term)",
    "bayes_totals AS (SELECT count(*) AS v, sum(s0) AS t0, sum(s1) AS t1, sum(s2) AS t2 FROM bayes_sums)",
    "theta AS (SELECT term, " + ", ".join(f"ln((s{i} + 0.1) / (t{i} + 0.1 * v)) AS th{i}" for i in range(3)) + " FROM bayes_sums, bayes_totals)",
    "prior AS (SELECT " + ", ".join(
        f"ln(count(*) FILTER (label = '{name}') / count(*)) AS p{i}" for i, name in enumerate(LABELS)) + " FROM texts WHERE split = 'train')",
    "bayes_scores AS (SELECT x.id, x.label, " + ", ".join(
        f"coalesce(sum(t.tfidf * th{i}), 0) + max(p{i}) AS s{i}" for i in range(3))
    + " FROM texts x CROSS JOIN prior LEFT JOIN t ON t.id = x.id LEFT JOIN theta h ON h.term = t.term WHERE x.split = 'valid' GROUP BY x.id, x.label)",
    f"bayes_votes AS (SELECT *, {o.label_name(o.first_max(['s0', 's1', 's2']))} AS predict_label FROM bayes_scores)",
]


def bayes_votes(spark, sf):
    rows, vocab = fitted(combined(spark, sf), True, 0.95, 10_000)
    held = tfidf.hold(vocab)
    weights = materialize(tfidf.tfidf_rows(rows, held))
    theta, priors = bayes.bayes_fit(weights.filter("split = 'train'"), len(held.value))
    return bayes.bayes_predict(weights.filter("split = 'valid'"), theta, priors)


@query("naive_bayes", sql(["split20"], "SELECT id, label, predict_label, " + ", ".join(f"round(s{i}, 5) AS score_{n}" for i, n in enumerate(LABELS)) + " FROM bayes_votes", BAYES))
def naive_bayes(spark, sf):
    v = bayes_votes(spark, sf)
    return v.select("id", "label", "predict_label", *[F.round(F.col("score")[i], 5).alias(f"score_{n}") for i, n in enumerate(LABELS)])


@query("naive_bayes_scores", sql(["split20"], f"SELECT {SCORE_COLUMNS} FROM per_label", BAYES + [o.scores_cte("per_label", "bayes_votes")]))
def naive_bayes_scores(spark, sf):
    return ev.scores(bayes_votes(spark, sf)).select(r6("macro_f1"), r6("weighted_f1"), r6("accuracy"))


# --- iterative fits -----------------------------------------------------------
# Tree counts, layers and iterations are the defaults of operators.models; the vocabulary is that of the notebook setting.
# SQL cannot fit these models, but it knows which rows must come back and what each must say: ``replayed``, the prediction is what the
# stored coefficients, nodes or weights give when they are worked out apart from the library; ``optimal``, the gradient of the
# loss at the fit is next to nothing.

FEATURES = 10_000


def expect(split, *flags):
    """One row per validation row of ``split``, every flag true."""
    return sql([split], f"SELECT id, label, {', '.join(f'true AS {f}' for f in flags)} FROM {split} WHERE split = 'valid'")


def replayed(again, model):
    """(id, label, replayed): whether the rows worked out again have the model's own prediction."""
    own = model.transform(again).select("id", "label", "again", F.col("prediction").cast("int").alias("p"))
    return own.select("id", "label", (F.col("again") == F.col("p")).alias("replayed"))


def optimal(share):
    return F.lit(bool(share <= replay.TOLERANCE)).alias("optimal")


@query("classical_model", expect("split15", "replayed", "optimal"))
def classical_model(spark, sf):
    df = serialized(spark, sf)
    model = md.ClassicalModel.fit(df.filter("split = 'train'"), "text")
    vectors = model.space.vectors(df.filter("split = 'valid'"), "text", keep=["label"])
    return replayed(replay.linear_again(vectors, model.classifier), model.classifier).select("*", optimal(model.optimality()))


def notebook_vectors(spark, sf):
    train, valid, space = md.split_vectors(combined(spark, sf), "text", FEATURES)
    return train, valid.drop("split"), md.estimators(train.count(), space.size)


@query("logreg_baseline", expect("split20", "replayed", "optimal"))
def logreg_baseline(spark, sf):
    train, valid, known = notebook_vectors(spark, sf)
    estimator = known["Logistic Regression"]
    model = estimator.fit(train)
    return replayed(replay.linear_again(valid, model), model).select("*", optimal(md.linear_optimality(model, train, estimator.getRegParam())))


@query("linear_svm", expect("split20", "replayed", "optimal"))
def linear_svm(spark, sf):
    """``replayed``: the margins in plain joins and sums give the same prediction."""
    train, valid, known = notebook_vectors(spark, sf)
    model = known["Linear SVM"].fit(train)
    start = known["Linear SVM"].gradient_share(train, model)
    table = spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(model.coefficients)], "term_idx int, w0 double, w1 double, w2 double")
    margin = tfidf.unrolled(boosting.entries_of(valid, "id"), "term_idx", "tfidf").join(table, "term_idx").groupBy("id").agg(
        *[F.sum(F.col("tfidf") * F.col(f"w{c}")).alias(f"m{c}") for c in range(3)])
    scores = F.array(*[F.round(F.coalesce(f"m{c}", F.lit(0.0)) + float(model.intercept[c]), 9) for c in range(3)])
    again = model.transform(valid).join(margin, "id", "left").select("id", "label", F.col("prediction").cast("int").alias("p"), scores.alias("z"))
    return again.select("id", "label", (F.get("z", "p") == F.array_max("z")).alias("replayed"), optimal(start))


@query("random_forest", expect("split20", "replayed"))
def random_forest(spark, sf):
    """``replayed``: from the nodes in the files of the saved model."""
    train, valid, known = notebook_vectors(spark, sf)
    model = known["Random Forest"].fit(train)
    path = scratch_path(spark, "forest")
    model.write().save(path)
    return replayed(replay.trees_again(valid, replay.forest_nodes(spark, path)), model)


@query("gradient_boosting", expect("split20", "replayed"))
def gradient_boosting(spark, sf):
    """``replayed``: from the table of nodes, by thresholds on the weights themselves."""
    train, valid, known = notebook_vectors(spark, sf)
    model = known["Gradient Boosting"].fit(train)
    return replayed(replay.trees_again(valid, materialize(replay.boosting_nodes(spark, model)), model.start), model)


@query("mlp", expect("split20", "replayed"))
def mlp(spark, sf):
    train, valid, known = notebook_vectors(spark, sf)
    estimator = known["MLP (TF-IDF)"]
    model = estimator.fit(train)
    return replayed(replay.network_again(valid, estimator.getLayers(), model.weights.toArray()), model)


@query("train_and_compare", sql(["split20"], """
SELECT unnest(['Logistic Regression', 'Multinomial NB', 'Linear SVM', 'Random Forest', 'Gradient Boosting', 'MLP (TF-IDF)']) AS model_name,
  count(*) AS n, true AS in_order FROM split20 WHERE split = 'valid'"""))
def train_and_compare(spark, sf):
    """All six models in full size. ``in_order``: scores are shares, and none but a higher macro-F1 is ranked before."""
    train, valid, space = md.split_vectors(combined(spark, sf), "text", FEATURES)
    board = materialize(md.train_and_compare(train, valid, space.size))
    place = Window.orderBy(F.desc("f1_macro"), "model_name")  # one row per model
    share = lambda c: F.col(c).between(0, 1)
    falling = F.coalesce(F.lag("f1_macro").over(place) >= F.col("f1_macro"), F.lit(True))
    return board.select("model_name", "n", (falling & share("accuracy") & share("f1_macro") & share("f1_weighted")).alias("in_order"))


SETTINGS = [
    md.Setting(lowercase=low, max_df=max_df, max_features=size, c=c)
    for low, max_df, size in ((False, 1.0, 120_000), (True, 0.95, 10_000)) for c in (0.5, 2.0)
]


@query("param_sweep", sql(["split15"], f"SELECT unnest([{', '.join(o.quoted(s.name) for s in SETTINGS)}]) AS run_name, count(*) AS n, true AS chosen_well "
    "FROM split15 WHERE split = 'valid'"))
def param_sweep(spark, sf):
    """Two vectorisers with two strengths each. ``chosen_well``: the setting marked as best has the highest macro-F1, and is the only one marked."""
    found = materialize(md.param_sweep(serialized(spark, sf), "text", SETTINGS))
    top = found.agg(F.struct(F.max("macro_f1").alias("f1"), F.count_if("best").alias("marked")).alias("t")).scalar()
    well = (top["marked"] == 1) & (~F.col("best") | (F.round(F.col("macro_f1"), 12) == F.round(top["f1"], 12)))
    return found.select("run_name", "n", well.alias("chosen_well"))


@query("predict_classical", sql(["dialogues"], "SELECT id, context, prompt, response, true AS replayed FROM dialogues"))
def predict_classical(spark, sf):
    """Train on the labelled triplets, predict the dialogues: the submission table, each prediction worked out again from the coefficients."""
    model = md.ClassicalModel.fit(pp.serialize(fx.triplets(spark, sf)))
    test = pp.serialize(fx.dialogue_triplets(spark, sf))
    out = model.predict(test, keep=["context", "prompt", "response"])
    again = replay.linear_again(model.space.vectors(test, "serialized_text"), model.classifier).select("id", id_to_label(F.col("again")).alias("again"))
    return out.join(again, "id").select("id", "context", "prompt", "response", (F.col("predict_label") == F.col("again")).alias("replayed"))


@query("predict_transformer", texts_sql(["transformer_scores"], f"""
SELECT t.id, t.prompt, t.response, {o.label_name(o.first_max(['t0', 't1', 't2']))} AS predict_label
FROM transformer_scores s JOIN triplets t ON t.id = s.id"""))
def predict_transformer(spark, sf):
    votes = fx.text_logits(spark, sf)["transformer"].select("id", pr.argmax_label(pr.softmax(F.col("logits"))).alias("predict_label"))
    return fx.texts(spark, sf).join(votes, "id").select("id", "prompt", "response", "predict_label")


@query("predict_hybrid", texts_sql(["sources"], f"""
SELECT t.id, t.prompt, t.response, {o.label_name(o.first_max([f'(0.2::DOUBLE * c{j} + 0.3::DOUBLE * t{j} + 0.5::DOUBLE * r{j})' for j in range(3)]))} AS predict_label
FROM sources s JOIN triplets t ON t.id = s.id"""))
def predict_hybrid(spark, sf):
    parts = {name: z.select("id", pr.softmax(F.col("logits")).alias("proba")) for name, z in fx.text_logits(spark, sf).items()}
    parts["rule"] = ft.rule_proba(ft.rule_features(fx.texts(spark, sf), fx.CUES, fx.HINTS)).select("id", "proba")
    voted = bl.blend_predict(bl.join_sources(parts), (0.2, 0.3, 0.5))
    return fx.texts(spark, sf).join(voted.select("id", "predict_label"), "id").select("id", "prompt", "response", "predict_label")
