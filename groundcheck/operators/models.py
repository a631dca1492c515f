"""Classifiers on TF-IDF vectors with Spark ML, and their comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

from pyspark import Broadcast, inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression, LogisticRegressionModel, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import LABELS, id_to_label, label_to_id
from ..session import materialize
from . import tfidf
from .boosting import SoftmaxBoosting
from .evaluate import scores
from .linear import SquaredHingeSVM, softmax_gradient
from .network import SigmoidNetwork

KEEP = ["label", "split"]
ROWS_PER_TASK = 2_000


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``(label, n, weight)`` with the balanced weight rows / (classes * n)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("t")).scalar()
    return counts.select("label", "n", (totals["rows"] / (totals["classes"] * F.col("n"))).alias("weight"))


def for_passes(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in at most one partition per ``ROWS_PER_TASK`` rows and no more than there are cores, joined without a shuffle.

    An iterative fit is hundreds of short passes, and each pays for every task a gradient of the model's size: that cost must not grow with the rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(cores, -(-rows // ROWS_PER_TASK))))


def training_rows(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """``vectors`` (label) with ``label_id`` and the balanced ``weight`` of the same rows' ``labels``."""
    return with_class_weight(vectors, labels).withColumn("label_id", label_to_id(F.col("label")))


def linear_optimality(model: LogisticRegressionModel, rows: DataFrame, strength: float) -> float:
    """The largest gradient entry of a fitted logistic regression on its stored training ``rows``, as a share of the one at zero."""
    weighted = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(1.0))
    left, start = softmax_gradient(weighted, model.coefficientMatrix.toArray().T.copy(), model.interceptVector.toArray(), strength)
    return left / start if start else 0.0


def with_class_weight(df: DataFrame, train: DataFrame) -> DataFrame:
    """Add ``weight``. The weight table has one row per label of the domain: broadcast."""
    known = class_weights(train.filter(F.col("label").isin(LABELS)))
    return df.join(F.broadcast(known.select("label", "weight")), "label")


@dataclass
class VectorSpace:
    """A fitted TF-IDF vocabulary, kept as a table and held by the tasks that use it."""

    vocab: DataFrame
    lowercase: bool

    @cached_property
    def held(self) -> Broadcast:
        return tfidf.hold(self.vocab)

    @property
    def size(self) -> int:
        return len(self.held.value)

    def vectors(self, df: DataFrame, column: str, row_id: str = "id", keep: list[str] | None = None) -> DataFrame:
        """``(id, *keep, features)`` in one projection over ``df``."""
        return tfidf.tfidf_vectors(tfidf.term_rows(df, column, self.lowercase, row_id, keep), self.held)


def fit_vector_space(
    rows: DataFrame, lowercase: bool = False, min_df: int = 2, max_df: float = 1.0, max_features: int = 120_000
) -> VectorSpace:
    """The vocabulary of stored ``term_rows``, which were counted with the same ``lowercase``."""
    return VectorSpace(materialize(tfidf.tfidf_vocab(rows, min_df, max_df, max_features)), lowercase)


def logistic_regression(rows: int, c: float = 1.0, max_iter: int = 1000, weighted: bool = False) -> LogisticRegression:
    """Multinomial, L2. Spark minimises the mean loss, so strength C becomes 1 / (C * rows); balanced
    weights sum to the number of rows."""
    lr = LogisticRegression(
        family="multinomial", labelCol="label_id", maxIter=max_iter, regParam=1.0 / (c * rows),
        elasticNetParam=0.0, standardization=False, tol=1e-9,
    )
    return lr.setWeightCol("weight") if weighted else lr


@dataclass
class ClassicalModel:
    """TF-IDF and balanced multinomial logistic regression on the serialized text."""

    space: VectorSpace
    classifier: LogisticRegressionModel
    #: what the fit saw, for ``optimality``; a loaded model has neither
    rows: DataFrame | None = None
    strength: float | None = None

    @classmethod
    def fit(
        cls, train: DataFrame, column: str = "serialized_text", c: float = 2.0, max_iter: int = 2500,
        max_features: int = 120_000, min_df: int = 2,
    ) -> "ClassicalModel":
        # the terms are counted once, and read from storage by the vocabulary and by the vectors
        rows = materialize(tfidf.term_rows(train, column, keep=["label"]))
        space = fit_vector_space(rows, min_df=min_df, max_features=max_features)
        # the optimiser passes over the rows once per iteration: read them from storage, not from the texts
        n = rows.count()
        stored = materialize(for_passes(training_rows(tfidf.tfidf_vectors(rows, space.held), rows), n))
        estimator = logistic_regression(n, c, max_iter, weighted=True)
        return cls(space, estimator.fit(stored), stored, estimator.getRegParam())

    def optimality(self) -> float:
        """The largest entry of the loss gradient at the fitted coefficients, as a share of the one at zero: one pass over the training rows."""
        return linear_optimality(self.classifier, self.rows, self.strength)

    def predict(self, df: DataFrame, column: str = "serialized_text", keep: list[str] | None = None) -> DataFrame:
        """``(id, *keep, proba, predict_label)``."""
        out = self.classifier.transform(self.space.vectors(df, column, keep=keep))
        return out.select(
            "id", *(keep or []), vector_to_array("probability").alias("proba"),
            id_to_label(F.col("prediction").cast("int")).alias("predict_label"),
        )

    def save(self, path: str) -> None:
        self.classifier.write().overwrite().save(f"{path}/classifier")
        self.space.vocab.write.mode("overwrite").parquet(f"{path}/vocab")

    @classmethod
    def load(cls, spark, path: str) -> "ClassicalModel":
        space = VectorSpace(spark.read.parquet(f"{path}/vocab"), lowercase=False)
        return cls(space, LogisticRegressionModel.load(f"{path}/classifier"))


def estimators(rows: int, features: int, **sizes) -> dict:
    """The compared classifiers by name. ``sizes`` overrides tree counts, depths and layers."""
    size = {
        "rf_trees": 100, "rf_depth": 20, "gbt_rounds": 100, "gbt_depth": 5, "svm_passes": 2000,
        "mlp_hidden": (512, 256, 128), "mlp_iter": 30, "seed": 42, **sizes,
    }
    label = {"labelCol": "label_id"}
    return {
        "Logistic Regression": logistic_regression(rows),
        "Multinomial NB": NaiveBayes(smoothing=0.1, **label),
        "Linear SVM": SquaredHingeSVM(c=1.0, max_passes=size["svm_passes"]),
        "Random Forest": RandomForestClassifier(
            numTrees=size["rf_trees"], maxDepth=size["rf_depth"], seed=size["seed"], **label
        ),
        "Gradient Boosting": SoftmaxBoosting(rounds=size["gbt_rounds"], depth=size["gbt_depth"]),
        "MLP (TF-IDF)": SigmoidNetwork([features, *size["mlp_hidden"], len(LABELS)], size["mlp_iter"], size["seed"]),
    }


def predictions(model, vectors: DataFrame) -> DataFrame:
    """``(id, label, predict_label)``."""
    return model.transform(vectors).select("id", "label", id_to_label(F.col("prediction").cast("int")).alias("predict_label"))


def split_vectors(
    df: DataFrame, column: str, max_features: int, max_df: float = 0.95, lowercase: bool = True
) -> tuple[DataFrame, DataFrame, VectorSpace]:
    """Train and valid vectors of a table with ``label`` and ``split``, stored for repeated passes."""
    rows = materialize(tfidf.term_rows(df, column, lowercase, keep=KEEP))
    space = fit_vector_space(rows.filter(F.col("split") == "train"), lowercase, max_df=max_df, max_features=max_features)
    return *stored_split(tfidf.tfidf_vectors(rows, space.held)), space


def stored_split(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors of the training rows, in few files for many passes, and of the validation rows."""
    known = materialize(vectors.withColumn("label_id", label_to_id(F.col("label"))))
    train = known.filter(F.col("split") == "train")
    return materialize(for_passes(train, train.count())), known.filter(F.col("split") == "valid")


def side_by_side(tasks: dict, parallelism: int = 4) -> dict:
    """``{name: task()}``, several at a time. A fit is a chain of short jobs, each too small for all cores: their gaps fill each other.

    The first failure is raised once the running tasks have ended.
    """
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        run = inheritable_thread_target(SparkSession.active())(lambda name: (name, tasks[name]()))
        return dict(pool.map(run, list(tasks), chunksize=1))


def train_and_compare(
    train: DataFrame, valid: DataFrame, features: int, names: list[str] | None = None, parallelism: int = 4, **sizes
) -> DataFrame:
    """``(model_name, n, accuracy, f1_macro, f1_weighted)`` by falling macro-F1; ``n`` validation rows were scored.

    The predictions of each model are stored, so a fit is paid once whatever is read of the result.
    """
    models = estimators(train.count(), features, **sizes)
    chosen = names or list(models)
    stored = side_by_side({n: lambda n=n: materialize(predictions(models[n].fit(train), valid).withColumn("model_name", F.lit(n))) for n in chosen}, parallelism)
    every = reduce(DataFrame.unionByName, [stored[n] for n in chosen])
    return scores(every, by=["model_name"]).select(
        "model_name", "n", "accuracy", F.col("macro_f1").alias("f1_macro"), F.col("weighted_f1").alias("f1_weighted")
    ).orderBy(F.desc("f1_macro"), "model_name")


@dataclass(frozen=True)
class Setting:
    """One point of a sweep: how the texts become vectors, and how strongly the classifier is held back."""

    lowercase: bool = False
    min_df: int = 2
    max_df: float = 1.0
    max_features: int = 120_000
    c: float = 2.0
    weighted: bool = True
    max_iter: int = 2500

    @property
    def name(self) -> str:
        return f"lower={int(self.lowercase)}_df={self.min_df}-{self.max_df:g}_features={self.max_features}_C={self.c:g}_weighted={int(self.weighted)}"


def param_sweep(df: DataFrame, column: str, settings: list[Setting], parallelism: int = 4) -> DataFrame:
    """``(run_name, n, macro_f1, accuracy, best)`` of every setting, fitted on the training rows of ``df`` and scored on the validation rows.

    Settings share what they have in common: the terms are counted once per ``lowercase``, a vocabulary and its vectors are stored once per
    vectoriser, and only the fits differ. ``best`` marks the highest macro-F1 (ties: the setting listed first).
    """
    counted = {low: materialize(tfidf.term_rows(df, column, low, keep=KEEP)) for low in sorted({s.lowercase for s in settings})}
    spaces = list(dict.fromkeys((s.lowercase, s.min_df, s.max_df, s.max_features) for s in settings))

    def vectorised(low: bool, min_df: int, max_df: float, features: int) -> tuple[DataFrame, DataFrame]:
        rows = counted[low]
        space = fit_vector_space(rows.filter(F.col("split") == "train"), low, min_df, max_df, features)
        train, valid = stored_split(tfidf.tfidf_vectors(rows, space.held))
        return materialize(for_passes(training_rows(train, train), train.count())), valid

    vectors = side_by_side({key: lambda key=key: vectorised(*key) for key in spaces}, parallelism)

    def run(place: int, s: Setting) -> DataFrame:
        train, valid = vectors[s.lowercase, s.min_df, s.max_df, s.max_features]
        model = logistic_regression(train.count(), s.c, s.max_iter, s.weighted).fit(train)
        return materialize(predictions(model, valid).select("id", "label", "predict_label", F.lit(s.name).alias("run_name"), F.lit(place).alias("place")))

    stored = side_by_side({i: lambda i=i, s=s: run(i, s) for i, s in enumerate(settings)}, parallelism)
    found = scores(reduce(DataFrame.unionByName, stored.values()), by=["run_name", "place"])
    # one row per setting
    first = found.agg(F.max_by("run_name", F.struct(F.round("macro_f1", 12), -F.col("place"))).alias("b")).scalar()
    return found.select("run_name", "n", "macro_f1", "accuracy", (F.col("run_name") == first).alias("best")).orderBy(F.desc("macro_f1"), "run_name")
