"""Boosting, the linear passes and the term store against plain numpy."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F, types as T

from groundcheck.operators import boosting as bo, linear, models as md, replay, tfidf

K = 3


def sparse_table(n=90, features=12, seed=1):
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, features)) < 0.4, r.integers(1, 6, (n, features)) / 5.0, 0.0)
    y = np.where(x[:, 0] > 0.5, 2, np.where(x[:, 1] + x[:, 2] > 0.6, 1, 0))
    rows = [(str(i), int(c), ["no", "intrinsic", "extrinsic"][c], Vectors.sparse(features, [(int(j), float(v[j])) for j in np.flatnonzero(v)])) for i, (v, c) in enumerate(zip(x, y))]
    return x, y, rows


def frame(spark, rows):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("label_id", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema)


def plain_boosting(x, y, rounds, depth, rate):
    """Every cut between different values, exact; the same gains, ties and Newton leaves."""
    start = np.log(np.maximum(np.bincount(y, minlength=K) / len(y), 1e-12))
    raw = np.tile(start, (len(y), 1))
    for _ in range(rounds):
        p = bo.probabilities(raw)
        step = np.zeros_like(raw)
        for c in range(K):
            r = (y == c) - p[:, c]
            h = np.abs(r) * (1 - np.abs(r))
            stack = [(np.arange(len(y)), 0)]
            while stack:
                rows, d = stack.pop()
                best = (0.0, None)
                for j in range(x.shape[1]) if d < depth else ():
                    for cut in np.unique(x[rows, j])[:-1]:
                        left = x[rows, j] <= cut
                        a, b = r[rows[left]], r[rows[~left]]
                        gain = round(len(a) * len(b) / (len(a) + len(b)) * (a.mean() - b.mean()) ** 2, 10)
                        if gain > best[0]:
                            best = (gain, (j, cut))
                if best[1] is None:
                    step[rows, c] = (K - 1) / K * r[rows].sum() / h[rows].sum() if h[rows].sum() > 1e-12 else 0.0
                else:
                    left = x[rows, best[1][0]] <= best[1][1]
                    stack += [(rows[left], d + 1), (rows[~left], d + 1)]
        raw += rate * step
    return raw


@pytest.mark.parametrize("block_rows, shares, refresh", [(1024, 1, 10), (16, 3, 2)])
def test_boosting_equals_the_plain_form(spark, block_rows, shares, refresh):
    x, y, rows = sparse_table()
    df = frame(spark, rows).repartition(4)
    model = bo.SoftmaxBoosting(rounds=4, depth=3, refresh=refresh, block_rows=block_rows, shares=shares).fit(df)
    want = plain_boosting(x, y, 4, 3, 0.1)
    got = {r.id: (r.proba, r.prediction) for r in model.transform(df).collect()}
    p = bo.probabilities(want)
    assert all(np.allclose(got[str(i)][0], p[i], atol=1e-8) and got[str(i)][1] == p[i].argmax() for i in range(len(y)))
    again = replay.trees_again(df, replay.boosting_nodes(spark, model), model.start)
    assert {r.id: r.again for r in again.collect()} == {i: int(v[1]) for i, v in got.items()}


def test_boosting_of_little(spark):
    _, _, rows = sparse_table()
    one = frame(spark, [(i, 1, "intrinsic", v) for i, _, _, v in rows[:5]])
    assert {r.prediction for r in bo.SoftmaxBoosting(rounds=2, depth=2).fit(one).transform(one).collect()} == {1.0}
    none = bo.SoftmaxBoosting(rounds=2).fit(one.limit(0))
    assert none.trees.feature.max() == -1


def test_many_values_share_bins():
    bins = bo.Bins(np.array([[1.0, 2.0, np.inf], [np.inf] * 3]))
    assert bins.cells(np.array([0, 0, 0, 0, 1]), np.array([0.5, 1.0, 1.5, 9.0, 7.0])).tolist() == [0, 0, 1, 2, 4]


def test_svm_reaches_the_optimum(spark):
    x, y, rows = sparse_table(60, 6, 3)
    df = frame(spark, rows).repartition(3)
    svm = linear.SquaredHingeSVM(tolerance=1e-8)
    model = svm.fit(df)
    assert svm.gradient_share(df, model) < 1e-7
    z = x @ model.coefficients + model.intercept
    sign = np.where(np.arange(K) == y[:, None], 1.0, -1.0)
    value = lambda w, b: (np.maximum(1 - sign * (x @ w + b), 0) ** 2).sum() + (w * w).sum() / 2 + (b * b).sum() / 2
    best = value(model.coefficients, model.intercept)
    r = np.random.default_rng(0)
    assert all(value(model.coefficients + 1e-2 * r.normal(size=model.coefficients.shape), model.intercept) > best for _ in range(20))
    assert {q.id: q.prediction for q in model.transform(df).collect()} == {str(i): float(c) for i, c in enumerate(z.argmax(1))}


def test_gradients_match_differences(spark):
    x, y, rows = sparse_table(40, 5, 4)
    df = frame(spark, rows).selectExpr("features", "label_id", "cast(1 + label_id as double) AS weight")
    r = np.random.default_rng(5)
    w, b = r.normal(size=(5, K)), r.normal(size=K)
    for loss in (linear.softmax_loss, linear.squared_hinge_loss):
        value, gradient, by_class = linear.loss_pass(df, w, b, loss)
        plain = lambda w, b: loss(x @ w + b, y, 1.0 + y)[0]
        assert math.isclose(value, plain(w, b))
        for j, c in ((0, 0), (3, 2)):
            e = np.zeros_like(w)
            e[j, c] = 1e-6
            assert math.isclose(gradient[j, c], (plain(w + e, b) - plain(w - e, b)) / 2e-6, rel_tol=1e-4, abs_tol=1e-5)
        d = np.array([1e-6, 0, 0])
        assert math.isclose(by_class[0], (plain(w, b + d) - plain(w, b - d)) / 2e-6, rel_tol=1e-4, abs_tol=1e-5)


def test_replays_agree_with_the_library(spark, tmp_path):
    _, _, rows = sparse_table()
    df = frame(spark, rows)
    known = md.estimators(90, 12, rf_trees=5, rf_depth=4, mlp_hidden=(6, 4), mlp_iter=15)
    forest = known["Random Forest"].fit(df)
    forest.write().save(str(tmp_path / "forest"))
    network = known["MLP (TF-IDF)"].fit(df)
    logistic = known["Logistic Regression"].fit(df)
    for model, again in (
        (forest, replay.trees_again(df, replay.forest_nodes(spark, str(tmp_path / "forest")))),
        (network, replay.network_again(df, known["MLP (TF-IDF)"].getLayers(), network.weights.toArray())), (logistic, replay.linear_again(df, logistic)),
    ):
        assert all(r.again == r.prediction for r in model.transform(again).collect())
    assert md.linear_optimality(logistic, df, known["Logistic Regression"].getRegParam()) < replay.TOLERANCE
    wrong = md.logistic_regression(90, 1.0, 1).fit(df)
    assert md.linear_optimality(wrong, df, known["Logistic Regression"].getRegParam()) > 10 * replay.TOLERANCE


def test_terms_are_counted_in_their_row(spark):
    r = random.Random(1)
    texts = ["", None, "one", "aa bb aa bb aa", "x y", " ".join(r.choices(["aa", "bb", "cc", "Dd", "é1", "f"], k=500))] + [" ".join(r.choices("abcdef", k=4)) for _ in range(5)]
    got = tfidf.term_rows(spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3), "t", True)
    assert "Exchange" not in tfidf.term_rows(spark.range(3).selectExpr("id", "'a' AS t"), "t")._jdf.queryExecution().executedPlan().toString()
    for row in got.collect():
        words = re.findall(r"\w{2,}", (texts[row.id] or "").lower())
        want = collections.Counter(words) + collections.Counter(f"{a} {b}" for a, b in zip(words, words[1:]))
        assert dict(zip(row.terms, row.tf)) == want and len(row.terms) == len(want)


def test_slices_keep_every_row():
    rows = pa.RecordBatch.from_pydict({"id": list(range(6)), "w": [["a"] * n for n in (3, 0, 50, 1, 1, 9)]})
    parts = list(tfidf._slices(rows, "w", 4))
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(6)) and len(parts) > 2


def test_a_sweep_shares_what_settings_share(spark):
    r = random.Random(6)
    rows = []
    for i in range(150):
        label = ["no", "no", "intrinsic", "extrinsic"][i % 4]
        rows.append((str(i), label, " ".join([label + "Word"] * r.randint(1, 3) + r.choices(["aa", "Bb", "cc"], k=5)), "train" if i % 5 else "valid"))
    df = spark.createDataFrame(rows, "id string, label string, text string, split string")
    settings = [md.Setting(lowercase=low, max_features=50, c=c, max_iter=30) for low in (False, True) for c in (1e-4, 2.0)]
    got = {x.run_name: x for x in md.param_sweep(df, "text", settings).collect()}
    assert set(got) == {s.name for s in settings} and {x.n for x in got.values()} == {30}
    best = [x for x in got.values() if x.best]
    assert len(best) == 1 and best[0].macro_f1 == max(x.macro_f1 for x in got.values())


def test_side_by_side_raises_the_failure(spark):
    def fail():
        raise KeyError("x")

    assert md.side_by_side({"a": lambda: 1, "b": lambda: 2}) == {"a": 1, "b": 2}
    with pytest.raises(KeyError):
        md.side_by_side({"a": lambda: 1, "b": fail})


def test_network_gradient_and_fit(spark):
    from groundcheck.operators import network

    x, y, rows = sparse_table(70, 6, 7)
    df = frame(spark, rows).repartition(3).selectExpr("features", "label_id", "1.0D AS weight")
    layers = [6, 4, K]
    start = np.random.default_rng(3).normal(size=6 * 4 + 4 + 4 * K + K)
    value, gradient = network.network_pass(linear.packed(df), layers, start)
    (w1, b1), (w2, b2) = network.matrices(layers, start)
    plain = lambda: linear.softmax_loss(1 / (1 + np.exp(-(x @ w1 + b1))) @ w2 + b2, y, np.ones(len(y)))[0]  # noqa: E731  (views of start)
    assert math.isclose(value, plain())
    for j in (0, 13, 25, 30, len(start) - 1):
        up, down = [(start.__setitem__(j, start[j] + e), plain())[1] for e in (1e-6, -2e-6)]
        start[j] += 1e-6
        assert math.isclose(gradient[j], (up - down) / 2e-6, rel_tol=1e-4, abs_tol=1e-5)
    model = md.estimators(70, 6, mlp_hidden=(6, 4), mlp_iter=60)["MLP (TF-IDF)"].fit(df)
    right = np.mean([r.prediction == r.label_id for r in model.transform(df).collect()])
    assert right > 0.8 and model.layers == [6, 6, 4, K]


def test_passes_do_not_pay_for_tasks_that_grow_with_the_rows(spark):
    many = spark.range(0, 400, 1, 40)
    assert md.for_passes(many, 80_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert md.for_passes(many, 3_000).rdd.getNumPartitions() == 2


def test_packed_rows_keep_empty_vectors(spark):
    rows = [(str(i), i % K, "no", Vectors.sparse(4, [] if i % 3 else [(i % 4, 2.0)])) for i in range(12)]
    df = frame(spark, rows).selectExpr("features", "label_id", "1.0D AS weight").coalesce(1)
    w, b = np.arange(12.0).reshape(4, K), np.ones(K)
    x = np.stack([r[3].toArray() for r in rows])
    assert math.isclose(linear.loss_pass(linear.packed(df), w, b, linear.softmax_loss)[0], linear.softmax_loss(x @ w + b, np.arange(12) % K, np.ones(12))[0])


def test_a_batch_is_counted_in_small_slices():
    words = pa.ListArray.from_arrays(pa.array(range(0, 1_000_001, 500), pa.int32()), pa.array(["aa"] * 1_000_000))
    assert max(len(p.column("w").flatten()) for p in tfidf._slices(pa.RecordBatch.from_pydict({"w": words}), "w")) <= 200_000


def test_a_task_sends_each_sum_once(spark, monkeypatch):
    _, y, rows = sparse_table(96, 6)
    df = frame(spark, rows).coalesce(1)
    bins = bo.Bins(np.full((6, 3), np.inf))
    blocks = bo.block_table(df, spark.sparkContext.broadcast(bins), np.zeros(K), 8)
    kind = type(blocks)
    held = []
    grouped = kind.groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *c: (held.extend(self.collect()), grouped(self, *c))[1])
    trees = bo.Trees.empty(1, 2)
    bo.level_pass(blocks, trees.part(0, 0), trees, 0, None, 4, 0.1, 1)
    keys = [k for r in held for k in np.frombuffer(bytes(r["key"]), np.int64) if k >= 0]
    assert len(keys) == len(set(keys)) == 6 * K  # 12 blocks; each sent its own before


def test_each_share_meets_in_a_task_of_its_own(spark):
    names = bo.share_keys(spark, 8)
    parts = spark.createDataFrame([(int(k),) for k in names], "share int").repartition(8, "share").select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() == len(set(names)) == 8


def test_blocks_are_cut_by_entries_and_sorted_by_cell(spark, monkeypatch):
    _, y, rows = sparse_table(96, 6)
    sizes = [len(v.indices) for *_, v in rows]
    monkeypatch.setattr(bo, "BLOCK_ENTRIES", 20)
    blocks = bo.block_table(frame(spark, rows).coalesce(1), spark.sparkContext.broadcast(bo.Bins(np.full((6, 3), np.inf))), np.zeros(K), 8192).collect()
    assert sum(b.rows for b in blocks) == 96 and sum(len(b.place) // 4 for b in blocks) == sum(sizes) and len(blocks) > 3
    for b in blocks:
        code = np.frombuffer(bytes(b.code), np.int32)
        assert (np.diff(code) >= 0).all() and (len(code) <= 20 or b.rows == 1)


def test_sums_of_equal_keys():
    key, sums = bo.added_up(np.array([5, 7, 2, 5]), np.arange(12.0).reshape(4, 3))
    assert key.tolist() == [2, 5, 7] and sums.tolist() == [[6, 7, 8], [9, 11, 13], [3, 4, 5]]
    assert len(bo.added_up(np.zeros(0, np.int64), np.zeros((0, 3)))[0]) == 0
