"""Whitening and the pivot index against plain numpy, and over awkward tables."""

import collections

import numpy as np
import pytest

from groundcheck.llm import pivot_index, whitening
from groundcheck.llm.eigen import leading_pairs, sturm_count, tridiagonalize

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")
EXTRA = "id x w c h v cid copies perm ball near e1 e2 size component n_links n label".split()


def table(spark, rows, entry="double"):
    """(vec_id, embedding) with further columns named as the operators name theirs inside."""
    schema = f"vec_id long, embedding array<{entry}>, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], *["x"] * len(EXTRA)) for i, v in rows], schema)


UNUSABLE = [(900, None), (901, []), (902, [None, 1, 2, 3]), (903, [NAN, 1, 2, 3]), (904, [1, INF, 2, 3]), (905, [-INF, 0, 0, 0])]


# --- eigenpairs ---------------------------------------------------------------


def matrices():
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.normal(size=(40, 40)))[0]
    yield from ((n, (lambda b: b.T @ b)(r.normal(size=(n + 5, n)))) for n in (1, 2, 3, 64))
    yield "equal", np.eye(30) * 3
    yield "clusters", q @ np.diag(np.r_[np.full(12, 5.0), np.linspace(5, 5 + 1e-13, 12), np.zeros(16)]) @ q.T
    yield "diagonal", np.diag(np.arange(40.0))
    yield "rank 3, small", q[:, :3] @ np.diag([3.0, 2, 1]) @ q[:, :3].T * 1e-9
    yield "zero", np.zeros((10, 10))
    yield "block", np.kron(np.eye(4), np.array([[2.0, 1], [1, 2]]))


@pytest.mark.parametrize("name, matrix", [pytest.param(n, m, id=str(n)) for n, m in matrices()])
def test_leading_pairs(name, matrix):
    values, vectors = leading_pairs(matrix, 32)
    k, scale = min(32, len(matrix)), np.abs(matrix).max() or 1
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:k]).max() <= 1e-13 * scale * len(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale * len(matrix)


def test_sturm_count_and_empty():
    b = np.random.default_rng(2).normal(size=(30, 30))
    diagonal, off, _ = tridiagonalize(b + b.T)
    at = np.linspace(-20, 20, 41)
    assert sturm_count(diagonal, off, at).tolist() == [int((np.linalg.eigvalsh(b + b.T) < x).sum()) for x in at]
    assert leading_pairs(np.zeros((0, 0)), 4)[0].size == 0


# --- whitening ----------------------------------------------------------------


def plain_whitening(vectors, k):
    x = np.floor(64 * np.array(vectors, dtype=float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    covariance = c.T @ c / n
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1][:k], components[:, ::-1][:, :k]
    return (n * x - sums).astype(object) ** 2, c @ components / np.sqrt(values), values / np.trace(covariance)


def test_whitening(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(size=(300, 4)) @ r.normal(size=(4, 4)) + 5
    data = [(i if i % 50 else None, v) for i, v in enumerate(vectors.tolist())] + [(7, vectors[7].tolist())]
    squares, want, shares = plain_whitening([v for _, v in data], 3)
    got = whitening.whiten(table(spark, data + UNUSABLE).repartition(5), 3).toPandas()
    assert len(got) == 3 * len(data) and set(got["n"]) == {len(data)} and got["identity_error"].nunique() == 1
    assert got["identity_error"].iloc[0] < 1e-12 and got["vec_id"].isna().sum() == 3 * 6
    for j in range(3):
        rows = got[got["component"] == j + 1]
        assert np.allclose(rows["explained"], shares[j], rtol=1e-12)
        known = {i: n for n, (i, _) in enumerate(data) if i is not None}
        signs = {round(abs(a - s * want[known[int(i)], j]), 6) == 0 and s for i, a in zip(rows["vec_id"], rows["whitened"]) if i == i for s in (1, -1)}
        assert signs in ({False, 1}, {False, -1})
    by_id = got[got["component"] == 1].dropna(subset="vec_id")
    assert all(d == sum(squares[known[int(i)]]) for i, d in zip(by_id["vec_id"], by_id["deviation"]))


def test_whitening_awkward(spark):
    assert whitening.whiten(table(spark, [])).collect() == [] == whitening.whiten(table(spark, UNUSABLE)).collect()
    assert whitening.whiten(table(spark, [(1, [1, 2, 3, 4])] * 5)).collect() == []  # no variance, no component
    two = whitening.whiten(table(spark, [(1, [1, 2, 3, 4]), (2, [2, 2, 3, 4])], "float")).collect()
    assert [r.component for r in two] == [1, 1] and {round(abs(r.whitened), 9) for r in two} == {1.0} and {r.explained for r in two} == {1.0}
    with pytest.raises(ValueError, match="2 to 4"):
        whitening.whiten(table(spark, [(1, [1, 2, 3, 4]), (2, [1, 2])]))
    with pytest.raises(Exception, match="2\\^30"):
        whitening.whiten(table(spark, [(1, [1e30, 2]), (2, [1, 2])]))


def test_exact_deviation_or_error():
    x = np.array([[2**40, 0], [0, 0], [0, 5]])
    assert whitening.deviations(x, 3, x.sum(0)).tolist() == (3 * x - x.sum(0)).tolist()
    with pytest.raises(OverflowError):
        whitening.deviations(x, 1 << 30, np.array([0, 0]))


# --- pivot index --------------------------------------------------------------


def plain_links(data, threshold=0.9):
    """vec_id -> (links, smallest id reachable), all pairs compared. Rows that repeat an id share their component."""
    fine = [(i, np.array(v, dtype=float)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v in fine])
    link = unit @ unit.T >= threshold - 1e-12
    np.fill_diagonal(link, False)
    near = collections.defaultdict(set)
    for a, b in zip(*np.nonzero(link)):
        near[fine[a][0]].add(fine[b][0])
    root = {}
    for i in sorted({i for i, _ in data if i is not None}):
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = i
                stack += near[x]
    links = collections.defaultdict(list)
    for (i, _), n in zip(fine, link.sum(1)):
        links[i].append(int(n))
    return links, root


def around(r, center, cos, n):
    """Unit vectors at the given cosine to ``center``."""
    c = np.array(center) / np.linalg.norm(center)
    u = r.normal(size=(n, len(c)))
    u -= (u @ c)[:, None] * c
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return cos * c + (1 - cos**2) ** 0.5 * u


def planted(dims, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(60, dims))
    groups = [r.normal(size=(150, dims)), np.repeat(base[:1], 30, 0), around(r, base[1], 0.995, 90), 3 * around(r, base[1], 0.93, 25)]
    groups += [around(r, b, c, 6) for b, c in zip(base[2:40], np.linspace(0.86, 0.999, 38))] + [np.zeros((3, dims))]
    rows = [v.tolist() for g in groups for v in g]
    ids = r.permutation(len(rows)).tolist()
    return list(zip(ids, rows)) + [(ids[0], rows[0]), (ids[155], rows[155]), (None, rows[3]), (None, rows[200])]


@pytest.mark.parametrize("settings", [
    pytest.param(pivot_index.Settings(), id="defaults"),
    pytest.param(pivot_index.Settings(block=16), id="small blocks"),
    pytest.param(pivot_index.Settings(block=16, leaders=1, least_pivots=8, near=4), id="few pivots"),
    pytest.param(pivot_index.Settings(threshold=0.95), id="other threshold"),
])
def test_near_vectors(spark, settings):
    data = planted(24, 5)
    links, root = plain_links(data, settings.threshold)
    got = pivot_index.near_vectors(table(spark, data + [(i, None if v is None else v * 6) for i, v in UNUSABLE]).repartition(7), settings=settings).collect()
    assert len(got) == len(data) + len(UNUSABLE)
    want = sum(sum(x) for x in links.values())
    right = [r for r in got if r.vec_id in links]
    found = sum(r.n_links for r in right)
    assert all(r.n_links <= max(links[r.vec_id]) for r in right) and found >= (0.99 if settings.near == 12 else 0.9) * want
    if found == want:
        assert all(r.component_id == root[r.vec_id] for r in right)
    for r in got:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        if r.vec_id is None or r.vec_id >= 900:
            assert r.n_links == 0 and r.component_id == r.vec_id


@pytest.mark.parametrize("most", [1, 40, 1 << 22])
def test_shared_pairs(most):
    r = np.random.default_rng(3)
    lists = lambda n: [np.array(sorted({7, *r.integers(0, 15, r.integers(0, 6)).tolist()})) for _ in range(n)]
    a, b = lists(20), lists(13)
    for least in (1, 2, 3):
        common = lambda x, y: sorted(set(x.tolist()) & set(y.tolist()))
        want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if len(common(x, y)) >= least and common(x, y)[0] == 7}
        assert set(zip(*(z.tolist() for z in pivot_index.shared_pairs(7, a, b, False, least, most)))) == want
        inner = {(i, j) for i, x in enumerate(a) for j, y in enumerate(a) if i < j and len(common(x, y)) >= least and common(x, y)[0] == 7}
        assert set(zip(*(z.tolist() for z in pivot_index.shared_pairs(7, a, a, True, least, most)))) == inner


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is the threshold itself, the hardest ones: at least 0.97 of them are found, against the 0.9 asked for."""
    r = np.random.default_rng(9)
    a = r.normal(size=(1500, 64))
    b = np.vstack([around(r, x, 0.9001, 1) for x in a])
    got = pivot_index.near_vectors(table(spark, list(enumerate(np.vstack([a, b]).tolist()))))
    assert got.filter("n_links > 0").count() >= 0.97 * 3000 and got.filter("n_links > 1").isEmpty()


def test_near_vectors_awkward(spark):
    none = pivot_index.near_vectors(table(spark, []))
    assert none.columns == ["vec_id", "n_links", "component_id", "kept"] and none.collect() == []
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in pivot_index.near_vectors(table(spark, UNUSABLE)).collect()} == {(i, 0, i, True) for i, _ in UNUSABLE}
    one = pivot_index.near_vectors(table(spark, [(5, [1, 2]), (5, [1, 2]), (4, [2, 4]), (9, [-1, -2])], "float")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in one) == [(4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (9, 0, 9, True)]
    with pytest.raises(ValueError, match="1 to 2"):
        pivot_index.near_vectors(table(spark, [(1, [1, 2]), (2, [1])]))


def test_a_dense_group_makes_no_pairs(spark):
    """2,000 edited copies of one vector: every row gets its 1,999 links, and what tasks hand on grows with the rows, not the pairs."""
    r = np.random.default_rng(11)
    data = list(enumerate(around(r, r.normal(size=32), 0.99, 2000).tolist()))
    df = table(spark, data)
    got = pivot_index.near_vectors(df)
    assert {(x.n_links, x.component_id) for x in got.collect()} == {(1999, 0)}
    s = pivot_index.Settings()
    classes = pivot_index.distinct_vectors(df, "vec_id", "embedding")
    described = pivot_index.describe(classes, pivot_index.draw_pivots(classes, 32, s), s)
    balled, centers = pivot_index.gather_balls(described, 32, s)
    members, entities = pivot_index.entities_of(balled, centers)
    assert members.count() == 2000 and entities.count() < 60
