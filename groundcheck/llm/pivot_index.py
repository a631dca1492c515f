"""Near duplicates of embeddings by a pivot-permutation index.

Each distinct vector is described by its nearest reference vectors (pivots), nearest first. Vectors stand in the inverted lists of
their pivots; two that share enough pivots are candidates, and their cosine decides. Lists are cut into blocks, pairs of blocks
are compared inside tasks, and a task returns sums and spanning edges, never the pairs.

Dense groups of edited copies are taken together first: a ball holds vectors so close to its leader that any two of them are linked by the
triangle inequality. Two balls that are near enough, or far enough, are decided as wholes; only those in between have their members compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import components
from .vectors import common_length, usable

#: Angles closer than this to a limit are not decided by the triangle inequality but by comparing members.
SLACK = 1e-7


@dataclass(frozen=True)
class Settings:
    """``pivots_per_root``: pivots drawn per square root of the distinct vectors, so that lists grow with the root too; ``most_pivots``
    bounds what is broadcast. ``near`` pivots describe a vector, ``shared`` of them make a candidate. ``leaders`` are tried per pivot."""

    threshold: float = 0.9
    near: int = 12
    shared: int = 2
    pivots_per_root: int = 4
    least_pivots: int = 64
    most_pivots: int = 8192
    leaders: int = 3
    block: int = 512

    @property
    def angle(self) -> float:
        return float(np.arccos(self.threshold))

    def pivots(self, vectors: int) -> int:
        return min(max(self.least_pivots, int(self.pivots_per_root * vectors**0.5)), self.most_pivots)


def units(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    """The vectors of a batch, in double precision and of unit length."""
    return scaled(batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d))


def scaled(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nested(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.ravel()))


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(cid, h, copies, v): one row per distinct linkable vector, with its smallest id. Copies are counted before the shuffle."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & linkable(F.col("v")))
    return rows.groupBy("v").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("copies")).select("cid", F.xxhash64("v").alias("h"), "copies", "v")


def linkable(vector: Column) -> Column:
    return usable(vector) & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False))


def kind_of(vectors: DataFrame) -> str:
    """Vectors travel as the input has them, floats as floats; tasks scale them in double precision."""
    return vectors.schema["v"].dataType.simpleString()


def draw_pivots(classes: DataFrame, d: int, s: Settings) -> np.ndarray:
    """Unit vectors of the rows with the least hashes, at most ``s.pivots``; of two that would be linked only one stays, so that a large
    group of edited copies gives no more pivots than any other place."""
    count = s.pivots(classes.count())
    drawn = classes.select("v", F.xxhash64("h", F.lit(1)).alias("o")).orderBy("o", "v").limit(count).toArrow()
    x = units(drawn.combine_chunks().to_batches()[0], "v", d)
    kept: list[int] = []
    for i in range(len(x)):
        if not kept or (x[kept] @ x[i]).max() < s.threshold:
            kept.append(i)
    return x[kept]


def describe(classes: DataFrame, pivots: np.ndarray, s: Settings) -> DataFrame:
    """``classes`` with ``perm``, the nearest pivots of each vector in order (ties by number)."""
    d, k = pivots.shape[1], min(s.near, len(pivots))
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v = units(batch, "v", d)
                far = -(v @ shared.value.T)
                perm = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
                perm = np.take_along_axis(perm, np.argsort(np.take_along_axis(far, perm, 1), axis=1, kind="stable"), 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, nested(perm.astype(np.int32))], [*batch.schema.names, "perm"])

    return classes.select("cid", "h", "copies", "v").mapInArrow(run, f"cid long, h long, copies long, v {kind_of(classes)}, perm array<int>")


def gather_balls(described: DataFrame, d: int, s: Settings) -> tuple[DataFrame, list]:
    """``described`` with ``ball`` (null: none) and ``near``, the cosine to the ball's leader; and the leaders of the balls.

    Leaders are the vectors of least hash, for ``s.leaders`` hashes, among those with the same nearest pivot: a group that
    holds much of a place gives its leader with as much probability. A vector joins the leader that most vectors can join, so that a group cut
    by the borders between pivots still meets in one ball. At most ``s.leaders`` times the pivots are held.
    """
    least = [F.min_by(F.struct("h", "v"), F.xxhash64("h", F.lit(i + 2))).alias(f"l{i}") for i in range(s.leaders)]
    found = described.groupBy(F.col("perm")[0].alias("p")).agg(*least).select(F.explode(F.array(*[f"l{i}" for i in range(s.leaders)])).alias("l"))
    leaders = found.select("l.*").distinct().orderBy("h", "v").toArrow().combine_chunks()
    x = units(leaders.to_batches()[0], "v", d)
    within = np.cos(s.angle / 2 - SLACK)
    held = described.sparkSession.sparkContext.broadcast(x)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                total += (units(whole.slice(at, 1024), "v", d) @ held.value.T >= within).sum(0)
        yield pa.RecordBatch.from_pydict({"l": np.flatnonzero(total > 0), "n": total[total > 0]})

    reach = {r.l: r.n for r in described.select("v").mapInArrow(count, "l long, n long").groupBy("l").agg(F.sum("n").alias("n")).collect()}
    order = sorted((l for l, n in reach.items() if n > 1), key=lambda l: (-reach[l], l))  # noqa: E741
    chosen = described.sparkSession.sparkContext.broadcast(x[order])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cos = units(batch, "v", d) @ chosen.value.T if len(chosen.value) else np.zeros((batch.num_rows, 1))
                hit = cos >= within
                ball = hit.argmax(1)
                none = ~hit.any(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(ball.astype(np.int64), mask=none), pa.array(cos[np.arange(len(ball)), ball], mask=none)], [*batch.schema.names, "ball", "near"])

    vectors = leaders.column("v").to_pylist()
    return described.mapInArrow(join, f"cid long, h long, copies long, v {kind_of(described)}, perm array<int>, ball long, near double"), [vectors[i] for i in order]


def entities_of(members: DataFrame, centers: list) -> tuple[DataFrame, DataFrame]:
    """(members, entities). Balls and single vectors are the entities: e1 (smallest id), e2, size (rows), parts (members), near (least
    cosine to the center), v (center), pivots (of all members). Balls are at most as many as leaders, so what describes them is broadcast."""
    spark = members.sparkSession
    in_ball = members.filter("ball is not null")
    balls = in_ball.groupBy("ball").agg(F.min("cid").alias("e1"), F.sum("copies").alias("size"), F.count(F.lit(1)).alias("parts"), F.min("near").alias("near"))
    lists = in_ball.select("ball", F.explode("perm").alias("p")).distinct().groupBy("ball").agg(F.collect_list("p").alias("pivots"))
    center = spark.createDataFrame(list(enumerate(centers)), f"ball long, v {kind_of(members)}")
    balls = materialize(balls.join(lists, "ball").join(center, "ball").withColumn("e2", -F.col("ball") - 1))
    one = members.filter("ball is null").select(
        F.col("cid").alias("e1"), F.col("h").alias("e2"), F.col("copies").alias("size"), F.lit(1).cast("long").alias("parts"), F.lit(1.0).alias("near"), "v", F.col("perm").alias("pivots"))
    key = F.broadcast(balls.select("ball", "e1", "e2"))
    held = in_ball.drop("near", "perm").join(key, "ball").select("cid", "h", "copies", "v", "e1", "e2")
    single = members.filter("ball is null").select("cid", "h", "copies", "v", F.col("cid").alias("e1"), F.col("h").alias("e2"))
    return held.unionByName(single), one.unionByName(balls.select(*one.columns))


def blocks(rows: DataFrame, count: Column, own: Column) -> DataFrame:
    """Each row once for every pair of blocks that its own block is in: lo, hi and side (0: its block is lo)."""
    other = rows.select("*", own.alias("_own"), F.explode(F.sequence(F.lit(0), count - 1)).alias("_other"))
    return other.select("*", F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") > F.col("_other")).cast("int").alias("side")).drop("_own", "_other")


def shared_pairs(p: int, a: list[np.ndarray], b: list[np.ndarray], same: bool, least: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that share at least ``least`` pivots, ``p`` the first of them. ``same``: i < j only.

    All lists hold ``p``. The entries of the two sides meet along the pivots, about ``most`` meetings at a time, and are counted per pair.
    """
    def entries(lists):
        of, pivot = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
        order = np.argsort(pivot, kind="stable")
        order = order[pivot[order] != p]
        return of[order], pivot[order]

    (ia, qa), (ib, qb) = entries(a), entries(b)
    low = np.searchsorted(qb, qa)
    count = np.searchsorted(qb, qa, "right") - low
    ends = np.cumsum(count)
    shared = np.ones(len(a) * len(b), dtype=np.int64)
    earlier = np.zeros(len(a) * len(b), dtype=bool)
    start = 0
    while start < len(qa):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        n = count[start:stop]
        at = np.repeat(low[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cells = np.repeat(ia[start:stop], n) * len(b) + ib[at]
        below = np.repeat(qa[start:stop] < p, n)
        earlier[cells[below]] = True
        shared += np.bincount(cells[~below], minlength=len(shared))
        start = stop
    i, j = np.divmod(np.flatnonzero((shared >= least) & ~earlier), len(b))
    return (i[i < j], j[i < j]) if same else (i, j)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


FOUND = "kind int, a1 long, a2 long, b1 long, b2 long, w long"


def records(kind: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a1": a[:, 0], "a2": a[:, 1], "b1": b[:, 0], "b2": b[:, 1], "w": w})


def compare_lists(entities: DataFrame, s: Settings, least: int) -> DataFrame:
    """Rows of three kinds: 0 (a: rows linked to all of entity a), 1 (a, b: entities linked, over a chain), 2 (a, b: members must be compared)."""
    postings = entities.select("*", F.explode("pivots").alias("p"))
    lengths = postings.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / s.block).cast("int").alias("parts_of_p"))
    dealt = postings.join(F.broadcast(lengths), "p")  # a row per pivot
    dealt = blocks(dealt, F.col("parts_of_p"), F.pmod(F.xxhash64("e1", "e2", F.lit(3)), F.col("parts_of_p")).cast("int"))
    angle = s.angle

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, lo, hi = key
        a, b = (rows, rows) if lo == hi else (rows[rows["side"] == 0], rows[rows["side"] == 1])
        if not len(a) or not len(b):
            return records(0, np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        i, j = shared_pairs(p, a["pivots"].tolist(), b["pivots"].tolist(), lo == hi, least)
        va, vb = (scaled(np.stack(t["v"].tolist()).astype(float)) for t in (a, b))
        cos = np.concatenate([np.einsum("ij,ij->i", va[i[x : x + 8192]], vb[j[x : x + 8192]]) for x in range(0, len(i) + 1, 8192)])
        reach = lambda x: np.arccos(np.clip(x, -1, 1))
        spread = reach(a["near"].to_numpy())[i] + reach(b["near"].to_numpy())[j]
        plain = spread == 0
        apart = reach(cos)
        sure = np.where(plain, cos >= s.threshold, apart + spread <= angle - SLACK)
        open_ = ~plain & ~sure & (apart - spread <= angle + SLACK)
        ka, kb = a[["e1", "e2"]].to_numpy(), b[["e1", "e2"]].to_numpy()
        x, y = i[sure], j[sure]
        wa, wb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        np.add.at(wa, x, b["size"].to_numpy()[y])
        np.add.at(wb, y, a["size"].to_numpy()[x])
        keys = ka if lo == hi else np.vstack([ka, kb])
        label = spanning(x, y if lo == hi else y + len(a), len(keys))
        moved = label != np.arange(len(keys))
        degree = wa + wb if lo == hi else np.concatenate([wa, wb])
        none = np.zeros(len(keys), np.int64)
        return pd.concat([
            records(0, keys[degree > 0], keys[degree > 0], degree[degree > 0]),
            records(1, keys[moved], keys[label[moved]], none[moved]), records(2, ka[i[open_]], kb[j[open_]], none[:1].repeat(open_.sum())),
        ])

    return dealt.select("p", "lo", "hi", "side", "e1", "e2", "size", "near", "v", "pivots").groupBy("p", "lo", "hi").applyInPandas(run, FOUND)


def compare_members(open_: DataFrame, members: DataFrame, entities: DataFrame, s: Settings) -> DataFrame:
    """The links between the members of two entities, in blocks: kind 0 (a: links of the member cid, h), 1 (a, b: the entities are linked)."""
    parts = entities.select("e1", "e2", F.ceil(F.col("parts") / s.block).cast("int").alias("n"))
    pairs = open_
    for c in "ab":
        pairs = pairs.join(parts.select(F.col("e1").alias(f"{c}1"), F.col("e2").alias(f"{c}2"), F.col("n").alias(f"n{c}")), [f"{c}1", f"{c}2"])
    ends = ["a1", "a2", "b1", "b2"]

    def side(c: str, other: str) -> DataFrame:
        of = members.select("cid", "h", "copies", "v", F.col("e1").alias(f"{c}1"), F.col("e2").alias(f"{c}2"))
        own = F.pmod(F.xxhash64("cid", "h", F.lit(5)), F.col(f"n{c}")).cast("int").alias(f"x{c}")
        return pairs.join(of, [f"{c}1", f"{c}2"]).select(*ends, own, F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(f"x{other}"), F.lit(c).alias("side"), "cid", "h", "copies", "v")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == "a"], rows[rows["side"] == "b"]
        if not len(a) or not len(b):
            return records(0, np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
        va, vb = (scaled(np.stack(t["v"].tolist()).astype(float)) for t in (a, b))
        link = va @ vb.T >= s.threshold
        degree = np.concatenate([link @ b["copies"].to_numpy(), a["copies"].to_numpy() @ link])
        keys = np.vstack([a[["cid", "h"]].to_numpy(), b[["cid", "h"]].to_numpy()])
        ends_ = np.array([key[:4]], dtype=np.int64).reshape(-1, 4)[: int(link.any())]
        return pd.concat([records(0, keys[degree > 0], keys[degree > 0], degree[degree > 0]), records(1, ends_[:, :2], ends_[:, 2:], np.zeros(len(ends_), np.int64))])

    return side("a", "b").unionByName(side("b", "a")).groupBy(*ends, "xa", "xb").applyInPandas(run, FOUND)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: rows within the cosine threshold, the smallest id reachable over links, and whether that is the row's own.

    Null, empty and zero vectors and those with null, NaN or infinite entries link with nothing; so do rows without an id, which are
    never kept. Equal vectors are links of each other. Rows that repeat an id count apart as links and share their component. Vectors of several lengths
    are an error. An empty table gives no rows. The pivots are a sample; every row is indexed. All links that are found are right; at the defaults
    99.7 % or more of the links at the threshold itself are found (random directions, 64 entries), and practically all closer ones.
    """
    s = settings
    classes = materialize(distinct_vectors(df, id_col, vector_col))
    d = common_length(classes, "v")
    rows = df.select(F.col(id_col).alias(id_col), F.col(vector_col).alias("_v")).select("*", F.col(id_col).cast("long").alias("_id"))
    if not d:
        return rows.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    pivots = draw_pivots(classes, d, s)
    described = materialize(describe(classes, pivots, s))
    balled, centers = gather_balls(described, d, s)
    members, entities = (materialize(x) for x in entities_of(materialize(balled), centers))
    found = materialize(compare_lists(entities, s, min(s.shared, len(pivots))))
    open_ = found.filter("kind = 2").select("a1", "a2", "b1", "b2")
    inner = materialize(compare_members(open_, members, entities, s)) if not open_.isEmpty() else found.limit(0)
    groups = components(found.unionByName(inner).filter("kind = 1").select(F.col("a1").alias("a"), F.col("b1").alias("b")))

    degree = lambda t, a, b: t.filter("kind = 0").groupBy(F.col("a1").alias(a), F.col("a2").alias(b)).agg(F.sum("w").alias(f"w_{a}"))
    known = entities.select("e1", "e2", "size", "parts").join(degree(found, "e1", "e2"), ["e1", "e2"], "left").join(groups.withColumnRenamed("node", "e1"), "e1", "left")
    known = materialize(known.select("e1", "e2", "parts", (F.col("size") - 1 + F.coalesce("w_e1", F.lit(0))).alias("links"), F.coalesce("component", "e1").alias("component")))
    # a ball's row is read by all its members: there are at most as many balls as leaders, so it is broadcast; a single vector's has one reader
    balls, one = known.filter((F.col("e2") < 0) & (F.col("parts") > 1)), known.filter("parts = 1")
    keyed = members.select("cid", "h", "e1", "e2")
    placed = keyed.join(F.broadcast(balls), ["e1", "e2"]).unionByName(keyed.join(one, ["e1", "e2"]))
    placed = placed.join(degree(inner, "cid", "h"), ["cid", "h"], "left").select("cid", "h", (F.col("links") + F.coalesce("w_cid", F.lit(0))).alias("links"), "component")
    vector = classes.select("cid", "h", "v").join(placed, ["cid", "h"]).select("h", F.col("v").alias("_v"), "links", "component")
    usable_ = F.when(F.col("_id").isNotNull() & linkable(F.col("_v")), F.xxhash64("_v"))
    out = rows.withColumn("h", usable_).join(vector, ["h", "_v"], "left")
    return out.select(
        id_col, F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "_id") == F.col("_id"), F.lit(False)).alias("kept"),
    )
