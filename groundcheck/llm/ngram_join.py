"""Jaccard join on word n-grams: blocked counts drop single documents, a prefix-filter join finds the pairs.

The columns (n-gram hashes) are dealt into blocks of a few million entries. A block finds which of its n-grams occur
in several documents, and every document adds up over the blocks how many of its n-grams can overlap at
all. A document whose sum is below the bound that its size sets has no partner and leaves. For the others, exact
overlaps are counted for pairs that share one of their rarest n-grams and whose sizes allow the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import components, seen_in

NO_DOC = 65535


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def ngram_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of words; of the whole text if it has fewer words."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z only, and U+0020, U+0009 to U+000D part words
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(w))
    m = len(w) - k + 1
    h = mix(w[:m] + np.uint64(k))
    for j in range(1, k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + m])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def fingerprint(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def set_rows(docs: DataFrame, n: int) -> DataFrame:
    """(id, n, fp): size and 128-bit fingerprint of each row's n-gram set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [ngram_set(t, n) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "n": [len(s) for s in sets], "fp": [fingerprint(s) if len(s) else None for s in sets]})

    return docs.mapInPandas(run, "id long, n long, fp binary")


def deal_blocks(docs: DataFrame, n: int, blocks: int, batch: int = 2_000_000) -> DataFrame:
    """Incidence of distinct sets, in rows (block, batch, kind, a, b, c) of up to a few million entries each.

    A task gathers documents until it has ``batch`` entries (or 60,000 documents). N-grams that two different sets of the
    batch share are counted at once and sent on as one entry, so a very common n-gram costs one entry per
    batch and not one per document. An entry is the low 32 bits of the hash below the block's bits and a
    16-bit place in the batch. Two n-grams of a block can look equal (one in two thousand at 2 million): then a document
    stays in that had no partner, and the exact counts that follow tell; none is lost.
    """

    def flush(base: int, seq: int, ids: list, sets: list) -> pd.DataFrame:
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        grams, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        order = np.argsort(grams)
        grams, doc = grams[order], doc[order]
        first = np.concatenate(([True], grams[1:] != grams[:-1]))
        start = np.flatnonzero(first)
        count = np.diff(np.append(start, len(grams)))
        own = np.bincount(doc[np.repeat(count > 1, count)], minlength=len(sets))
        grams, doc = grams[start], np.where(count > 1, NO_DOC, doc[start]).astype(np.uint16)
        edges = np.searchsorted(grams, [np.uint64((b << 64) // blocks) for b in range(1, blocks)])
        bounds = [0, *edges.tolist(), len(grams)]
        low = (grams * np.uint64(blocks) >> np.uint64(32)).astype(np.uint32)
        key = base + seq
        rows = [(b, key, 0, low[i:j].tobytes(), doc[i:j].tobytes(), b"") for b, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
        rows.append((key % blocks, key, 1, np.array(ids, dtype=np.int64).tobytes(), sizes.tobytes(), own.astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["block", "batch", "kind", "a", "b", "c"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, seq, total = TaskContext.get().partitionId() << 24, 0, 0
        ids, sets, seen = [], [], set()
        for part in batches:
            for i, text in zip(part["id"], part["text"]):
                grams = ngram_set(text, n)
                fp = fingerprint(grams)
                if not len(grams) or fp in seen:
                    continue
                seen.add(fp)
                ids.append(i), sets.append(grams)
                total += len(grams)
                if total >= batch or len(ids) >= 60_000:
                    yield flush(base, seq, ids, sets)
                    ids, sets, seq, total = [], [], seq + 1, 0
        if ids:
            yield flush(base, seq, ids, sets)

    return docs.mapInPandas(run, "block int, batch long, kind int, a binary, b binary, c binary")


def count_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each batch: how many n-grams of this block its documents share with another batch."""
    out = [tuple(r) for r in rows.loc[rows["kind"] == 1, ["batch", "kind", "a", "b", "c"]].itertuples(index=False)]
    rows = rows[rows["kind"] == 0]
    if len(rows):
        grams = [np.frombuffer(x, dtype=np.uint32) for x in rows["a"]]
        of = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        grams, doc = np.concatenate(grams), np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in rows["b"]])
        order = np.argsort(grams, kind="stable")
        grams, doc, of = grams[order], doc[order], of[order]
        start = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        count = np.diff(np.append(start, len(grams)))
        shared = np.repeat((count > 1) | (np.maximum.reduceat(doc, start) == NO_DOC), count) & (doc != NO_DOC)
        place, times = np.unique(of[shared].astype(np.int64) << 16 | doc[shared], return_counts=True)
        at, doc = place >> 16, (place & NO_DOC).astype(np.uint16)
        for row, key in enumerate(rows["batch"]):
            i, j = np.searchsorted(at, [row, row + 1])
            if j > i:
                out.append((key, 0, doc[i:j].tobytes(), times[i:j].astype(np.int64).tobytes(), b""))
    return pd.DataFrame(out, columns=["batch", "kind", "a", "b", "c"])


def above_bound(percent: int):
    """Documents of a batch with enough shared n-grams: at least ``percent`` of their own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["kind"] == 1].iloc[0]
        ids, sizes = np.frombuffer(head["a"], dtype=np.int64), np.frombuffer(head["b"], dtype=np.int64)
        shared = np.frombuffer(head["c"], dtype=np.int64).copy()
        for r in rows[rows["kind"] == 0].itertuples(index=False):
            shared[np.frombuffer(r.a, dtype=np.uint16)] += np.frombuffer(r.b, dtype=np.int64)
        return pd.DataFrame({"id": ids[100 * shared >= percent * sizes]})

    return run


def is_link(a: Column, b: Column, overlap: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose stored sets reach the threshold. Sizes alone rule most others out first."""
    size = sets.select("node", "n")
    for side in ("a", "b"):
        pairs = pairs.join(size.select(F.col("node").alias(side), F.col("n").alias(f"n{side}")), side)
    pairs = pairs.filter((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("grams").alias(f"g{side}")), side)
    overlap = F.size(F.array_intersect("ga", "gb"))
    return pairs.filter(is_link(F.col("na"), F.col("nb"), overlap, percent)).select("a", "b")


def weights(sets: DataFrame) -> DataFrame:
    """(node, weight): in how many sets a set's n-grams occur, on average. Of a text and its edited copies the text they come from has the most."""
    grams = sets.select("node", "n", F.explode("grams").alias("gram"))
    common = materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    return grams.join(common, "gram").groupBy("node").agg((F.sum("df") / F.first("n")).alias("weight"))


def star_pairs(keys: DataFrame, weight: DataFrame) -> DataFrame:
    """For each node of ``keys`` (node, component, key) one partner worth a check: of the nodes with most weight of each of its keys,
    the one it meets most often in another component.

    One pair per node, whatever a key's size. A set that is linked this way need not be compared with the rest of
    its group, since only components are asked for; what it leaves out, ``cross_pairs`` finds.
    """
    ranked = keys.join(weight, "node")
    centers = materialize(ranked.groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("node")).alias("node"), "component")).alias("top"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).filter("lo <> hi").select("key", (-F.col("top.node")).alias("b"), F.col("top.component").alias("of")))
    votes = keys.join(centers, "key").filter("component <> of").groupBy("node", "b").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("node").agg(F.max(F.struct("n", (-F.col("b")).alias("b"))).alias("m"))
    return best.select(F.col("node").alias("a"), (-F.col("m.b")).alias("b"))


def rare_grams(sets: DataFrame, percent: int) -> DataFrame:
    """(node, n, component, rest, gram): the n-grams by which a set can meet one of another component, and how many follow each.

    N-grams of one component only are set aside. The others are ordered by how many sets hold them; those set aside
    come first. Two sets that reach the threshold share one of the first n - ceil(percent * n / 100) + 1.
    """
    grams = sets.select("node", "n", "component", F.explode("grams").alias("gram"))
    across = materialize(grams.groupBy("gram").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df")
    ).filter("lo <> hi").select("gram", "df"))
    held = grams.join(across, "gram").groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("held"))
    prefix = F.expr(f"cast(n - ceil({percent} * n / 100.0) + 1 as int) - cast(n - size(held) as int)")
    first = held.filter(prefix > 0).select(
        "node", "n", "component", F.size("held").alias("held"), F.posexplode(F.slice("held", F.lit(1), prefix)).alias("pos", "g")
    )
    return materialize(first.select("node", "n", "component", (F.col("held") - F.col("pos")).alias("rest"), F.col("g.gram").alias("gram")))


def cross_pairs(first: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that may reach the threshold: all of them.

    Sets of n and m entries reach it only with an overlap of at least percent * (n + m) / (100 + percent). Two sets
    are compared at the first of the rare n-grams they share, and only if what follows it in both is enough for that.
    """
    a, b = (first.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "component", "rest")], "gram") for s in "ab")
    enough = (100 + percent) * F.least("resta", "restb") >= percent * (F.col("na") + F.col("nb"))
    return a.join(b, "gram").filter((F.col("componenta") < F.col("componentb")) & enough).select("a", "b").distinct()


def similar_groups(
    docs: DataFrame, percent: int = 75, n: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = 2_000_000, rounds: int = 1
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id.

    Two documents link when their sets of word ``n``-grams have a Jaccard similarity of at least ``percent``
    hundredths (counted in integers); component_id is the smallest id that links reach. Equal sets are one
    class and are never paired. N-grams are 64-bit hashes.

    A text without words, or null, has n_shingles 0 and links with nothing; shorter texts than ``n`` words are
    one n-gram. Rows that repeat an id are one document with several texts: any of them links it. A row without
    an id links with nothing and has no component. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    thin = materialize(set_rows(rows.filter("id is not null"), n))
    total = thin.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one node per set, whatever ids hold it: an id with several texts has several sets
    classes = materialize(thin.filter("n > 0").groupBy("fp").agg(F.min("id").alias("id")).withColumn("node", F.xxhash64("fp")))

    dealt = deal_blocks(rows.filter("id is not null"), n, max(1, round(total / block)), block)
    counted = dealt.groupBy("block").applyInPandas(count_block, "batch long, kind int, a binary, b binary, c binary")
    able = counted.groupBy("batch").applyInPandas(above_bound(percent), "id long").distinct()
    nodes = materialize(thin.join(able, "id", "left_semi").select("fp").distinct().join(classes, "fp").select("id", "node", F.col("fp").alias("want")))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salts = [np.uint64(s) for s in (0, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B)]
        for batch in batches:
            out = []
            for node, want, text in zip(batch["node"], batch["want"], batch["text"]):
                grams = ngram_set(text, n)
                if fingerprint(grams) == want:  # else another text of a repeated id
                    out.append((node, len(grams), grams.view(np.int64), [int(np.min(mix(grams ^ s)).view(np.int64)) for s in salts]))
            yield pd.DataFrame(out, columns=["node", "n", "grams", "least"])

    near = rows.filter(seen_in(nodes.select("id"), ["id"])).join(nodes, "id").select("node", "want", "text")
    sets = materialize(near.mapInPandas(sets_of, "node long, n long, grams array<long>, least array<long>").dropDuplicates(["node"]))

    weight = materialize(weights(sets))
    own = F.coalesce("component", "node").alias("component")
    by_least = sets.select("node", F.col("node").alias("component"), F.explode("least").alias("key"))
    links = materialize(verified(star_pairs(by_least, weight), sets, percent))
    for _ in range(rounds):  # partners by the rare n-grams that still lie in several components
        placed = sets.join(materialize(components(links)), "node", "left").select("node", "n", own, "grams")
        by_gram = rare_grams(placed, percent).select("node", "component", F.col("gram").alias("key"))
        links = materialize(links.unionByName(verified(star_pairs(by_gram, weight), sets, percent)))
    found = materialize(components(links))
    placed = sets.join(found, "node", "left").select("node", "n", own, "grams")
    more = materialize(verified(cross_pairs(rare_grams(placed, percent), percent), sets, percent))
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)))
    linked = classes.join(found, "node")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    linked = linked.join(least, "component").select("node", "least")
    of_class = materialize(classes.join(linked, "node", "left").select("fp", F.coalesce("least", "id").alias("component")))
    out = thin.join(of_class, "fp", "left").select(F.col("id"), "n", F.coalesce("component", "id").alias("component"))
    repeated = thin.groupBy("id").count().filter("count > 1")
    if not repeated.isEmpty():  # their texts are one node: join the components they lie in
        ends = out.join(repeated, "id").select("id", "component")
        merged = materialize(components(ends.select(F.col("id").alias("a"), F.col("component").alias("b"))))
        out = out.join(merged, out["component"] == merged["node"], "left").select("id", "n", F.coalesce(merged["component"], out["component"]).alias("component"))
    alone = set_rows(rows.filter("id is null"), n).select("id", "n", F.lit(None).cast("long").alias("component"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their group, with their own columns. Rows without an id stay."""
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, **options)
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    return docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")).join(gone, "id", "left_anti").select("row.*")
