"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, short_batches, small, written

#: Products that are looked at together.
PAIRS = 1 << 17


class Forest:
    """Trees of the same depth. Node k of a tree has the children 2k+1 and 2k+2; a vector goes right
    where its product with the node's direction is at least the node's threshold."""

    def __init__(self, directions: np.ndarray, thresholds: np.ndarray) -> None:
        self.directions, self.thresholds = directions, thresholds  # (trees, nodes, dim), (trees, nodes)
        self.trees, self.nodes = thresholds.shape
        self.depth = (self.nodes + 1).bit_length() - 1

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
        """Each node's direction joins two random vectors of the sample there; its threshold is their
        median, so that leaves hold equally many."""
        n_nodes = (1 << depth) - 1
        directions = np.zeros((trees, n_nodes, sample.shape[1]), dtype=np.float32)
        thresholds = np.zeros((trees, n_nodes))
        for t in range(trees):
            rng = np.random.default_rng((seed, t))
            at = [np.arange(len(sample))]
            for k in range(n_nodes):
                here, at = at[0], at[1:]
                w = rng.standard_normal(sample.shape[1])
                if len(here) > 1:
                    a, b = sample[rng.choice(here, 2, replace=False)]
                    w = a - b if np.any(a != b) else w
                w = (w / np.linalg.norm(w)).astype(np.float32)
                p = sample[here] @ w.astype(np.float64)
                cut = float(np.median(p)) if len(p) else 0.0
                directions[t, k], thresholds[t, k] = w, cut
                right = p >= cut
                at += [here[~right], here[right]]
        return cls(directions, thresholds)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree. Vectors are multiplied with a tree's directions block by block, so that memory does not grow with both."""
        out = np.zeros((len(vectors), self.trees), dtype=np.int64)
        rows = max(1, PAIRS // max(1, self.nodes))
        for t in range(self.trees):
            directions = self.directions[t].T.astype(np.float64)
            for begin in range(0, len(vectors), rows):
                side = vectors[begin : begin + rows] @ directions >= self.thresholds[t]
                node = np.zeros(len(side), dtype=np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + side[np.arange(len(side)), node]
                out[begin : begin + rows, t] = node - self.nodes
        return out

    def search(self, q: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the ``visits`` leaves that one queue shared by all trees yields first. Its
        order is the sum of the squared distances to the hyperplanes on whose other side the leaf lies."""
        side = np.einsum("tnd,d->tn", self.directions, q) - self.thresholds
        margins = side.tolist()
        queue = [(0.0, t, 0) for t in range(self.trees)]
        out: list[tuple[int, int]] = []
        while queue and len(out) < visits:
            far, t, k = heapq.heappop(queue)
            row = margins[t]
            while k < self.nodes:
                m = row[k]
                near = 2 * k + 1 + (m >= 0)
                heapq.heappush(queue, (far + m * m, t, 4 * k + 3 - near))
                k = near
            out.append((t, k - self.nodes))
        return out


def _usable(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, keep: int, n: int) -> DataFrame:
    """One row for each distinct vector: ``uid`` (smallest vec_id) and its ``keep`` smallest vec_ids.
    The smallest are found in rounds over ever fewer salts, so that copies of one vector, however
    many, are never together before few of them are left."""
    salts = 64
    while salts * 50_000 < n:
        salts *= 8
    kept = rows
    while salts >= 1:
        salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
        along = W.partitionBy("vector", "salt").orderBy("vec_id")
        kept = kept.withColumn("salt", salt).withColumn("new", F.coalesce(F.lag("vec_id").over(along) != F.col("vec_id"), F.lit(True)).cast("int"))  # repeated rows aren't
        kept = kept.withColumn("rank", F.sum("new").over(along)).where((F.col("new") == 1) & (F.col("rank") <= keep)).select("vec_id", "vector")
        salts //= 8
    ids = F.sort_array(F.collect_list("vec_id"))
    return kept.groupBy("vector").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("uid"), "ids", "vector")


def visits_for(forest: Forest, sample: np.ndarray, k: int, recall: float, queries: int = 64) -> tuple[int, float]:
    """How many leaves a query has to visit so that ``recall`` of the ``k`` nearest are in them, measured on some vectors of the sample against all of
    it; and which share of the sample a query looks at then."""
    some = np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(np.int64)
    scores = sample[some] @ sample.T
    scores[np.arange(len(some)), some] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1, 1.0
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    leaves = forest.leaves(sample)
    n_leaves = forest.nodes + 1
    all_leaves = forest.trees * n_leaves
    for most in (2 * n_leaves, all_leaves):  # mostly the first is enough
        met, opened = [], []
        for q, near in zip(some, nearest, strict=True):
            order = np.full((forest.trees, n_leaves), all_leaves, dtype=np.int64)
            for at, (t, leaf) in enumerate(forest.search(sample[q], most)):
                order[t, leaf] = at
            first = order[np.arange(forest.trees), leaves].min(axis=1)  # when each vector is met
            met.append(first[near])
            opened.append(first)
        visits = int(np.sort(np.concatenate(met))[min(len(some) * k - 1, int(np.ceil(recall * len(some) * k)) - 1)]) + 1
        if visits <= most:
            break
    visits = min(visits, all_leaves)
    return visits, float(np.mean([np.mean(x < visits) for x in opened]))


def _place(forest, level: int, slices: int):
    """Each vector once a tree, in its region of it."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: Forest = forest.value
        for pdf in batches:
            if not len(pdf):
                continue
            leaves = trees.leaves(np.stack(pdf["vector"].to_numpy()).astype(np.float64))
            for t in range(trees.trees):
                yield pdf.assign(leaf=leaves[:, t], region=(t << level) | (leaves[:, t] >> (trees.depth - level)), slice=pdf["uid"] % slices)

    return place


def _visit(forest, level: int, slices: int, visits: int):
    """Each query once for each region that it visits, with the leaves that it opens there."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: Forest = forest.value
        for pdf in batches:
            rows = []
            for uid, vector in zip(pdf["uid"], pdf["vector"], strict=True):
                by_region: dict[int, list[int]] = {}
                for t, leaf in trees.search(np.asarray(vector, dtype=np.float64), visits):
                    by_region.setdefault((t << level) | (leaf >> (trees.depth - level)), []).append(leaf)
                rows += [(uid, vector, leaves, region, s) for region, leaves in by_region.items() for s in range(slices)]
            yield pd.DataFrame(rows, columns=["q_uid", "q_vector", "leaves", "region", "slice"])

    return visit


FOUND = "q_uid long, uids array<long>, scores array<double>"
NONE = np.iinfo(np.int64).max


def best_of_leaves(V: np.ndarray, uid: np.ndarray, leaf: np.ndarray, Q: np.ndarray, opened: list[np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query, ``uid`` (NONE: none) and score of the ``keep`` vectors of ``V`` (sorted by ``leaf``) with the largest products, of those in its
    ``opened`` leaves and of no others; of equal products, those with the smallest uid. A leaf's vectors are multiplied at once with the queries that open
    it; whatever comes as near to a query's last place as rounding could move it is multiplied again by itself, and that product decides."""
    of = np.repeat(np.arange(len(Q)), [len(x) for x in opened])
    at = np.concatenate(opened) if len(opened) else np.zeros(0, dtype=np.int64)
    order = np.argsort(at, kind="stable")
    of, at = of[order], at[order]
    best = np.full((len(Q), keep), -np.inf)
    name = np.full((len(Q), keep), NONE, dtype=np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        unsure = 8 * V.shape[1] * np.finfo(np.float64).eps * np.sqrt((Q * Q).sum(axis=1))
        length = np.sqrt((V * V).sum(axis=1))
        for x in np.unique(at):
            lo, hi = np.searchsorted(leaf, [x, x + 1])
            every = of[np.searchsorted(at, x) : np.searchsorted(at, x + 1)]
            wide = min(hi - lo, PAIRS)
            for begin in range(lo, hi, PAIRS):
                part = slice(begin, min(begin + PAIRS, hi))
                for some in range(0, len(every), max(1, PAIRS // wide)):
                    rows = every[some : some + max(1, PAIRS // wide)]
                    S = Q[rows] @ V[part].T
                    near = ~(S < (best[rows, -1] - unsure[rows] * length[part].max())[:, None])
                    up = near.any(axis=1)
                    rows, near = rows[up], near[up]
                    if not len(rows):
                        continue
                    r, c = np.nonzero(near)
                    exact = np.full(near.shape, -np.inf)
                    exact[r, c] = np.nan_to_num((V[part][c] * Q[rows[r]]).sum(axis=1), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    scores = np.concatenate((best[rows], exact), axis=1)
                    names = np.concatenate((name[rows], np.where(near, uid[part][None, :], NONE)), axis=1)
                    top = np.lexsort((names, -scores), axis=1)[:, :keep]
                    best[rows], name[rows] = np.take_along_axis(scores, top, axis=1), np.take_along_axis(names, top, axis=1)
    return name, best


def _rank(keep: int):
    """The ``keep`` largest products, in double precision, of each query with the vectors of a region that it opens."""

    def rank(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            vectors = vectors.sort_values(["leaf", "uid"], kind="stable")
            V = np.stack(vectors["vector"].to_numpy()).astype(np.float64)
            Q = np.stack(queries["q_vector"].to_numpy()).astype(np.float64)
            names, scores = best_of_leaves(V, vectors["uid"].to_numpy(), vectors["leaf"].to_numpy(), Q, [np.asarray(x, dtype=np.int64) for x in queries["leaves"]], keep)
            out = [(q, n[n != NONE], s[n != NONE]) for q, n, s in zip(queries["q_uid"], names, scores, strict=True)]
        return pd.DataFrame(out, columns=["q_uid", "uids", "scores"])

    return rank


def neighbours(
    rows: DataFrame,
    is_query: Column,
    k: int = 20,
    trees: int = 8,
    leaf: int = 64,
    recall: float = 0.95,
    least_visits: int = 64,
    sample: int = 32_768,
    most_depth: int = 12,
    region: int = 65_536,
    query_block: int = 16_384,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest rows found for each query row of ``rows`` (``vec_id, embedding``), by largest inner
    product in double precision, never the row itself; ties go to the smaller vec_id.

    Equal vectors are taken together (only their ``k + 1`` smallest ids can ever be returned). A forest is
    fitted to at most ``sample`` vectors, chosen by hash; every vector is put in a leaf of each tree. A query
    visits the leaves that come first in the queue that its trees share, as many as ``recall`` asks for: that number is measured on the sample before the
    search (``visits_for``), ``least_visits`` at least. Only vectors in open leaves are multiplied, and candidates are reranked by their exact product in
    double precision, so with all leaves open the result is that of brute force, ties included. Isotropic vectors need most of a tree's leaves; clustered
    ones few. Leaves are searched by region: about ``region`` vectors and at most about ``query_block`` of the queries that visit it; a region's vectors
    are copied only for the blocks of its own queries, which grow with how many regions a query visits and not with the table.

    Vectors null, zero, with a null or non-finite component, or not of the most common length take no
    part. Rows with equal vec_id and equal vectors count once. Empty tables give an empty result.
    Returns ``query_id, rank, vec_id, score``.
    """
    spark = rows.sparkSession
    short_batches(spark, 4096)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    got = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("is_query"))
    dims = got.where("vector is not null").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return empty
    usable = written(got.where(F.col("vec_id").isNotNull() & _usable(F.col("vector"), dims[0]["dim"])), "ann-rows")
    n = usable.count()
    if not n:
        return empty
    keep = k + 1
    vectors = written(distinct_vectors(usable.select("vec_id", "vector"), keep, n), "ann-vectors")
    n = vectors.count()
    chosen = np.stack(vectors.orderBy(F.xxhash64("uid"), "uid").limit(sample).select("vector").toPandas()["vector"].to_numpy()).astype(np.float64)
    depth = max(0, min(most_depth, int(np.ceil(np.log2(max(1, n / leaf)))), int(np.log2(max(1, len(chosen) / 4)))))
    fitted = Forest.fit(chosen, trees, depth, seed)
    forest = spark.sparkContext.broadcast(fitted)  # trees * 2**most_depth directions at most
    visits = max(least_visits, visits_for(fitted, chosen, k, recall)[0])
    del chosen
    give_back()
    level = max(0, min(depth, int(np.round(np.log2(max(1, n / region))))))
    slices = max(1, round(n / (1 << level) / region))
    q_uid = usable.where("is_query").select("vec_id", "vector").join(vectors.select("uid", "vector"), "vector").select(F.col("vec_id").alias("query_id"), F.col("uid").alias("q_uid"))
    q_uid = written(q_uid.distinct(), "ann-queries")
    queries = vectors.join(q_uid.select(F.col("q_uid").alias("uid")).distinct(), "uid", "left_semi").select("uid", "vector")
    kind = usable.schema["vector"].dataType.simpleString()
    visited = queries.repartition(4 * spark.sparkContext.defaultParallelism, "uid").mapInPandas(
        _visit(forest, level, slices, visits), f"q_uid long, q_vector {kind}, leaves array<long>, region long, slice long"
    )
    visited = written(visited, "ann-visits")
    blocks = written(visited.where("slice = 0").groupBy("region").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("blocks")), "ann-blocks")
    blocks = F.broadcast(blocks) if small(blocks, 200_000) else blocks  # at most trees * 2**level rows
    placed = vectors.select("uid", "vector").mapInPandas(_place(forest, level, slices), f"uid long, vector {kind}, leaf long, region long, slice long")
    placed = placed.join(blocks, "region").select("uid", "vector", "leaf", "region", "slice", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = visited.join(blocks, "region").select("q_uid", "q_vector", "leaves", "region", "slice", F.pmod(F.xxhash64("q_uid"), F.col("blocks")).cast("int").alias("block"))
    found = placed.groupBy("region", "slice", "block").cogroup(asked.groupBy("region", "slice", "block")).applyInPandas(_rank(keep), FOUND)
    found = written(found, "ann-found")
    one = found.select("q_uid", F.explode(F.arrays_zip("uids", "scores")).alias("x")).select("q_uid", F.col("x.uids").alias("uid"), F.col("x.scores").alias("score")).distinct()
    first = W.partitionBy("q_uid").orderBy(F.desc("score"), "uid")
    top = one.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep)
    each = top.join(vectors.select("uid", "ids"), "uid").select("q_uid", "score", F.explode("ids").alias("vec_id"))
    by_item = W.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("r", F.row_number().over(by_item)).where(F.col("r") <= keep)
    answers = written(best.groupBy("q_uid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best")), "ann-answers")
    others = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    return (
        q_uid.join(answers, "q_uid")
        .select("query_id", F.posexplode(F.slice(others, 1, k)))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
    )
