"""Exact top-k by inner product: dual-tree search over cover trees.

Data and queries are indexed alike. A tree's levels have scales that are powers of two. A node of
scale s has a centre, one of its points, that all its points lie within s of; its children are
centred at points more than s / 2 from each other that cover it within s / 2. Children of a single
point lie together in one leaf. A node also knows its covering radius, the distance
of its farthest point. A pair of a query node and a data node is skipped when no pair of their
points can reach the worst kth score of the query group: for centres q, p and radii r, s the
inner product is at most q.p + r |p| + s |q| + r s. Where all points are about as far from each
other, as random directions in many dimensions are, no tree has covers to skip.

The rows of the data never move: every task builds trees over batches of its rows, searches
them with the query tree, and keeps the k best for each query; the tasks' results are merged.
The query tree is broadcast in blocks of QUERY_BLOCK queries and QUERY_BYTES at most, so more
queries mean more passes over the data. Scores are sums of products of integers, exact in any
order below 2 ** 53; vectors whose lengths allow more are an error.

Cases: vectors that are null, empty, or hold a null or a non-finite component, and rows without
a vec_id, take no part. Rows that share the query's vec_id are the query's own; a vec_id that
occurs in several query rows is one query by its first vector in order. Vectors of another
length than the query's take no part in its search. Ties go to the smaller vec_id. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K, EVERY, SCALE = 5, 50, 256
LEAF = 24
#: Inner products below this are exact in doubles.
EXACT = 2.0**53
#: Rows under one tree, and queries and their bytes in one broadcast.
BATCH, QUERY_BLOCK, QUERY_BYTES = 4096, 20_000, 1 << 26


@dataclass
class Tree:
    """Nodes in depth-first order: points are permuted so that each node owns a slice."""

    points: np.ndarray
    order: np.ndarray  # original row of each point
    centre: np.ndarray  # row in points
    radius: np.ndarray
    norm: np.ndarray  # of the centre
    low: np.ndarray
    high: np.ndarray
    children: list[list[int]]


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A cover tree, top down; a node's children are picked farthest first, and nodes of at most ``leaf`` points stay whole."""
    order: list[np.ndarray] = []
    nodes: list[list] = []  # centre (original row), radius, low, high, children
    squares = (points**2).sum(1)

    def grow(rows: np.ndarray, centre: int, away: np.ndarray, at: int, split: bool = True) -> int:
        me = len(nodes)
        radius = float(away.max())
        nodes.append([centre, radius, at, at + len(rows), []])
        if len(rows) <= leaf or radius == 0.0 or not split:
            order.append(rows)
            return me
        half = 2.0 ** (np.ceil(np.log2(radius)) - 1)
        mine, size = points[rows], squares[rows]
        own, nearest, centres = np.zeros(len(rows), np.int64), away.copy(), [centre]
        while nearest.max() > half:
            far = int(nearest.argmax())
            d = np.sqrt(np.maximum(size + size[far] - 2 * (mine @ mine[far]), 0))
            d[far] = 0.0
            closer = d < nearest
            nearest[closer], own[closer] = d[closer], len(centres)
            centres.append(int(rows[far]))
        count = np.bincount(own, minlength=len(centres))
        for k in np.flatnonzero(count > 1):
            some = own == k
            nodes[me][4].append(grow(rows[some], centres[k], nearest[some], at))
            at += int(count[k])
        single = count[own] == 1
        if single.any():
            nodes[me][4].append(grow(rows[single], centre, away[single], at, False))
        return me

    grow(np.arange(len(points)), 0, np.sqrt(np.maximum(((points - points[0]) ** 2).sum(1), 0)), 0)
    permuted = np.concatenate(order)
    place = np.empty(len(points), np.int64)
    place[permuted] = np.arange(len(points))
    centre = place[[n[0] for n in nodes]]
    norm = np.sqrt((points[permuted][centre] ** 2).sum(1))
    return Tree(points[permuted], permuted, centre, np.array([n[1] for n in nodes]), norm, np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes]), [n[4] for n in nodes])


class Best:
    """The k best (score, vec_id) of each query, by falling score and rising vec_id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.own, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, low: int, high: int) -> float:
        return float(self.score[low:high, -1].min())

    def offer(self, low: int, high: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids[None, :] == self.own[low:high, None], -np.inf, scores)
        worth = np.flatnonzero((scores >= self.score[low:high, -1:]).any(1) & np.isfinite(scores).any(1))
        if not len(worth):
            return
        rows = worth + low
        both = np.concatenate([self.score[rows], scores[worth]], 1)
        vec = np.concatenate([self.vec[rows], np.broadcast_to(ids, (len(worth), len(ids)))], 1)
        vec = np.where(np.isfinite(both), vec, np.iinfo(np.int64).max)
        pick = np.lexsort((vec, -both), axis=1)[:, : self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(both, pick, 1), np.take_along_axis(vec, pick, 1)


def search(queries: Tree, data: Tree, ids: np.ndarray, best: Best) -> int:
    """Offer every pair of points to best but those in pairs of nodes that cannot matter; returns the number of pairs skipped.

    ids: of data.points; best: by queries.points.
    """
    roots, skipped = [(0, 0)], 0
    while roots:
        q, p = roots.pop()
        a, b = int(queries.low[q]), int(queries.high[q])
        middle = float(queries.points[queries.centre[q]] @ data.points[data.centre[p]])
        bound = middle + queries.radius[q] * data.norm[p] + data.radius[p] * queries.norm[q] + queries.radius[q] * data.radius[p]
        if bound + 1e-9 * abs(bound) + 1e-6 < best.worst(a, b):
            skipped += (b - a) * int(data.high[p] - data.low[p])
            continue
        below, under = queries.children[q], data.children[p]
        if not below and not under:
            c, d = int(data.low[p]), int(data.high[p])
            best.offer(a, b, queries.points[a:b] @ data.points[c:d].T, ids[c:d])
        elif under and (not below or data.radius[p] >= queries.radius[q]):
            towards = data.points[data.centre[under]] @ queries.points[queries.centre[q]] + data.radius[under] * queries.norm[q]
            roots += [(q, under[i]) for i in np.argsort(towards)]  # the most promising is popped first
        else:
            roots += [(c, p) for c in below]
    return skipped


def _vectors(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """vec_id, and by length the rows and integer vectors that take part."""
    ids, lists = common.column(batch, "vec_id"), common.column(batch, "embedding")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    starts = np.cumsum(sizes) - sizes
    usable = ids.is_valid().to_numpy(zero_copy_only=False)
    found = {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero((sizes == size) & usable)
        x = np.floor(scale * flat[starts[rows][:, None] + np.arange(size)])
        good = np.isfinite(x).all(1)
        found[int(size)] = rows[good], x[good]
    return ids.fill_null(0).to_numpy().astype(np.int64), found


def _search_task(shared, k: int, scale: float, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {size: (tree, ids, Best(ids, k)) for size, (tree, ids) in shared.value.items()}
        held: dict[int, list] = {size: [] for size in blocks}

        def flush(size: int) -> None:
            tree, _, best = blocks[size]
            ids, points = (np.concatenate(x) for x in zip(*held[size]))
            held[size] = []
            data = build(points)
            search(tree, data, ids[data.order], best)

        longest = {size: np.sqrt((tree.points**2).sum(1).max(initial=0)) for size, (tree, _, _) in blocks.items()}
        for batch in batches:
            all_ids, found = _vectors(batch, scale)
            for size, (rows, x) in found.items():
                if size in blocks:
                    if np.sqrt((x**2).sum(1).max(initial=0)) * longest[size] >= EXACT:
                        raise ValueError("inner products of 2 ** 53 and more are not exact in doubles: scale the vectors down")
                    for a in range(0, len(rows), batch_rows):
                        held[size].append((all_ids[rows[a : a + batch_rows]], x[a : a + batch_rows]))
                        if sum(len(i) for i, _ in held[size]) >= batch_rows:
                            flush(size)
        for size, (_, ids, best) in blocks.items():
            if held[size]:
                flush(size)
            q, r = np.nonzero(np.isfinite(best.score))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best.vec[q, r]), pa.array(best.score[q, r].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def exact_topk(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, query_block: int = QUERY_BLOCK, batch_rows: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id and score of the k best partners of every row whose vec_id is divisible by ``every``."""
    common.importable(spark)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own_vectors = plain.filter((F.col("vec_id") % every == 0) & usable).groupBy("vec_id", F.size("embedding").alias("size")).agg(F.min("embedding").alias("embedding"))
    asked = common.Scratch(spark).save(own_vectors, "queries")  # one vector of each vec_id and length
    total = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("numbers")).first()
    blocks = max(1, -(-total["n"] // query_block), -(-8 * total["numbers"] // QUERY_BYTES))
    parts = []
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = own.select("vec_id", "embedding").orderBy("vec_id", "embedding").toArrow()  # about query_block rows
        trees = {}
        batch = rows.combine_chunks().to_batches()
        if not batch:
            continue
        ids, found = _vectors(batch[0], scale)
        for size, (at, x) in found.items():
            own_ids, first = np.unique(ids[at], return_index=True)
            if len(first):
                tree = build(x[first])
                trees[size] = tree, own_ids[tree.order]
        if trees:
            shared = spark.sparkContext.broadcast(trees)
            parts.append(plain.mapInArrow(common.tidied(_search_task(shared, k, scale, batch_rows)), "query_id long, vec_id long, score long"))
    if not parts:
        return plain.limit(0).selectExpr("vec_id query_id", "0 rank", "vec_id", "0L score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % {EVERY} = 0 AND d.vec_id <> q.vec_id AND len(q.e) = len(d.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
