"""Approximate nearest neighbours by largest inner product.

Vectors are lifted to equal length, so the largest inner product is the smallest
distance; Gaussian (2-stable) projections to PROJECTED dimensions are indexed by
kd-trees. A query takes projected neighbours in rising distance, leaf by leaf,
and verifies them on the original vectors. For a vector at distance r, its
squared projected distance over r squared is chi-square with PROJECTED degrees of
freedom; the search stops once a vector nearer than the k-th found would have
shown up by now with probability CONFIDENCE.

The whole index is two levels deep. A kd-tree over a bounded sample of projected
vectors cuts space into blocks of about BLOCK vectors; every vector is in one,
with a tree of its own there, and a block keeps its bounding box. A query first
searches its home block; the k-th distance found there then shuts out all blocks
whose boxes are too far by the same test, and stops the search early in the
others. Boxes nest as the cuts do, so a query finds its blocks down the tree, without
a look at all of them. Queries of a block come in blocks too; only k rows a query
and block are merged.

The driver and the closures hold two boxes and SAMPLE_OF_BLOCK projected points for
each BLOCK vectors: a few bytes for each thousand of the vectors' own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import util

K, EVERY = 20, 20
PROJECTED, CONFIDENCE, LEAF = 8, 0.97, 64
#: Vectors in a block of candidates and of queries.
BLOCK, QUERIES_BLOCK = 32_768, 2_048
#: Projected vectors that the cuts between blocks are fitted on: in all, or for each block where that is more.
SAMPLE, SAMPLE_OF_BLOCK = 20_000, 16
SEED = 99


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """For an even number of degrees of freedom."""
    h = np.asarray(x, np.float64) / 2
    term = np.exp(-np.minimum(h, 700))
    total = np.zeros_like(h)
    for j in range(degrees // 2):
        total += term
        term = term * h / (j + 1)
    return 1 - total


def chi_square_quantile(p: float, degrees: int) -> float:
    lo, hi = 0.0, 10.0 * degrees + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, degrees) < p else (lo, mid)
    return hi


class KdTree:
    """Points in leaves of about `leaf`, cut at medians of the widest dimension;
    a leaf keeps its points' bounding box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        cuts, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                cuts.append((a, b))
                continue
            own = points[self.order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        cuts.sort()
        self.start = np.array([a for a, _ in cuts], np.int64)
        self.end = np.array([b for _, b in cuts], np.int64)
        sorted_points = points[self.order]
        self.low = np.minimum.reduceat(sorted_points, self.start, axis=0) if len(points) else np.empty((0, points.shape[1]))
        self.high = np.maximum.reduceat(sorted_points, self.start, axis=0) if len(points) else np.empty((0, points.shape[1]))

    def leaf_distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances from a point to all leaves' boxes: what the projected distance of their points is at least."""
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", gap, gap)


def top_k(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: largest score, then smallest id."""
    if len(ids) > 4 * k:
        worst = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= worst)
    else:
        some = np.arange(len(ids))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def projection(dims: int) -> np.ndarray:
    """The same Gaussian matrix in every process."""
    return np.random.default_rng(SEED).normal(size=(dims, PROJECTED))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Projections of vectors lifted to length `longest`."""
    lift = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
    return np.hstack([x, lift[:, None]]) @ projection(x.shape[1] + 1)


def cuts(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, threshold) of the inner nodes of a kd-tree with 2 ** levels leaves, children of node k at 2 k and 2 k + 1."""
    axis, at = np.zeros(1 << levels, np.int64), np.zeros(1 << levels)
    parts = {1: points}
    for node in range(1, 1 << levels):
        own = parts.pop(node)
        if len(own):
            axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            at[node] = np.median(own[:, axis[node]])
        right = own[:, axis[node]] > at[node]
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return axis, at


def placed(points: np.ndarray, axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.ones(len(points), np.int64)
    while len(node) and node[0] < len(axis):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > at[node])
    return node - len(axis)


class Boxes:
    """Bounding boxes of the blocks (leaves) of cuts and of all nodes above them;
    node 1 is the root, children of node k are 2 k and 2 k + 1."""

    def __init__(self, levels: int, blocks: np.ndarray, low: np.ndarray, high: np.ndarray, parts: np.ndarray):
        n = 1 << levels
        self.low, self.high = np.full((2 * n, PROJECTED), np.inf), np.full((2 * n, PROJECTED), -np.inf)
        self.low[n + blocks], self.high[n + blocks] = low, high
        for k in range(levels - 1, -1, -1):
            own, left = slice(1 << k, 2 << k), slice(2 << k, 4 << k)
            self.low[own] = self.low[left].reshape(-1, 2, PROJECTED).min(axis=1)
            self.high[own] = self.high[left].reshape(-1, 2, PROJECTED).max(axis=1)
        self.parts = np.ones(n, np.int64)
        self.parts[blocks] = parts
        self.leaves = n

    def distances(self, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distances of a point to boxes; infinite to empty ones."""
        gap = np.maximum(np.maximum(self.low[nodes] - q, q - self.high[nodes]), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def within(self, q: np.ndarray, limit: float, closed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, distances) of the boxes nearer than limit (closed: or as near)."""
        nodes = np.ones(1, np.int64)
        while True:
            near = self.distances(nodes, q)
            some = (near <= limit) & np.isfinite(near) if closed else near < limit
            nodes, near = nodes[some], near[some]
            if not len(nodes) or nodes[0] >= self.leaves:
                return nodes - self.leaves, near
            nodes = np.concatenate([2 * nodes, 2 * nodes + 1])

    def nearest(self, q: np.ndarray) -> int:
        """The block whose box is nearest, the first among equals."""
        node = 1
        while node < self.leaves:
            node = 2 * node + int(np.argmin(self.distances(np.array([2 * node, 2 * node + 1]), q)))
        blocks, near = self.within(q, float(self.distances(np.array([node]), q)[0]), closed=True)
        return int(blocks[np.lexsort((blocks, near))[0]])


def query_point(q: np.ndarray) -> np.ndarray:
    """Projections of queries: their lift is 0."""
    return np.hstack([q, np.zeros((len(q), 1))]) @ projection(q.shape[1] + 1)


class Block:
    """Vectors of one block: originals, lifted projections and their tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float):
        self.longest = longest
        self.tree = KdTree(lifted(x, longest))
        self.x, self.ids = x[self.tree.order], ids[self.tree.order]
        self.need = chi_square_quantile(CONFIDENCE, PROJECTED)

    def search(self, qid: int, q: np.ndarray, k: int, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest found, of rows other than the query's.
        bound: a squared distance within which k are known already."""
        tree = self.tree
        near = tree.leaf_distances(query_point(q[None])[0])
        order = np.argsort(near, kind="stable")
        ids, scores = np.empty(0, np.int64), np.empty(0)
        level = q @ q + self.longest**2
        a, step = 0, 8
        while a < len(order):
            # nearer vectors than the k-th that are unseen are at least near[order[a]] away in projection
            kth = min(bound, level - 2 * scores[-1] if len(ids) >= k else np.inf)
            if near[order[a]] >= self.need * max(kth, 1e-12):
                break
            leaves = order[a : a + step]
            rows = np.concatenate([np.arange(s, e) for s, e in zip(tree.start[leaves], tree.end[leaves])])
            rows = rows[self.ids[rows] != qid]
            ids = np.concatenate([ids, self.ids[rows]])
            scores = np.concatenate([scores, np.einsum("ij,j->i", self.x[rows], q)])
            best = top_k(ids, scores, k)
            ids, scores = ids[best], scores[best]
            a, step = a + step, min(2 * step, 256)
        return ids, scores


def _vectors(batch: pa.RecordBatch, column: str = "v"):
    """(dimension, rows, matrix) for each dimension in a batch."""
    d = np.asarray(batch.column("d"))
    v = batch.column(column)
    for n in np.unique(d).tolist():
        rows = np.flatnonzero(d == n)
        yield n, rows, pa.compute.list_flatten(v.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(-1, n)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v double array) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return own.where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda c: c != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the largest inner
    product found for each query, ties to the smaller id, rows with the query's id left out.

    Vectors that are null, empty, zero or hold a null or a non-finite component
    take no part, as queries or candidates, nor do null ids; vectors of another
    length than a query's don't meet it. Fewer than k candidates give all; repeated rows are candidates
    of their own, and repeated queries give one answer. Scores are in double
    precision on the original vectors. Empty tables give empty results.
    """
    spark = vectors.sparkSession
    util.bounded_batches(spark)
    own = usable(vectors, id_col, vec_col).withColumn("d", F.size("v"))
    asked = usable(queries, id_col, vec_col).dropDuplicates(["id"]).withColumn("d", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    sizes = own.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("longest")).collect()  # a row for each vector length
    longest = {r.d: r.longest for r in sizes}
    levels = {r.d: max(0, math.ceil(math.log2(r.n / BLOCK))) for r in sizes}
    if not sizes:
        return own.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    need = chi_square_quantile(CONFIDENCE, PROJECTED)

    # cuts between blocks, from a sample
    part = {r.d: int(min(1.0, max(SAMPLE / len(sizes), SAMPLE_OF_BLOCK << levels[r.d]) / r.n) * (1 << 30)) for r in sizes if levels[r.d]}
    trees = {d: (np.zeros(1, np.int64), np.zeros(1)) for d in longest}
    if part:
        drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.create_map(*[F.lit(x) for kv in part.items() for x in kv])[F.col("d")]

        def project(batches):
            for batch in batches:
                for d, _, x in _vectors(batch):
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), pa.array(lifted(x, longest[d]).tolist(), pa.list_(pa.float64()))], names=["d", "p"])

        got = own.where(drawn).select("d", "v").mapInArrow(project, "d int, p array<double>").toPandas()
        trees |= {d: cuts(np.array(g["p"].tolist()), levels[d]) for d, g in got.groupby("d")}

    def place(point):
        def run(batches):
            for batch in batches:
                for d, rows, x in _vectors(batch):
                    p = point(x, d)
                    ids, v = batch.column("id").take(pa.array(rows)), batch.column("v").take(pa.array(rows))
                    columns = [pa.array([d] * len(x), pa.int32()), pa.array(placed(p, *trees[d])), ids, v, pa.array(p.tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["d", "b", "id", "v", "p"])

        return run

    schema = "d int, b long, id long, v array<double>, p array<double>"
    own = util.written(own.select("d", "id", "v").mapInArrow(place(lambda x, d: lifted(x, longest[d])), schema), "vectors")
    asked = util.written(asked.where(F.col("d").isin(*longest)).select("d", "id", "v").mapInArrow(place(lambda x, d: query_point(x)), schema), "queries")

    # boxes of the blocks that hold rows: as many as blocks; large ones (ties) fall into parts
    edges = [f(F.get("p", F.lit(k))).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(PROJECTED)]
    boxes = own.groupBy("d", "b").agg(F.count("*").alias("n"), *edges).toPandas()
    boxes["parts"] = np.ceil(boxes["n"] / (2 * BLOCK)).astype(int)
    edge = lambda g, n: g[[f"{n}{k}" for k in range(PROJECTED)]].to_numpy()
    known = {d: Boxes(levels[d], g["b"].to_numpy(), edge(g, "lo"), edge(g, "hi"), g["parts"].to_numpy()) for d, g in boxes.groupby("d")}
    parts = spark.createDataFrame(boxes[["d", "b", "parts"]].astype("int64"))
    rows = own.join(parts, ["d", "b"]).withColumn("s", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).select(F.col("d").cast("long"), "b", "s", "id", "v")

    def route(batches):
        """The blocks a query visits, nearest first: only home (kth null), or all others near enough."""
        for batch in batches:
            kth, out = batch.column("kth").to_pylist(), []
            for d, at, p in _vectors(batch.set_column(batch.schema.get_field_index("d"), "d", pa.array([PROJECTED] * batch.num_rows, pa.int32())), "p"):
                for k, q in zip(at.tolist(), p):
                    own_boxes = known[batch.column("d")[k].as_py()]
                    home = own_boxes.nearest(q)
                    own_part = batch.column("id")[k].as_py() % int(own_boxes.parts[home])
                    if kth[k] is None:
                        out.append((k, home, own_part, None))
                        continue
                    for j in own_boxes.within(q, need * max(kth[k], 1e-12))[0].tolist():
                        out += [(k, j, s, kth[k]) for s in range(int(own_boxes.parts[j])) if (j, s) != (home, own_part)]
            take = pa.array([o[0] for o in out], pa.int64())
            columns = [batch.column("d").cast(pa.int64()).take(take), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), batch.column("id").take(take), batch.column("v").take(take), pa.array([o[3] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "b", "s", "id", "v", "kth"])

    def meet(group: pa.Table) -> pa.Table:
        asks = np.asarray(group.column("asks").combine_chunks().to_numpy(zero_copy_only=False))
        ids, d = np.asarray(group.column("id")), group.column("d")[0].as_py()
        x = pa.compute.list_flatten(group.column("v").combine_chunks()).to_numpy().reshape(-1, d)
        bound = group.column("kth").to_pandas().fillna(np.inf).to_numpy()
        out_q, out_i, out_s, out_d = [], [], [], []
        if asks.any() and not asks.all():
            block = Block(ids[~asks], x[~asks], longest[d])
            for qid, q, most in zip(ids[asks].tolist(), x[asks], bound[asks].tolist()):
                i, score = block.search(qid, q, k, most)
                out_q.append(np.full(len(i), qid))
                out_i.append(i)
                out_s.append(score)
                out_d.append(q @ q + longest[d] ** 2 - 2 * score)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.empty(0, t))
        return pa.table({"query_id": cat(out_q, np.int64), "vec_id": cat(out_i, np.int64), "score": cat(out_s, np.float64), "far": cat(out_d, np.float64)})

    def visited(routed: DataFrame) -> DataFrame:
        """k rows at most for each query and block; a block's queries come QUERIES_BLOCK at a time."""
        load = routed.groupBy("d", "b", "s").agg(F.ceil(F.count("*") / QUERIES_BLOCK).alias("qs"))
        seekers = routed.join(load, ["d", "b", "s"]).select("d", "b", "s", F.lit(True).alias("asks"), "id", "v", "kth", F.pmod(F.xxhash64("id", F.lit(2)), F.col("qs")).alias("q"))
        held = rows.join(load, ["d", "b", "s"]).select("d", "b", "s", F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("kth"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qs") - 1)).alias("q"))
        return held.unionByName(seekers).groupBy("d", "b", "s", "q").applyInArrow(meet, "query_id long, vec_id long, score double, far double")

    routes = "d long, b long, s long, id long, v array<double>, kth double"
    first = util.written(visited(asked.withColumn("kth", F.lit(None).cast("double")).mapInArrow(route, routes)), "home")
    # the k-th distance found at home; a query that found fewer must visit every block
    kth = first.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("far")).alias("kth"))
    bounded = asked.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
    found = first.unionByName(visited(bounded.select(*asked.columns, "kth").mapInArrow(route, routes)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each vector whose id is divisible by 20."""
    vectors = util.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op7_nearest": op7_nearest}
