"""Nearest neighbours by largest inner product: a vantage-point tree per shard, with relaxed triangle pruning.

Inner products become distances by one more coordinate: sqrt(M^2 - |x|^2) for a candidate x, 0 for a query q, with M the
largest norm, gives |q - x|^2 = |q|^2 + M^2 - 2 q.x.  A tree node halves its points by their distance to a vantage point
and keeps the range of those distances on either side; by the triangle inequality no point of a side is nearer to q than
``gap`` = how far q's own distance to the vantage point lies outside that range.  A side is left out for a query when
``factor * gap`` exceeds the distance of the last neighbour kept so far: factor 1 is exact, larger ones search less.

Equal vectors are one point that stands for the smallest ids among them, as no larger one can be returned; equal query
vectors are searched once.  So a vector that a third of all rows share costs as much as any other.

Every shard holds at most about ``SHARD`` points.  Shard points and query points meet by a shuffle on the shard; within a
task a shard's points come first, then its queries in batches, so that a task holds one shard and one batch.  The best
rows of a shard are ranked by a window over the query vector, and handed to the queries that share it (salted where many
do).  Every query vector visits every shard, as the shards are dealt by hash; the trees prune within them.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite entries, and rows without vec_id take no
part; vectors of another length are neither candidates nor queries of one another; rows that repeat id and vector count
once; a query's candidates are the rows of all other ids; equal scores go by smaller vec_id; an empty table gives no rows;
other columns are ignored.  Scores add the products in the order of the dimensions, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.llm.common import saved
from paysieve.llm.vectors import usable

TOP, EVERY = 20, 20
FACTOR = 5.0
SHARD, LEAF = 8192, 64
MANY, SALTS, HOT_SHARE = 4096, 64, 1000  # query vectors shared by more than MANY rows and 1/HOT_SHARE of all get salts


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added in the order of the columns."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class VantageTree:
    """A vantage-point tree over candidate vectors, searched for many queries at once."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, largest: float, factor: float = FACTOR, leaf: int = LEAF):
        """``ids`` are the smallest ids of the vectors, by which ties are settled; ``largest`` is M^2."""
        self.x, self.ids, self.largest, self.factor = vectors, ids, largest, factor
        with np.errstate(all="ignore"):
            extra = np.sqrt(np.maximum(largest - (vectors ** 2).sum(axis=1), 0.0))
        self.points = np.column_stack([vectors, extra])
        self.squares = (self.points ** 2).sum(axis=1)
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []  # (first, last, vantage point, inner node, outer node, ranges)
        self.rng = np.random.default_rng(13)
        self.scored = 0
        self._build(0, len(vectors), leaf)

    def _away(self, points: np.ndarray, squares: np.ndarray, at: int) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(np.maximum(squares + self.squares[at] - 2 * (points @ self.points[at]), 0.0))

    def _build(self, first: int, last: int, leaf: int) -> int:
        node = len(self.nodes)
        self.nodes.append((first, last, -1, -1, -1, None))
        if last - first > leaf:
            own = self.order[first:last]
            some = self.rng.choice(own, min(len(own), 48), replace=False)
            # Of a few points, the one whose distances to others spread most.
            tried = self.rng.choice(own, min(len(own), 6), replace=False)
            spread = [np.var(self._away(self.points[some], self.squares[some], int(t))) for t in tried]
            vantage = int(tried[int(np.argmax(spread))])
            away = self._away(self.points[own], self.squares[own], vantage)
            half = len(own) // 2
            halves = np.argpartition(away, half)
            self.order[first:last] = own[halves]
            inner, outer = away[halves[:half]], away[halves[half:]]
            ranges = (inner.min(), inner.max(), outer.min(), outer.max())
            a = self._build(first, first + half, leaf)
            b = self._build(first + half, last, leaf)
            self.nodes[node] = (first, last, vantage, a, b, ranges)
        return node

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the best k vectors per query and their exact scores; -1 and -inf where there are fewer."""
        n = len(queries)
        self.q = queries
        self.q_points = np.column_stack([queries, np.zeros(n)])
        with np.errstate(all="ignore"):
            self.q_squares = (queries ** 2).sum(axis=1)
            # Rounding of a distance and of a blocked inner product, with room to spare.
            self.slack = 1e-7 * np.sqrt(self.q_squares + self.largest)
            self.eps = 1e-13 * queries.shape[1] * np.sqrt(self.q_squares * self.largest)
        self.best = np.full((n, k), -np.inf)
        self.found = np.full((n, k), -1, "i8")
        self.home = np.full(n, -1, "i8")
        everyone = np.arange(n)
        self._seed(0, everyone)
        self._visit(0, everyone)
        return self.found, self.best

    def _seed(self, node: int, who: np.ndarray) -> None:
        """The leaf on a query's own side of every split gives its first neighbours."""
        first, last, vantage, a, b, ranges = self.nodes[node]
        if vantage < 0:
            self.home[who] = node
            self._leaf(who, self.order[first:last])
            return
        d = self._away(self.q_points[who], self.q_squares[who], vantage)
        inside = d <= (ranges[1] + ranges[2]) / 2
        for child, side in ((a, who[inside]), (b, who[~inside])):
            if len(side):
                self._seed(child, side)

    def _visit(self, node: int, who: np.ndarray) -> None:
        first, last, vantage, a, b, ranges = self.nodes[node]
        if vantage < 0:
            who = who[self.home[who] != node]
            if len(who):
                self._leaf(who, self.order[first:last])
            return
        d = self._away(self.q_points[who], self.q_squares[who], vantage)
        for child, low, high in ((a, ranges[0], ranges[1]), (b, ranges[2], ranges[3])):
            with np.errstate(all="ignore"):
                gap = np.maximum(np.maximum(low - d, d - high), 0.0)
                last_kept = np.sqrt(np.maximum(self.q_squares[who] + self.largest - 2 * self.best[who, -1], 0.0))
                go = ~(self.factor * gap > last_kept + self.slack[who])  # a distance that is no number prunes nothing
            if go.any():
                self._visit(child, who[go])

    def _leaf(self, who: np.ndarray, members: np.ndarray) -> None:
        self.scored += len(who) * len(members)
        k = self.best.shape[1]
        with np.errstate(all="ignore"):
            rough = self.q[who] @ self.x[members].T
            i, j = np.nonzero(~(rough < (self.best[who, -1] - self.eps[who])[:, None]))
            scores = exact_scores(self.q[who[i]], self.x[members[j]])
        touched, place = np.unique(i, return_inverse=True)
        if not len(touched):
            return
        rows = who[touched]
        # The kept ones and the new ones, ranked together by query, score and id.
        owner = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        score = np.concatenate([self.best[rows].ravel(), scores])
        where = np.concatenate([self.found[rows].ravel(), members[j]])
        name = np.where(where >= 0, self.ids[where], np.iinfo("i8").max)
        order = np.lexsort((name, -score, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = rank < k
        self.best[rows] = score[order][keep].reshape(len(rows), k)
        self.found[rows] = where[order][keep].reshape(len(rows), k)


def points(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, vec (little-endian doubles), norm2 and uid (digest of the vector) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, m in usable(b.column("v")):
                m = m + 0.0  # one zero
                rows, m = rows[(m != 0).any(axis=1)], m[(m != 0).any(axis=1)]
                with np.errstate(all="ignore"):
                    norms = (m ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), m.shape[1], "i4")), pa.array([r.tobytes() for r in m.astype("<f8")], pa.binary()), pa.array(norms)],
                                                 names=["vec_id", "dim", "vec", "norm2"])

    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, dim int, vec binary, norm2 double").withColumn("uid", F.md5("vec"))


def _search_batches(k: int, factor: float):
    """Streams rows ordered by dim, shard, side: a shard's points (side 0) make its tree, then its queries (side 1) pass."""

    def answer(tree: VantageTree, names: list[np.ndarray], uids: list[str], queries: np.ndarray) -> pa.RecordBatch:
        found, best = tree.search(queries, k)
        uid, ids, scores = [], [], []
        for u, row, score in zip(uids, found, best, strict=True):
            there = row >= 0
            every = np.concatenate([names[p] for p in row[there]])
            value = np.repeat(score[there], [len(names[p]) for p in row[there]])
            order = np.lexsort((every, -value))[:k]
            uid += [u] * len(order)
            ids.append(every[order])
            scores.append(value[order])
        return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["uid", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree, names, held = None, None, [], []
        for b in batches:
            keys = np.column_stack([b.column(c).to_numpy() for c in ("dim", "shard", "side")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                part = b.slice(i, j - i)
                dim, shard, side = keys[i].tolist()
                matrix = np.frombuffer(b"".join(part.column("vec").to_pylist()), "<f8").reshape(-1, dim)
                if (dim, shard) != place:
                    place, tree, names, held = (dim, shard), None, [], []
                if side == 0:
                    held.append(matrix)
                    names += [np.array(x, "i8") for x in part.column("ids").to_pylist()]
                    largest = part.column("largest")[0].as_py()
                    continue
                if tree is None and held:
                    tree = VantageTree(np.concatenate(held), np.array([x[0] for x in names]), largest, factor)
                    held = []
                if tree is not None:
                    yield answer(tree, names, part.column("uid").to_pylist(), matrix)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = TOP, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``is_query`` (over vec_id) picks, against all other rows."""
    rows = saved(points(vectors).dropDuplicates(["uid", "vec_id"]))
    # A vector's ids: the smallest k + 1, as one of them may be the query itself.
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("uid").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    distinct = saved(ranked.groupBy("uid").agg(F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.first("norm2").alias("norm2"), F.array_sort(F.collect_list("vec_id")).alias("ids")))
    spaces = distinct.groupBy("dim").agg(F.max("norm2").alias("largest"), F.ceil(F.count("*") / shard).cast("int").alias("shards")).collect()  # one per vector length
    if not spaces:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    spaces_df = F.broadcast(vectors.sparkSession.createDataFrame(spaces))
    queries = rows.where(is_query).select("uid", F.col("vec_id").alias("query_id"))
    wanted = saved(queries.groupBy("uid").agg(F.count("*").alias("n")))

    side = lambda v: F.lit(v).alias("side")
    placed = distinct.join(spaces_df, "dim").select(
        "dim", F.pmod(F.xxhash64("uid"), F.col("shards")).cast("int").alias("shard"), side(0), "uid", "vec", "ids", "largest")
    asked = distinct.join(wanted, "uid", "left_semi").join(spaces_df, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), side(1), "uid", "vec", F.lit(None).cast("array<long>").alias("ids"), "largest")
    n_shards = sum(s.shards for s in spaces)
    met = placed.unionByName(asked).repartition(n_shards, "dim", "shard").sortWithinPartitions("dim", "shard", "side")
    found = met.mapInArrow(_search_batches(k + 1, factor), "uid string, vec_id long, score double")
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= k + 1)
    best = best.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("best"))

    # At most HOT_SHARE query vectors can each hold more than that share of the queries, so the list is small.
    n_queries = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(wanted.where(F.col("n") > max(MANY, math.ceil(n_queries / HOT_SHARE))).select("uid", F.lit(SALTS).alias("salts")))
    best = best.join(hot, "uid", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    queries = queries.join(hot, "uid", "left").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    own = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    out = queries.join(best, ["uid", "salt"]).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
