"""Exact ranked lexical search: sparse ball trees with centroid-radius bounds, searched best-first.

A document is a sparse vector of term impacts, an item one of term weights, and a score is their inner product in whole
numbers.  Every task cuts its documents into shards of bounded size and builds a binary tree of balls over each: the
members of a node are split at a wide gap of their projections on the line between two far members.  For an item q, no
member of a ball with centroid c and radius r scores more than q.c + |q| r; that bound is computed in doubles and
rounded up past its own error, so it is safe.  Nodes are opened best bound first until the next bound is below the last
kept score; at a leaf the whole-number scores are exact.  A node whose bound equals the last kept score is still opened,
because of ties by id.

Items are taken in blocks of at most about ``BLOCK_TERMS`` (item, term) pairs, each against all documents; one block's
terms and document frequencies are what the driver holds and broadcasts.  Only the terms of the block take part in a
document's vector; the rest cannot change a score.  A shard's best rows go to a window that ranks them by item.

Defined cases: null and empty texts have no terms, count nowhere and are never found; each row is a document, so repeated
rows are ranked one by one; rows without doc_id count in the statistics and are not ranked; an item's terms are those of
all its rows, rows without item_id are no items; equal scores go by ascending doc_id; an item without a scoring document
has no rows; empty tables give none.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paysieve.llm.common import saved

TOP = 10
SHARD = 8192  # documents per tree
LEAF = 64
BLOCK_TERMS = 16_000  # (item, term) pairs per block of items
# Digits, A-Z, a-z and all beyond ASCII belong to terms; every other byte separates them, and A-Z are lower-cased.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Rows:
    """Sparse rows of whole numbers: row i has columns cols[ptr[i]:ptr[i + 1]] with values vals."""

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int):
        self.ptr, self.cols, self.vals, self.width = ptr, cols, vals, width

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.ptr[rows + 1] - self.ptr[rows]
        ptr = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.ptr[rows] - ptr[:-1], sizes) + np.arange(ptr[-1])
        return Rows(ptr, self.cols[at], self.vals[at], self.width)

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Row sums of vals * dense[cols], in the type of ``dense``."""
        sums = np.concatenate([np.zeros(1, dense.dtype), np.cumsum(self.vals * dense[self.cols], dtype=dense.dtype)])
        return sums[self.ptr[1:]] - sums[self.ptr[:-1]]

    def squares(self) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.vals.astype("f8") ** 2)])
        return sums[self.ptr[1:]] - sums[self.ptr[:-1]]

    def mean(self) -> np.ndarray:
        return np.bincount(self.cols, self.vals, self.width) / len(self)

    def dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        at = slice(self.ptr[row], self.ptr[row + 1])
        out[self.cols[at]] = self.vals[at]
        return out


class BallTree:
    """Balls over sparse rows; ``left`` is -1 at leaves, which hold members[first:last]."""

    def __init__(self, rows: Rows, leaf: int = LEAF):
        self.rows, self.width = rows, rows.width
        self.members = np.arange(len(rows))
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.spans: list[tuple[int, int]] = []
        self.left: list[int] = []
        self.right: list[int] = []
        todo = [(0, len(rows), -1, False)]
        while todo:
            first, last, parent, is_right = todo.pop()
            node, own = len(self.left), self.rows.take(self.members[first:last])
            centre = own.mean()
            # |x - c|^2 = |x|^2 - 2 x.c + |c|^2; rounding is covered by a slack in proportion to the terms.
            norms, middle = own.squares(), float(centre @ centre)
            away = np.maximum(norms - 2 * own.dot(centre) + middle, 0.0)
            slack = 1e-9 * (float(norms.max()) + middle + 1)
            self.centres.append(centre)
            self.radii.append(math.sqrt(float(away.max()) + slack) * (1 + 1e-9))
            self.spans.append((first, last))
            self.left.append(-1)
            self.right.append(-1)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            if last - first > leaf:
                a = own.dense(int(away.argmax()))
                to_a = norms - 2 * own.dot(a)
                b = own.dense(int(to_a.argmax()))
                places = own.dot(a - b)
                order = np.argsort(places, kind="stable")
                self.members[first:last] = self.members[first:last][order]
                # The widest gap in the middle half keeps groups whole and the tree's depth logarithmic.
                low, high = len(order) // 4, 3 * len(order) // 4
                gaps = np.diff(places[order][low:high + 1])
                half = first + (low + int(gaps.argmax()) + 1 if gaps.any() else len(order) // 2)
                todo += [(half, last, node, True), (first, half, node, False)]
        self.leaves = {n: self.rows.take(self.members[slice(*self.spans[n])]) for n in range(len(self.left)) if self.left[n] < 0}

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For every node a whole number that no member's score exceeds."""
        norm = math.sqrt(float((weights.astype("f8") ** 2).sum()))
        centre = np.array([c[terms] @ weights for c in self.centres])
        return np.floor((centre + norm * np.array(self.radii)) * (1 + 1e-9)) + 1

    def search(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """Best (score, id) of at most k rows with a positive score, equal scores by id; and the number of rows scored."""
        dense = np.zeros(self.width, "i8")
        dense[terms] = weights
        bound = self.bounds(terms, weights)
        queue, best, scored = [(-bound[0], 0)], [], 0
        while queue:
            limit, node = heapq.heappop(queue)
            if -limit <= 0 or len(best) == k and -limit < best[-1][0]:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(queue, (max(limit, -bound[child]), child))
                continue
            score = self.leaves[node].dot(dense)
            scored += len(score)
            good = np.flatnonzero(score > 0 if len(best) < k else score >= best[-1][0])
            if len(good):
                names = ids[self.members[slice(*self.spans[node])]][good]
                order = np.lexsort((names, -score[good]))[:k]
                best = sorted([*best, *zip(score[good][order].tolist(), names[order].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        return best, scored


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), columns and counts of the block's terms, per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.value
        for b in batches:
            n, cols, counts = [], [], []
            for t in b["text"]:
                words = terms_of(t)
                found = Counter(map(known.get, words))
                found.pop(None, None)
                n.append(len(words))
                cols.append(np.fromiter(found.keys(), "i4", len(found)))
                counts.append(np.fromiter(found.values(), "i8", len(found)))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": n, "cols": cols, "counts": counts})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n long, cols array<int>, counts array<long>")


def _items(items: DataFrame) -> DataFrame:
    """item_id, term, block: the distinct terms of every item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, t) for i, text in zip(b["item_id"], b["text"], strict=True) for t in dict.fromkeys(terms_of(text))]
            yield pd.DataFrame(rows, columns=["item_id", "term"])

    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInPandas(run, "item_id string, term binary").distinct()


def _search_block(counted: DataFrame, wanted: dict[str, tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, width: int, k: int, shard: int) -> DataFrame:
    """item_id, doc_id, score: the best rows of every shard."""
    shared = counted.sparkSession.sparkContext.broadcast(wanted)  # one block of items

    def best(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat(parts, ignore_index=True)
        ids, sizes = b["doc_id"].to_numpy("i8"), b["cols"].map(len).to_numpy("i8")
        cols, counts = np.concatenate(b["cols"].to_list()).astype("i8"), np.concatenate(b["counts"].to_list()).astype("i8")
        m = 10 + 90 * b["n"].to_numpy("i8") * n_docs // n_terms
        vals = 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, sizes))
        tree = BallTree(Rows(np.concatenate([[0], np.cumsum(sizes)]), cols, vals, width))
        rows = []
        for item, (terms, weights) in shared.value.items():
            rows += [(item, i, s) for s, i in tree.search(terms, weights, ids, k)[0]]
        yield pd.DataFrame(rows, columns=["item_id", "doc_id", "score"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for at in range(0, len(b), shard):
                held.append(b.iloc[at:at + shard])
                if sum(map(len, held)) >= shard:
                    yield from best(held)
                    held = []
        if held:
            yield from best(held)

    # Documents without a term of the block score nothing.
    rows = counted.where("doc_id IS NOT NULL AND size(cols) > 0")
    return rows.mapInPandas(run, "item_id string, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, shard: int = SHARD) -> DataFrame:
    """item_id (text), rank, doc_id, score: the k highest-scoring documents of every item."""
    spark = docs.sparkSession
    pairs = saved(_items(items))
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    found = spark.createDataFrame([], "item_id string, doc_id long, score long")
    for block in range(blocks):
        own: dict[str, list[bytes]] = {}
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            own.setdefault(r.item_id, []).append(bytes(r.term))
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms in own.values() for t in terms}))}
        counted = saved(_counted(docs, spark.sparkContext.broadcast(vocabulary)))
        n_docs, n_terms = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), "i8")
        for r in counted.select(F.explode("cols").alias("term")).groupBy("term").count().collect():  # the block's terms
            df[r.term] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], "i8")
        wanted = {}
        for item, terms in sorted(own.items()):
            cols = np.array(sorted(vocabulary[t] for t in terms), "i8")
            wanted[item] = (cols, weight[cols])
        if n_terms:
            found = found.unionByName(saved(_search_block(counted, wanted, n_docs, n_terms, len(vocabulary), k, shard)))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
