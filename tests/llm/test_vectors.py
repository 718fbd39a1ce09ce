"""Whitening, ranked search and nearest neighbours against plain numpy and plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from paysieve.llm import ball_tree, vantage, whitening
from paysieve.llm.common import prepare
from paysieve.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
VECS = "vec_id long, embedding array<float>, label int, v string, score string, dim string"


@pytest.fixture(scope="module")
def vec_frame(spark):
    def make(rows):
        return prepare(spark).createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], VECS)
    return make


def f4(rows):
    return [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]


# ---- whitening


def matrices():
    r = np.random.default_rng(5)
    a, b = r.normal(size=(40, 40)), r.normal(size=(40, 6))
    yield a @ a.T
    yield b @ b.T
    yield np.diag([5.0, 5, 5, 1, 1, 0, 0])
    yield np.ones((6, 6))
    yield np.zeros((3, 3))
    yield np.array([[2.0]])
    yield np.diag([1e8, 1, 1e-8, 0])
    q = np.linalg.qr(a)[0]
    yield q @ np.diag(np.repeat(np.arange(10.0), 4)) @ q.T


@pytest.mark.parametrize("v", list(matrices()))
def test_split_finds_all_eigenpairs(v):
    e, q = whitening.eigen_split(v)
    size = max(np.linalg.norm(v), 1e-300)
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-13 * size, rtol=0)
    assert np.abs(q.T @ q - np.eye(len(v))).max() < 1e-13
    assert np.abs(v @ q - q * e).max() < 1e-13 * size


def test_polar_factor_is_the_sign():
    r = np.random.default_rng(6)
    q = np.linalg.qr(r.normal(size=(20, 20)))[0]
    d = np.concatenate([-np.logspace(-9, 0, 10), np.logspace(-7, 1, 10)])
    u = whitening.polar_factor(q @ np.diag(d) @ q.T)
    assert np.abs(u - q @ np.diag(np.sign(d)) @ q.T).max() < 1e-6
    assert np.abs(u @ u - np.eye(20)).max() < 1e-12


def plain_whitening(rows, k=8):
    kept = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    dims = Counter(len(v) for _, v in kept)
    dim = max(dims, key=lambda d: (dims[d], d))
    kept = [(i, v) for i, v in kept if len(v) == dim]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = np.array([[n * a - b for a, b in zip(row, s)] for row in x], dtype=object)
    cov = np.cov((d / n).astype("f8").T, bias=True).reshape(dim, dim)
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    return [i for i, _ in kept], n, (d * d).sum(axis=1).tolist(), (d / n).astype("f8") @ q[:, :k] / np.sqrt(e[:k]), (e / e.sum())[:k]


def same_whitening(out, rows):
    ids, n, deviation, w, share = plain_whitening(rows)
    got = sorted(out.collect(), key=lambda r: (r.vec_id, r.component))
    order = np.argsort(ids, kind="stable")
    assert len(got) == w.size
    assert {r.n for r in got} == {n}
    k = w.shape[1]
    assert [r.deviation for r in got[::k]] == [deviation[i] for i in order]
    mine = np.array([r.whitened for r in got]).reshape(-1, k)
    assert [r.component for r in got[:k]] == list(range(1, k + 1))
    signs = np.sign((mine * w[order]).sum(axis=0))
    assert np.abs(mine * signs - w[order]).max() < 1e-8
    assert np.allclose([r.explained for r in got[:k]], share, rtol=1e-9)
    assert all(abs(r.identity_error) < 1e-9 for r in got)


def test_whitening_query_equals_numpy(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same_whitening(QUERIES["op11_embedding_whitening"](spark, SF), rows)


def test_whitening_edge_rows(spark, vec_frame, tmp_path):
    r = np.random.default_rng(8)
    rows = f4([(i, r.normal(size=10).tolist()) for i in range(40)] + [(40, None), (41, []), (42, [1.0, None] + [0.0] * 8), (43, [math.inf] + [0.0] * 9),
               (44, [math.nan] * 10), (45, [1.0, 2.0]), (47, [30.5] * 10), (46, [0.25] * 10), (48, [0.25] * 10)])
    vec_frame(rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    same_whitening(QUERIES["op11_embedding_whitening"](spark, str(tmp_path)), rows)


def test_whitening_without_variance(vec_frame):
    assert whitening.whiten(vec_frame([])).count() == 0
    assert whitening.whiten(vec_frame([(1, None), (None, [None])])).count() == 0
    one = whitening.whiten(vec_frame([(1, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert [r.whitened for r in one] == [[None, None]] * 2
    assert {(r.n, int(r.deviation), r.identity_error) for r in one} == {(2, 0, None)}
    flat = whitening.whiten(vec_frame([(i, [float(i), 1.0, float(i)]) for i in range(9)])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] and r.identity_error < 1e-9 for r in flat)
    big = whitening.whiten(vec_frame([(i, [float(2 ** 38 * (i % 2)), 1.0]) for i in range(4)])).collect()
    assert {int(r.deviation) for r in big} == {(2 * 1024 * 2 ** 38) ** 2}


# ---- ranked search


def plain_search(docs, items, k=10):
    words = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(t):
        return words.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in rows if c), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    wanted = {}
    for i, t in items:
        if i is not None and t is not None:
            wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c in rows:
            if i is None or not c:
                continue
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(str(item), r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_search_equals_plain_loop(docs_frame, edge_rows, spark):
    r = random.Random(2)
    docs = [(i, t) for i, t, *_ in edge_rows]
    for n in range(100, 700):
        docs.append((n, " ".join(f"W{min(r.randrange(1, 400), r.randrange(1, 400))}" for _ in range(r.randrange(1, 60)))))
    docs += [(n, docs[200][1]) for n in range(2000, 2300)] + [(300, "no99 no98")]
    items = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(1, 30)))) for i in range(12)] + [
        (20, docs[200][1]), (21, None), (22, "!!"), (None, "w1 w2"), (23, "absentterm"), (24, "w5"), (24, "w5 w6"), (24, "w5"), (25, "ünï \U0001f600 TAIL")]
    frame = prepare(spark).createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    for options in ({}, {"block_terms": 40, "shard": 50}):
        out = ball_tree.ranked(docs_frame(docs).repartition(3), frame, **options)
        assert sorted((x.item_id, x.rank, x.doc_id, x.score) for x in out.collect()) == plain_search(docs, items)


def test_search_of_empty_tables(docs_frame, spark):
    items = prepare(spark).createDataFrame([(1, "a b")], "item_id long, text string")
    assert ball_tree.ranked(docs_frame([]), items).count() == 0
    assert ball_tree.ranked(docs_frame([(1, None), (2, "")]), items).count() == 0
    assert ball_tree.ranked(docs_frame([(1, "a b")]), items.limit(0)).count() == 0


def test_search_matches_its_sql(spark, duck):
    got = sorted(tuple(r) for r in QUERIES["op12_ranked_search"](spark, SF).select("item_id", "rank", "doc_id", "score").collect())
    assert got == sorted(duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op12_ranked_search']})").fetchall())
    assert got


def test_bounds_hold_and_prune():
    """No member scores above a node's bound; with clustered documents most are never scored."""
    r = np.random.default_rng(3)
    rows = []
    for c in range(64):
        base = np.sort(r.choice(500, 20, replace=False))
        for _ in range(40):
            rows.append((base, np.full(20, 500_000) + r.integers(0, 50, 20)))
    ptr = np.concatenate([[0], np.cumsum([len(c) for c, _ in rows])])
    sparse = ball_tree.Rows(ptr, np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), 500)
    tree = ball_tree.BallTree(sparse, leaf=32)
    ids = np.arange(len(rows))
    for c in range(0, 64, 7):
        terms, weights = rows[c * 40][0], r.integers(1, 3000, 20)
        dense = np.zeros(500, "i8")
        dense[terms] = weights
        scores = sparse.dot(dense)
        bound = tree.bounds(terms, weights)
        for node, (first, last) in enumerate(tree.spans):
            assert scores[tree.members[first:last]].max() <= bound[node]
        best, scored = tree.search(terms, weights, ids, 10)
        order = np.lexsort((ids, -scores))[:10]
        assert best == list(zip(scores[order].tolist(), order.tolist()))
        assert scored < len(rows) / 2


# ---- nearest neighbours


def plain_nearest(rows, k=20, every=20):
    kept = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = []
    for i, v in kept:
        if i % every == 0:
            scores = sorted((-sum_in_order(v, w), j) for j, w in kept if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def sum_in_order(a, b):
    s = 0.0
    for x, y in zip(a, b):
        s += x * y
    return s


@pytest.fixture(scope="module")
def vec_rows():
    r = np.random.default_rng(9)
    rows = [(i, (r.normal(size=8) * r.uniform(0.2, 3)).tolist()) for i in range(900)]
    rows += [(i, rows[33][1]) for i in range(900, 1500)]  # one common vector
    return f4(rows + [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0, None] + [0.0] * 6), (2080, [math.nan] * 8), (2100, [1.0, 2.0]), (2101, [3.0, -1.0]),
                      (None, [1.0] * 8), (40, rows[40][1]), (60, rows[61][1]), (2120, [5.0])])


@pytest.mark.parametrize("shard", [64, 8192])
def test_factor_one_is_exact(vec_frame, vec_rows, shard):
    from pyspark.sql import functions as F
    out = vantage.nearest(vec_frame(vec_rows).repartition(5), F.col("vec_id") % 20 == 0, factor=1.0, shard=shard)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in out.collect()) == plain_nearest(vec_rows)


def test_hot_queries_are_salted(vec_frame, vec_rows, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(vantage, "MANY", 5)
    out = vantage.nearest(vec_frame(vec_rows), F.col("vec_id") % 20 == 0, factor=1.0)
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in out.collect()) == plain_nearest(vec_rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    out = {}
    for x in QUERIES["op13_nearest_neighbours"](spark, folder).collect():
        out.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], "f8")
    at, hit, n = {int(i): j for j, i in enumerate(ids)}, 0, 0
    assert sorted(out) == sorted(i for i in at if i % 20 == 0)
    for i, got in out.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(s == sum_in_order(m[at[i]], m[at[j]]) for _, j, s in got)
        assert [(-s, j) for _, j, s in got] == sorted((-s, j) for _, j, s in got)
        scores = m @ m[at[i]]
        best = [int(j) for j in ids[np.lexsort((ids, -scores))] if j != i][:20]
        hit, n = hit + len({g[1] for g in got} & set(best)), n + 20
    assert hit / n >= 0.95


def test_pruning_searches_less_as_the_factor_grows():
    r = np.random.default_rng(4)
    x = np.concatenate([c + 0.05 * r.normal(size=(200, 16)) for c in r.normal(size=(20, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scored = []
    for factor in (1.0, 2.0, 6.0):
        tree = vantage.VantageTree(x, np.arange(len(x)), float((x ** 2).sum(axis=1).max()), factor)
        tree.search(x[::40], 21)
        scored.append(tree.scored)
    assert scored[0] < 100 * len(x) * 0.5
    assert scored[2] <= scored[1] <= scored[0]


def test_nearest_of_empty_tables(vec_frame):
    from pyspark.sql import functions as F
    every = F.col("vec_id") % 20 == 0
    assert vantage.nearest(vec_frame([]), every).count() == 0
    assert vantage.nearest(vec_frame([(1, [1.0])]), every).count() == 0
    assert vantage.nearest(vec_frame([(0, [1.0])]), every).count() == 0
    assert [tuple(r) for r in vantage.nearest(vec_frame(f4([(0, [1e30]), (3, [1e30]), (4, [-1e30])])), every).collect()] == [(0, 1, 3, float(np.float32(1e30)) ** 2), (0, 2, 4, -float(np.float32(1e30)) ** 2)]
