"""Jobs cover whole texts and whole tables."""

import inspect

import numpy as np
import pytest
from check import table
from paths import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paysieve.fixtures import requests
from paysieve.functions import features as X
from paysieve.operators import retrieval as RT
from paysieve.plans import learn
from paysieve.plans.memory import search_sides
from paysieve.sources import files as S
from paysieve.streaming import jobs as J


def plain_grid(text):
    """Cell means over all 2,048-byte tiles, byte by byte."""
    cells = [[] for _ in range(2048)]
    for i, b in enumerate(text.encode("utf-8")):
        cells[i % 2048].append(b)
    return np.array([sum(c) / len(c) / 255.0 if c else 0.0 for c in cells])


def test_byte_grid_covers_the_whole_text(spark):
    texts = ["", "short", "é" * 1024, "a" * 2048 + "\u00ff" * 10, "".join(chr(33 + i * i % 90) for i in range(5000)), "z" * 33_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.byte_grid(F.col("t")).alias("g"))
    for r in df.collect():
        g = plain_grid(texts[r.id])
        assert np.isclose(r.g.mean, g.mean()) and np.isclose(r.g.std, g.std()), r.id
        assert np.isclose(r.g.high, (g > 0.8).mean())
        assert np.isclose(r.g.edge, np.abs(np.diff(g.reshape(32, 64), axis=1)).sum() / 2048)
        blocks = g.reshape(8, 4, 16, 4).mean(axis=(1, 3)).ravel()
        vec = np.concatenate([[g.mean(), g.std(), (g > 0.6).mean(), (g < 0.05).mean()], blocks])[:64]
        n = np.linalg.norm(vec)
        assert np.allclose(r.g.vec, vec / n if n > 1e-8 else vec), r.id


def test_blank_line_blocks_hold_every_request_and_body(spark, duck):
    path = S.scratch(spark, "anomalous")
    S.write_blank_line_blocks(requests(spark, SF), path)
    b = S.read_blank_line_blocks(spark, path)
    want = requests(spark, SF).select(F.concat("method", F.lit(" "), "url", F.lit(" HTTP/1.1\nCookie: "), "cookie", F.when(F.col("body") != "", F.concat(F.lit("\n\n"), "body")).otherwise("")).alias("b"))
    strip = lambda c: F.regexp_replace(c, "\n$", "")
    assert sorted(r[0] for r in b.select(strip("block")).collect()) == sorted(r[0] for r in want.select(strip("b")).collect())
    # the oracle's text without its filter
    sql = entry.oracle_sql()["src_blankline_blocks"].replace(" WHERE body=''", "")
    df = entry.queries()["src_blankline_blocks"](spark, SF)
    cur = duck.execute(sql)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in cur.description], cur.fetchall())


def test_body_escapes_are_undone(spark):
    bodies = ["a=1\n\nb=2", "x\r\n\r\ny", "%0A%25%0D", "%250A", "\n\n", "{\"k\": \"v\"}", ""]
    df = spark.createDataFrame([("POST", f"/{i}", "c=1", b) for i, b in enumerate(bodies)], "method string, url string, cookie string, body string")
    path = S.scratch(spark, "normal")
    S.write_blank_line_blocks(df, path)
    got = {r.block.split(" ")[1]: r.block.partition("\n\n")[2] for r in S.read_blank_line_blocks(spark, path).collect()}
    assert {k: v.removesuffix("\n") if bodies[int(k[1:])] == "" else v for k, v in got.items()} == {f"/{i}": b for i, b in enumerate(bodies)}


@pytest.mark.parametrize("key", ["jn_retrieve", "rag_context"])
def test_searches_take_every_fiftieth_row_against_all(spark, duck, key):
    # the oracle's text with whole query and chunk sides
    sql = entry.oracle_sql()[key].replace("q.vec_id<5 AND c.vec_id>=5", "q.vec_id%50=0")
    df = entry.queries()[key](spark, SF)
    cur = duck.execute(sql)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("per_category", [False, True])
def test_search_is_the_same_in_one_and_in_many_blocks(spark, per_category):
    q, c = search_sides(spark, SF)
    a, b = (sorted(tuple(r) for r in RT.search(q, c, "embedding", 3, per_category, *sizes).select("qid", "chunk_id", "category", "rank").collect()) for sizes in ((), (3, 20)))
    assert a == b and len(a) >= 3 * q.count()


def test_hot_source_is_scored_in_chunks_and_over_batches(spark):
    n = 900
    df = spark.range(n).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 40).cast("bigint").alias("user_id"),
                               F.timestamp_seconds(F.floor(F.col("id") * 7 / 2)).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 20).alias("entropy"))
    want, seen = {}, {}
    for r in df.orderBy("ts", "event_id").collect():  # one ring after the other
        last, rates, x = seen.get(r.user_id, (None, [], []))
        us = r.ts.timestamp()
        rates, x = (rates + [1.0 if last is None else 1.0 / max(us - last, 1e-6)])[-16:], (x + [r.entropy])[-16:]
        seen[r.user_id] = us, rates, x
        full = np.array([0.0] * (16 - len(x)) + x)
        pad = np.concatenate([[0, 0], full, [0]])
        trend = (pad[:-3] + pad[1:-2] + pad[2:-1] + pad[3:]) / 4
        want[r.event_id] = len(x), 1 / (1 + np.exp(-(2 * np.abs(full - trend).mean() + abs(trend[-1] - trend[0]) + 0.1 * sum(rates) / 16)))
    whole, _ = J.series_step(df, 0, None, 50)
    a, state = J.series_step(df.filter("event_id < 300"), 0, None, 50)
    b, state = J.series_step(df.filter("event_id >= 300"), 1, state, 50)
    assert max(r.n for r in state.groupBy("user_id").agg(F.count("*").alias("n")).collect()) == 16
    for got in (whole, a.unionByName(b)):
        rows = got.collect()
        assert len(rows) == n
        assert all(r.n_points == want[r.event_id][0] and np.isclose(r.anom, want[r.event_id][1]) for r in rows)


def test_policy_of_a_hot_label_is_folded_over_batches(spark):
    df = spark.range(5000).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 4)).alias("label"),
                                  F.when(F.pmod(F.xxhash64("id"), F.lit(6)) == 0, -1.0).otherwise(1.0).alias("reward"))
    want = {}
    for r in df.orderBy("seq").collect():
        t, n = want.get(r.label, (0.38, 0))
        want[r.label] = min(max(t + (-0.025 if r.reward < 0 else 0.005), 0.30), 0.46), n + 1
    state = None
    for epoch, rows in enumerate((df.filter("seq < 1700"), df.filter("seq >= 1700 and label = 'hot'"), df.filter("seq >= 1700 and label <> 'hot'"))):
        out, state = J.policy_step(rows, epoch, state)
    got = {r.label: (round(r.threshold, 9), r.episodes) for r in out.collect()}
    assert got == {k: (round(t, 9), n) for k, (t, n) in want.items()}


@pytest.mark.parametrize("key", ["str_source_state", "str_adaptive_feedback"])
def test_no_task_gathers_a_key_in_pandas(spark, key):
    plans = []
    run = J.stateful_batches

    def spy(df, name, step):
        def watched(batch, epoch, state):
            rows, after = step(batch, epoch, state)
            plans.extend(d._jdf.queryExecution().toString() for d in (rows, after))
            return rows, after
        return run(df, name, watched)
    J.stateful_batches = spy
    try:
        entry.queries()[key](spark, SF)
    finally:
        J.stateful_batches = run
    assert plans and not any("InPandas" in p for p in plans)


def test_late_rows_are_counted_as_input_rows(spark, duck):
    df = entry.queries()["str_late_data"](spark, SF)
    want = duck.execute("""WITH s AS (SELECT min(ts)+(max(ts)-min(ts))/2 AS mid, date_trunc('millisecond',max(ts)) - INTERVAL 10 MINUTE AS mark FROM events),
      e AS (SELECT ts, date_trunc('hour',ts) + INTERVAL 1 HOUR AS end_ts, ts>=mid AS early, mark FROM events, s)
      SELECT count(*) FILTER (early AND end_ts<=mark), count(*) FILTER (NOT early AND ts<mark), count(*) FILTER (NOT early AND end_ts<=mark) FROM e""").fetchone()
    assert tuple(df.select("kept", "late_rows", "dropped_rows").first()) == want and want[1] > 0
    assert "coalesce(1)" not in inspect.getsource(entry.queries()["str_late_data"])


@pytest.mark.parametrize("key", ["ml_rf_train", "ml_rf_score", "ml_incremental_retrain"])
def test_forests_have_full_size_and_are_measured_on_other_rows(spark, monkeypatch, key):
    calls, fit = [], learn.fit

    def small(rows, names, trees=learn.TREES, depth=learn.DEPTH):
        calls.append((trees, depth, rows.filter("row_id % 10 >= 8").count()))
        return fit(rows, names, 2, 3)
    monkeypatch.setattr(learn, "fit", small)
    monkeypatch.setattr(learn, "MIN_SAMPLES", 1)
    out = entry.queries()[key](spark, SF).collect()
    assert calls == [(128, 14, 0)]
    if key == "ml_incremental_retrain":
        assert out[0].status == "trained" and out[0].held_out > 0 and 0 <= out[0].fit <= 1
