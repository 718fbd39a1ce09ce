"""Rows reach many tasks whatever the file's layout; equal views are scored once."""

from pyspark.sql import functions as F

from paysieve import session
from paysieve.fixtures import payload_rows
from paysieve.functions import rules as R
from paysieve.functions.scoring import VIEW_NAMES, VIEW_WEIGHT, add_view_scores, lowered_views, score_views, spark_sql


def rows_per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]


def test_one_row_group_over_many_splits_is_spread(spark, tmp_path):
    n = 4000
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"),
                          F.rand(1).alias("value"), F.sha2(F.col("id").cast("string"), 512).alias("props")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert spark.read.parquet(f"{tmp_path}/events.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        found = rows_per_task(payload_rows(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(found) == n and max(found) <= n / 4


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    found = rows_per_task(session.spread_rows(spark.range(5000)))
    assert sum(found) == 5000 and len(found) >= 50 and max(found) <= 110


TEXTS = ["", "plain text", "id=1' or 1=1 --", "q=%3Cscript%3Ealert(1)%3C%2Fscript%3E", "a+b", "&lt;script&gt;alert(1)", "%253Cscript%253E", "&#60;svg onload=alert(1)>",
         '{"a": "union select 1"}', "x=../../etc/passwd&x=php://input", "ZWNobyBoZWxsbyB3b3JsZCBhbGVydA==", "UNION  SELECT", "%zz+%41", "<!DOCTYPE a [<!ENTITY b SYSTEM \"file:///\">]>", None]


def test_views_left_empty_do_not_change_the_scores(spark):
    df = spark.createDataFrame([(i, t, t) for i, t in enumerate(TEXTS)], "id int, raw string, norm string")
    cols = [f"vs_{k}" for k in R.ATTACKS]
    got = {r["id"]: r for r in add_view_scores(df).select("id", "discrepant", *cols).collect()}
    plain = score_views(df)
    plain = plain.withColumns({f"vl_{v}": F.lower(f"v_{v}") for v in VIEW_NAMES})
    want = plain.select("id", *[F.greatest(*[F.expr(spark_sql(R.VIEW_RULES[k].replace("vl", f"vl_{v}"))) * VIEW_WEIGHT.get(v, 1.0) for v in VIEW_NAMES]).alias(f"vs_{k}") for k in R.ATTACKS])
    for r in want.collect():
        g = got[r["id"]]
        assert all(g[c] == (max(r[c], 0.25) if g["discrepant"] and c in ("vs_SQLi", "vs_XSS") else r[c]) for c in cols), TEXTS[r["id"]]
    left = score_views(df.filter("raw = 'plain text'")).select(*[c.alias(n) for n, c in lowered_views().items()]).first()
    assert left["vl_url_deep"] == "plain text" and {left["vl_html"], left["vl_raw"], left["vl_normalized"], left["vl_url_once"]} == {""}


def test_byte_grid_holds_a_bounded_number_of_grids():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from paysieve.functions import features as X
    texts = pd.Series([None, "", "a", "é" * 1500, "x" * 2048, "%41" * 3000] + [f"id={i}' or 1=1" for i in range(2500)])
    tracemalloc.start()
    found = next(X.byte_grid.func(iter([texts])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    one_by_one = pd.concat([next(X.byte_grid.func(iter([texts.iloc[i:i + 1]]))) for i in [*range(6), 1000, 2505]])
    picked = found.iloc[[*range(6), 1000, 2505]]
    assert len(found) == len(texts) and (np.stack(picked.vec) == np.stack(one_by_one.vec)).all()
    assert all((picked[c].to_numpy() == one_by_one[c].to_numpy()).all() for c in ("edge", "high", "mean", "std"))
    assert len(next(X.byte_grid.func(iter([texts[:0]])))) == 0
    assert peak < len(texts) * 2048 * 8


def test_series_of_one_query_is_not_taken_for_another_location(spark):
    from paysieve.operators.decide import add_series
    df = spark.createDataFrame([("a'--", 1, "cookie")], "norm string, depth int, location string")
    first = add_series(df, F.col("location")).select("series").first()[0]
    second = add_series(df.drop("location"), F.lit("query")).select("series").first()[0]
    assert [b for a, b in zip(first, second) if a != b] == [1.0]


def dense_moments(t):
    import numpy as np
    b = np.frombuffer((t or "").encode("utf-8"), dtype=np.uint8)
    cells = np.zeros(2048)
    for i in range(min(b.size, 2048)):
        cells[i] = b[i::2048].mean() / 255.0
    g = cells.reshape(32, 64)
    blocks = g.reshape(8, 4, 16, 4).mean(axis=(1, 3)).reshape(-1)
    vec = np.concatenate([[cells.mean(), cells.std(), (cells > 0.6).mean(), (cells < 0.05).mean()], blocks])[:64]
    return vec / np.linalg.norm(vec), np.abs(np.diff(g, axis=1)).sum() / 2048, (cells > 0.8).mean()


def test_byte_grid_visits_only_the_filled_cells():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from paysieve.functions import features as X
    texts = [None, "", "a", "z" * 64, "z" * 65, "ÿ" * 63, "x" * 2047, "y" * 2048, "é" * 1500, "%41" * 3000, "id=1' or 1=1 --"]
    found = X.grid_moments(pd.Series(texts))
    for i, t in enumerate(texts):
        vec, edge, high = dense_moments(t)
        assert np.allclose(found.vec[i], vec, atol=1e-12) and np.allclose([found.edge[i], found.high[i]], [edge, high], atol=1e-12), t
    short = pd.Series([f"id={i}" for i in range(X.GRID_ROWS)])
    tracemalloc.start()
    X.grid_moments(short)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < X.GRID_ROWS * 2048 * 8 / 4


def test_a_batch_of_one_row_group_is_spread(spark, tmp_path, monkeypatch):
    from paysieve.plans import decide
    from paysieve.plans.streams import payload_stream
    from paysieve.streaming import jobs
    n, seen = 4000, []
    spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 7).alias("user_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")

    def verdicts(rows, *same):
        seen.append(rows_per_task(rows))
        return rows.select(*same, F.lit("SQLi").alias("pred"), F.lit(True).alias("mal"), F.lit(1.0).alias("conf"))
    monkeypatch.setattr(decide, "gated_verdicts", verdicts)
    assert jobs.alerts(payload_stream(spark, str(tmp_path))).count() == n
    assert sum(map(sum, seen)) == n and max(map(max, seen)) <= n / 4
