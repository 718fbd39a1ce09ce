"""Skew-safe operators equal their plain forms, also when one key holds most rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF
from paysieve.operators import memory as M
from paysieve.operators import windows as W
from paysieve.operators.scale import clamp_fold, lowest_per_group, md5_number
from paysieve.plans.dataset import _gsplit, _split


def skewed(spark, n=4000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("v"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lowest_per_group_is_exact(spark):
    df = skewed(spark)
    r = md5_number(F.col("id").cast("string"))
    got = lowest_per_group(df, ["key"], r, F.floor(F.col("group_n") * 0.15), "id", buckets=64).filter("picked").select("id")
    w = Window.partitionBy("key")
    want = df.withColumn("rn", F.row_number().over(w.orderBy(r, "id"))).withColumn("n", F.count("*").over(w)).filter("rn <= floor(n * 0.15)").select("id")
    assert rows(got) == rows(want)


def test_chunked_window_equals_plain_window(spark):
    df = W.id_chunks(skewed(spark), "id", rows=100)
    r, w = W.chunked(df, ["key"], ["id"], 15)
    got = W.own_rows(r.withColumn("s", F.sum("v").over(w.rowsBetween(-15, 0)))).select("id", "s")
    want = skewed(spark).select("id", F.sum("v").over(Window.partitionBy("key").orderBy("id").rowsBetween(-15, 0)).alias("s"))
    assert rows(got) == rows(want)


def test_sessions_equal_plain_windows(spark):
    df = skewed(spark).withColumn("ts", F.timestamp_seconds(F.col("id") * 10 + F.when(F.col("id") % 97 == 0, 5000).otherwise(0)))
    got = W.sessions(W.time_chunks(df, "ts", rows=200), "key", ["ts", "id"], 60).groupBy("key").agg(F.count("*").alias("n"), F.sum("n").alias("r"))
    w = Window.partitionBy("key").orderBy("ts", "id")
    new = (F.lag("ts").over(w).isNull() | (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 60_000_000)).cast("int")
    want = df.withColumn("new", new).groupBy("key").agg(F.sum("new").alias("n"), F.count("*").alias("r"))
    assert rows(got) == rows(want)


def test_clamp_fold_equals_sequential(spark):
    df = skewed(spark).withColumn("d", F.when(F.col("v") < 50, -0.025).otherwise(0.03))
    got = {r.key: round(r.value, 9) for r in clamp_fold(df, "key", "id", F.col("d"), 0.2, 0.95, F.lit(0.38), levels=(50, 500)).collect()}
    want: dict[str, float] = {}
    for r in df.orderBy("id").collect():
        want[r.key] = min(0.95, max(0.2, want.get(r.key, 0.38) + r.d))
    assert got == {k: round(v, 9) for k, v in want.items()}


def test_memory_lookup_is_the_same_in_one_and_in_many_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("label", F.col("label").cast("string"))
    mem, q = e.filter("vec_id % 10 < 3"), e.filter("vec_id % 10 >= 3")
    cols = ["qid", "mid", "rank"]
    a = M.nearest(q, mem, "vec_id", "embedding", "vec_id", "label", 8).select(cols)
    b = M.nearest(q, mem, "vec_id", "embedding", "vec_id", "label", 8, per_block=20).select(cols)
    assert rows(a) == rows(b)


def test_split_is_disjoint_and_complete(spark):
    s = _split(spark, SF)
    assert s.count() == spark.read.parquet(f"{SF}/documents.parquet").count() == s.select("doc_id").distinct().count()
    assert all(r.n >= 1 for r in s.filter("part='test'").groupBy("lang").agg(F.count("*").alias("n")).collect())


def test_group_split_keeps_copies_together(spark):
    assert {r.part for r in _gsplit(spark, SF).collect()} == {"train", "test"}
