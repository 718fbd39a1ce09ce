"""Per-source time series over event time, chunked so that a hot source is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.operators.decide import anomaly, moving_average, trend_residual
from paysieve.operators.scale import with_previous

SERIES = 16
CHUNK_ROWS = 500_000


def time_chunks(df: DataFrame, ts: str, rows: int = CHUNK_ROWS, at_least: int = 8) -> DataFrame:
    """Adds ``tc_``: equal time ranges, about ``rows`` rows each (one-row statistics, then a projection)."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    stat = df.agg(F.min(us).alias("lo_"), (F.max(us) + 1).alias("hi_"), F.greatest(F.lit(at_least), F.ceil(F.count("*") / rows)).alias("parts_"))
    df = df.crossJoin(F.broadcast(stat))
    return df.withColumn("tc_", F.floor((us - F.col("lo_")) * F.col("parts_") / F.greatest(F.col("hi_") - F.col("lo_"), F.lit(1)))).drop("lo_", "hi_", "parts_")


def id_chunks(df: DataFrame, seq: str, rows: int = CHUNK_ROWS, at_least: int = 8) -> DataFrame:
    stat = df.agg((F.max(seq) + 1).alias("hi_"), F.greatest(F.lit(at_least), F.ceil(F.count("*") / rows)).alias("parts_"))
    return df.crossJoin(F.broadcast(stat)).withColumn("tc_", F.floor(F.col(seq) * F.col("parts_") / F.col("hi_"))).drop("hi_", "parts_")


def chunked(df: DataFrame, key: list[str], order: list[str], k: int) -> tuple[DataFrame, Window]:
    """(rows with halo, window) for frames that look back at most k rows; ``df`` carries tc_."""
    out = with_previous(df, key, order, F.col("tc_"), k)
    return out, Window.partitionBy(*key, "chunk_").orderBy(*order)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("not halo_").drop("halo_", "chunk_", "tc_")


def request_rate(w: Window, ts: str = "ts") -> Column:
    """1 / max(gap seconds, 1e-6); the first request of a source counts as 1."""
    prev = F.lag(ts).over(w)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))) / 1e6
    return F.when(prev.isNull(), 1.0).otherwise(1.0 / F.greatest(gap, F.lit(1e-6)))


def source_matrix(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """Last sixteen points per source as ``matrix`` (array of value arrays), zero padded in front."""
    rows, w = chunked(df, [key], order, SERIES)
    rows = rows.withColumn("qps", request_rate(w))
    point = F.array("qps", *values)
    rows = rows.withColumn("pts_", F.collect_list(point).over(w.rowsBetween(-(SERIES - 1), 0)))
    zero = F.array(*[F.lit(0.0)] * (1 + len(values)))
    rows = own_rows(rows).withColumn("n_points", F.size("pts_").cast("bigint"))
    return rows.withColumn("matrix", F.concat(F.array_repeat(zero, F.lit(SERIES) - F.size("pts_")), F.col("pts_"))).drop("pts_")


def series_encoding(df: DataFrame) -> DataFrame:
    """Residual energy, slope and mean rate of each matrix, with the anomaly score."""
    df = df.withColumns({"primary": F.transform("matrix", lambda p: p[1]), "rates": F.transform("matrix", lambda p: p[0])})
    resid, slope = trend_residual(F.col("primary"))
    df = df.withColumns({"trend": moving_average(F.col("primary")), "resid": resid, "slope": slope,
                         "qps_mean": F.aggregate("rates", F.lit(0.0), lambda a, v: a + v) / SERIES})
    return df.withColumn("anom", anomaly(F.col("resid"), F.col("slope"), F.col("qps_mean")))


def sessions(df: DataFrame, key: str, order: list[str], gap_seconds: int) -> DataFrame:
    """Bursts per source: new-burst flags per chunk, then chunk totals give the running burst number."""
    rows, w = chunked(df, [key], order, 1)
    prev = F.lag("ts").over(w)
    rows = rows.withColumn("new_", (prev.isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp")) > gap_seconds * 1_000_000)).cast("int")).filter("not halo_")
    rows = rows.withColumn("run_", F.sum("new_").over(w))
    per = rows.groupBy(key, "chunk_").agg(F.sum("new_").alias("c_"))
    per = per.withColumn("base_", F.sum("c_").over(Window.partitionBy(key).orderBy("chunk_")) - F.col("c_")).drop("c_")
    return rows.join(per, [key, "chunk_"]).withColumn("burst", F.col("base_") + F.col("run_")) \
        .groupBy(key, "burst").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
