"""Skew-safe building blocks: exact cuts, chunked windows and ordered folds.

None of them puts a whole key (or the whole table) into one task: a hot key is split into chunks and
only bounded per-chunk summaries meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_number(c: Column) -> Column:
    """First 32 bits of md5 as BIGINT; shared with the SQL oracle."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def lowest_per_group(df: DataFrame, group: list[str], rank: Column, take: Column, tie: str, buckets: int = 4096, limit32: int = 1 << 32) -> DataFrame:
    """Exactly the ``take`` rows with the lowest (rank, tie) of every group, plus the cut as flag ``picked``.

    rank is a 32-bit hash.  Counts per (group, rank bucket) locate the bucket in which the cut falls;
    rows are ranked by a window inside their bucket (1/``buckets`` of a group).  ``take`` may use ``group_n``.
    """
    width = limit32 // buckets
    df = df.withColumns({"rank_": rank}).withColumn("bucket_", F.floor(F.col("rank_") / width))
    counts = df.groupBy(*group, "bucket_").agg(F.count("*").alias("n_"))
    w = Window.partitionBy(*group)
    cuts = counts.withColumns({"before_": F.sum("n_").over(w.orderBy("bucket_")) - F.col("n_"), "group_n": F.sum("n_").over(w)}) \
        .withColumn("take_", take.cast("bigint")).withColumn("left_", F.col("take_") - F.col("before_"))
    # Whole buckets before the cut have left_ >= their size, those behind it left_ <= 0, so one comparison
    # serves all; the window works inside buckets and reuses the join's partitioning.
    j = df.join(cuts.select(*group, "bucket_", "left_"), [*group, "bucket_"])
    order = Window.partitionBy(*group, "bucket_").orderBy("rank_", tie)
    return j.withColumn("picked", F.row_number().over(order) <= F.col("left_")).drop("rank_", "bucket_", "left_")


def with_previous(df: DataFrame, key: list[str], order: list[str], chunk: Column, k: int) -> DataFrame:
    """Rows plus the last ``k`` rows before each chunk (flag ``halo_``), keyed by (key, chunk_).

    chunk must not decrease along the order.  A window over (key, chunk_) then sees the same ``k``
    predecessors as one over the key, while a hot key is spread over its chunks.
    """
    cols = df.columns
    df = df.withColumn("chunk_", chunk)
    desc = [F.desc(c) for c in order]
    tail = df.withColumn("rn_", F.row_number().over(Window.partitionBy(*key, "chunk_").orderBy(*desc))).filter(F.col("rn_") <= k)
    tails = tail.groupBy(*key, "chunk_").agg(F.collect_list(F.struct(*[F.col(c) for c in order], F.struct(*cols).alias("r_"))).alias("t_"))
    # every earlier chunk holds at least one row, so k earlier chunks always contain the k predecessors
    prior = tails.withColumn("p_", F.flatten(F.collect_list("t_").over(Window.partitionBy(*key).orderBy("chunk_").rowsBetween(-k, -1))))
    halo = prior.select("chunk_", F.explode(F.slice(F.reverse(F.array_sort("p_")), 1, k)).alias("e_")).select("chunk_", "e_.r_.*").withColumn("halo_", F.lit(True))
    return df.withColumn("halo_", F.lit(False)).unionByName(halo)


def clamp_fold(df: DataFrame, key: str, seq: str, delta: Column, lo: float | Column, hi: float | Column, start: Column, levels=(1000, 1000 ** 2, 1000 ** 3)) -> DataFrame:
    """Ordered fold x -> clip(x + delta, lo, hi) per key; the bounds may be columns.

    Such steps compose to one step of the same form (shift, low, high), so chunks of at most 1000
    rows are folded on their own and the chunk results are folded level by level.
    """
    step = F.struct(F.col("shift_"), F.col("lo_"), F.col("hi_"))
    cur = df.select(key, F.col(seq).alias("seq_"), delta.alias("shift_"), F.lit(lo).alias("lo_"), F.lit(hi).alias("hi_"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(-1e9).alias("l"), F.lit(1e9).alias("h"))

    def compose(acc: Column, e: Column) -> Column:
        def clip(x: Column) -> Column:
            return F.least(e["e"]["hi_"], F.greatest(e["e"]["lo_"], x + e["e"]["shift_"]))
        return F.struct((acc["s"] + e["e"]["shift_"]).alias("s"), clip(acc["l"]).alias("l"), clip(acc["h"]).alias("h"))

    for width in (*levels, None):
        group = F.floor(F.col("seq_") / width) if width else F.lit(0)
        folded = cur.groupBy(key, group.alias("g_")).agg(F.array_sort(F.collect_list(F.struct("seq_", step.alias("e")))).alias("a_"), F.min("seq_").alias("seq_")) \
            .withColumn("c_", F.aggregate("a_", zero, compose))
        cur = folded.select(key, "seq_", F.col("c_.s").alias("shift_"), F.col("c_.l").alias("lo_"), F.col("c_.h").alias("hi_"))
    return cur.select(key, F.least("hi_", F.greatest("lo_", start + F.col("shift_"))).alias("value"))
