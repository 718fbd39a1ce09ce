"""Retrieval: chunk table, vectors, top-k search of a query table over a chunk table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.operators.memory import top_rows

QUERY_BLOCK, CHUNK_BLOCK = 1000, 4000


def heading_chunks(df: DataFrame, text: str, key: str, min_chars: int = 80) -> DataFrame:
    """Sections that start at a heading line, with their title."""
    parts = F.split(F.col(text), r"\n(?=#{1,4}\s)")
    out = df.select(key, F.posexplode(parts).alias("part", "t")).withColumn("t", F.trim(F.col("t"), F.lit(" \n\r\t")))
    title = F.trim(F.ltrim(F.substring_index("t", "\n", 1), F.lit("#")))
    return out.filter(F.length("t") >= min_chars).select(key, "part", title.alias("title"), F.col("t").alias("chunk"))


def search(queries: DataFrame, chunks: DataFrame, vec: str, k: int, per_category: bool = False, query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK) -> DataFrame:
    """Top-k chunks per query (and category).  Query blocks meet chunk blocks in groups of bounded size, each
    keeps its best k, and a window merges these short lists; no vector goes through the driver."""
    nq = queries.count() // query_block + 1
    nc = chunks.count() // chunk_block + 1
    q = queries.select(F.col("qid").cast("bigint").alias("id_"), F.col(vec).alias("v_"), F.lit("").alias("cat_"), F.lit(True).alias("query_"),
                       F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    c = chunks.select(F.col("chunk_id").cast("bigint").alias("id_"), F.col(vec).alias("v_"), F.col("category").alias("cat_"), F.lit(False).alias("query_"),
                      F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).cast("int").alias("cb"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.query_], pdf[~pdf.query_]
        out = [pd.DataFrame({"qid": [], "mid": [], "label": [], "sim": []})]
        if len(a) and len(b):
            ids, v = a.id_.to_numpy(), np.stack(a.v_.to_numpy()).astype(np.float64)
            for _, own in b.groupby("cat_", dropna=False) if per_category else [("", b)]:
                out.append(top_rows(ids, v, own.id_.to_numpy(), own.cat_.to_numpy(), np.stack(own.v_.to_numpy()).astype(np.float64), k))
        return pd.concat(out[1:] or out).rename(columns={"mid": "chunk_id", "label": "category"})[["qid", "chunk_id", "category", "sim"]]
    cols = ["id_", "v_", "cat_", "query_", "qb", "cb"]
    part = q.select(cols).unionByName(c.select(cols)).groupBy("qb", "cb").applyInPandas(block, "qid bigint, chunk_id bigint, category string, sim double")
    keys = ["qid", "category"] if per_category else ["qid"]
    w = Window.partitionBy(*keys).orderBy(F.desc("sim"), "chunk_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def context(hits: DataFrame, text: Column, per_hit: int, budget: int) -> DataFrame:
    """Joined text of the ranked hits of a query while the running length stays within the budget."""
    h = hits.withColumn("block", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit(" "), F.col("category"), F.lit("] "), F.substring(text, 1, per_hit)))
    h = h.withColumn("used", F.sum(F.length("block")).over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("used") <= budget)
    return h.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda s: s["block"]), "\n").alias("context"))
