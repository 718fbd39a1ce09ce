"""Memory and retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, table
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.functions.labels import infer_label
from paysieve.operators import memory as M
from paysieve.operators import retrieval as RT
from paysieve.operators.decide import decide_parts
from paysieve.plans.evaluate import misses_raw
from paysieve.plans.normalise import normalised
from paysieve.plans.registry import query
from paysieve.sources.files import scratch
from paysieve.session import cut_lineage, spread


def vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"), (F.col("vec_id") % 7).alias("hits"))
    return e.filter("vec_id % 10 < 3"), e.filter("vec_id % 10 >= 3")


def hits(spark, sf, k=M.TOP_K):
    mem, qs = vectors(spark, sf)
    return M.nearest(qs, mem, "vec_id", "embedding", "vec_id", "label", k)


@query("jn_memory_knn")
def _knn(spark, sf):
    return hits(spark, sf).select("qid", "mid", "label", F.round("sim", 5).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("udaf_class_vote")
def _vote(spark, sf):
    return M.class_vote(hits(spark, sf)).select("qid", "label", "n", F.round("score", 5).alias("score"))


@query("jn_memory_exact")
def _exact(spark, sf):
    """First stored label of an equal text: an equi join on the hash, whatever the memory's size."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2(F.trim("text"), 256).alias("h"))
    mem = d.filter("doc_id % 10 < 3").groupBy("h").agg(F.min_by("lang", "doc_id").alias("stored"))
    return d.filter("doc_id % 10 >= 3").join(mem, "h").select("doc_id", "stored")


@query("jn_near_duplicate")
def _near(spark, sf):
    mem, qs = vectors(spark, sf)
    return M.upsert_plan(qs, mem, "vec_id", "embedding", "vec_id", "label", threshold=0.55).select("qid", "action", "target", F.round("sim", 5).alias("sim"))


@query("agg_memory_stats")
def _stats(spark, sf):
    mem, _ = vectors(spark, sf)
    per = mem.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("embedding")).alias("values_"))
    return per.agg(F.sum("n").alias("size"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", F.col("n").cast("string")))), ",").alias("by_label"), F.sum("values_").alias("n_values"))


@query("ml_encoder_guard")
def _guard(spark, sf):
    """Vectors of another encoder or dimension are left out by a partition filter."""
    e = table(spark, sf, "embeddings").withColumns({"encoder_mode": F.when(F.pmod("vec_id", F.lit(5)) == 0, "other").otherwise("hash"), "dim": F.size("embedding")})
    return e.filter("encoder_mode='hash' AND dim=64").groupBy("label").agg(F.count("*").alias("n"))


@query("snk_memory_table")
def _snk(spark, sf):
    """Save as a table partitioned by encoder mode and dimension; load with a partition filter."""
    e = table(spark, sf, "embeddings").withColumns({"encoder_mode": F.when(F.pmod("vec_id", F.lit(5)) == 0, "other").otherwise("hash"), "dim": F.size("embedding")})
    path = scratch(spark, "memory")
    e.write.partitionBy("encoder_mode", "dim").parquet(path)
    return spark.read.parquet(path).filter("encoder_mode='hash' AND dim=64").groupBy("label").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query("fus_memory_fuse")
def _fuse(spark, sf):
    """Decision with a memory of stored payloads: nearest by trigram vector, exact hits by hash."""
    rows = normalised(payload_rows(spark, sf)).withColumn("raw", F.col("payload"))
    texts = cut_lineage(rows.select("row_id", "label", "payload", "norm"))
    vectors_ = cut_lineage(texts.select("row_id", "label", "payload", X.trigram_embed(F.col("norm")).alias("v")))
    mem = vectors_.filter("row_id % 10 < 3")
    near = M.nearest(vectors_, mem, "row_id", "v", "row_id", "label")
    score = F.exp(-M.BETA * (1.0 - F.greatest("sim", F.lit(0.0))))
    votes = near.groupBy("qid").agg(*[F.sum(F.when(F.col("label") == k, score).otherwise(0.0)).alias(f"v_{k}") for k in R.LABELS], F.max("sim").alias("mem_hit"), F.sum(score).alias("t_"))
    exact = mem.groupBy(F.trim("payload").alias("key_")).agg(F.min_by("label", "row_id").alias("mem_exact"))

    def lookup(df):
        df = df.join(votes, df["row_id"] == votes["qid"], "left").join(exact, F.trim("raw") == F.col("key_"), "left")
        return df.withColumns({**{f"mem_{k}": F.coalesce(F.col(f"v_{k}") / F.col("t_"), F.lit(0.0)) for k in R.LABELS}, "mem_hit": F.coalesce("mem_hit", F.lit(0.0))})
    return decide_parts(rows, ["row_id"], "mf_label", "mf_conf", "mf_mal", memory=lookup).select("row_id", F.col("mf_label").alias("verdict"), F.round(F.col("mf_conf").cast("double"), 4).alias("conf"), F.col("mf_mal").alias("mal"))


# --- retrieval ---------------------------------------------------------------------------------
def search_sides(spark, sf):
    """Every row whose id is divisible by 50 is a query; all rows are searched."""
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    c = e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("c"), F.pmod("label", F.lit(4)).cast("string")).alias("category"), "embedding")
    return q, c


@query("jn_retrieve")
def _ret(spark, sf):
    """Per-category quota max(1, k // categories), then the best k overall."""
    q, c = search_sides(spark, sf)
    per = RT.search(q, c, "embedding", 2, per_category=True).drop("rank")
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "chunk_id")
    return per.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("qid", "chunk_id", "category", F.round("sim", 5).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("rag_context")
def _ctx(spark, sf):
    q, c = search_sides(spark, sf)
    h = RT.search(q, c, "embedding", 6)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return RT.context(h.join(docs, "chunk_id"), F.col("text"), 800, 3500)


def markdown_docs(spark, sf):
    """Documents with a heading line in front of every second sentence."""
    return table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"\n", "\n## "))


@query("rag_chunk_headings")
def _head(spark, sf):
    return RT.heading_chunks(markdown_docs(spark, sf), "text", "doc_id").select("doc_id", F.col("part").cast("bigint").alias("part"), "title", F.length("chunk").cast("bigint").alias("n_chars"))


@query("rag_chunk_misses")
def _miss(spark, sf):
    m = misses_raw(spark, sf)
    return m.select("row_id", F.format_string("miss true=%s pred=%s source=%s\npayload: %s", "label", infer_label(F.col("payload")), "source", "payload").alias("chunk"))


@query("rag_chunk_catalog")
def _cat(spark, sf):
    """Named sections: a heading with one word opens a section that runs to the next heading."""
    parts = F.split("text", r"\n(?=## )")
    d = markdown_docs(spark, sf).select("doc_id", F.posexplode(parts).alias("part", "t"))
    name = F.lower(F.regexp_extract("t", r"^##\s+([A-Za-z0-9_]+)", 1))
    return d.filter((name != "") & (F.length(F.trim("t")) >= 40)).select("doc_id", F.col("part").cast("bigint").alias("part"), name.alias("name"), F.length(F.trim("t")).cast("bigint").alias("n_chars"))


def corpus(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("chunk_id"), F.when(F.col("source").isin("src0", "src1"), "community").when(F.col("lang") == "en", "literature").otherwise("dataset").alias("category"), F.col("text").alias("chunk"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("page:"), F.col("page_id")).alias("chunk_id"), F.lit("architecture").alias("category"), F.col("html").alias("chunk"))
    m = misses_raw(spark, sf).select(F.concat(F.lit("miss:"), F.col("row_id")).alias("chunk_id"), F.lit("miss_pattern").alias("category"), F.col("payload").alias("chunk"))
    return d.unionByName(p).unionByName(m)


@query("rag_collect")
def _coll(spark, sf):
    return corpus(spark, sf).select("chunk_id", "category", F.length("chunk").cast("bigint").alias("n_chars"))


@query("rag_stats")
def _rs(spark, sf):
    return corpus(spark, sf).groupBy("category").agg(F.count("*").alias("n"))


@query("rag_build_index")
def _idx(spark, sf):
    """Vectors written as a table next to their chunks, then read back."""
    path = scratch(spark, "index")
    spread(corpus(spark, sf)).select("chunk_id", "category", X.trigram_embed(F.col("chunk")).alias("vec")).write.parquet(path)
    return spark.read.parquet(path).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("mean_norm"))


@query("rag_miss_query")
def _mq(spark, sf):
    """Query text per label from its first misses, matched against the documents by trigram vector."""
    m = misses_raw(spark, sf).select("label", "row_id", F.col("payload").alias("s"), F.row_number().over(Window.partitionBy("label").orderBy("row_id")).alias("rn")).filter("rn <= 3")
    q = m.groupBy("label").agg(F.concat_ws(" ", F.first("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "s"))), lambda x: x["s"]), " ")).alias("qtext"))
    qid = F.array_position(F.array(*[F.lit(k) for k in R.LABELS]), F.col("label"))
    qv = q.select(qid.alias("qid"), X.trigram_embed(F.col("qtext")).alias("v"))
    c = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("category"), X.trigram_embed(F.col("text")).alias("v"))
    return RT.search(qv, c, "v", 6).select("qid", "chunk_id", "category", F.round("sim", 3).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@query("udf_encoder")
def _enc(spark, sf):
    """Encoder hook: any pandas UDF text -> vector can replace the default."""
    df = spread(table(spark, sf, "documents")).select("doc_id", "lang", X.trigram_embed(F.col("text")).alias("v"))
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.size("v")), 1).alias("dim"))
