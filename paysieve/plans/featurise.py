"""Featurise job: feature and predicate columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, requests, table
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.functions import text as T
from paysieve.functions.scoring import add_scores, high_entropy, repeated_names
from paysieve.operators import decompose as D
from paysieve.plans.normalise import normalised
from paysieve.plans.registry import query
from paysieve.plans.score import scored
from paysieve.session import evaluated_once, spread


def texts(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.lit("doc").alias("origin"), F.col("doc_id").alias("row_id"), "text")
    rows = payload_rows(spark, sf).select(F.lit("payload").alias("origin"), "row_id", F.col("payload").alias("text"))
    return docs.unionByName(rows)


def page_texts(spark, sf):
    pages = spread(table(spark, sf, "pages")).select(F.lit("page").alias("origin"), F.col("page_id").alias("row_id"), F.col("html").alias("text"))
    rows = payload_rows(spark, sf).select(F.lit("payload").alias("origin"), "row_id", F.col("payload").alias("text"))
    return pages.unionByName(rows)


def out(cols: dict, digits: int = 6):
    return [F.round(c.cast("double"), digits).alias(n) for n, c in cols.items()]


@query("fea_entropy")
def _entropy(spark, sf):
    return texts(spark, sf).select("origin", "row_id", F.round(X.entropy(F.col("text")), 6).alias("entropy"))


@query("fea_statistical")
def _stat(spark, sf):
    return texts(spark, sf).select("origin", "row_id", *out(X.statistical(F.col("text"))))


@query("fea_keyword_hits")
def _kw(spark, sf):
    return page_texts(spark, sf).select("origin", "row_id", *out(X.semantic(F.col("text"))))


@query("fea_nesting_depth")
def _nest(spark, sf):
    return page_texts(spark, sf).select("origin", "row_id", X.nesting_depth(F.col("text")).alias("depth"))


@query("fea_structural")
def _struct(spark, sf):
    return page_texts(spark, sf).select("origin", "row_id", *out(X.structural(F.col("text"))))


@query("fea_location_depth")
def _loc(spark, sf):
    df = D.request_parts(requests(spark, sf))
    df = normalised(df, "raw").select("location", "depth", X.lookup(F.col("location"), X.LOCATION_WEIGHT, 0.5).alias("w"))
    return df.groupBy("location", F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("weight"))


def feature_rows(spark, sf):
    """Normalised payload rows with the 22 feature columns."""
    df = normalised(payload_rows(spark, sf))
    feats = X.all_features(F.col("norm"), F.lit("query"), F.col("depth"))
    return df.withColumns(feats), list(feats)


@query("fea_vector")
def _vec(spark, sf):
    df, names = feature_rows(spark, sf)
    return df.select("row_id", *[F.round(F.col(n), 6).alias(n) for n in names])


def feature_weights(spark, sf):
    """Default rank weight plus the class gap of each feature (one aggregation, then unpivot)."""
    df, names = feature_rows(spark, sf)
    attack = F.col("label") != "Normal"
    gaps = df.agg(*[(F.avg(F.when(attack, F.col(n))) - F.avg(F.when(~attack, F.col(n)))).alias(n) for n in names])
    long = gaps.unpivot([], names, "feature", "gap")
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")) - 1
    return long.select("feature", rank.alias("pos"), F.round(1.0 / (1.0 + rank * 0.01) + F.least(F.abs("gap"), F.lit(1.0)), 6).alias("weight"))


@query("fea_select_topk")
def _topk(spark, sf):
    return feature_weights(spark, sf).orderBy(F.desc("weight"), "pos").limit(15).select("feature", "weight")


@query("fea_byte_grid")
def _grid(spark, sf):
    df = texts(spark, sf).select("origin", "row_id", X.byte_grid(F.col("text")).alias("g"))
    return df.select("origin", "row_id", *[F.round(F.col("g.vec")[i], 5).alias(f"v{i}") for i in (0, 1, 2, 3, 4, 20, 63)],
                     F.round("g.edge", 5).alias("edge"), F.round("g.high", 5).alias("high"))


def protocol_rows(spark, sf):
    """Parts of the requests with protocol scalars."""
    df = normalised(D.request_parts(requests(spark, sf)), "raw")
    df = add_scores(df, "obf")
    vec = X.protocol_vector(F.col("raw"), F.col("location"), F.col("depth"), F.col("obf"), repeated_names(F.col("raw_low")))
    return df.withColumns(vec), list(vec)


@query("fea_protocol_vec")
def _proto(spark, sf):
    df, names = protocol_rows(spark, sf)
    return df.select("req_id", "location", "field", *[F.round(n, 6).alias(n) for n in names])


@query("fea_multimodal_vec")
def _mm(spark, sf):
    df, names = protocol_rows(spark, sf)
    df = df.withColumn("cat", F.concat(F.array(*names), X.byte_grid(F.col("raw"))["vec"]))
    norm = F.sqrt(F.aggregate("cat", F.lit(0.0), lambda a, x: a + x * x))
    df = df.withColumn("norm2", norm)
    return df.select("req_id", "location", "field", *[F.round(F.col("cat")[i] / F.col("norm2"), 5).alias(f"m{i}") for i in (0, 1, 5, 8, 9, 12, 71)])


@query("fea_trigram_embed")
def _tri(spark, sf):
    """Sparse form: (doc, bucket, weight) from the unit vectors."""
    df = spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(X.trigram_embed(F.col("text"))).alias("bucket", "w"))
    return df.filter(F.col("w") > 0.05).select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round(F.col("w").cast("double"), 4).alias("w"))


@query("fea_case_switch")
def _case(spark, sf):
    return texts(spark, sf).select("origin", "row_id", F.round(X.case_switch_rate(F.col("text")), 6).alias("rate"))


@query("fea_marker_score")
def _mark(spark, sf):
    return texts(spark, sf).select("origin", "row_id", X.marker_score(F.col("text")).cast("bigint").alias("score"))


@query("fea_payload_hash")
def _hash(spark, sf):
    return texts(spark, sf).select("origin", "row_id", X.payload_hash(F.col("text")).alias("hash"))


# --- predicates over pages, documents and requests ----------------------------------------------
@query("prd_payload_segment")
def _seg(spark, sf):
    df = table(spark, sf, "pages").select("page_id", F.explode(F.split(D.path_of(F.concat("url", F.when(F.pmod("page_id", F.lit(4)) == 0, "/%3Cb%3E").otherwise(""))), "/")).alias("s"))
    dec = T.url_plus(F.col("s"))
    return df.select("page_id", "s", ((F.length(dec) >= 3) & dec.rlike(D.SEGMENT_PATTERN)).alias("flag"))


@query("prd_duplicate_params")
def _dup(spark, sf):
    df = table(spark, sf, "pages").select("page_id", F.lower(F.concat("url", F.when(F.pmod("page_id", F.lit(2)) == 0, "?id=1&ref=2&ID=3").otherwise("&a=1&a=2"))).alias("u"))
    return df.select("page_id", repeated_names(F.col("u")).alias("flag"))


@query("prd_hex32_tokens")
def _hex(spark, sf):
    rows = payload_rows(spark, sf).select("row_id", "payload")
    md5 = F.md5(F.col("row_id").cast("string"))
    tok = F.when(F.pmod("row_id", F.lit(3)) == 0, F.upper(md5)).when(F.pmod("row_id", F.lit(3)) == 1, F.concat(F.upper(F.substring(md5, 1, 16)), F.substring(md5, 17, 16))).otherwise(md5)
    t = F.when(F.pmod("row_id", F.lit(2)) == 0, tok).otherwise(F.col("payload"))
    df = rows.select("row_id", t.alias("t"))
    whole = F.col("t").rlike(R.PATTERNS["HEX32_WHOLE"])
    return df.select("row_id", whole.alias("standalone"), (whole & F.col("t").rlike("[A-F]") & F.col("t").rlike("[a-f]")).alias("mixed"),
                     (whole & F.col("t").rlike("[A-F]") & ~F.col("t").rlike("[a-f]")).alias("upper"), F.col("t").rlike(R.PATTERNS["HEX32_PARAM"]).alias("in_param"))


@query("prd_hi_entropy_token")
def _hi(spark, sf):
    tokens = spread(table(spark, sf, "documents")).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{20,40}"), F.lit(0))).alias("tok"))
    made = payload_rows(spark, sf).select(F.col("row_id").alias("doc_id"), F.substring(F.replace(F.base64(F.encode(F.md5("payload"), "UTF-8")), F.lit("="), F.lit("")), 1, 36).alias("tok"))
    return tokens.unionByName(made).select("doc_id", "tok", high_entropy(F.col("tok")).alias("flag"))


@query("prd_semantic_gate")
def _gate(spark, sf):
    """Which rows deserve the costly pass; the two branches are split by filter and unioned."""
    df = scored(spark, sf, "bctx", "dup_raw_low", "low", "norm")
    marks = F.lit(False)
    for m in R.MARKERS["DEEP_MARK"]:
        marks = marks | F.col("low").contains(m)
    benign = F.col("bctx") & (X.count_char(F.col("low"), "%") < 4) & (F.length("low") <= 120)
    words = F.lit(False)
    for m in R.MARKERS["SUSPICIOUS"]:
        words = words | F.col("low").contains(m)
    deep = (F.length("norm") >= 4) & ~benign & (words | marks | F.col("low").rlike(R.PATTERNS["HEX32_TOKEN"]) | F.col("dup_raw_low") | (F.length("low") > 80))
    flagged = evaluated_once(df, "row_id", "label", deep=deep)
    costly = flagged.filter("deep").withColumn("branch", F.lit("deep"))
    cheap = flagged.filter("not deep").withColumn("branch", F.lit("cheap"))
    return costly.unionByName(cheap).groupBy("label", "branch").agg(F.count("*").alias("n"), F.sum("row_id").alias("ids"))


@query("prd_benign_fast_path")
def _fast(spark, sf):
    df = scored(spark, sf, "obf", "strong", "hexw", "rp_peak", "depth")
    simple = (F.length("raw") <= 16) & ~F.col("raw").rlike(r"[^\x00-\x7F]") & (X.count_char(F.col("raw"), "%") < 2)
    fast = ~F.col("obf") & ~F.col("strong") & ~F.col("hexw") & (F.col("depth") < 2) & (simple | ((F.round("rp_peak", 6) < 0.22) & (F.length("raw") < 120)))
    return df.select("row_id", fast.alias("flag"))


ATTACK_SHAPES = ["%3d", "%26", "%00", "%2500", "%25ef%25bf%25bd", "/**/", "%252"]


@query("prd_attack_shape")
def _shape(spark, sf):
    enc, dec = D.aggregate_text(F.col("url"), F.col("body"))
    low = F.lower(enc)
    hit = enc.contains("\u0000") | enc.rlike(R.PATTERNS["FULLWIDTH"]) | dec.rlike(R.PATTERNS["FULLWIDTH"])
    for s in ATTACK_SHAPES:
        hit = hit | low.contains(s)
    return requests(spark, sf).select("req_id", hit.alias("flag"))


@query("job_feature_summary")
def _sum(spark, sf):
    df, names = feature_rows(spark, sf)
    pick = ["entropy", "special_ratio", "encoded_ratio", "decode_depth"]
    return df.groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(n), 5).alias(f"avg_{n}") for n in pick], *[F.round(F.max(n), 5).alias(f"max_{n}") for n in pick])
