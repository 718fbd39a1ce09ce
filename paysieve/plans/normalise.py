"""Normalise job: decode columns over the payload table, keyed rows or step summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysieve.fixtures import payload_rows, table
from paysieve.functions import text as T
from paysieve.plans.registry import query
from paysieve.session import reuse



def keyed(key: str, fn, prep=None):
    """Register a query that returns (row_id, value) over all payload rows."""
    @query(key)
    def _run(spark, sf):
        df = payload_rows(spark, sf)
        col = F.col("payload") if prep is None else prep(F.col("payload"))
        return df.select("row_id", fn(col).alias("value"))


def visible(c):
    return F.replace(c, F.lit("\u0000"), F.lit("<NUL>"))


keyed("nrm_fullwidth", T.fullwidth_to_ascii)
keyed("nrm_url_decode", lambda c: visible(T.url_round(c)))
keyed("nrm_triple_url", lambda c: visible(F.when(T.needs_triple(c), T.url_triple(c)).otherwise(c)))
keyed("nrm_encoded_null", lambda c: visible(T.encoded_nulls(c)))
keyed("nrm_js_unicode", T.js_unicode)
keyed("nrm_hex_escape", T.hex_escape)
keyed("nrm_base64_whole", T.base64_whole)
keyed("nrm_atob", T.atob_inner, prep=lambda c: F.concat(F.lit("eval(atob('"), F.regexp_replace(F.base64(F.encode(c, "UTF-8")), "\\s", ""), F.lit("'))")))
keyed("nrm_decode_once", lambda c: F.concat_ws("|", F.coalesce(T.decode_once(c)["step"], F.lit("-")), visible(T.decode_once(c)["cur"])))
keyed("nrm_null_strip", T.strip_nulls, prep=lambda c: F.regexp_replace(c, "(?s)(.)", "$1\u0000"))
keyed("nrm_charcode", T.charcode_text)
keyed("nrm_sql_char", T.sql_char_text, prep=lambda c: F.concat(F.lit("x=ChAr("), F.pmod(F.length(c), F.lit(26)) + 65, F.lit(", 66)"), c))
keyed("nrm_string_concat", T.join_literals, prep=lambda c: F.regexp_replace(c, "([a-z]{3})([a-z]{2})", "'$1' + '$2'"))
keyed("nrm_eval_unwrap", T.eval_inner)
keyed("nrm_homoglyph_fold", T.fold_homoglyphs)
keyed("nrm_concat_reassemble", T.concat_reassembled, prep=lambda c: F.regexp_replace(c, "([a-z]{3})([a-z]{2})", "$1' + '$2"))
keyed("nrm_log4j_expand", T.log4j_expand, prep=lambda c: F.regexp_replace(c, "([jJ])(n)", "\\${lower:$1}\\${upper:$2}"))
keyed("nrm_decode_variants", lambda c: visible(F.array_join(T.decode_variants(c), "␞")))
keyed("nrm_encoding_depth", lambda c: T.encoding_depth(c).cast("bigint"))
keyed("nrm_crs_layers", lambda c: visible(T.percent_layers(c)))


@query("nrm_html_unescape")
def _html(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), F.lit("page").alias("origin"), T.html_unescape(F.col("html")).alias("value"))
    rows = payload_rows(spark, sf).select("row_id", F.lit("payload").alias("origin"), T.html_unescape(F.col("payload")).alias("value"))
    return pages.unionByName(rows)


@query("nrm_magic_prefix")
def _magic(spark, sf):
    df = payload_rows(spark, sf).withColumn("t", F.concat(
        F.when(F.pmod("row_id", F.lit(3)) == 0, "GIF89a\r\n").when(F.pmod("row_id", F.lit(3)) == 1, "junk").otherwise(""),
        F.lit("<?XML v?>"), F.col("payload")))
    return df.select("row_id", T.magic_step(F.col("t")).alias("m")).select("row_id", F.col("m.cur").alias("value"), F.col("m.step").alias("step"))


@query("nrm_xml_entities")
def _xml(spark, sf):
    df = payload_rows(spark, sf).withColumn("t", F.concat(F.col("payload"), F.lit("&#38;#65;")))
    return df.select("row_id", T.xml_entities(F.col("t")).alias("m")).select("row_id", F.col("m.cur").alias("value"), F.col("m.n").cast("bigint").alias("changed"))


@query("nrm_decode_fixpoint")
def _fix(spark, sf):
    df = payload_rows(spark, sf).select("row_id", T.decode_fixpoint(F.col("payload")).alias("d"))
    return df.select("row_id", visible(F.col("d.cur")).alias("value"), F.array_join("d.chain", ">").alias("chain"))


def normalised(df, raw: str = "payload"):
    """Adds norm, chain and depth to rows that carry a raw text."""
    return df.withColumn("n_", reuse(f"normalise:{raw}", lambda: T.normalise(F.col(raw)))).withColumns({
        "norm": F.col("n_.norm"), "chain": F.col("n_.chain"), "depth": F.size("n_.chain")}).drop("n_")


@query("nrm_normalize")
def _norm(spark, sf):
    return normalised(payload_rows(spark, sf)).select("row_id", visible(F.col("norm")).alias("norm"), F.array_join("chain", ">").alias("chain"))


@query("job_normalise_summary")
def _norm_summary(spark, sf):
    """Step chain histogram with the share of changed rows (two-phase aggregation)."""
    df = normalised(payload_rows(spark, sf))
    return df.groupBy("kind", F.array_join("chain", ">").alias("chain")).agg(
        F.count("*").alias("n"), F.count_if(F.col("norm") != F.col("payload")).alias("changed"))
