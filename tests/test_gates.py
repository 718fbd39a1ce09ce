"""Literal tests in front of regular expressions, marker lists and decode steps never change a result."""

from pyspark.sql import functions as F

from paysieve.functions import rules as R
from paysieve.functions import text as T
from paysieve.functions.scoring import spark_sql, sql_literal

TEXTS = [
    "", " ", "plain text", "  padded words \t", "a+b", "union  select 1", "select x from y", "insert  into t", "drop table t", "sleep (3)", "benchmark(1)", "x or 1 = 1", "'a'", "--", "%27", "%2527", "%2d%2d", "0xABCD", "; shutdown",
    "Calle mayor", "carrer x", "cami+y", "camin,z", "avenida%20", "paseo ", "plaza", "pla ", "rambla", "passatge ", "avinguda", "travesia", "porta ", "c/%2bx", "C/ x", "c/é",
    "\nset-cookie", "%0aSetCookie", "tamper=", "passw%68", "?logina=1", "ciudada=", "%3Cscript", "alert(1)", "alert%28", "%06", "do&nombre=x", "do%0a/", "nombre  like", "%24email", "and 1 = 1", "AND 2<3", "%252e", "/etc/passwd",
    "b1=?", "&b1=%3f", "provincia=|", "pwd=a%2b", "modoa=1", "precio=%7c", "ciudad=|", "cantidad=1?", "b1=x/", "login=%20", "password=!", "direccion=*", "remember=on/", "remember%3don%2f", "cp%3d%20", "apellidos%3d%7c", "email= ", "nombre=&",
    "or 1 LIKE 1", "1e0", "a1e0b", "ECHO hi", "${IFS}wget", "{cat,curl", "||bash", "%0ash ", "/*!50*/", "/**/", "sel/*x*/ect", "uni%09on", "or '1'='1'", "#", "&&echo", "||o", "$(echo", "ech0$", "$(1%2b", "?o %20",
    "ＡＢ", "x​y", "é", "€uro", "\u0000a\u0000b\u0000c", "\\u0041\\u0042", "\\x41", "&#x41;", "&#65;", "%0d%0a", "\r\n", "..%c0%af", "eval(atob('eA=='))", "eval( 'x' )", "'a' + 'b'", "char(65,66)", "String.fromCharCode(88)",
    "GIF89a<x>", "  GIF89aabc", "junk<?xml v?>", "<?XML v?>", "YWJjZGVmZ2g=", " YWJjZGVmZ2hp ", "abcdefgh", "abcdefgh ijk", "&lt;b&gt;", "%41%42", "%zz", "{\"a\": 1}", "modo=x&login=%00", None,
    *[m for k in sorted(R.MARKERS) for m in R.MARKERS[k]], *[m.upper() for k in sorted(R.MARKERS) for m in R.MARKERS[k]], *[" ".join(R.MARKERS[k]) for k in sorted(R.MARKERS)]]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, raw string").withColumn("low", F.lower("raw")).cache()


def ungated(text):
    return R.render(text, sql_literal, lambda c, p: f"regexp_like({c},{p})", lambda c, p: f"regexp_count({c},{p})")


def test_gated_patterns_and_grouped_markers_give_the_plain_result(spark):
    df = frame(spark)
    names = sorted({*R.GATES, *R.LOW_GATES, *R.WIDE} - {"ENTITY_BROKEN"})  # that one is only asked of texts with the gate
    tests = [f"{f}({c},{n})" for n in names for f in ("rx", "nrx") for c in ("raw", "low")] + [f"{f}({c},{n})" for n in sorted(R.MARKERS) for f in ("anyof", "nof") for c in ("raw", "low")]
    for at in range(0, len(tests), 80):
        part = tests[at:at + 80]
        wrong = df.select(*[F.count_if(~F.expr(spark_sql(t)).eqNullSafe(F.expr(ungated(t)))).alias(t) for t in part]).first().asDict()
        assert not {k: v for k, v in wrong.items() if v}


def test_patterns_that_meet_every_text_are_gated():
    for name in ("SQLI_MARK", "ADDRESS_VETO", "STREET", "DYNAMIC_MARK", "BOOL_LIKE", "ECHO", "FULLWIDTH", "NUL", "CRLF", "SHELL_ECHO"):
        assert not spark_sql(f"rx(low,{name})").startswith("regexp_like"), name
    assert spark_sql("rx(raw,STREET)").startswith("regexp_like")  # letters of both cases


def test_unmarked_texts_need_no_decode_step(spark):
    df = frame(spark).select("raw", T.normalise(F.col("raw")).alias("n"), T.decoded(F.col("raw")).alias("d"), F.col("raw").rlike(T.MARKED).alias("marked"))
    rows = df.collect()
    assert [r.raw for r in rows if r.n != r.d] == []
    free = {r.raw for r in rows if r.marked is False}
    assert {"", "plain text", "  padded words \t", "union  select 1"} <= free and not free & {"a+b", "abcdefgh", "é", "GIF89a<x>", "junk<?xml v?>"}


def test_wide_characters_are_translated(spark):
    got = spark.createDataFrame([("ＡＢ c",), ("plain",), ("еоа",), (None,)], "t string").select(T.fullwidth_to_ascii(F.col("t")), T.fold_homoglyphs(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("AB c", "AB c"), ("plain", "plain"), ("еоа", "eoa"), (None, None)]
