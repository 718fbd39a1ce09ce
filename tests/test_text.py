"""Decode properties and edge rows."""

from pyspark.sql import functions as F

from paysieve.functions import rules as R
from paysieve.functions import text as T
from paysieve.functions.scoring import add_scores
from paysieve.functions.techniques import SparkText, TECHNIQUES
from paysieve.operators import decompose as D

SAMPLES = ["plain words", "1' OR '1'='1", "<script>alert(1)</script>", "../../etc/passwd", "ignore previous text", "a=1&b=2", "", "%", "%C3", "100% cotton", "x" * 5000, "\U0001F600 ok"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")


def norm(spark, texts, prep=None):
    df = frame(spark, texts)
    raw = F.col("t") if prep is None else prep(F.col("t"))
    df = df.select("id", raw.alias("raw")).select("id", T.normalise(F.col("raw")).alias("n"))
    return [r.norm for r in df.select("id", "n.norm").orderBy("id").collect()]


def test_idempotent(spark):
    once = norm(spark, SAMPLES)
    assert norm(spark, once) == once


def test_plain_unchanged(spark):
    assert norm(spark, ["plain words", "order 66", "price list"]) == ["plain words", "order 66", "price list"]


def test_encodings_are_undone(spark):
    base = ["<script>alert(1)</script>", "; cat /etc/hosts", "../../etc/passwd", "jailbreak mode"]
    want = norm(spark, base)
    d = SparkText()
    exprs = {n: e(d) for n, _, e in TECHNIQUES}
    for name in ("url_encode", "double_url_encode", "html_entity_full", "unicode_escape"):
        df = frame(spark, base).select("id", F.col("t").alias("x"), F.md5("t").alias("h")).select("id", F.expr(exprs[name]).alias("t"))
        enc = [r.t for r in df.orderBy("id").collect()]
        assert norm(spark, enc) == want, name


def test_long_text_is_kept_whole(spark):
    text = "word " * 4000 + "%41"
    assert norm(spark, [text])[0] == text[:-3] + "A"


def test_stray_percent(spark):
    df = frame(spark, ["a%zz%41%"]).select(T.url_round(F.col("t")).alias("v"))
    assert df.first().v == "a%zzA%"


def test_repeated_keys_and_blanks(spark):
    df = frame(spark, ["b=1&a=2&b=&c&&x=y=z"]).select(D.grouped_pairs(F.col("t")).alias("p"))
    assert [(r.key, r.val) for r in df.first().p] == [("b", "1"), ("b", ""), ("a", "2"), ("c", ""), ("x", "y=z")]


def test_json_edges(spark):
    df = frame(spark, ['{"a":{"b":[1,{"c":null}]},"d":true}', "{broken", "plain"]).select("id", D.json_leaves(F.col("t")).alias("p")).orderBy("id")
    rows = [r.p for r in df.collect()]
    assert {(x.key, x.val) for x in rows[0]} == {("a.b[0]", "1"), ("a.b[1].c", "None"), ("d", "True")}
    assert rows[1] is None and rows[2] is None


def test_multipart_without_header_boundary(spark):
    body = '------WebKitFormBoundaryX\r\nContent-Disposition: form-data; name="f"\r\n\r\nv1\r\n------WebKitFormBoundaryX--'
    df = frame(spark, [body]).select(D.multipart_pairs(F.col("t"), F.lit("")).alias("p"))
    assert [(r.key, r.val) for r in df.first().p] == [("f", "v1")]


def test_score_maps_sum_to_one(spark):
    df = frame(spark, SAMPLES).select("id", F.col("t").alias("raw"), F.col("t").alias("norm"), F.lit(0).alias("depth"))
    for p in ("kw", "st", "rp"):
        cols = [f"{p}_{k}" for k in R.LABELS]
        s = add_scores(df, *cols)
        for r in s.select(*cols).collect():
            assert all(v >= 0 for v in r) and abs(sum(r) - 1) < 1e-9


def test_rescue_branches(spark):
    rows = [("nombre=Ana%00&modo=x", "SQLi"), ("eval(atob('d2dldCBodHRw'))", "CMD"), ("&#60;script&#62;run&#60;/script&#62;", "XSS")  # the alert( marker would be caught by an earlier branch
           , ("union and 1 like 1", "SQLi"), ("9F86d081884c7D659a2feaa0c55ad015", "SQLi"), ("hello world", None)]
    df = frame(spark, [t for t, _ in rows]).select("id", F.col("t").alias("raw"), F.col("t").alias("norm"), F.lit(1).alias("depth"))
    got = [r.rescue_label for r in add_scores(df, "rescue_label").orderBy("id").collect()]
    assert got == [w for _, w in rows]


def test_trigram_vectors_equal_a_loop():
    import numpy as np
    import pandas as pd

    from paysieve.functions import features as X
    texts = ["", None, "ab", "abc", "Select select İx \U0001f600\U0001f600\U0001f600 ﬀ", "a b ccc ccc"]
    got = X.embed_texts(pd.Series(texts, dtype=object))
    for t, row in zip(texts, got, strict=True):
        low, want = (t or "").lower(), np.zeros(X.EMBED_DIM)
        for i in range(len(low) - 2):
            want[X.hash_bucket(low[i:i + 3])] += 1.0
        for w in low.split():
            want[X.hash_bucket(w)] += 0.5 * (len(w) >= 3)
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-8))
