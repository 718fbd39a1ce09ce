"""The rules as one program over Arrow batches give the values, nulls and matches of the Spark expressions."""

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from test_gates import TEXTS

from paysieve.functions import batch_rules as B
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.functions.fusion_rules import FUSION_STAGES
from paysieve.functions.scoring import STAGES, VIEW_STAGES, add_scores, add_view_scores, batch_scores, lowered_views, score_views, view_discrepancy

ODD = ["and 1 like 1", "ſcript", "x and 1=1", "éand 1=1", "and 1=1é", "and 1=1́", "<svǵ", "<SVG>", "ſVG <ſvg", "<!DOCTYPEK", "a\x0bunion\x0bselect", "select\rx\rfrom", "select a from",
       "precio=%2b\n", "x%2b\r\n", "x%2b\n\n", "%2b\u0085", "id=" + "a1" * 16, "ID=" + "A1" * 16 + "é", "é" + "0f" * 16, "0f" * 16 + "\n", "modo=a&modo=b&x=" + "Ab1" * 8, "A" * 41, "%0a" + "y" * 8 + "set-cookie",
       "\U0001f600\U0001f600&&echo", "&#60;" * 3 + "script", "sh", "||sh", "||shé", "jamón", "Calleé", "calle é", "portá", "=%20\"", "%c0%af\n..%c0%af", "{\"a\":{\"b\":\"pwd=%3f\"}}", "\\u0061\\u0062\\u0063 login="]


def frame(spark):
    rows = [(i, t, None if t is None else t.strip(), i % 3) for i, t in enumerate([*TEXTS, *ODD])]
    return spark.createDataFrame(rows, "id int, raw string, norm string, depth int").cache()


def differing(want, got, names):
    a, b = ({r["id"]: r for r in x} for x in (want, got))
    assert a.keys() == b.keys()
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12))
    return sorted({n for i in a for n in names if not close(float(a[i][n]) if hasattr(a[i][n], "as_tuple") else a[i][n], b[i][n])})


def test_every_pattern_matches_what_java_matches(spark):
    rows = frame(spark).select("raw", F.lower("raw").alias("low"))
    for c in ("raw", "low"):
        table = rows.select(F.col(c), *[F.col(c).rlike(p).alias(n) for n, p in R.PATTERNS.items()], *[F.regexp_count(c, F.lit(R.PATTERNS[n])).alias(f"n_{n}") for n in ("LETTER", "UNICODE_ESCAPE")]).toArrow()
        text = table.column(c)
        wrong = [(n, t) for n in R.PATTERNS for t, want, got in zip(text.to_pylist(), table.column(n).to_pylist(), pc.match_substring_regex(text, B.PATTERN[n]).to_pylist()) if want != got]
        assert wrong == []
        assert all(pc.count_substring_regex(text, B.PATTERN[n]).to_pylist() == table.column(f"n_{n}").to_pylist() for n in ("LETTER", "UNICODE_ESCAPE"))


def test_score_stages_equal_their_spark_columns(spark):
    df = frame(spark)
    names = [n for st in STAGES for n, _ in st]
    got = batch_scores(df, ["id"], names)
    want = add_scores(df, *names).select("id", *names)
    assert differing(want.collect(), got.collect(), names) == []
    assert [f.dataType for f in got.schema if f.name in ("obf", "strong", "kw_Normal", "rescue_label")] == [f.dataType for f in want.schema if f.name in ("obf", "strong", "kw_Normal", "rescue_label")]


def test_view_stages_equal_their_spark_columns(spark):
    df = frame(spark)
    names = [*[f"vs_{k}" for k in R.ATTACKS], "vs_peak", "view_label", "view_conf"]
    views = score_views(df).withColumns(lowered_views()).withColumn("discrepant", view_discrepancy())
    assert differing(add_view_scores(df).select("id", *names).collect(), batch_scores(views, ["id"], names, VIEW_STAGES).collect(), names) == []


def test_anomaly_and_entropy_of_a_batch(spark):
    from paysieve.operators.decide import add_series, decide_parts
    df = frame(spark).filter("raw IS NOT NULL")
    want = {r["id"]: r["anom"] for r in add_series(df, F.lit("query")).select("id", "anom").collect()}
    got = {r["id"]: r["anom"] for r in decide_parts(df, ["id"], "anom").collect()}
    assert want.keys() == got.keys() and all(math.isclose(want[i], got[i], rel_tol=1e-12) for i in want)
    assert X.text_entropies(["", "aa", None]).tolist()[:2] == [0.0, 0.0]


def test_equal_tests_stand_once_and_types_tell_literals_apart():
    p = B.compile_stages([[("a", "CASE WHEN contains(low,'x') THEN TRUE ELSE 1.0D END"), ("b", "contains(low,'x') AND TRUE"), ("c", "length(low)-length(replace(low,'ab','')) + 1")]], ["b", "c"])
    assert sum(s[0] == "contains" for s in p.steps) == 1 and len({s[2] for s in p.steps if s[0] == "value"}) == 2
    assert [x.to_pylist() for x in B.evaluate(p, {"low": pa.array(["abxab", None, ""])}, 3)] == [[True, None, False], [5, None, 1]]
    whole = B.compile_stages(VIEW_STAGES + STAGES + FUSION_STAGES, ["fin_label"])
    assert len(whole.steps) == len(set(whole.steps))


def test_the_cascade_is_one_step_of_the_plan(spark):
    """Some thousand score expressions over row after row were planned, compiled and copied."""
    from paysieve.operators.decide import decide_parts
    plan = decide_parts(frame(spark), ["id"], "fin_label", "fin_conf", "fin_mal")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "rp_SQLi" not in plan and "lf_XSS" not in plan


def test_request_scores_are_batches_and_texts_stay_behind_the_join(spark, monkeypatch):
    from paths import SF

    from paysieve.plans import explain
    verdicts = spark.createDataFrame([(1, "SQLi", 0.5, True)], "req_id long, pred string, conf double, mal boolean")
    monkeypatch.setattr(explain, "request_verdicts", lambda spark, sf: verdicts)
    for run in (explain._flip, explain._boost, explain._resc):
        plan = run(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "rp_SQLi" not in plan and "an_raw_low" not in plan
    assert not {"enc", "raw"} & set(explain.request_frame(spark, SF, shape=F.col("enc").contains("x")).columns)
