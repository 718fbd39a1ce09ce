"""Rules behind required literals against every rule run on every text."""

import re
import time

import pytest
from paths import SF
from pyspark.sql import functions as F

from paysieve.fixtures import table
from paysieve.operators import rule_index as X
from paysieve.plans import label

PATTERNS = [r"union\s+select", r"<script", r"ab", r"(?i)JNDI:", r"a|bcd", r"x(?:hello){2,}y", r"foo(bar)?baz", r"\Qa.b*c\E", r"(?i:KEY)word", r"\bfile://\b", r"(?=look)lookahead", r"[a-z]{4}", r"ends$",
            r"s?elect+ed", r"(?i)straße", r"(?x) spa ced", r"漢字表", r".*", "", r"\d{3}-token-\d+", r"(one|two)three", r"abc(?!def)ghi", r"(?<n>java)named"]
TEXTS = ["1 union  select 2", "<script>", "cab", "${jndi:ldap}", "abcd", "xhellohelloy", "foobaz foobarbaz", "a.b*c", "axb*c", "keyword", "see file://x", "lookahead", "ends", "selected electttted", "strasse straße", "spaced", "漢字表",
         "", None, "123-token-9", "twothree", "abcghi abcdefghi", "javanamed", "line\nunion\nselect"]


@pytest.mark.parametrize("pattern,literal", [(r"union\s+select", "select"), (r"a|bcd", None), (r"x(?:hello){2,}y", "hello"), (r"foo(bar)?baz", "foo"), (r"\Qa.b*c\E", "a.b*c"), (r"(?i)JNDI:", "jndi:"),
                                             (r"abc(?!def)ghi", "abcghi"), (r"(?<n>java)named", None), (r"\bfile://\b", "file://"), ("", None)])
def test_required_literals(pattern, literal):
    assert X.required_literal(pattern) == literal


def test_index_loses_no_match(spark):
    rows = spark.createDataFrame([(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)], "id int, low string, other string")
    got = {r.id: list(r.hits) for r in rows.select("id", X.matching(PATTERNS, "low", "other").alias("hits")).collect()}
    plain = rows.select("id", *[F.coalesce(F.regexp_like("low", F.lit(p)) | F.coalesce(F.regexp_like("other", F.lit(p)), F.lit(False)), F.regexp_like("other", F.lit(p)), F.lit(False)).alias(f"p{n}") for n, p in enumerate(PATTERNS)])
    want = {r.id: [n for n in range(len(PATTERNS)) if r[f"p{n}"]] for r in plain.collect()}
    assert got == want
    assert {n for hits in got.values() for n in hits} >= set(range(len(PATTERNS) - 1)) - {14}


def test_rule_tables_are_bounded(spark, monkeypatch):
    rules = label.rule_table(spark)
    assert len(X.bounded_rules(rules)) == len(label.RULES)
    monkeypatch.setattr(X, "MAX_RULES", len(label.RULES) - 1)
    with pytest.raises(ValueError):
        X.bounded_rules(rules)
    monkeypatch.setattr(X, "MAX_RULES", 100)
    monkeypatch.setattr(X, "MAX_RULE_CHARS", 10)
    with pytest.raises(ValueError):
        X.bounded_rules(rules)


def test_a_thousand_rules_cost_little_more_than_eight(spark):
    docs = table(spark, SF, "documents").select(F.lower("text").alias("low"), F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("col").cache()
    docs.count()
    few = [re.escape(p) if not p.strip() else p for _, p, *_ in label.RULES]
    many = few + [f"rule{n:04d}[a-z]+marker" for n in range(1000)]

    def seconds(patterns):
        best = []
        for _ in range(3):
            began = time.time()
            docs.select(F.size(X.matching(patterns, "low")).alias("n")).agg(F.sum("n")).collect()
            best.append(time.time() - began)
        return min(best)
    assert seconds(many) < 2 * seconds(few) + 0.5


def test_rates_count_texts_without_a_hit(spark):
    texts = spark.createDataFrame([("a union select",), ("plain",), (None,), ("union select <script",)], "low string")
    got = {r.prio: (r.n, r.hits, r.rate) for r in label.rule_rates(texts, label.rule_table(spark)).collect()}
    assert got[3] == (4, 2, 0.5) and got[4] == (4, 1, 0.25) and got[2] == (4, 0, 0.0)
    assert label.rule_rates(texts.limit(0), label.rule_table(spark)).count() == 0
