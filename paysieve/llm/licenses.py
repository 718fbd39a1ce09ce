"""License scan: ordered signature rules behind a keyword prefilter, overlaps settled by priority and containment.

All rules are one constant array.  Per document, the rules' keywords among its words are found by a set intersection;
only rules whose keyword and second word both occur are run.  A detection is an interval of words.  Sorted by start,
falling end, falling priority and rule order, everything that can contain a detection stands before it; so one pass,
which remembers the farthest end per priority, drops each detection that lies inside one of equal or higher priority.

Everything happens inside a row: no shuffle, no Python.

Defined cases: null and empty texts have no words, labels are empty and the score is 0; repeated rows are scanned one by
one; columns not named in ``keep`` are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.llm.common import word_array
from paysieve.llm.license_rules import TOP, rules

RULE = "struct<no:int,label:string,keyword:string,also:string,priority:int,confidence:double,pattern:string,base:boolean>"
FOUND = "struct<start:int,minus_end:int,minus_priority:int,no:int,label:string,confidence:double,base:boolean>"


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(text: Column, rule: Column) -> Column:
    """Detections of one rule: the words before a match are counted in the pieces and matches to its left."""
    steps = F.zip_with(F.split(text, rule["pattern"], -1), F.regexp_extract_all(text, rule["pattern"], 0), lambda p, m: F.struct(_blanks(p).alias("gap"), (_blanks(m) + 1).alias("n"), m.isNotNull().alias("hit")))
    return F.aggregate(
        F.filter(steps, lambda s: s["hit"]),
        F.struct(F.lit(-1).alias("at"), F.expr(f"cast(array() as array<{FOUND}>)").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["n"] - 1).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + s["gap"]).alias("start"), (-(acc["at"] + s["gap"] + s["n"])).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["no"].alias("no"),
                rule["label"].alias("label"), rule["confidence"].alias("confidence"), rule["base"].alias("base")))).alias("out")),
        lambda acc: acc["out"])


def _settled(found: Column) -> Column:
    """Detections that no earlier one of equal or higher priority reaches around; base ones stay."""
    reach = [f"r{p}" for p in range(1, TOP + 1)]

    def step(acc: Column, x: Column) -> Column:
        end, priority = -x["minus_end"], -x["minus_priority"]
        own = F.lit(0)
        for p, r in enumerate(reach, 1):
            own = F.when(priority == p, acc[r]).otherwise(own)
        return F.struct(
            F.when(x["base"] | (end > own), F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
            *[F.when(priority >= p, F.greatest(acc[r], end)).otherwise(acc[r]).alias(r) for p, r in enumerate(reach, 1)])

    start = F.struct(F.expr(f"cast(array() as array<{FOUND}>)").alias("out"), *[F.lit(0).alias(r) for r in reach])
    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, n_words and ``found``: settled detections, sorted by start."""
    table = rules()
    every = F.from_json(F.lit(json.dumps(table)), f"array<{RULE}>")  # folded to one constant
    keywords = F.from_json(F.lit(json.dumps(sorted({r["keyword"] for r in table}))), "array<string>")
    rows = docs.select(*[F.col(k) for k in keep], F.inline(F.array(F.struct(word_array(F.col("text")).alias("_words")))))
    hits = F.array_intersect("_words", keywords)
    rows = rows.select(*keep, F.size("_words").cast("long").alias("n_words"), F.inline(F.array(F.struct(
        hits.alias("_hits"), F.when(F.size(hits) > 0, F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).alias("_text")))))
    text = F.col("_text")
    gated = F.filter(every, lambda r: F.array_contains(F.col("_hits"), r["keyword"]) & F.contains(text, r["also"]))
    gated = F.filter(gated, lambda r: F.rlike(text, r["pattern"]))
    found = F.when(text.isNotNull(), _settled(F.flatten(F.transform(gated, lambda r: _places(text, r))))).otherwise(F.expr(f"cast(array() as array<{FOUND}>)"))
    return rows.select(*keep, "n_words", F.inline(F.array(F.struct(found.alias("found")))))


def labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")
