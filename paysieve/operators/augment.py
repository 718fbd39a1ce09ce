"""Augment job: rows x techniques -> variants, built inside each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.functions.techniques import TECHNIQUES, SparkText
from paysieve.session import evaluated_once, reuse

D = SparkText()
EXPR = {n: e for n, _, e in TECHNIQUES}
TYPES = {n: t for n, t, _ in TECHNIQUES}


def variant(name: str) -> Column:
    """Variant of column x with choice hash h."""
    return reuse(f"technique:{name}", lambda: F.expr(EXPR[name](D)))


def with_choice(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumns({"x": F.col(text), "h": F.md5(F.concat_ws("|", F.col(text), F.lit(name)))})


def apply_one(df: DataFrame, text: str, name: str, key: str = "row_id") -> DataFrame:
    """Changed variants of one technique for the labels it applies to."""
    rows = df.filter("label <> 'Normal'")
    if TYPES[name]:
        rows = rows.filter(F.col("label").isin(TYPES[name]))
    out = evaluated_once(with_choice(rows, text, name), key, "label", text, variant=variant(name))
    return out.filter(F.col("variant") != F.col(text)).select(key, "label", "variant")


def expand(df: DataFrame, text: str, n: int, only: list[str] | None = None, key: str = "row_id") -> DataFrame:
    """n variants per attack row: applicable techniques in md5 order, the first n that change the text.

    The choice is made inside the row (no row x technique table is shuffled); each technique is
    evaluated only for the rows in which it can still be chosen.
    """
    names = [t for t in TYPES if only is None or t in only]
    rows = df.filter("label <> 'Normal'")
    applicable = [F.when(F.lit(not TYPES[t]) | F.col("label").isin(TYPES[t] or ["-"]), F.struct(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(t))).alias("r"), F.lit(t).alias("t"))) for t in names]
    rows = rows.withColumn("cand_", F.array_sort(F.array_compact(F.array(*applicable))))
    branches = " ".join(f"WHEN '{t}' THEN (SELECT_{t})".replace(f"(SELECT_{t})", _bound(EXPR[t](D), text)) for t in names)
    made = F.expr(f"transform(cand_, e -> struct(e.t AS technique, CASE e.t {branches} END AS variant))")
    changed = F.filter(made, lambda v: v["variant"] != F.col(text))
    rows = evaluated_once(rows, key, "label", text, v_=changed)
    texts = F.transform("v_", lambda v: v["variant"])
    distinct = F.filter(F.transform("v_", lambda v, i: F.struct(v["technique"].alias("technique"), v["variant"].alias("variant"), (F.array_position(texts, v["variant"]) == i + 1).alias("f"))), lambda v: v["f"])
    return rows.select(key, "label", F.posexplode(F.slice(distinct, 1, n)).alias("pos", "v")).select(key, "label", "pos", "v.technique", "v.variant")


def _bound(expr: str, text: str) -> str:
    """The technique text with x and h bound to the row's text and the candidate's choice hash."""
    return f"element_at(transform(array(named_struct('x',{text},'h',md5(concat_ws('|',{text},e.t)))), z -> {_qualify(expr)}),1)"


def _qualify(expr: str) -> str:
    import re
    out, inside = [], False
    for part in re.split(r"('(?:[^'\\]|\\.)*')", expr):
        out.append(part if part.startswith("'") else re.sub(r"(?<![\w.])([xh])(?![\w(])", r"z.\1", part))
    return "".join(out)
