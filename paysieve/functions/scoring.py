"""Text views and staged score columns over rows with (raw, norm, depth)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from paysieve.functions import rules as R
from paysieve.functions import text as T
from paysieve.functions.batch_rules import compile_stages, evaluate, score_batches
from paysieve.functions.features import grid_texture, series_anomaly, text_entropies
from paysieve.functions.text import let
from paysieve.session import reuse


def sql_literal(s: str) -> str:
    """Spark SQL literal; the dollar sign is escaped because ``${name}`` is substituted in SQL text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def spark_sql(text: str) -> str:
    return R.render(text, sql_literal, lambda c, p: f"regexp_like({c},{p})", lambda c, p: f"regexp_count({c},{p})", gated=True)


def xml_canonical(c: Column) -> Column:
    return F.regexp_replace(F.replace(T.strip(c), F.lit("\u0000"), F.lit("")), "(?:%00)+", "")


def xml_deep(c: Column) -> Column:
    return T.xml_entities(T.magic_step(c)["cur"])["cur"]


def address_view(low: Column) -> Column:
    c = T.strip(low)
    for a, b in (("+", " "), ("%20", " "), ("%2b", " "), ("%ef%bf%bd", "a"), ("�", "a"), ("%2c", ",")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def plus_view(c: Column) -> Column:
    c = T.strip(c)
    for a, b in (("%252b", " "), ("%2b", " "), ("%252c", ","), ("%2c", ","), ("+", " "), ("%252f", "/"), ("%2f", "/")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def param_names(c: Column) -> Column:
    return F.regexp_extract_all(F.replace(c, F.lit("?"), F.lit("&")), F.lit(R.PATTERNS["PARAM_NAME"]), F.lit(1))


def repeated_names(c: Column) -> Column:
    return F.when(c.contains("="), let(param_names(c), lambda n: F.size(n) > F.size(F.array_distinct(n)))).otherwise(F.lit(False))


def high_entropy(token: Column) -> Column:
    s = T.strip(token)
    shape = s.rlike("^[A-Za-z0-9]{20,40}$") & s.rlike("[A-Z]") & s.rlike("[a-z]") & s.rlike("[0-9]")
    return shape & (F.size(F.array_distinct(F.split(s, ""))) >= 8)


def high_entropy_value(raw: Column) -> Column:
    values = F.regexp_extract_all(F.replace(raw, F.lit("?"), F.lit("&")), F.lit(R.PATTERNS["PARAM_NAME"]), F.lit(2))
    return F.when(raw.rlike("[A-Za-z0-9]{20}"), F.exists(values, high_entropy)).otherwise(F.lit(False))


def atob_text(raw: Column) -> Column:
    token = F.regexp_extract(raw, r"(?i)atob\s*\(\s*['\"]([A-Za-z0-9+/=]+)['\"]\s*\)", 1)
    padded = F.concat(F.rtrim(token, F.lit("=")), F.lit("=="))
    padded = F.substring(padded, 1, (F.ceil(F.length(F.rtrim(token, F.lit("="))) / 4) * 4).cast("int"))
    return F.when(raw.rlike("(?i)atob"), F.coalesce(F.lower(T.base64_text(padded)), F.lit(""))).otherwise("")


def raw_() -> Column:
    return F.col("raw")


def low_() -> Column:
    return F.col("low")


def raw_low_() -> Column:
    return F.col("raw_low")


VIEWS = {
    "klow": lambda: F.lower(T.fold_homoglyphs(low_())), "folded": lambda: F.lower(T.fold_homoglyphs(raw_())),
    "dform": lambda: F.lower(T.url_plus(raw_())), "uraw": lambda: F.lower(T.js_unicode(raw_())), "ulow": lambda: F.lower(T.js_unicode(low_())),
    "xm": lambda: xml_canonical(F.concat_ws(" ", raw_(), low_())), "xl": lambda: xml_canonical(low_()),
    "addr": lambda: address_view(low_()), "low_sp": lambda: F.replace(low_(), F.lit("+"), F.lit(" ")),
    "raw_low_pp": lambda: plus_view(raw_low_()), "low_pp": lambda: plus_view(low_()),
    "mbody": lambda: F.when(raw_().contains("\n\n"), F.substr(raw_(), F.instr(raw_(), "\n\n") + 2)).otherwise(raw_()),
    "reasm": lambda: F.lower(T.concat_reassembled(raw_())), "b64": lambda: atob_text(raw_()),
    "nocomment": lambda: F.replace(raw_low_(), F.lit("/**/"), F.lit("")),
    "inner_low": lambda: F.lower(F.replace(F.regexp_extract(raw_(), R.PATTERNS["JSON_NESTED"], 1), F.lit('\\"'), F.lit('"'))),
    "dup_raw_low": lambda: repeated_names(raw_low_()), "dup_low": lambda: repeated_names(low_()), "hient_any": lambda: high_entropy_value(raw_()),
}
VIEWS_2 = {
    "xd": lambda: xml_deep(F.col("xm")), "xld": lambda: xml_deep(F.col("xl")),
    "addr_name": lambda: F.replace(F.replace(F.col("addr"), F.lit("%27"), F.lit("")), F.lit("'"), F.lit("")),
    "addr_np": lambda: F.regexp_replace("addr", "%[0-9a-f]{2}", " "),
    "b64u": lambda: F.lower(T.url_percent(T.url_percent(F.col("b64")))),
}
VIEWS_3 = {"blob": lambda: F.concat_ws(" ", "b64", "b64u", "raw_low")}
# Input columns of a batch stand behind the kept ones under this prefix; some are made in the batch, of another column.
IN = "in_"
TEXTURE = ["g_std", "g_edge", "g_high"]
DERIVED = {**dict.fromkeys(TEXTURE, ["raw"]), "anom": ["series", "norm"]}
# Values of a feature series; the batch fills in the entropy.
SERIES, ENTROPY_AT = 16, 3
STAGES = R.SCORE_STAGES + [R.REASM, R.REASM2, R.REASM3, R.REASM4, R.SPECIAL, R.RESCUE]


def add_views(df: DataFrame, used: set[str]) -> DataFrame:
    """Adds the lower-cased texts, the text views among ``used`` and the views these are made of."""
    need2 = {n for n in VIEWS_2 if n in used} | ({"b64u"} if "blob" in used else set())
    deps = {"xd": "xm", "xld": "xl", "addr_name": "addr", "addr_np": "addr", "b64u": "b64"}
    need1 = {n for n in VIEWS if n in used} | {deps[n] for n in need2} | ({"b64"} if "blob" in used else set())
    df = df.withColumns({"raw_low": F.lower("raw"), "low": F.lower("norm")})
    for group, need in ((VIEWS, need1), (VIEWS_2, need2), (VIEWS_3, used)):
        cols = {n: reuse(f"view:{n}", f) for n, f in group.items() if n in need}
        df = df.withColumns(cols) if cols else df
    return df


def add_scores(df: DataFrame, *wanted: str, stages=None) -> DataFrame:
    """Adds the wanted signal / score columns and whatever they depend on."""
    stages = R.needed(list(wanted), STAGES if stages is None else stages)
    used = set(re.findall(r"\w+", " ".join(e for st in stages for _, e in st))) | set(wanted)
    df = add_views(df, used)
    for st in stages:
        df = df.withColumns({n: reuse(e, lambda e=e: F.expr(spark_sql(e))) for n, e in st})
    return df


def derived_columns(names: list[str]):
    """Inputs that a batch makes of its columns: byte-grid texture of the texts, anomaly of the feature series."""
    def derived(inputs: dict) -> dict:
        found = {}
        if set(names) & set(TEXTURE):
            found = dict(zip(TEXTURE, map(pa.array, grid_texture(inputs["raw"].to_pylist())), strict=True))
        if "anom" in names:
            n = len(inputs["series"])
            series = inputs["series"].flatten().to_numpy(zero_copy_only=False).reshape(n, SERIES).copy()
            series[:, ENTROPY_AT] = text_entropies(inputs["norm"].to_pylist())
            a = series_anomaly(series)
            found["anom"] = pa.array(a, mask=np.isnan(a))
        return {n: found[n] for n in names}
    return derived


def batch_scores(df: DataFrame, keep: list[str], wanted: list[str], stages=None) -> DataFrame:
    """Columns ``keep`` and the wanted signal / score columns, worked out over Arrow batches.

    The views are Spark columns; the rules are one program (``batch_rules``) in which equal tests stand once, in place of some
    thousand expressions over some hundred columns that are planned, compiled and copied from row to row.  A model, memory or
    view column that is no stage is an input column of ``df``.
    """
    program = compile_stages(STAGES if stages is None else stages, wanted)
    made = [c for c in program.columns if c in DERIVED]
    needed = sorted({c for c in program.columns if c not in DERIVED}.union(*[DERIVED[c] for c in made]))
    df = add_views(df, set(program.columns) | {c[6:] for c in needed if c.startswith("lower_")})
    inputs = [F.lower(c[6:]).alias(f"{IN}{c}") if c.startswith("lower_") else F.col(c).alias(f"{IN}{c}") for c in needed]
    rows = df.select(*keep, *inputs)
    types = {f.name: f.dataType for f in rows.schema}
    empty = {c: pa.array([], to_arrow_type(types[f"{IN}{c}"])) for c in needed} | {c: pa.array([], pa.float64()) for c in made}
    out = StructType([StructField(n, types[n]) for n in keep]
                     + [StructField(f"out_{i}", StringType() if pa.types.is_null(x.type) else from_arrow_type(x.type)) for i, x in enumerate(evaluate(program, empty, 0))])
    run = score_batches(program, len(keep), derived_columns(made), IN)
    return rows.mapInArrow(run, out).toDF(*keep, *wanted)


def map_columns(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{k}") for k in R.LABELS]


def score_views(df: DataFrame) -> DataFrame:
    """Eight equivalent views of a payload as columns v_*."""
    def quoted(c: Column) -> Column:
        return F.when(raw_().contains("%") | raw_().contains("+"), c).otherwise(raw_())
    df = df.withColumns({"v_raw": F.col("raw"), "v_normalized": F.col("norm"), "v_url_once": quoted(T.url_plus(raw_())),
                         "v_url_deep": quoted(T.url_plus(T.url_plus(T.url_plus(raw_()))))})
    deep = F.col("v_url_deep")
    df = df.withColumn("v_html", F.when(deep.contains("&"), T.html_unescape(deep)).otherwise(deep))

    def tokens(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(r"(?:^|[^A-Za-z0-9+/])([A-Za-z0-9+/]{16,}={0,2})"), F.lit(1))
        fixed = F.transform(found, lambda t: F.coalesce(T.base64_text(F.concat(F.rtrim(t, F.lit("=")), F.repeat(F.lit("="), F.pmod(-F.length(F.rtrim(t, F.lit("="))), F.lit(4)).cast("int")))), F.lit("")))
        return F.when(c.rlike("[A-Za-z0-9+/]{16}"), F.array_join(F.filter(fixed, lambda t: t != ""), " ")).otherwise("")
    from paysieve.operators.decompose import json_leaves, pairs_of
    pairs = pairs_of(F.replace(F.col("v_url_deep"), F.lit("?"), F.lit("&")))
    leaves = json_leaves(F.col("v_html"))
    return df.withColumns({
        "v_base64": tokens(F.concat_ws(" ", "v_html", "raw")),
        "v_json": F.coalesce(F.array_join(F.transform(leaves, lambda p: F.concat_ws(" ", p["key"], p["val"])), " "), F.lit("")),
        "v_params": F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["key"], p["val"])), " "),
    })


VIEW_NAMES = ["raw", "normalized", "url_once", "url_deep", "html", "base64", "json", "params"]
# Views whose scores weigh more.
VIEW_WEIGHT = {"html": 1.25, "url_deep": 1.25, "json": 1.25, "params": 1.25}


def lowered_views() -> dict[str, Column]:
    """Lower-cased views; one equal to a view of at least its weight cannot raise the maximum and is left empty."""
    ranked = sorted(VIEW_NAMES, key=lambda v: -VIEW_WEIGHT.get(v, 1.0))
    out = {f"vl_{ranked[0]}": F.lower(f"v_{ranked[0]}")}
    for i, v in enumerate(ranked[1:], 1):
        known = F.col(f"v_{v}").isin(*[F.col(f"v_{w}") for w in ranked[:i]])
        out[f"vl_{v}"] = F.when(known, "").otherwise(F.lower(f"v_{v}"))
    return out


def add_view_scores(df: DataFrame) -> DataFrame:
    """Per class the maximum weighted score over the views, dominant label and its confidence."""
    df = score_views(df)
    cols = {}
    for k in R.ATTACKS:
        per = []
        for v in VIEW_NAMES:
            text = spark_sql(R.VIEW_RULES[k].replace("vl", f"vl_{v}"))
            per.append(F.expr(text) * VIEW_WEIGHT.get(v, 1.0))
        cols[f"vs_{k}"] = F.greatest(*per)
    df = df.withColumns(lowered_views())
    df = df.withColumns(cols).withColumn("discrepant", view_discrepancy())
    floor = F.when(F.col("discrepant"), 0.25).otherwise(0.0)
    df = df.withColumns({f"vs_{k}": F.greatest(f"vs_{k}", floor) for k in ("SQLi", "XSS")})
    df = df.withColumn("vs_peak", F.expr(R.peak("vs")))
    return df.withColumns({
        "view_label": F.when(F.col("vs_peak") < 0.20, "Normal").otherwise(F.expr(R.best("vs"))),
        "view_conf": F.when(F.col("vs_peak") < 0.20, F.greatest("vs_peak", F.lit(0.05))).otherwise(F.col("vs_peak"))})


# ``add_view_scores`` as stages over the lower-cased views vl_* and ``discrepant``.
VIEW_STAGES = [
    [(f"vr_{k}", "greatest(" + ",".join(f"({R.VIEW_RULES[k].replace('vl', f'vl_{v}')})*{VIEW_WEIGHT.get(v, 1.0)}D" for v in VIEW_NAMES) + ")") for k in R.ATTACKS],
    [(f"vs_{k}", f"greatest(vr_{k},CASE WHEN discrepant THEN 0.25D ELSE 0.0D END)" if k in ("SQLi", "XSS") else f"vr_{k}") for k in R.ATTACKS],
    [("vs_peak", R.peak("vs"))],
    [("view_label", f"CASE WHEN vs_peak<0.20 THEN 'Normal' ELSE {R.best('vs')} END"), ("view_conf", "CASE WHEN vs_peak<0.20 THEN greatest(vs_peak,0.05D) ELSE vs_peak END")],
]


def view_discrepancy() -> Column:
    lraw = F.lower("v_raw")
    return (lraw.contains("boundary") & ~F.lower("v_url_deep").contains("boundary")) \
        | ((F.col("v_json") != "") & ~F.contains("v_raw", "v_json")) \
        | ((F.col("v_params") != "") & ~F.contains("v_raw", "v_params") & lraw.contains("%3d"))
