"""Dataset jobs: seeded sampling, splits, augmentation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from paysieve.fixtures import local_table, payload_rows, table
from paysieve.functions import techniques as Q
from paysieve.functions.labels import infer_label
from paysieve.operators import augment as A
from paysieve.operators.scale import lowest_per_group, md5_number
from paysieve.plans.evaluate import batches, dedupe, family, misses_raw
from paysieve.plans.label import inferred_templates
from paysieve.plans.registry import query

SEED = "42"


def rank(key: str):
    return md5_number(F.concat_ws("#", F.col(key).cast("string"), F.lit(SEED)))


@query("smp_stratified_split")
def _split(spark, sf):
    """Per language: test = max(1, 15 %); exact by rank histogram, hot strata are not sorted in one task."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    out = lowest_per_group(d, ["lang"], rank("doc_id"), F.greatest(F.lit(1), F.floor(F.col("group_n") * 0.15)), "doc_id")
    return out.select("doc_id", "lang", F.when(F.col("picked"), "test").otherwise("train").alias("part"))


@query("smp_group_split")
def _gsplit(spark, sf):
    """Group-aware split: all copies and variants of one seed text share a side (decided by the seed hash alone)."""
    b = batches(spark, sf)
    side = F.when(F.pmod(md5_number(F.col("payload")), F.lit(100)) < 15, "test").otherwise("train")
    return b.groupBy("source", side.alias("part")).agg(F.count("*").alias("n"), F.sum("seq").alias("ids"))


@query("smp_fewshot")
def _few(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return lowest_per_group(e, ["label"], rank("vec_id"), F.lit(5), "vec_id").filter("picked").select("vec_id", "label")


@query("smp_shuffle_cap")
def _cap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("g"))
    return lowest_per_group(d, ["g"], rank("doc_id"), F.lit(300), "doc_id").filter("picked").select("doc_id")


@query("smp_normal_negatives")
def _neg(spark, sf):
    d = table(spark, sf, "documents").filter(infer_label(F.col("text")) == "Normal").select("doc_id", F.lit(1).alias("g"))
    return lowest_per_group(d, ["g"], rank("doc_id"), F.lit(100), "doc_id").filter("picked").select("doc_id")


@query("smp_seed_sampling")
def _seeds(spark, sf):
    from paysieve.plans.sources import doc_lines
    lines = doc_lines(spark, sf).filter(F.length("line").between(4, 499)).select((F.col("doc_id") * 100000 + F.col("pos")).alias("line_id"), F.pmod("doc_id", F.lit(5)).alias("source_id"), "line")
    return lowest_per_group(lines, ["source_id"], rank("line_id"), F.lit(20), "line_id").filter("picked").select("source_id", "line_id", "line")


@query("smp_balance_to_count")
def _bal(spark, sf):
    """Every label expanded towards the size of the largest one by numbered copies, exact duplicates dropped."""
    p = payload_rows(spark, sf)
    n = p.groupBy("label").agg(F.count("*").alias("c"))
    top = n.agg(F.max("c").alias("m"))
    times = n.crossJoin(F.broadcast(top)).select("label", F.ceil(F.col("m") / F.col("c")).alias("k"))
    e = p.join(F.broadcast(times), "label").select("label", F.concat("payload", F.lit("#")).alias("base"), F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("copy"))
    made = e.select("label", F.concat("base", F.col("copy").cast("string")).alias("payload")).distinct()
    return made.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("chars"))


# --- augmentation -------------------------------------------------------------------------------
def technique_query(name):
    @query(f"aug_{name}")
    def _run(spark, sf):
        return A.apply_one(payload_rows(spark, sf), "payload", name)


for _n in Q.NAMES:
    technique_query(_n)


def technique_table(spark):
    rows = [(n, ",".join(t)) for n, t, _ in Q.TECHNIQUES]
    return local_table(spark, rows, [("name", pa.string()), ("types", pa.string())])


@query("aug_expand")
def _exp(spark, sf):
    return A.expand(payload_rows(spark, sf), "payload", 3).select("row_id", F.col("pos").cast("bigint").alias("pos"), "technique", "variant")


@query("aug_expand_dataset")
def _expd(spark, sf):
    """Originals and variants, counted per source."""
    p = payload_rows(spark, sf)
    v = A.expand(p, "payload", 2).select("label", F.concat(F.lit("obfuscation:"), "technique").alias("source"), F.col("variant").alias("payload"))
    rows = p.select("label", F.lit("original").alias("source"), "payload").unionByName(v)
    return rows.groupBy("label", "source").agg(F.count("*").alias("n"), F.sum(F.length("payload")).alias("chars"))


INCREMENT = Q.NAMES[25:55]


@query("aug_technique_increment")
def _inc(spark, sf):
    p = payload_rows(spark, sf)
    capped = lowest_per_group(p.filter("label<>'Normal'").withColumn("g", F.lit(1)), ["g"], rank("row_id"), F.lit(500), "row_id").filter("picked")
    return A.expand(capped, "payload", 2, only=INCREMENT).select("row_id", F.col("pos").cast("bigint").alias("pos"), "technique", "variant")


@query("agg_technique_stats")
def _ts(spark, sf):
    v = A.expand(payload_rows(spark, sf), "payload", 3)
    return v.groupBy("technique").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "technique").limit(15)


@query("jn_technique_applicable")
def _ja(spark, sf):
    """Attack rows per applicable technique: labels are aggregated before the technique table is joined."""
    per = payload_rows(spark, sf).filter("label<>'Normal'").groupBy("label").agg(F.count("*").alias("n"))
    t = F.broadcast(technique_table(spark))
    ok = (F.col("types") == "") | F.array_contains(F.split("types", ","), F.col("label"))
    return per.join(t, ok).select("label", "name", "n")


MUTATORS = {"case": ("case_random", None), "comment": (None, lambda x: F.replace(x, F.lit(" "), F.lit("/**/"))), "encode": ("url_encode", None),
            "split": (None, lambda x: F.regexp_replace(x, "(?i)union", "uni'+'on")), "partial_entity": ("html_entity_partial", None),
            "svg": (None, lambda x: F.concat(F.lit("<svg/onload="), x, F.lit(">"))), "event": (None, lambda x: F.concat(F.lit('<img src=x onerror="'), x, F.lit('">')))}
CODE_MUTATORS = {"logic_split": lambda x: F.regexp_replace(x, "(?i)(u)(nion)|(s)(elect)|(s)(cript)|(a)(lert)", "$1$3$5$7'+'$2$4$6$8"),
                 "charcode_wrap": lambda x: F.concat(F.lit("String.fromCharCode("), F.array_join(F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("string")), ","), F.lit(")")),
                 "nested_eval": lambda x: F.when(F.length(x) < 30, F.concat(F.lit("eval(atob('"), x, F.lit("'))"))).otherwise(F.concat(F.lit("eval(/*x*/("), x, F.lit("))"))),
                 "comment_inject": lambda x: F.replace(x, F.lit(" "), F.lit("/**/"))}


def mutated(df, which):
    x = F.col("payload")
    rows = A.with_choice(df.filter("label<>'Normal'"), "payload", "mutate")
    items = [F.struct(F.lit(k).alias("mutator"), (A.variant(t) if t else fn(x)).alias("variant")) for k, (t, fn) in which.items()]
    return rows.select("row_id", "payload", F.explode(F.array(*items)).alias("m")).select("row_id", "payload", "m.*").filter(F.col("variant") != F.col("payload")).drop("payload")


@query("aug_mutators")
def _mut(spark, sf):
    return mutated(payload_rows(spark, sf), MUTATORS)


@query("aug_ast_mutators")
def _ast(spark, sf):
    return mutated(payload_rows(spark, sf), {k: (None, f) for k, f in CODE_MUTATORS.items()})


def template_variants():
    """The nine template transforms of the technique table."""
    x, pos = F.col("x"), F.pmod(F.conv(F.substring("h", 9, 8), 16, 10).cast("bigint"), F.greatest(F.length("x"), F.lit(1))).cast("int")
    enc = F.expr(A.D.urlenc(A.D.urlenc("x")))
    return {"repeat_url_encode": F.expr(A.D.urlenc(A.D.urlenc(A.D.urlenc("x")))), "double_url_encode_plus": enc,
            "insert_null_byte": F.concat(F.substr(x, F.lit(1), pos), F.lit("<NUL>"), F.substr(x, pos + 1)),
            "deep_inline_comment": F.when(x.rlike(r"\s"), F.regexp_replace(x, r"(?s)^(\S*)(\s+)", "$1/**/$2")).otherwise(F.concat(x, F.lit("/**/"))),
            "zero_width_inject": F.concat(F.substr(x, F.lit(1), pos), F.lit("​"), F.substr(x, pos + 1)), "mixed_case_burst": A.variant("case_random"),
            "hex_wrap_keywords": A.variant("hex_escape"), "md5_hex32_camouflage": A.variant("md5_hex32_camouflage"), "json_null_in_key": A.variant("json_null_in_key")}


@query("aug_discovered")
def _disc(spark, sf):
    rows = A.with_choice(payload_rows(spark, sf).filter("label<>'Normal'"), "payload", "template")
    t = template_variants()
    items = [F.struct(F.lit(k).alias("template"), v.alias("variant")) for k, v in t.items()]
    return rows.select("row_id", F.explode(F.array(*items)).alias("m")).select("row_id", "m.*")


@query("udf_technique")
def _ut(spark, sf):
    """Named transforms picked from the table by a name column."""
    names = list(template_variants())
    rows = A.with_choice(payload_rows(spark, sf), "payload", "template").withColumn("template", F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod("row_id", F.lit(len(names))) + 1).cast("int")))
    from paysieve.functions.labels import first_match
    return rows.select("row_id", "template", first_match([(F.col("template") == n, c) for n, c in template_variants().items()]).alias("variant"))


@query("aug_registry_upsert")
def _reg(spark, sf):
    """Known templates gain uses, unseen ones become rows, unknown templates are refused."""
    known = list(template_variants())
    seen = misses_raw(spark, sf).select(F.explode(inferred_templates(F.col("payload"))).alias("template")).groupBy("template").agg(F.count("*").alias("uses"))
    table_ = local_table(spark, [(n, 1) for n in known[:4]], [("template", pa.string()), ("use_count", pa.int64())])
    j = table_.join(seen.filter(F.col("template").isin(known)), "template", "full")
    return j.select("template", (F.coalesce("use_count", F.lit(0)) + F.coalesce("uses", F.lit(0))).alias("use_count"), F.col("use_count").isNull().alias("is_new"))


@query("aug_heldout_cases")
def _held(spark, sf):
    """Technique x applicable seeds, three variants each: seeds by md5 order within the technique."""
    held = heldout_names()
    out = None
    for name in held:
        v = A.apply_one(payload_rows(spark, sf), "payload", name).withColumn("technique", F.lit(name))
        out = v if out is None else out.unionByName(v)
    r = md5_number(F.concat_ws("#", F.col("row_id").cast("string"), "technique"))
    return lowest_per_group(out, ["technique"], r, F.lit(3), "row_id").filter("picked").select("technique", "row_id", "variant")


def heldout_names():
    return ["ifs_var_bypass", "homoglyph_substitution", "overlong_utf8_encoding", "data_uri_xss", "html_entity_full", "tab_newline", "nested_comment", "php_filter_wrapper"]


@query("set_heldout")
def _seth(spark, sf):
    """Techniques not used in the training increment, with the rows they apply to."""
    used = technique_table(spark).filter(F.col("name").isin(INCREMENT))
    rest = technique_table(spark).select("name", "types").subtract(used)
    per = payload_rows(spark, sf).filter("label<>'Normal'").groupBy("label").agg(F.count("*").alias("n"))
    ok = (F.col("types") == "") | F.array_contains(F.split("types", ","), F.col("label"))
    return per.join(F.broadcast(rest), ok).groupBy("name").agg(F.sum("n").alias("rows"), family(F.first("name")).alias("family"))


@query("set_intersect_known")
def _seti(spark, sf):
    """Kinds that occur in the payload table and are known technique names."""
    alias = {"url": "url_encode", "double_url": "double_url_encode", "unicode": "unicode_escape", "case": "case_random", "multipart": "multipart_boundary_sim"}
    from paysieve.functions.labels import first_match
    seen = payload_rows(spark, sf).select(first_match([(F.col("kind") == k, F.lit(v)) for k, v in alias.items()], F.col("kind")).alias("name")).distinct()
    return seen.intersect(technique_table(spark).select("name"))


@query("aug_failure_train_rows")
def _ftr(spark, sf):
    """Deduplicated base rows, failures, and two variants per attack failure."""
    base = payload_rows(spark, sf).select("label", "payload", F.col("row_id").alias("seq"))
    base = dedupe(base).select("label", F.lit("base").alias("origin"))
    m = misses_raw(spark, sf)
    v = A.expand(m, "payload", 2).select("label", F.lit("variant").alias("origin"))
    return base.unionByName(m.select("label", F.lit("failure").alias("origin"))).unionByName(v).groupBy("origin", "label").agg(F.count("*").alias("n"))


@query("aug_round_variants")
def _rv(spark, sf):
    """Variant pool of several generators, distinct, capped by md5 order."""
    p = payload_rows(spark, sf)
    pool = mutated(p, MUTATORS).select("variant").unionByName(mutated(p, {k: (None, f) for k, f in CODE_MUTATORS.items()}).select("variant")).distinct()
    pool = pool.withColumns({"g": F.lit(1), "k": F.md5("variant")})
    return lowest_per_group(pool, ["g"], md5_number(F.col("variant")), F.lit(400), "k").filter("picked").select("variant")
