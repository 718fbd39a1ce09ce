"""DuckDB text for sampling and augmentation."""

import re

from oracles.base import q, values, with_payloads
from oracles.decide import infer
from oracles.evaluate import BATCHES, FAMILY, MRAW
from oracles.label import DEPTH, TPL
from oracles.sources import LINES
from paysieve.functions import techniques as Q
from paysieve.plans.dataset import INCREMENT, heldout_names


class DuckText(Q.SparkText):
    def q(self, s):
        return q(s)

    def sub(self, x, pattern, repl):
        safe = re.sub(r"\\(?!\d)", r"\\\\", repl)
        return f"regexp_replace({x},{q(pattern)},{q(safe)},'g')"

    def has(self, x, pattern):
        return f"regexp_matches({x},{q(pattern)})"

    def chars(self, x, body):
        b = body.replace("{g}", "substr(h,(i-1)%32+1,1)").replace("{code}", "unicode(c)::VARCHAR").replace("{code4}", "lpad(lower(to_hex(unicode(c))),4,'0')")
        return f"array_to_string(list_transform(split({x},''), lambda c, i: {b}),'')"

    def codes(self, x, prefix="", suffix=""):
        return f"array_to_string(list_transform(split({x},''), lambda c: {q(prefix)}||unicode(c)||{q(suffix)}),',')"

    def fold(self, x, pattern, t):
        return f"list_reduce(list_reverse_sort(list_distinct(regexp_extract_all({x},{q(pattern)}))), lambda acc, t: replace(acc,t,{t}), {x})"

    def hexof(self, t):
        return f"lower(hex(encode({t})))"

    def urlenc(self, x):
        return f"url_encode({x})"

    def b64(self, x):
        return f"to_base64(encode({x}))"

    def pick(self, options, salt=""):
        return f"CASE ('0x'||substr(h,1,8))::BIGINT%{len(options)} " + " ".join(f"WHEN {i} THEN {q(o)}" for i, o in enumerate(options)) + " END"

    def number(self, lo, span):
        return f"(('0x'||substr(h,9,8))::BIGINT%{span}+{lo})::VARCHAR"

    def position(self, x):
        return f"(('0x'||substr(h,9,8))::BIGINT%greatest(length({x}),1))"

    def last(self, x, sep):
        return f"split_part({x},{q(sep)},-1)"

    letter = "regexp_matches(c,'^\\p{L}$')"
    alnum = "regexp_matches(c,'^[\\p{L}\\p{N}]$')"


D = DuckText()


def expr(e):
    return e(D).replace(" DIV ", "//")


def one(name, types, e):
    lab = f"AND label IN ({','.join(q(t) for t in types)})" if types else ""
    return f"SELECT row_id, label, variant FROM (SELECT row_id, label, x, {expr(e)} AS variant FROM (SELECT row_id, label, payload AS x, md5(payload||'|{name}') AS h FROM payload_rows WHERE label<>'Normal' {lab})) WHERE variant<>x"


def all_variants(names, src="payload_rows"):
    parts = []
    for n, t, e in Q.TECHNIQUES:
        if n in names:
            parts.append(f"SELECT row_id, label, '{n}' AS technique, variant FROM ({one(n, t, e).replace('payload_rows', src)})")
    return " UNION ALL ".join(parts)


def expanded(n, names=Q.NAMES, src="payload_rows"):
    """ex(row_id, label, pos, technique, variant)"""
    return (f"av AS MATERIALIZED ({all_variants(names, src)}), av1 AS (SELECT *, row_number() OVER (PARTITION BY row_id, variant ORDER BY md5(row_id||'|'||technique)) AS dn FROM av), "
            f"ex AS MATERIALIZED (SELECT row_id, label, rn-1 AS pos, technique, variant FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY md5(row_id||'|'||technique)) AS rn FROM av1 WHERE dn=1) WHERE rn<={n})")


def rank(k):
    return f"('0x'||substr(md5({k}||'#42'),1,8))::BIGINT, {k}"


TT = f"tt(name,types) AS ({values([(n, ','.join(t)) for n, t, _ in Q.TECHNIQUES])})"
HM = "md5(payload||'|mutate')"
MUT = {"case": Q.TECHNIQUES[0][2], "encode": dict((n, e) for n, _, e in Q.TECHNIQUES)["url_encode"], "partial_entity": dict((n, e) for n, _, e in Q.TECHNIQUES)["html_entity_partial"]}
MROWS = f"mw AS (SELECT row_id, payload AS x, {HM} AS h FROM payload_rows WHERE label<>'Normal')"
MUTATE = " UNION ALL ".join([f"SELECT row_id, '{k}' AS mutator, x, {expr(e)} AS variant FROM mw" for k, e in MUT.items()] + [
    "SELECT row_id, 'comment', x, replace(x,' ','/**/') FROM mw", "SELECT row_id, 'split', x, regexp_replace(x,'(?i)union','uni''+''on','g') FROM mw",
    "SELECT row_id, 'svg', x, '<svg/onload='||x||'>' FROM mw", "SELECT row_id, 'event', x, '<img src=x onerror=\"'||x||'\">' FROM mw"])
CODE = " UNION ALL ".join([
    "SELECT row_id, 'logic_split' AS mutator, x, regexp_replace(x,'(?i)(u)(nion)|(s)(elect)|(s)(cript)|(a)(lert)','\\1\\3\\5\\7''+''\\2\\4\\6\\8','g') AS variant FROM mw",
    f"SELECT row_id, 'charcode_wrap', x, 'String.fromCharCode('||{D.codes('x')}||')' FROM mw",
    "SELECT row_id, 'nested_eval', x, CASE WHEN length(x)<30 THEN 'eval(atob('''||x||'''))' ELSE 'eval(/*x*/('||x||'))' END FROM mw", "SELECT row_id, 'comment_inject', x, replace(x,' ','/**/') FROM mw"])
E = {n: e for n, _, e in Q.TECHNIQUES}
TEMPL = {"repeat_url_encode": "url_encode(url_encode(url_encode(x)))", "double_url_encode_plus": "url_encode(url_encode(x))",
         "insert_null_byte": f"substr(x,1,{D.position('x')})||'<NUL>'||substr(x,{D.position('x')}+1)",
         "deep_inline_comment": "CASE WHEN regexp_matches(x,'\\s') THEN regexp_replace(x,'(?s)^(\\S*)(\\s+)','\\1/**/\\2') ELSE x||'/**/' END",
         "zero_width_inject": f"substr(x,1,{D.position('x')})||chr(8203)||substr(x,{D.position('x')}+1)", "mixed_case_burst": expr(E["case_random"]), "hex_wrap_keywords": expr(E["hex_escape"]),
         "md5_hex32_camouflage": expr(E["md5_hex32_camouflage"]), "json_null_in_key": expr(E["json_null_in_key"])}
TROWS = "tw AS (SELECT row_id, label, payload AS x, md5(payload||'|template') AS h FROM payload_rows)"
APPL = "(types='' OR list_contains(string_split(types,','),label))"

SQL = {
    **{f"aug_{n}": with_payloads(one(n, t, e)) for n, t, e in Q.TECHNIQUES},
    "smp_stratified_split": f"SELECT doc_id, lang, CASE WHEN rn<=greatest(1,floor(n*0.15)) THEN 'test' ELSE 'train' END AS part FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {rank('doc_id')}) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents)",
    "smp_group_split": f"WITH {BATCHES} SELECT source, CASE WHEN ('0x'||substr(md5(payload),1,8))::BIGINT%100<15 THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(seq)::BIGINT AS ids FROM bt GROUP BY 1,2",
    "smp_fewshot": f"SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {rank('vec_id')})<=5",
    "smp_shuffle_cap": f"SELECT doc_id FROM documents ORDER BY {rank('doc_id')} LIMIT 300",
    "smp_normal_negatives": f"SELECT doc_id FROM documents WHERE ({infer('text')})='Normal' ORDER BY {rank('doc_id')} LIMIT 100",
    "smp_seed_sampling": f"WITH {LINES} SELECT doc_id%5 AS source_id, line_id, line FROM (SELECT *, doc_id*100000+pos AS line_id FROM ln WHERE length(line) BETWEEN 4 AND 499) QUALIFY row_number() OVER (PARTITION BY doc_id%5 ORDER BY {rank('line_id')})<=20",
    "smp_balance_to_count": with_payloads("SELECT label, count(*) AS n, sum(length(p))::BIGINT AS chars FROM (SELECT DISTINCT label, payload||'#'||c AS p FROM (SELECT label, payload, unnest(range(1,(k+1)::BIGINT)) AS c FROM payload_rows JOIN (SELECT label, ceil(max(count(*)) OVER ()/count(*)) AS k FROM payload_rows GROUP BY 1) USING (label))) GROUP BY 1"),
    "aug_expand": with_payloads("SELECT row_id, pos, technique, variant FROM ex", expanded(3)),
    "aug_expand_dataset": with_payloads("SELECT label, source, count(*) AS n, sum(length(p))::BIGINT AS chars FROM (SELECT label, 'original' AS source, payload AS p FROM payload_rows UNION ALL SELECT label, 'obfuscation:'||technique, variant FROM ex) GROUP BY 1,2", expanded(2)),
    "aug_technique_increment": with_payloads("SELECT row_id, pos, technique, variant FROM ex", f"cp AS (SELECT * FROM payload_rows WHERE label<>'Normal' ORDER BY {rank('row_id')} LIMIT 500), " + expanded(2, INCREMENT, "cp")),
    "agg_technique_stats": with_payloads("SELECT technique, count(*) AS n FROM ex GROUP BY 1 ORDER BY n DESC, technique LIMIT 15", expanded(3)),
    "jn_technique_applicable": with_payloads(f"SELECT label, name, n FROM (SELECT label, count(*) AS n FROM payload_rows WHERE label<>'Normal' GROUP BY 1) JOIN tt ON {APPL}", TT),
    "aug_mutators": with_payloads(f"SELECT row_id, mutator, variant FROM ({MUTATE}) WHERE variant<>x", MROWS),
    "aug_ast_mutators": with_payloads(f"SELECT row_id, mutator, variant FROM ({CODE}) WHERE variant<>x", MROWS),
    "aug_discovered": with_payloads(" UNION ALL ".join(f"SELECT row_id, '{k}' AS template, {e} AS variant FROM tw WHERE label<>'Normal'" for k, e in TEMPL.items()), TROWS),
    "udf_technique": with_payloads("SELECT row_id, template, CASE template " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in TEMPL.items()) + " END AS variant FROM (SELECT *, [" + ",".join(f"'{k}'" for k in TEMPL) + "][row_id%9+1] AS template FROM tw)", TROWS),
    "aug_registry_upsert": with_payloads("SELECT coalesce(k.template,s.template) AS template, coalesce(k.c,0)+coalesce(s.uses,0) AS use_count, k.c IS NULL AS is_new FROM (SELECT unnest(["
        + ",".join(f"'{k}'" for k in list(TEMPL)[:4]) + "]) AS template, 1::BIGINT AS c) k FULL JOIN (SELECT template, count(*) AS uses FROM (SELECT unnest(list_distinct(list_filter(" + TPL + ", lambda t: t IS NOT NULL))) AS template FROM dd WHERE row_id IN (SELECT row_id FROM mr)) WHERE template IN ("
        + ",".join(f"'{k}'" for k in TEMPL) + ") GROUP BY 1) s USING (template)", DEPTH + ", " + MRAW),
    "aug_heldout_cases": with_payloads(f"SELECT technique, row_id, variant FROM ({all_variants(heldout_names())}) QUALIFY row_number() OVER (PARTITION BY technique ORDER BY ('0x'||substr(md5(row_id||'#'||technique),1,8))::BIGINT, row_id)<=3"),
    "set_heldout": with_payloads(f"SELECT name, sum(n)::BIGINT AS rows, any_value(family) AS family FROM (SELECT name, n, {FAMILY.replace('(kind', '(name')} AS family FROM (SELECT label, count(*) AS n FROM payload_rows WHERE label<>'Normal' GROUP BY 1) JOIN tt ON {APPL} WHERE name NOT IN ({','.join(q(n) for n in INCREMENT)})) GROUP BY 1", TT),
    "set_intersect_known": with_payloads("SELECT DISTINCT CASE kind WHEN 'url' THEN 'url_encode' WHEN 'double_url' THEN 'double_url_encode' WHEN 'unicode' THEN 'unicode_escape' WHEN 'case' THEN 'case_random' WHEN 'multipart' THEN 'multipart_boundary_sim' ELSE kind END AS name FROM payload_rows INTERSECT SELECT name FROM tt", TT),
    "aug_failure_train_rows": with_payloads("SELECT origin, label, count(*) AS n FROM (SELECT 'base' AS origin, label FROM (SELECT * FROM payload_rows QUALIFY row_number() OVER (PARTITION BY payload ORDER BY row_id)=1) UNION ALL SELECT 'failure', label FROM mr UNION ALL SELECT 'variant', label FROM ex) GROUP BY 1,2", MRAW + ", " + expanded(2, src="mr")),
    "aug_round_variants": with_payloads(f"SELECT variant FROM (SELECT DISTINCT variant FROM ({MUTATE} UNION ALL {CODE}) WHERE variant<>x) ORDER BY ('0x'||substr(md5(variant),1,8))::BIGINT, md5(variant) LIMIT 400", MROWS),
}
