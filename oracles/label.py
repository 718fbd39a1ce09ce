"""DuckDB text for the label job."""

from oracles.base import PAYLOADS, q, values, with_payloads
from oracles.decide import infer
from oracles.evaluate import FAMILY, MRAW, P
from oracles.normalise import log4j, normal_ctes
from oracles.scoring import score_ctes, scored_payloads
from paysieve.plans.label import CLUSTERS, RULES, SIGNATURES, TEMPLATES

VAR = ("d0 AS (SELECT *, payload AS v0 FROM payload_rows), " + ", ".join(f"d{i} AS (SELECT *, url_decode(v{i - 1}) AS v{i} FROM d{i - 1})" for i in range(1, 7))
       + f", dv AS (SELECT *, [v0,v1,v2,v3,v4,v5,v6,{log4j('v6')},{log4j('v0')}] AS vs FROM d6)")
SIG = f"sg(c,cve,name,verdict,pattern,shown) AS ({values([(i, *s) for i, s in enumerate(SIGNATURES)])})"
PATCH = VAR + ", " + SIG + ", ph AS (SELECT row_id, arg_min(c, i*10+c) AS c FROM (SELECT row_id, unnest(vs) AS v, unnest(range(1,10)) AS i FROM dv) JOIN sg ON regexp_matches(v,pattern) GROUP BY 1), pa AS (SELECT p.*, sg.cve, sg.name, sg.verdict, sg.shown FROM payload_rows p LEFT JOIN ph USING (row_id) LEFT JOIN sg USING (c))"
CLUSTER = "label||':'||CASE " + " ".join(f"WHEN regexp_matches(lower(payload),{q(p)}) THEN '{n}'" for p, n in CLUSTERS) + " WHEN length(payload)-length(replace(payload,'%',''))>=8 THEN 'high_pct_blob' WHEN contains(lower(payload),'union') OR contains(lower(payload),'select') THEN 'sqli_keywords' WHEN contains(lower(payload),'<script') OR contains(lower(payload),'alert(') THEN 'xss_keywords' ELSE 'other' END"


def custom(raw, *wanted):
    return f"WITH RECURSIVE {PAYLOADS}, cu AS MATERIALIZED (SELECT row_id, {raw} AS raw FROM payload_rows), {normal_ctes('(SELECT raw AS txt FROM cu)')}, cn AS (SELECT cu.*, norm, len(chain)::INT AS depth FROM cu JOIN nm ON txt=raw), {score_ctes('cn', 'sc', *wanted)} "


DEPTH = "d0 AS (SELECT *, payload AS v0 FROM payload_rows), " + ", ".join(f"d{i} AS (SELECT *, url_decode(replace(v{i - 1},'+',' ')) AS v{i} FROM d{i - 1})" for i in range(1, 7)) + ", dd AS (SELECT *, " + "+".join(f"(v{i}<>v{i - 1})::INT" for i in range(1, 7)) + " AS dep FROM d6)"
TPL = "[" + ", ".join(f"CASE WHEN regexp_matches(payload,{q(p)}) THEN '{t}' END" for p, t in TEMPLATES) + ", CASE WHEN dep>=3 THEN 'repeat_url_encode' WHEN dep=2 THEN 'double_url_encode_plus' END, CASE WHEN payload<>lower(payload) AND payload<>upper(payload) THEN 'mixed_case_burst' END]"
RT = f"rt(prio,pattern,label,confidence,cluster,enabled) AS ({values(RULES)})"


def prefix(a="lo", b="hi"):
    return f"trim(substr({a},1,coalesce(len(list_filter(range(1,least(length({a}),length({b}))+1), lambda i: substr({a},1,i::BIGINT)=substr({b},1,i::BIGINT))),0)::BIGINT))"


MCL = MRAW + f", mc AS (SELECT {CLUSTER} AS cluster, label, count(*) AS n, min(lower(payload)) AS lo, max(lower(payload)) AS hi FROM mr GROUP BY 1,2)"
INS = MCL + ", " + RT + f", ins AS (SELECT pattern,label,confidence::DOUBLE AS confidence,cluster,enabled FROM rt UNION ALL SELECT p,label,0.60,cluster,true FROM (SELECT *, {prefix()} AS p FROM mc) WHERE length(p)>=8 AND p NOT IN (SELECT pattern FROM rt))"

SQL = {
    "lab_virtual_patch": with_payloads("SELECT row_id, cve, verdict FROM pa", PATCH),
    "agg_patch_block_rate": with_payloads("SELECT kind, count(*) AS n, round(avg((cve IS NOT NULL)::INT),4) AS block_rate FROM pa GROUP BY 1", PATCH),
    "lab_patch_rule": with_payloads("SELECT '# Virtual Patch '||cve||chr(10)||'SecRule ARGS \"@rx '||shown||'\" \"id:99001,phase:2,deny,msg:''VirtualPatch '||name||'''\"' AS rule, count(*) AS n FROM pa WHERE cve IS NOT NULL GROUP BY 1", PATCH),
    "lab_infer": with_payloads(f"SELECT row_id, {infer('payload', 'rl')} AS value FROM (SELECT *, CASE row_id%4 WHEN 0 THEN label WHEN 1 THEN CASE WHEN label='Normal' THEN 'norm' ELSE 'anom' END ELSE '' END AS rl FROM payload_rows)"),
    "lab_concat_rescue": custom("regexp_replace(payload,'(?i)(un)(ion)|(scr)(ipt)|(sel)(ect)','\\1\\3\\5''+''\\2\\4\\6','g')", "concat_label", "concat_conf") + "SELECT row_id, concat_label AS verdict, round(concat_conf::DOUBLE,6) AS conf FROM sc",
    "lab_atob_rescue": custom("CASE WHEN row_id%2=0 THEN 'eval(atob('''||to_base64(encode(payload))||'''))' ELSE payload END", "atob_label", "atob_conf") + "SELECT row_id, atob_label AS verdict, round(atob_conf::DOUBLE,6) AS conf FROM sc",
    "lab_risk_level": P("SELECT pred, CASE WHEN pred='Normal' THEN 'low' WHEN conf>=0.85 THEN 'high' WHEN conf>=0.6 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM pr GROUP BY 1,2"),
    "lab_tech_family": with_payloads(f"SELECT kind, {FAMILY} AS family, count(*) AS n FROM payload_rows GROUP BY 1,2"),
    "lab_cluster_key": with_payloads(f"SELECT row_id, {CLUSTER} AS cluster FROM payload_rows"),
    "lab_infer_templates": with_payloads(f"SELECT row_id, unnest(list_distinct(list_filter({TPL}, lambda t: t IS NOT NULL))) AS template FROM dd", DEPTH),
    "lab_source_parts": with_payloads("SELECT split_part(source,':',1) AS prefix, CASE WHEN contains(source,':') THEN split_part(source,':',2) ELSE source END AS obf_kind, count(*) AS n FROM (SELECT source FROM payload_rows UNION ALL SELECT source FROM documents) GROUP BY 1,2"),
    "lab_dynamic_rules": scored_payloads("SELECT s.row_id, h.label AS verdict, h.confidence::DOUBLE AS conf, h.cluster FROM sc s LEFT JOIN (SELECT row_id, r.label, r.confidence, r.cluster FROM sc JOIN rt r ON r.enabled AND (regexp_matches(raw_low,r.pattern) OR regexp_matches(low,r.pattern)) AND NOT (bform_raw_low AND length(raw)>35 AND ends_with(r.cluster,':other')) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY r.prio)=1) h USING (row_id)", "bform_raw_low", extra=RT),
    "jn_rules_regex": with_payloads("SELECT row_id, r.prio, r.label AS verdict FROM payload_rows JOIN rt r ON r.enabled AND regexp_matches(lower(payload),r.pattern) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY r.prio)=1", RT),
    "udf_rule_table": with_payloads("SELECT cluster, truth, count(*) AS n FROM (SELECT row_id, p.label AS truth, r.cluster FROM payload_rows p JOIN rt r ON r.enabled AND regexp_matches(lower(payload),r.pattern) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY r.prio)=1) GROUP BY 1,2", RT),
    "jn_fp_replay": with_payloads("SELECT prio, count(*) AS n, sum(h)::BIGINT AS hits, round(avg(h),6) AS rate, round(avg(h),6)>0.02 AS rejected FROM (SELECT prio, regexp_matches(low,pattern)::INT AS h FROM rt CROSS JOIN (SELECT lower(text) AS low FROM documents UNION ALL SELECT lower(payload) FROM payload_rows WHERE label='Normal')) GROUP BY 1", RT),
    "snk_rule_table": with_payloads("SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled FROM ins", INS),
    "set_rule_insert": with_payloads("SELECT * FROM ins", INS),
    "agg_common_prefix": with_payloads(f"SELECT origin, grp, CASE WHEN length(p)>=8 THEN p ELSE '' END AS prefix FROM (SELECT *, {prefix()} AS p FROM (SELECT 'doc' AS origin, source AS grp, min(lower(text)) AS lo, max(lower(text)) AS hi FROM documents GROUP BY 2 UNION ALL SELECT 'payload', label||'/'||(row_id%64), min(lower(payload)), max(lower(payload)) FROM payload_rows GROUP BY 2))"),
    "agg_miss_clusters": with_payloads("SELECT cluster, n, CASE WHEN length(p)>=8 THEN p ELSE '' END AS pattern, rate, CASE WHEN length(p)<8 THEN 'no_pattern' WHEN rate>0.02 THEN 'rejected' ELSE 'registered' END AS status FROM (SELECT cluster, sum(n)::BIGINT AS n, "
        + prefix("min(lo)", "max(hi)") + " AS p FROM mc GROUP BY 1) m LEFT JOIN LATERAL (SELECT round(avg(contains(lower(payload),m.p)::INT),6) AS rate FROM payload_rows WHERE label='Normal' AND length(m.p)>=8) ON true", MCL),
}
