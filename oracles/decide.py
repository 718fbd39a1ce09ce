"""DuckDB text for the decide job."""

import re

from oracles.base import PAYLOADS, REQUESTS, q
from oracles.decompose import LEAF, PARTS, pairs
from oracles.featurise import FEATS, GRID, LET, case_map
from oracles.normalise import normal_ctes, unescape, vis
from oracles.scoring import NSRC, b64_tokens, duck_sql, score_ctes
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.functions.fusion_rules import FUSION_STAGES
from paysieve.functions.labels import LABEL_PATTERNS
from paysieve.functions.scoring import STAGES, VIEW_NAMES, VIEW_WEIGHT

UP = "url_decode(replace({},'+',' '))"


def infer(text, raw="''"):
    w = " ".join(f"WHEN regexp_matches({text},{q(p)}) THEN '{lab}'" for p, lab in LABEL_PATTERNS)
    return (f"CASE WHEN {raw} IN ('Normal','norm','0','benign','good') THEN 'Normal' WHEN {raw}<>'' AND {raw} NOT IN ('anom','1','attack','malicious') THEN {raw}"
            f" WHEN regexp_matches(coalesce({text},''),'^\\s*$') THEN 'Normal' {w} WHEN {raw} IN ('anom','1','attack','malicious') THEN 'SQLi' ELSE 'Normal' END")


FEAT15 = list(FEATS.items())[:15]


def series_ctes(src, out, weight="1.0"):
    arr = "[" + ", ".join(f"({weight if n == 'location_weight' else e})::DOUBLE" for n, e in FEAT15) + ", 0.0]"
    win = "list_transform(range(1,17), lambda i: list_sum(list_slice(series, greatest(i-2,1)::BIGINT, least(i+1,16)::BIGINT))/4)"
    return (f"{out}_1 AS MATERIALIZED (SELECT *, {arr} AS series FROM {src}), {out}_2 AS MATERIALIZED (SELECT *, {win} AS trend FROM {out}_1), "
            f"{out}_3 AS (SELECT *, list_sum(list_transform(range(1,17), lambda i: abs(series[i]-trend[i])))/16 AS resid, trend[16]-trend[1] AS slope, series[4] AS third FROM {out}_2), "
            f"{out} AS MATERIALIZED (SELECT *, 1.0/(1.0+exp(-(resid*2.0+abs(slope)+third*0.1))) AS anom FROM {out}_3)")


def views_ctes(src, out):
    """Views v_*, scores vs_*, view_label, view_conf, discrepant (keyed by rid)."""
    leaves = f"""{out}_w AS (
      SELECT rid, '' AS path, try_cast(v_html AS JSON) AS v, 0 AS d FROM {out}_h WHERE starts_with(trim(v_html,' '||chr(9)||chr(10)||chr(13)),'{{') AND try_cast(v_html AS JSON) IS NOT NULL
      UNION ALL SELECT rid, CASE WHEN isobj THEN CASE WHEN path='' THEN k ELSE path||'.'||k END ELSE path||'['||k||']' END,
        CASE WHEN isobj THEN json_extract(v,'$."'||k||'"') ELSE json_extract(v,'$['||k||']') END, d+1
      FROM (SELECT rid, path, v, d, json_type(v)='OBJECT' AS isobj, unnest(CASE WHEN json_type(v)='OBJECT' THEN json_keys(v) ELSE list_transform(range(json_array_length(v)::BIGINT), lambda z: z::VARCHAR) END) AS k
        FROM {out}_w WHERE json_type(v) IN ('OBJECT','ARRAY') AND d<8)),
    {out}_l AS (SELECT rid, string_agg(path||' '||t,' ' ORDER BY path) AS v_json FROM (SELECT rid, CASE WHEN path='' THEN 'value' ELSE path END AS path, {LEAF} AS t FROM {out}_w WHERE json_type(v) NOT IN ('OBJECT','ARRAY')) GROUP BY 1)"""
    per = {k: "greatest(" + ",".join(f"({duck_sql(R.VIEW_RULES[k].replace('vl', 'vl_' + v))})*{VIEW_WEIGHT.get(v, 1.0)}" for v in VIEW_NAMES) + ")" for k in R.ATTACKS}
    disc = ("((contains(vl_raw,'boundary') AND NOT contains(vl_url_deep,'boundary')) OR (v_json<>'' AND NOT contains(v_raw,v_json))"
            " OR (v_params<>'' AND NOT contains(v_raw,v_params) AND contains(vl_raw,'%3d')))")
    return f"""{out}_0 AS (SELECT *, raw AS v_raw, norm AS v_normalized, {UP.format('raw')} AS v_url_once, {UP.format(UP.format(UP.format('raw')))} AS v_url_deep FROM {src}),
    {out}_h AS MATERIALIZED (SELECT *, {unescape('v_url_deep')} AS v_html FROM {out}_0), {leaves},
    {out}_1 AS MATERIALIZED (SELECT h.*, {b64_tokens("v_html||' '||raw")} AS v_base64, coalesce(l.v_json,'') AS v_json,
      array_to_string(list_transform({pairs("replace(v_url_deep,'?','&')")}, lambda p: p.k||'='||p.v),' ') AS v_params FROM {out}_h h LEFT JOIN {out}_l l USING (rid)),
    {out}_2 AS (SELECT *, {', '.join(f'lower(v_{v}) AS vl_{v}' for v in VIEW_NAMES)} FROM {out}_1),
    {out}_3 AS (SELECT *, {disc} AS discrepant, {', '.join(f'{e} AS vr_{k}' for k, e in per.items())} FROM {out}_2),
    {out}_4 AS (SELECT *, {', '.join((f'greatest(vr_{k}, CASE WHEN discrepant THEN 0.25 ELSE 0.0 END)' if k in ('SQLi', 'XSS') else f'vr_{k}') + f' AS vs_{k}' for k in R.ATTACKS)} FROM {out}_3),
    {out}_5 AS (SELECT *, {R.peak('vs')} AS vs_peak FROM {out}_4),
    {out} AS MATERIALIZED (SELECT *, CASE WHEN vs_peak<0.20 THEN 'Normal' ELSE {R.best('vs')} END AS view_label, CASE WHEN vs_peak<0.20 THEN greatest(vs_peak,0.05) ELSE vs_peak END AS view_conf FROM {out}_5)"""


TEXTURE = ("tx AS (SELECT 'p' AS origin, rid AS row_id, raw AS t FROM np1), " + GRID
           + f", tex AS (SELECT np1.*, CASE WHEN isnan(gv.v[2]) THEN 0 ELSE gv.v[2] END AS g_std, gv.edge AS g_edge, gv.high AS g_high, (CASE WHEN length({LET.replace('(t,', '(raw,')})>=8 THEN (len(regexp_extract_all(regexp_replace(regexp_replace({LET.replace('(t,', '(raw,')},'\\p{{Lu}}','1','g'),'[^1]','0','g'),'1+|0+'))-1)/greatest(length({LET.replace('(t,', '(raw,')})-1,1) ELSE 0 END)::DOUBLE AS cs_rate FROM np1 JOIN gv ON gv.row_id=rid)")
NOMEM = ", ".join(f"0.0::DOUBLE AS mem_{k}" for k in R.LABELS) + ", 0.0::DOUBLE AS mem_hit, NULL::VARCHAR AS mem_exact"


def decided(body, *wanted, mem=NOMEM, memctes="", source=PAYLOADS, weight="1.0"):
    """Full decision chain over payload rows as ``dc``; mem: memory columns (aliases m.*) if given with ctes; source: ctes with payload_rows."""
    stages = R.needed(list(wanted), FUSION_STAGES)
    used = set(re.findall(r"\w+", " ".join(e for st in stages for _, e in st))) | set(wanted)
    base = [n for st in STAGES for n, _ in st if n in used] + [f"kw_{k}" for k in R.LABELS] + (["dup_raw_low"] if "dup_raw_low" in used else [])
    sql = (f"WITH RECURSIVE {source}, {normal_ctes('(SELECT payload AS txt FROM payload_rows)')}, {NSRC}, np1 AS MATERIALIZED (SELECT *, row_id AS rid FROM np0), {TEXTURE}, "
           f"{series_ctes('tex', 'se', weight)}, {views_ctes('se', 'vw')}, {memctes + ', ' if memctes else ''}me AS (SELECT vw.*, {mem} FROM vw{' LEFT JOIN mm_ ON mm_.mid=rid' if memctes else ''}), {score_ctes('me', 'sc', *base)}, "
           f"f0 AS (SELECT *, {', '.join(f'kw_{k} AS ml_{k}' for k in R.LABELS)} FROM sc)")
    prev = "f0"
    for i, st in enumerate(stages):
        sql += f", fz{i} AS (SELECT *, {', '.join(f'{duck_sql(e)} AS {n}' for n, e in st)} FROM {prev})"
        prev = f"fz{i}"
    return sql + f", dc AS MATERIALIZED (SELECT * FROM {prev}) " + body


def vec(p, labels=R.LABELS):
    cols = [f"{p}_{k}" for k in labels]
    return decided("SELECT row_id, " + ", ".join(f"round({c}::DOUBLE,5) AS {c}" for c in cols) + " FROM dc", *cols)


def dec(p):
    return decided(f"SELECT row_id, {p}_label AS verdict, round({p}_conf::DOUBLE,5) AS conf, {p}_mal AS mal FROM dc", f"{p}_label", f"{p}_conf", f"{p}_mal")


def light(ctes, body):
    return f"WITH RECURSIVE {PAYLOADS}, {normal_ctes('(SELECT payload AS txt FROM payload_rows)')}, {NSRC}, np1 AS MATERIALIZED (SELECT *, row_id AS rid FROM np0), {ctes} {body}"


# request verdicts: a part's verdict depends on its text and location only, so each pair is decided once
PART_TEXTS = REQUESTS + ", " + PARTS + ", vp0 AS MATERIALIZED (SELECT p.* FROM parts p), part_texts AS MATERIALIZED (SELECT row_number() OVER () AS row_id, raw AS payload, location FROM (SELECT DISTINCT raw, location FROM vp0))"
FAST = ("(NOT obf AND NOT strong AND NOT hexw AND depth<2 AND ((length(raw)<=16 AND NOT regexp_matches(raw,'[^\\x00-\\x7F]') AND (length(raw)-length(replace(raw,'%','')))<2) OR (round(rp_peak,6)<0.22 AND length(raw)<120)))")
VERDICTS = (decided("", "fin_label", "fin_conf", "fin_mal", "obf", "strong", "hexw", "rp_peak", "kw_Normal", source="@SOURCE@", weight=case_map("location", X.LOCATION_WEIGHT, 0.5))
            .replace("payload_rows", "part_texts").replace("@SOURCE@", PART_TEXTS).removeprefix("WITH RECURSIVE ").rstrip()
            + f", pt AS MATERIALIZED (SELECT raw, location, norm, CASE WHEN gate THEN 'Normal' ELSE fin_label END AS pred, NOT gate AND fin_mal AS mal, round((CASE WHEN gate THEN kw_Normal ELSE fin_conf END)::DOUBLE,6) AS conf FROM (SELECT *, {FAST} AS gate FROM dc)), "
            "pv AS (SELECT v.*, pt.norm, pred, mal, conf FROM vp0 v JOIN pt ON pt.raw=v.raw AND pt.location=v.location), "
            "rv AS MATERIALIZED (SELECT req_id, pred, conf, mal, location, field, raw, norm FROM (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY mal DESC, conf DESC, "
            "CASE location WHEN 'query' THEN 0 WHEN 'header' THEN 1 WHEN 'cookie' THEN 2 WHEN 'multipart' THEN 3 WHEN 'body' THEN 3 WHEN 'json' THEN 4 ELSE 5 END, ord) AS rn FROM (SELECT *, 0 AS ord FROM pv)) WHERE rn=1), "
            "rq AS (SELECT v.*, r.ts, r.src, r.label, r.kind FROM rv v JOIN requests r USING (req_id))")


def verdicts(body):
    return f"WITH RECURSIVE {VERDICTS} {body}"


SQL = {
    **{k: vec(p) for k, p in [("sco_semantic_boost", "sb"), ("sco_protocol_bias", "pro"), ("sco_vision_bias", "vis"), ("sco_multimodal", "mm"), ("fus_late_fusion", "lf"), ("fus_obf_boost", "ob")]},
    **{k: dec(p) for k, p in [("fus_base_predict", "base"), ("fus_threshold", "th"), ("fus_fallback", "fb"), ("fus_fp_guard", "gd"), ("fus_benign_override", "ov"), ("lab_semantic_tiebreak", "fin")]},
    "lab_arbitrate": decided("SELECT row_id, ar_label AS verdict, round(ar_conf::DOUBLE,5) AS conf FROM dc", "ar_label", "ar_conf"),
    "fus_calibrated_weights": decided("SELECT obf, count(*) AS n, " + ", ".join(f"round(max({c}),6) AS {c}" for c in ["cw_base", "cw_sem", "cw_mm", "cw_dl"]) + " FROM dc GROUP BY 1", "obf", "cw_base", "cw_sem", "cw_mm", "cw_dl"),
    "fus_gate": decided("SELECT row_id, " + ", ".join(f"round({c},6) AS {c}" for c in ["w_base", "w_sem", "w_mm", "w_dl"]) + " FROM dc", "w_base", "w_sem", "w_mm", "w_dl"),
    "sco_semantic_kw": light(score_ctes("np0", "sc", *[f"sem_{k}" for k in R.LABELS]),
                             "SELECT row_id, " + ", ".join(f"round(sem_{k}::DOUBLE,5) AS sem_{k}" for k in R.LABELS) + ", len(h)::BIGINT AS hits, round(len(h)/greatest(len(tk),1),6) AS density FROM (SELECT *, list_filter(tk, lambda t: t IN ("
                             + ",".join(q(m) for m in R.MARKERS["SUSPICIOUS"]) + ")) AS h FROM (SELECT *, regexp_extract_all(low,'[a-z]{3,}') AS tk FROM sc))"),
    "sco_semantic_views": light(views_ctes("np1", "vw"), "SELECT row_id, " + ", ".join(f"round(vs_{k}::DOUBLE,5) AS vs_{k}" for k in R.ATTACKS) + ", view_label, round(view_conf::DOUBLE,5) AS view_conf FROM vw"),
    "nrm_semantic_views": light(views_ctes("np1", "vw"), "SELECT row_id, " + ", ".join(f"{vis('v_' + v)} AS v_{v}" for v in VIEW_NAMES) + " FROM vw"),
    "prd_parser_discrepancy": light(views_ctes("np1", "vw"), "SELECT row_id, discrepant AS flag FROM vw"),
    "win_pseudo_series": light(series_ctes("np1", "se"), "SELECT row_id, " + ", ".join(f"round({c},5) AS {c}" for c in ("resid", "slope", "third", "anom")) + " FROM se"),
    "flagship": verdicts("SELECT label, count(*) AS n_requests, count(*) FILTER (mal) AS flagged, count(*) FILTER (pred=label) AS exact, round(count(*) FILTER (mal)/count(*),4) AS flag_rate, round(avg(conf),4) AS avg_conf FROM rq GROUP BY 1"),
    "fus_request_report": verdicts("SELECT req_id, method, n_parts, pred, CASE WHEN pred='Normal' THEN 'low' WHEN conf>=0.85 THEN 'high' WHEN conf>=0.6 THEN 'medium' ELSE 'low' END AS risk FROM rq JOIN (SELECT req_id, method FROM requests) USING (req_id) JOIN (SELECT req_id, count(*) AS n_parts FROM parts GROUP BY 1) USING (req_id)"),
    "fus_request_reduce": verdicts("SELECT req_id, pred, conf, mal, location FROM rq"),
    "job_decide_summary": verdicts("SELECT pred, date_trunc('day',ts) AS day, count(*) AS n, count(*) FILTER (mal) AS flagged FROM rq GROUP BY 1,2"),
}
