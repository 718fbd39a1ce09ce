"""DuckDB text for the evaluate job."""

from oracles.base import PAYLOADS, q, with_payloads
from oracles.decide import infer
from oracles.featurise import entropy
from oracles.normalise import normal_ctes
from oracles.scoring import NSRC, scored_payloads
from paysieve.functions import rules as R

PREDS = (f"{PAYLOADS}, {normal_ctes('(SELECT payload AS txt FROM payload_rows)')}, {NSRC}, pr0 AS (SELECT *, {infer('norm')} AS pred, {infer('payload')} AS pred0, "
         "len(regexp_extract_all(norm,'[^\\p{L}\\p{N}]'))/greatest(length(norm),1) AS special FROM np0), "
         "pr AS MATERIALIZED (SELECT *, round(CASE WHEN pred='Normal' THEN 1-0.5*special ELSE least(0.99,0.55+0.08*depth+0.4*special) END,4) AS conf, label<>'Normal' AS atk, pred<>'Normal' AS hit, kind<>'plain' AS obf FROM pr0)")
TIER = "CASE WHEN ('0x'||substr(md5(src),1,8))::BIGINT%100<10 THEN 'canary' WHEN ('0x'||substr(md5(src),1,8))::BIGINT%100<15 THEN 'shadow' ELSE 'stable' END"
FEEDBACK = PREDS + f", fb AS MATERIALIZED (SELECT row_id AS seq, ts, src, {TIER} AS tier, pred AS predicted, label AS true_label, CASE WHEN pred=label THEN 1.0 WHEN pred<>'Normal' AND label<>'Normal' THEN -0.5 ELSE -1.0 END::DOUBLE AS reward, payload FROM pr)"


def P(body, extra=""):
    return f"WITH RECURSIVE {PREDS}{', ' + extra if extra else ''} {body}"


def FB(body, extra=""):
    return f"WITH RECURSIVE {FEEDBACK}{', ' + extra if extra else ''} {body}"


def ratio(n, d, digits=4):
    return f"round(CASE WHEN {d}>0 THEN {n}/{d} ELSE 0 END::DOUBLE,{digits})"


def binary(truth, pred, where="true"):
    c = {n: f"count(*) FILTER ({where} AND {t} AND {p})" for n, t, p in [("tp", truth, pred), ("fp", f"NOT ({truth})", pred), ("fn", truth, f"NOT ({pred})"), ("tn", f"NOT ({truth})", f"NOT ({pred})")]}
    r, p = f"(CASE WHEN {c['tp']}+{c['fn']}>0 THEN {c['tp']}/({c['tp']}+{c['fn']}) ELSE 0 END)", f"(CASE WHEN {c['tp']}+{c['fp']}>0 THEN {c['tp']}/({c['tp']}+{c['fp']}) ELSE 0 END)"
    return {**c, "recall": f"round({r},4)", "precision": f"round({p},4)", "f1": f"round(CASE WHEN {r}+{p}>0 THEN 2*{r}*{p}/({r}+{p}) ELSE 0 END,4)", "fpr": ratio(c["fp"], f"({c['fp']}+{c['tn']})")}


FAMILY = ("CASE WHEN regexp_matches(kind,'url|unicode|hex|base64|entity|encoding|charcode') THEN 'encoding' WHEN regexp_matches(kind,'json|multipart|boundary|xinclude|proxy') THEN 'parser' "
          "WHEN regexp_matches(kind,'comment|concat|split|whitespace|paren|operator|tautology') THEN 'structure' WHEN regexp_matches(kind,'ifs|brace|wildcard|cmd') THEN 'command' "
          "WHEN regexp_matches(kind,'svg|img|data_uri|ontoggle|xss') THEN 'xss' ELSE 'semantic' END")
PATTERN = """CASE WHEN kind='double_url' OR contains(lower(payload),'%252') THEN CASE WHEN label='CMD' THEN 'double_url_encode_cmd' ELSE 'double_url_encode_sqli' END
 WHEN kind='null_byte' OR contains(lower(payload),'%00') THEN 'null_byte_in_params' WHEN kind='unicode' OR regexp_matches(payload,'\\\\u[0-9a-fA-F]{4}') THEN 'unicode_escape_sqli'
 WHEN kind='multipart' OR contains(lower(payload),'webkitformboundary') THEN CASE WHEN label='CMD' THEN 'multipart_boundary_cmd' ELSE 'multipart_boundary_sqli' END
 WHEN kind='url' AND regexp_matches(lower(payload),'echo|str=|str%3d') THEN 'url_encode_cmd' WHEN kind='base64' THEN 'base64_fragment_sqli' WHEN kind='case' THEN 'case_random_cmd'
 WHEN kind='fullwidth' THEN 'unicode_normalization' ELSE 'other:'||kind END"""
FPCAT = """CASE WHEN regexp_matches(lower(payload),'modo=|login=|password=|usuario=|clave=') THEN 'login_form_other' WHEN regexp_matches(lower(payload),'%2[0-9a-f]{2}') THEN 'url_encoded'
 WHEN regexp_matches(lower(payload),'<script|onerror|alert\\(') THEN 'xss_like' WHEN regexp_matches(lower(payload),'union|select|insert|or\\s+1') THEN 'sqli_like'
 WHEN regexp_matches(lower(payload),'\\.\\./|etc/passwd') THEN 'path_like' WHEN regexp_matches(lower(payload),'webkitformboundary|multipart') THEN 'multipart_like' WHEN length(payload)>500 THEN 'long_payload' ELSE 'other_'||pred END"""
MISS = "ms AS MATERIALIZED (SELECT *, split_part(source,':',1) AS prefix, " + PATTERN + " AS pattern FROM pr WHERE atk AND NOT hit)"


def crs_ctes():
    from paysieve.plans.evaluate import CRS
    arr = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(d,{q(p)}) OR regexp_matches(payload,{q(p)}) THEN '{i}' END" for i, p in CRS) + "], lambda h: h IS NOT NULL)"
    return f"cr0 AS (SELECT *, {arr} AS hits FROM (SELECT *, url_decode(payload) AS d FROM payload_rows)), cr AS MATERIALIZED (SELECT *, CASE WHEN len(hits)=0 THEN 'Normal' WHEN len(list_filter(hits, lambda h: starts_with(h,'942')))>0 THEN 'SQLi' WHEN len(list_filter(hits, lambda h: starts_with(h,'941')))>0 THEN 'XSS' WHEN len(list_filter(hits, lambda h: starts_with(h,'932')))>0 THEN 'CMD' ELSE 'SQLi' END AS crs FROM cr0)"


ROUNDS = "rd AS (SELECT date_trunc('day',ts) AS round, count(*) AS total, count(*) FILTER (event_type='error') AS missed, round((count(*)-count(*) FILTER (event_type='error'))/count(*),4) AS recall FROM events GROUP BY 1)"
DRIFT = "SELECT count(*) AS n, round(avg(recall),4) AS mean, round(stddev_pop(recall),4) AS std, min(recall) AS low, max(recall) AS high, round(max(recall)-min(recall),4) AS spread, arg_min(recall,round) AS first, arg_max(recall,round) AS last, round(arg_max(recall,round)-arg_min(recall,round),4) AS delta FROM rd"
CONFIGS = "cf AS (SELECT *, p<>'Normal' AS phit FROM (SELECT label, kind, atk, obf, 'full' AS config, pred AS p FROM pr UNION ALL SELECT label, kind, atk, obf, 'no_decode', pred0 FROM pr UNION ALL SELECT label, kind, atk, obf, 'depth1', CASE WHEN depth<=1 THEN pred ELSE pred0 END FROM pr))"
CM = f"cm AS (SELECT config, {ratio('count(*) FILTER (atk AND obf AND phit)', 'count(*) FILTER (atk AND obf)')} AS recall, {ratio('count(*) FILTER (NOT atk AND phit)', 'count(*) FILTER (NOT atk)')} AS fpr FROM cf GROUP BY 1)"
BATCHES = "bt AS (SELECT doc_id AS seq, text AS payload, 'documents' AS source FROM documents UNION ALL SELECT conv_id*1000+turn+1000000000, text, 'conversations' FROM conversations UNION ALL SELECT item_id+2000000000000, text, 'benchmark' FROM benchmark)"
MRAW = f"mr AS (SELECT * FROM payload_rows WHERE label<>'Normal' AND ({infer('payload')})='Normal')"
SUB = {"all": "true", "obfuscated": "(atk AND obf)", "normal": "(NOT atk)"}

SQL = {
    "agg_binary_metrics": "SELECT " + ", ".join(f"{e} AS {n}" for n, e in binary("truth", "pred").items())
        + f" FROM (SELECT quality=1 AS truth, round({entropy('text')},6)<4.3 AND len(regexp_extract_all(text,'[^\\p{{L}}\\p{{N}}]'))/greatest(length(text),1)<0.25 AS pred FROM documents JOIN labels USING (doc_id))",
    "agg_multiclass": P(f"SELECT count(*) AS n, round(avg((pred=label)::INT),4) AS accuracy, {ratio('count(*) FILTER (atk AND pred=label)', 'count(*) FILTER (atk)')} AS exact_recall FROM pr"),
    "agg_subset_metrics": P("SELECT " + ", ".join(f"{e} AS {s}_{n}" for s, w in SUB.items() for n, e in binary("atk", "hit", w).items() if n in ("tp", "fp", "fn", "tn", "recall", "fpr")) + " FROM pr"),
    "agg_recall_buckets": P(f"SELECT coalesce(kind,'*') AS kind, coalesce(label,'*') AS label, coalesce(family,'*') AS family, count(*) AS total, count(*) FILTER (hit) AS detected, count(*) FILTER (pred=label) AS exact, round(count(*) FILTER (hit)/count(*),4) AS recall, round(count(*) FILTER (pred=label)/count(*),4) AS exact_recall FROM (SELECT *, {FAMILY} AS family FROM pr WHERE atk) GROUP BY GROUPING SETS ((kind),(label),(family))"),
    "agg_miss_counts": P("SELECT dim, val, n, round(n*100.0/sum(n) OVER (PARTITION BY dim),2)::DOUBLE AS pct FROM (" + " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS val, count(*) AS n FROM ms GROUP BY 2" for d in ("label", "source", "prefix", "pattern")) + ")", MISS),
    "lab_miss_pattern": with_payloads(f"SELECT row_id, {PATTERN} AS pattern FROM payload_rows"),
    "top_miss_patterns": P("SELECT pattern, count(*) AS n, round(count(*)/sum(count(*)) OVER ()*100,2) AS pct FROM ms GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10", MISS),
    "agg_crosstab": "SELECT lang, " + ", ".join(f"count(*) FILTER (regexp_extract(source,'^(src[0-9])',1)='src{i}') AS src{i}" for i in range(10)) + " FROM documents GROUP BY 1",
    "agg_score_histogram": P("SELECT floor(round(conf*10000)/100)::BIGINT AS bin, count(*) AS n FROM pr GROUP BY 1 ORDER BY n DESC, bin LIMIT 10"),
    "agg_fallback_coverage": P("SELECT scope, sum(n)::BIGINT AS n, sum(hits)::BIGINT AS hits, round(sum(hits)/sum(n),4) AS share FROM (SELECT 'all' AS scope, * FROM per UNION ALL SELECT 'top5', * FROM (SELECT * FROM per ORDER BY n DESC, pattern LIMIT 5)) GROUP BY 1",
                               MISS + ", per AS (SELECT pattern, count(*) AS n, count(*) FILTER (regexp_matches(payload,'%|\\\\u|&#|0x')) AS hits FROM ms GROUP BY 1)"),
    "lab_fp_category": P(f"SELECT row_id, {FPCAT} AS category FROM pr"),
    "agg_fp_report": P(f"SELECT category, pred, count(*) AS n, count(*) FILTER (hit OR conf<0.9) AS flagged, round(count(*) FILTER (hit OR conf<0.9)/count(*),4) AS fpr FROM (SELECT *, {FPCAT} AS category FROM pr WHERE NOT atk) GROUP BY 1,2"),
    "lab_crs_rules": with_payloads("SELECT row_id, array_to_string(hits,',') AS hits, crs FROM cr", crs_ctes()),
    "agg_top_rules": with_payloads("SELECT rule, count(*) AS n FROM (SELECT unnest(hits) AS rule FROM cr) GROUP BY 1 ORDER BY n DESC, rule LIMIT 15", crs_ctes()),
    "agg_baseline_compare": P(f"SELECT detector, {ratio('count(*) FILTER (atk AND h)', 'count(*) FILTER (atk)')} AS recall, {ratio('count(*) FILTER (NOT atk AND h)', 'count(*) FILTER (NOT atk)')} AS fpr FROM (SELECT 'engine' AS detector, atk, hit AS h FROM pr UNION ALL SELECT 'baseline', label<>'Normal', len(hits)>0 FROM cr) GROUP BY 1", crs_ctes()),
    "agg_drift": f"WITH {ROUNDS} {DRIFT}",
    "agg_converged": f"WITH {ROUNDS} SELECT n, mean>=0.7 AND last>=0.7 AND std<=0.1 AND spread<=0.3 AS converged FROM ({DRIFT})",
    "agg_round_recall": "SELECT round, sum(n)::BIGINT AS total, sum(CASE WHEN event_type='error' THEN n ELSE 0 END)::BIGINT AS missed, string_agg(event_type||'='||n,',' ORDER BY event_type||'='||n) AS by_type FROM (SELECT date_trunc('day',ts) AS round, event_type, count(*) AS n FROM events GROUP BY 1,2) GROUP BY 1",
    "agg_block_label_recall": P(f"SELECT coalesce(r,-1)::BIGINT AS round, count(*) AS n, {ratio('count(*) FILTER (hit)', 'count(*)')} AS block_recall, {ratio('count(*) FILTER (pred=label)', 'count(*)')} AS label_recall FROM (SELECT *, row_id%3 AS r FROM pr WHERE atk) GROUP BY ROLLUP (r)"),
    "agg_seed_median": "SELECT round(median(recall),4) AS median, round(avg(recall),4) AS mean, round(min(recall),4) AS low, round(max(recall),4) AS high FROM (SELECT round(count(*) FILTER (event_type<>'error')/count(*),6) AS recall FROM events GROUP BY user_id%7)",
    "agg_recovery": P(f"SELECT kind, count(*) AS total, count(*) FILTER (hit) AS recovered, {ratio('count(*) FILTER (hit)', 'count(*)')} AS rate, count(*)=0 AS vacuous FROM pr WHERE atk AND pred0='Normal' GROUP BY 1"),
    "agg_ablation_delta": P("SELECT config, recall, fpr, round(recall-(SELECT recall FROM cm WHERE config='full'),4) AS d_recall, round(fpr-(SELECT fpr FROM cm WHERE config='full'),4) AS d_fpr FROM cm", CONFIGS + ", " + CM),
    "agg_mm_delta": P("SELECT label, round(a,4) AS on_rate, round(b,4) AS off_rate, round((a-b)*100,2) AS delta_pp FROM (SELECT label, avg(hit::INT) AS a, avg((pred0<>'Normal')::INT) AS b FROM pr GROUP BY 1)"),
    "agg_latency": """WITH o AS (SELECT value AS v, row_number() OVER (ORDER BY value)-1 AS i, count(*) OVER () AS n FROM events)
        SELECT max(n) AS n, round(avg(v),4) AS mean, round(quantile_cont(v,0.5),4) AS p50, round(quantile_cont(v,0.95),4) AS p95, max(v) AS top, max(v) FILTER (i=least(floor(n*0.99),n-1)) AS p99, max(v) FILTER (i=floor(floor(n*0.99)*0.99)) AS p99_trimmed FROM o""",
    "agg_attack_distribution": P("SELECT pred, count(*) AS n FROM (SELECT * FROM pr WHERE hit ORDER BY ts DESC, row_id DESC LIMIT 50) GROUP BY 1"),
    "snk_alerts": P("SELECT row_id, ts, pred, conf FROM pr WHERE hit ORDER BY ts DESC, row_id DESC LIMIT 20"),
    "agg_reward_summary": FB("SELECT tier, count(*) AS n, round(avg(reward),4) AS mean, count(*) FILTER (reward>0) AS positive, count(*) FILTER (reward<0) AS negative FROM fb GROUP BY 1"),
    "agg_calibration": P(f"SELECT r AS recall, f AS fpr, CASE WHEN r<0.98 THEN 0.03 ELSE 0 END::DOUBLE AS d_semantic, CASE WHEN r<0.98 THEN -0.02 ELSE 0 END::DOUBLE AS d_base, CASE WHEN f>0.02 THEN 0.02 ELSE 0 END::DOUBLE AS d_multimodal, CASE WHEN f>0.02 THEN -0.01 ELSE 0 END::DOUBLE AS d_series FROM (SELECT {ratio('count(*) FILTER (atk AND obf AND hit)', 'count(*) FILTER (atk AND obf)')} AS r, {ratio('count(*) FILTER (NOT atk AND hit)', 'count(*) FILTER (NOT atk)')} AS f FROM pr)"),
    "agg_gate": P("SELECT coalesce(config,'*') AS config, min(recall) AS recall, max(fpr) AS fpr, bool_and(recall>=0.995 AND fpr<=0.013) AS ok FROM cm GROUP BY ROLLUP (config)", CONFIGS + ", " + CM),
    "jn_label_eval": "SELECT lang, quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM labels JOIN documents USING (doc_id) GROUP BY 1,2,3",
    "jn_unseen_kinds": with_payloads("SELECT kind, count(*) AS n FROM payload_rows WHERE row_id%64>=45 AND kind NOT IN (SELECT kind FROM payload_rows WHERE row_id%64<45) GROUP BY 1"),
    "top_weakest": P("SELECT kind, label, count(*) AS n, round(avg((pred0<>'Normal')::INT),4) AS recall FROM pr WHERE atk GROUP BY 1,2 ORDER BY recall, kind, label LIMIT 8"),
    "agg_canonical_sync": P(f"SELECT a.*, mean AS round_mean, std AS round_std FROM (SELECT count(*) AS n, {ratio('count(*) FILTER (atk AND hit)', 'count(*) FILTER (atk)')} AS recall FROM pr) a CROSS JOIN ({DRIFT})", ROUNDS),
    "top_hardest_first": P("SELECT row_id, label, conf FROM pr WHERE atk ORDER BY conf, row_id"),
    "top_cap_rows": with_payloads("SELECT row_id, payload, label FROM payload_rows WHERE label<>'Normal' ORDER BY row_id LIMIT 80"),
    "top_samples": with_payloads("SELECT label, row_id, payload FROM payload_rows QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id)<=3"),
    "top_argmax_label": scored_payloads("SELECT row_id, CASE " + " ".join(f"WHEN round(kw_{k},9)>=round(greatest({','.join('kw_' + j for j in R.LABELS)}),9) THEN '{k}'" for k in R.LABELS) + " END AS argmax FROM sc", *[f"kw_{k}" for k in R.LABELS]),
    "set_union_batches": f"WITH {BATCHES} SELECT source, count(*) AS n, sum(length(payload))::BIGINT AS chars FROM bt GROUP BY 1",
    "set_dedupe": f"WITH {BATCHES} SELECT seq, source, length(payload) AS n_chars FROM bt QUALIFY row_number() OVER (PARTITION BY payload ORDER BY seq)=1",
    "set_variant_distinct": with_payloads("SELECT upper(payload) AS variant, min(row_id) AS row_id FROM payload_rows WHERE upper(payload)<>payload AND upper(payload) NOT IN (SELECT payload FROM payload_rows) GROUP BY 1"),
    "set_pool_mix": with_payloads("SELECT payload, min(prio)::BIGINT AS prio, min(row_id) AS row_id FROM (SELECT payload, 0 AS prio, row_id FROM mr UNION ALL SELECT payload, 1, row_id FROM payload_rows WHERE label<>'Normal') GROUP BY 1", MRAW),
    "set_carry_over": with_payloads("SELECT row_id, 'miss' AS origin FROM mr UNION ALL SELECT row_id, 'carry' FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn, count(*) OVER () AS n FROM payload_rows WHERE label<>'Normal' AND kind='plain') WHERE rn<=greatest(3,floor(n/2))", MRAW),
}
