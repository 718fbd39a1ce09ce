"""DuckDB text for the featurise job."""

from oracles.base import PAYLOADS, q, with_payloads, with_requests
from oracles.decompose import PARTS, dec
from oracles.normalise import normal_ctes
from oracles.scoring import duck_sql, dup, hient, score_ctes, scored_payloads
from paysieve.functions import features as X
from paysieve.functions import rules as R
from paysieve.plans.featurise import ATTACK_SHAPES

TEXTS = "tx AS (SELECT 'doc' AS origin, doc_id AS row_id, text AS t FROM documents UNION ALL SELECT 'payload', row_id, payload FROM payload_rows)"
PTEXTS = "tx AS (SELECT 'page' AS origin, page_id AS row_id, html AS t FROM pages UNION ALL SELECT 'payload', row_id, payload FROM payload_rows)"


def nrx(e, p):
    return f"len(regexp_extract_all({e},{q(p)}))"


def cc(e, c):
    return f"(length({e})-length(replace({e},{q(c)},'')))"


def entropy(t):
    return (f"(CASE WHEN length({t})=0 THEN 0.0 ELSE -list_sum(list_transform(list_distinct(split({t},'')), "
            f"lambda c: (length({t})-length(replace({t},c,'')))/length({t})*log2((length({t})-length(replace({t},c,'')))/length({t})))) END)")


def statistical(t):
    n = f"greatest(length({t}),1)"
    return {"length": n, "digit_ratio": f"{nrx(t, chr(92) + 'p{Nd}')}/{n}", "special_ratio": f"{nrx(t, '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]')}/{n}", "entropy": entropy(t),
            "paren_count": f"{cc(t, '(')}+{cc(t, ')')}", "encoded_ratio": f"{cc(t, '%')}/{n}", "upper_ratio": f"{nrx(t, chr(92) + 'p{Lu}')}/{n}"}


def semantic(t):
    out = {k: "(" + "+".join(f"contains(lower({t}),{q(w)})::INT" for w in ws) + ")" for k, ws in X.KEYWORDS.items()}
    out["tag_count"] = nrx(t, "<[^>]+>")
    return out


def nesting(t):
    return (f"(CASE WHEN {nrx(t, '[(' + chr(92) + '[{<)' + chr(92) + ']}>]')}=0 THEN 0 ELSE list_reduce(list_transform(regexp_extract_all({t},{q('[(' + chr(92) + '[{<)' + chr(92) + ']}>]')}), "
            "lambda c: {'d': CASE WHEN contains('([{<',c) THEN 1 ELSE -1 END, 'm': 0}), lambda a, x: {'d': greatest(0,a.d+x.d), 'm': greatest(a.m, a.d+x.d)}, {'d':0,'m':0}).m END)")


def structural(t):
    return {"ast_depth": nesting(t), "html_nodes": nrx(t, "<[a-zA-Z][^>]*>"), "js_calls": nrx(t, r"\w+\s*\("), "xml_entities": nrx(t, r"&\w+;"),
            "angle_bracket_ratio": f"{cc(t, '<')}/greatest(length({t}),1)"}


def sel(cols):
    return ", ".join(f"round(({e})::DOUBLE,6) AS {n}" for n, e in cols.items())


def on(texts, cols):
    return with_payloads(f"SELECT origin, row_id, {cols} FROM tx", texts)


def case_map(col, table, default):
    return "CASE " + " ".join(f"WHEN {col}='{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END::DOUBLE"


FEATS = {**statistical("norm"), "location_weight": "1.0", "decode_depth": "len(chain)", **semantic("norm"), **structural("norm")}
FROWS = ("WITH RECURSIVE " + PAYLOADS + ", " + normal_ctes("(SELECT payload AS txt FROM payload_rows)")
         + ", fr AS MATERIALIZED (SELECT p.row_id, p.label, " + ", ".join(f"({e})::DOUBLE AS {n}" for n, e in FEATS.items()) + " FROM payload_rows p JOIN nm ON txt=payload) ")

# The cells that a text reaches are the first ones, so the sums below need no row for a cell of zeros.
GRID = """gb AS MATERIALIZED (SELECT origin, row_id, i % 2048 AS c, sum(x) / count(*) / 255.0::DOUBLE AS v FROM (
    SELECT origin, row_id, unnest(range(len(l))) AS i, ('0x' || unnest(l))::INT::DOUBLE AS x FROM (SELECT origin, row_id, regexp_extract_all(hex(encode(t)), '..') AS l FROM tx)) GROUP BY 1, 2, 3),
gp AS (SELECT *, lag(v) OVER (PARTITION BY origin, row_id ORDER BY c) AS before FROM gb),
g0 AS (SELECT origin, row_id, count(*) AS n, sum(v) / 2048 AS mean, sum(v * v) / 2048 AS m2, count(*) FILTER (v > 0.6) / 2048 AS hi, (count(*) FILTER (v < 0.05) + 2048 - count(*)) / 2048 AS lo,
  count(*) FILTER (v > 0.8) / 2048 AS high, (sum(CASE WHEN c % 64 = 0 THEN 0.0 ELSE abs(v - before) END) + CASE WHEN count(*) < 2048 AND count(*) % 64 <> 0 THEN arg_max(v, c) ELSE 0.0 END) / 2048 AS edge FROM gp GROUP BY 1, 2),
gk AS (SELECT origin, row_id, map_from_entries(list((k, b))) AS m FROM (SELECT origin, row_id, c // 256 * 16 + c % 64 // 4 AS k, sum(v) / 16 AS b FROM gb GROUP BY 1, 2, 3) GROUP BY 1, 2),
g1 AS (SELECT tx.origin, tx.row_id, coalesce(edge, 0.0) AS edge, coalesce(high, 0.0) AS high,
  list_concat([coalesce(mean, 0.0), sqrt(greatest(coalesce(m2 - mean * mean, 0.0), 0)), coalesce(hi, 0.0)::DOUBLE, coalesce(lo, 1.0)::DOUBLE], list_transform(range(60), lambda k: coalesce(m[k], 0.0))) AS v
  FROM tx LEFT JOIN g0 ON g0.origin = tx.origin AND g0.row_id = tx.row_id LEFT JOIN gk ON gk.origin = tx.origin AND gk.row_id = tx.row_id),
gv AS MATERIALIZED (SELECT origin, row_id, edge, high, list_transform(v, lambda x: x/sqrt(list_sum(list_transform(v, lambda y: y*y)))) AS v FROM g1)"""

PROTO = {
    "proto_location": case_map("location", X.PROTOCOL_LOCATION, 0.6), "proto_decode_depth": "least(depth,6)/6.0", "proto_obfuscated": "obf::INT::DOUBLE",
    "proto_multipart": "contains(raw_low,'webkitformboundary')::INT::DOUBLE", "proto_repeat": f"{dup('raw_low')}::INT::DOUBLE",
    "proto_ampersand_density": f"least({cc('raw', '&')}/20.0,1.0)", "proto_pct_density": f"least({cc('raw', '%')}/30.0,1.0)", "proto_null_byte": "contains(raw_low,'%00')::INT::DOUBLE",
}
PSRC = (PARTS + ", pp0 AS MATERIALIZED (SELECT * FROM parts), " + normal_ctes("(SELECT raw AS txt FROM pp0)")
        + ", pn AS (SELECT p.*, norm, len(chain)::INT AS depth FROM pp0 p JOIN nm ON txt=raw), " + score_ctes("pn", "sc", "obf"))

MD5 = "md5(row_id::VARCHAR)"
HEXT = f"CASE WHEN row_id%2=0 THEN CASE row_id%3 WHEN 0 THEN upper({MD5}) WHEN 1 THEN upper(substr({MD5},1,16))||substr({MD5},17,16) ELSE {MD5} END ELSE payload END"
WORDS = " OR ".join(f"contains(low,{q(w)})" for w in R.MARKERS["SUSPICIOUS"])
MARKS = " OR ".join(f"contains(low,{q(w)})" for w in R.MARKERS["DEEP_MARK"])
QUERY = "regexp_extract(url,'^[^?#]*\\?([^#]*)',1)"
MARKERS9 = ["%00", "%252", "\\u00", "&#", "%2b", "/**/", "<script", "union", "select"]
LET = "regexp_replace(t,'[^\\p{L}]','','g')"

SQL = {
    "fea_entropy": on(TEXTS, f"round({entropy('t')},6) AS entropy"),
    "fea_statistical": on(TEXTS, sel(statistical("t"))),
    "fea_keyword_hits": on(PTEXTS, sel(semantic("t"))),
    "fea_nesting_depth": on(PTEXTS, f"({nesting('t')})::DOUBLE AS depth"),
    "fea_structural": on(PTEXTS, sel(structural("t"))),
    "fea_location_depth": with_requests(
        f"SELECT location, depth::BIGINT AS depth, count(*) AS n, round(sum({case_map('location', X.LOCATION_WEIGHT, 0.5)}),4) AS weight FROM (SELECT location, len(chain) AS depth FROM pp0 JOIN nm ON txt=raw) GROUP BY 1,2",
        PARTS + ", pp0 AS MATERIALIZED (SELECT * FROM parts), " + normal_ctes("(SELECT raw AS txt FROM pp0)"), recursive=True),
    "fea_vector": FROWS + "SELECT row_id, " + ", ".join(f"round({n},6) AS {n}" for n in FEATS) + " FROM fr",
    "fea_select_topk": FROWS + "SELECT feature, weight FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {i} AS pos, round(1.0/(1.0+{i}*0.01)+least(abs(avg({n}) FILTER (label<>'Normal')-avg({n}) FILTER (label='Normal')),1.0),6) AS weight FROM fr"
        for i, n in enumerate(FEATS)) + ") ORDER BY weight DESC, pos LIMIT 15",
    "fea_byte_grid": with_payloads(
        "SELECT origin, row_id, " + ", ".join(f"CASE WHEN isnan(v[{i + 1}]) THEN 0.0 ELSE round(v[{i + 1}],5) END AS v{i}" for i in (0, 1, 2, 3, 4, 20, 63)) + ", round(edge,5) AS edge, round(high,5) AS high FROM gv", TEXTS + ", " + GRID),
    "fea_protocol_vec": with_requests("SELECT req_id, location, field, " + ", ".join(f"round(({e})::DOUBLE,6) AS {n}" for n, e in PROTO.items()) + " FROM sc", PSRC, recursive=True),
    "fea_multimodal_vec": with_requests(
        "SELECT req_id, location, field, " + ", ".join(f"round(c[{i + 1}]/sqrt(list_sum(list_transform(c, lambda y: y*y))),5) AS m{i}" for i in (0, 1, 5, 8, 9, 12, 71)) + " FROM mmv",
        PSRC + ", s2 AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM sc), tx AS (SELECT 'p' AS origin, rid AS row_id, raw AS t FROM s2), " + GRID
        + ", mmv AS (SELECT s2.*, list_concat([" + ", ".join(f"({e})::DOUBLE" for e in PROTO.values()) + "], list_transform(gv.v, lambda x: CASE WHEN isnan(x) THEN 0 ELSE x END)) AS c FROM s2 JOIN gv ON gv.row_id=rid)", recursive=True),
    "fea_trigram_embed": """WITH tri AS (SELECT doc_id, substr(l,(i)::BIGINT,3) AS tok, 1.0 AS w FROM (SELECT doc_id, lower(text) AS l, unnest(range(1,length(text)-1)) AS i FROM documents)
        UNION ALL SELECT doc_id, tok, 0.5 FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text),'[^\\s]+')) AS tok FROM documents) WHERE length(tok)>=3),
      b AS (SELECT doc_id, (('0x'||substr(md5(tok),1,8))::BIGINT % 384) AS bucket, sum(w)::DOUBLE AS w FROM tri GROUP BY 1,2)
      SELECT doc_id, bucket, round(w,4) AS w FROM (SELECT doc_id, bucket, w/sqrt(sum(w*w) OVER (PARTITION BY doc_id)) AS w FROM b) WHERE w>0.05""",
    "fea_case_switch": on(TEXTS, f"round(CASE WHEN length({LET})>=8 THEN (len(regexp_extract_all(regexp_replace(regexp_replace({LET},'\\p{{Lu}}','1','g'),'[^1]','0','g'),'1+|0+'))-1)/greatest(length({LET})-1,1) ELSE 0 END::DOUBLE,6) AS rate"),
    "fea_marker_score": on(TEXTS, "(" + "+".join(f"contains(lower(t),{q(m)})::INT" for m in MARKERS9) + "+len(regexp_extract_all(t,'[＀-￯]')))::BIGINT AS score"),
    "fea_payload_hash": on(TEXTS, "substr(sha256(t),1,16) AS hash"),
    "prd_payload_segment": f"SELECT page_id, s, (length({dec('s')})>=3 AND regexp_matches({dec('s')},'(?i)(union|select|script|alert|onerror|\\.\\./|etc/passwd|<|>|%27|%22)')) AS flag FROM (SELECT page_id, unnest(string_split(regexp_extract(url||CASE WHEN page_id%4=0 THEN '/%3Cb%3E' ELSE '' END,'^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)',1),'/')) AS s FROM pages)",
    "prd_duplicate_params": f"SELECT page_id, {dup('u')} AS flag FROM (SELECT page_id, lower(url||CASE WHEN page_id%2=0 THEN '?id=1&ref=2&ID=3' ELSE '&a=1&a=2' END) AS u FROM pages)",
    "prd_hex32_tokens": with_payloads(
        f"SELECT row_id, w AS standalone, w AND regexp_matches(t,'[A-F]') AND regexp_matches(t,'[a-f]') AS mixed, w AND regexp_matches(t,'[A-F]') AND NOT regexp_matches(t,'[a-f]') AS upper, regexp_matches(t,{q(R.PATTERNS['HEX32_PARAM'])}) AS in_param FROM (SELECT *, regexp_matches(t,{q(R.PATTERNS['HEX32_WHOLE'])}) AS w FROM (SELECT row_id, {HEXT} AS t FROM payload_rows))"),
    "prd_hi_entropy_token": with_payloads(
        f"SELECT doc_id, tok, {hient('tok')} AS flag FROM (SELECT doc_id, unnest(regexp_extract_all(text,'[A-Za-z0-9]{{20,40}}')) AS tok FROM documents UNION ALL SELECT row_id, substr(replace(to_base64(encode(md5(payload))),'=',''),1,36) FROM payload_rows)"),
    "prd_semantic_gate": scored_payloads(
        f"SELECT label, CASE WHEN deep THEN 'deep' ELSE 'cheap' END AS branch, count(*) AS n, sum(row_id)::BIGINT AS ids FROM (SELECT *, length(norm)>=4 AND NOT (bctx AND {cc('low', '%')}<4 AND length(low)<=120) AND ({WORDS} OR {MARKS} OR regexp_matches(low,{q(R.PATTERNS['HEX32_TOKEN'])}) OR dup_raw_low OR length(low)>80) AS deep FROM sc) GROUP BY 1,2",
        "bctx", "dup_raw_low"),
    "prd_benign_fast_path": scored_payloads(
        f"SELECT row_id, NOT obf AND NOT strong AND NOT hexw AND depth<2 AND ((length(raw)<=16 AND NOT regexp_matches(raw,'[^\\x00-\\x7F]') AND {cc('raw', '%')}<2) OR (round(rp_peak,6)<0.22 AND length(raw)<120)) AS flag FROM sc",
        "obf", "strong", "hexw", "rp_peak"),
    "prd_attack_shape": with_requests(
        "SELECT req_id, (contains(enc,chr(0)) OR regexp_matches(enc,'[＀-￯]') OR regexp_matches(" + dec("enc") + ",'[＀-￯]') OR " + " OR ".join(f"contains(lower(enc),'{s}')" for s in ATTACK_SHAPES)
        + f") AS flag FROM (SELECT req_id, CASE WHEN body<>'' THEN body WHEN regexp_matches(q,'^p=[^&]*$') THEN substr(q,3) ELSE q END AS enc FROM (SELECT *, {QUERY} AS q FROM requests))"),
    "job_feature_summary": FROWS + "SELECT label, count(*) AS n, " + ", ".join(f"round(avg({n}),5) AS avg_{n}, round(max({n}),5) AS max_{n}" for n in ["entropy", "special_ratio", "encoded_ratio", "decode_depth"]) + " FROM fr GROUP BY 1",
}
