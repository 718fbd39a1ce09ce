"""DuckDB text for sources and sinks."""

from oracles.base import q, with_payloads, with_requests
from oracles.decide import infer
from oracles.evaluate import FB, P

WS = "' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"
RAW = "method||' '||url||' HTTP/1.1'||chr(10)||'Host: eval.local'||chr(10)||'X-Forwarded-For: '||src||chr(10)||'Cookie: '||cookie||chr(10)||chr(10)||body"
AFTERQ = "CASE WHEN contains(x,'=') THEN substr(x,instr(x,'=')+1) ELSE x END"
CANDS = ("list_concat(CASE WHEN pl='' THEN [] WHEN contains(pl,'=') THEN list_transform(string_split(pl,'&'), lambda x: " + AFTERQ + ") ELSE [pl] END, "
         "CASE WHEN contains(url,'?') THEN [substr(url,instr(url,'?')+1),url] ELSE [url] END, [src])")
BODY = f"trim(body,{WS})"
BPAY = ("list_filter(list_transform(list_concat(list_concat(CASE WHEN contains(url,'?') THEN [url_decode(substr(url,instr(url,'?')+1)),url_decode(substr(url,instr(url,'?')+1))] ELSE [] END, "
        "list_transform(list_filter(list_transform(string_split(cookie,';'), lambda s: trim(s)), lambda s: contains(s,'=')), lambda s: substr(s,instr(s,'=')+1))), "
        f"CASE WHEN {BODY}<>'' AND lower({BODY})<>'null' AND NOT starts_with({BODY},'HTTP/') THEN CASE WHEN contains({BODY},'=') THEN list_transform(string_split({BODY},'&'), lambda x: CASE WHEN contains(x,'=') THEN url_decode(substr(x,instr(x,'=')+1)) ELSE x END) ELSE [{BODY}] END ELSE [] END), "
        f"lambda p: trim(p,{WS})), lambda p: length(p)>=2)")
BPAY_GSI = BPAY
LINES = f"ln AS (SELECT doc_id, unnest(range(0,len(l))) AS pos, trim(unnest(l),{WS}) AS line FROM (SELECT doc_id, string_split(text,chr(10)) AS l FROM documents))"


def mined(t):
    allx = (f"list_concat(list_concat(flatten(list_transform(regexp_extract_all({t},'(?s)```\\w*\\n(.*?)```',1), lambda b: string_split(b,chr(10)))), regexp_extract_all({t},'`([^`\\n]{{4,512}})`',1)), "
            f"list_concat(regexp_extract_all({t},'(?i)<code[^>]*>([^<]{{4,512}})</code>',1), list_filter(list_transform(string_split({t},chr(10)), lambda x: trim(x,{WS})), lambda x: NOT regexp_matches(lower(x),'^//|^note:'))))")
    return (f"list_distinct(list_filter(list_transform({allx}, lambda s: trim(trim(s,{WS}),'''\"')), lambda s: length(s) BETWEEN 3 AND 4096 AND NOT regexp_matches(lower(s),'^\\s*#|^(?:note:|example:|//|http://|https://)')))")


HREF = q("(?i)<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([^<]{4,200})</a>")

SQL = {
    "src_labeled_csv": with_payloads("SELECT label, count(*) AS n, sum(length(payload))::BIGINT AS chars FROM payload_rows GROUP BY 1"),
    "snk_csv": with_payloads("SELECT source, count(*) AS n FROM payload_rows GROUP BY 1"),
    "src_request_csv": with_requests("SELECT CASE WHEN req_id%10=0 THEN 'GET' ELSE method END AS method, 'csv' AS source, count(*) AS n, count(*) FILTER (body<>'') AS with_body, sum(length(url))::BIGINT AS url_chars FROM requests GROUP BY 1"),
    "src_http1_log": with_requests(f"SELECT req_id, method, url, 3::BIGINT AS n_headers, src AS xff, trim(body,{WS}) AS body FROM requests"),
    "src_http2_json_log": with_requests(f"SELECT req_id, method, url, CASE WHEN req_id%3=2 THEN trim(body,{WS}) ELSE body END AS body, 'HTTP/2' AS protocol FROM requests"),
    "src_protocol_tag": with_requests(f"SELECT req_id, CASE WHEN req_id%3=1 THEN 'WS' ELSE method END AS method, CASE WHEN req_id%3=1 THEN '/websocket' ELSE url END AS url, CASE req_id%3 WHEN 0 THEN 'HTTP/3' WHEN 1 THEN 'WebSocket' ELSE 'HTTP/1.1' END AS protocol, CASE req_id%3 WHEN 0 THEN 'quic' WHEN 1 THEN 'websocket' ELSE 'api' END AS source, CASE WHEN req_id%3=1 THEN length({RAW}) ELSE length(trim(body,{WS})) END AS body_chars FROM requests"),
    "src_csic_csv": with_requests(f"SELECT req_id, fragment, {infer('fragment', 'rl')} AS label FROM (SELECT req_id, rl, l[list_position(list_transform(l, lambda x: length(x)), list_max(list_transform(l, lambda x: length(x))))] AS fragment FROM (SELECT *, {CANDS} AS l FROM (SELECT *, trim(payload,{WS}) AS pl, CASE WHEN label='Normal' THEN 'norm' ELSE 'anom' END AS rl FROM requests))) WHERE length(fragment)>=2"),
    "src_gsi_blocks": with_requests(f"SELECT req_id, payload, {infer('payload', 'rl')} AS label FROM (SELECT req_id, CASE WHEN label='Normal' THEN 'norm' ELSE 'anom' END AS rl, unnest({BPAY_GSI}) AS payload FROM requests)"),
    "src_blankline_blocks": with_requests(f"SELECT label, count(*) AS n FROM (SELECT {infer('payload', 'rl')} AS label FROM (SELECT 'anom' AS rl, unnest({BPAY}) AS payload FROM requests)) GROUP BY 1"),
    "src_block_payloads": with_requests(f"SELECT req_id, unnest(range(0,len(l))) AS pos, unnest(l) AS payload FROM (SELECT req_id, {BPAY} AS l FROM requests)"),
    "src_payload_lines": f"WITH {LINES} SELECT doc_id, pos, line, 'XSS' AS label FROM ln WHERE line<>'' AND NOT regexp_matches(line,'^\\s*#|^//|^(?i:note:)') AND length(line) BETWEEN 3 AND 4096",
    "src_seed_payloads": with_payloads(f"SELECT row_id, CASE WHEN a='Normal' THEN 'SQLi' ELSE a END AS label FROM (SELECT row_id, {infer('line')} AS a FROM (SELECT row_id, trim(payload,{WS}) AS line FROM payload_rows) WHERE length(line) BETWEEN 3 AND 4096)"),
    "src_codeblock_mining": "WITH t AS (SELECT doc_id, '```sql'||chr(10)||substr(text,1,120)||chr(10)||'```'||chr(10)||regexp_replace(text,'([A-Z][a-z]{4,})','`\\1`','g')||chr(10)||'<code>'||split_part(text,'.',1)||'</code>' AS t FROM documents) SELECT doc_id, count(*) AS n, sum(length(payload))::BIGINT AS chars, min(payload) AS lo, max(payload) AS hi FROM (SELECT doc_id, unnest(" + mined("t") + ") AS payload FROM t) GROUP BY 1",
    "src_link_extract": f"""WITH l AS (SELECT page_id, base, unnest(range(0,len(h))) AS pos, trim(unnest(h)) AS href, trim(unnest(t)) AS title FROM (SELECT page_id, regexp_extract(url,'^(https?://[^/]+)',1) AS base, regexp_extract_all(html,{HREF},1) AS h, regexp_extract_all(html,{HREF},2) AS t FROM pages)),
      a AS (SELECT *, CASE WHEN regexp_matches(href,'^https?://') THEN href WHEN starts_with(href,'/') THEN base||href ELSE base||'/'||href END AS link FROM l),
      f AS (SELECT * FROM a WHERE length(title)>=6 AND (regexp_matches(lower(title),'an|th|en|ci') OR contains(lower(link),'waf')) QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos)=1)
      SELECT base, link, title, page_id FROM f QUALIFY row_number() OVER (PARTITION BY base ORDER BY page_id, pos)<=5""",
    "src_article_payloads": f"SELECT page_id, label, count(*) AS n, sum(length(p))::BIGINT AS chars FROM (SELECT page_id, p, {infer('p')} AS label FROM (SELECT page_id, unnest({mined('h')}) AS p FROM (SELECT page_id, replace(html,'><','>'||chr(10)||'<') AS h FROM pages))) WHERE label<>'Normal' GROUP BY 1,2",
    "src_jsonl": P("SELECT row_id AS seq, payload, label, pred, source FROM pr WHERE atk AND NOT hit ORDER BY row_id DESC LIMIT 200"),
    "snk_miss_fp_jsonl": P("SELECT sink, label, count(*) AS n, sum(row_id)::BIGINT AS ids FROM (SELECT 'miss' AS sink, * FROM pr WHERE atk AND obf AND NOT hit UNION ALL SELECT 'fp', * FROM pr WHERE NOT atk AND (hit OR conf<0.9)) GROUP BY 1,2"),
    "snk_failure_log": FB("SELECT true_label, predicted, count(*) AS n FROM fb WHERE predicted<>true_label GROUP BY 1,2"),
    "snk_metrics_json": P("SELECT label, count(*) AS n, round(avg(hit::INT),4) AS flag_rate FROM pr GROUP BY 1"),
    "snk_waf_rules": P("""SELECT 'SecRule ARGS "@rx '||pat||'" "id:10001,phase:2,deny,msg:'''||pred||' detected''"' AS modsecurity, 'alert http any any -> any any (msg:"'||pred||'"; content:"'||span||'"; sid:90001;)' AS suricata, count(*) AS n FROM
      (SELECT *, CASE WHEN span<>'' THEN replace(regexp_replace(trim(span),'([^A-Za-z0-9_ ])','\\\\\\1','g'),' ','\\s+') ELSE CASE pred WHEN 'SQLi' THEN 'union\\s+select' WHEN 'XSS' THEN '<script' WHEN 'CMD' THEN '[;&|]' WHEN 'PathTraversal' THEN '\\.\\./' WHEN 'FileInclusion' THEN 'php://' ELSE '' END END AS pat FROM
        (SELECT *, regexp_extract(norm,'(?i)(union\\s+select|<script|\\.\\./|php://|<!entity|jndi:|ignore\\s+previous)',1) AS span FROM pr WHERE hit)) GROUP BY 1,2"""),
    "job_ingest_summary": with_requests("SELECT CASE WHEN req_id%20=0 THEN 'bad_rows' ELSE 'requests' END AS target, CASE WHEN req_id%20=0 OR label='Normal' THEN 'norm' ELSE 'anom' END AS raw_label, count(*) AS n FROM requests GROUP BY 1,2"),
}
