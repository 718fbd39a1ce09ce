"""DuckDB text for the decompose job."""

from oracles.base import with_payloads, with_requests

NL = "chr(13)||chr(10)"


def dec(e):
    return f"url_decode(replace({e},'+',' '))"


def pairs(e):
    """List of structs k, v in order."""
    return (f"list_transform(list_filter(string_split({e},'&'), lambda x: x<>''), lambda x: "
            f"{{'k': {dec('''string_split(x,'=')[1]''')}, 'v': CASE WHEN contains(x,'=') THEN {dec('''substr(x,instr(x,'=')+1)''')} ELSE '' END}})")


QUERY = "regexp_extract(url,'^[^?#]*\\?([^#]*)',1)"
STRIP = "' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12)"
ISJSON = f"starts_with(trim(body,{STRIP}),'{{')"
ISMULTI = "(contains(lower(ctype),'multipart') OR contains(body,'WebKitFormBoundary'))"
HEADERS = "[{'k':'Accept','v':'*/*'},{'k':'X-Forwarded-For','v':src},{'k':'Cookie','v':cookie},{'k':'Content-Type','v':ctype},{'k':'Referer','v':referer}]"

COOKIES = ("ck AS (SELECT req_id, trim(string_split(x,'=')[1]) AS key, trim(substr(x,instr(x,'=')+1)) AS val "
           "FROM (SELECT req_id, unnest(string_split(cookie,';')) AS x FROM requests) WHERE contains(x,'='))")


def unpaired(src, cols, lst, pos=True):
    return f"(SELECT {cols}, unnest(range(1,len(l)+1)) AS i, unnest(l).k AS k, unnest(l).v AS v FROM (SELECT *, {lst} AS l FROM {src}))"


LEAF = "CASE json_type(v) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN v::VARCHAR='true' THEN 'True' ELSE 'False' END WHEN 'VARCHAR' THEN json_extract_string(v,'$') ELSE v::VARCHAR END"
JSON_BODIES = """jb AS (
 SELECT event_id AS req_id, 'event' AS origin, '{"a": {"b": [1, {"c": "x'||event_id||'"}, true]}, "n": null, "p": '||props||'}' AS body FROM events
 UNION ALL SELECT req_id, 'request', body FROM requests WHERE """ + ISJSON + ")"


def top(src, cols):
    return (f"SELECT {cols}, k, {LEAF} AS v FROM (SELECT {cols}, k, json_extract(j, '$.\"'||k||'\"') AS v FROM "
            f"(SELECT {cols}, body::JSON AS j, unnest(json_keys(body::JSON)) AS k FROM {src}))")


def flat(src, cols):
    """Recursive walk; rows with depth counters, leaves are scalar rows."""
    return f"""walk AS (
 SELECT {cols}, '' AS path, try_cast(body AS JSON) AS v, 0 AS d FROM {src} WHERE try_cast(body AS JSON) IS NOT NULL
 UNION ALL
 SELECT {cols}, CASE WHEN isobj THEN CASE WHEN path='' THEN k ELSE path||'.'||k END ELSE path||'['||k||']' END,
   CASE WHEN isobj THEN json_extract(v,'$."'||k||'"') ELSE json_extract(v,'$['||k||']') END, d+1
 FROM (SELECT {cols}, path, v, d, json_type(v)='OBJECT' AS isobj,
   unnest(CASE WHEN json_type(v)='OBJECT' THEN json_keys(v) ELSE list_transform(range(json_array_length(v)::BIGINT), lambda z: z::VARCHAR) END) AS k
   FROM walk WHERE json_type(v) IN ('OBJECT','ARRAY') AND d<8)),
leaves AS (SELECT {cols}, CASE WHEN path='' THEN 'value' ELSE path END AS k, {LEAF} AS v FROM walk WHERE json_type(v) NOT IN ('OBJECT','ARRAY'))"""


MULTI = f"""mp AS (
 SELECT req_id, regexp_extract(c,'(?i)name="([^"]+)"',1) AS k,
  CASE WHEN contains(c,{NL}||{NL}) THEN trim(substr(c,instr(c,{NL}||{NL})+4),{STRIP})
       WHEN contains(c,chr(10)||chr(10)) THEN trim(substr(c,instr(c,chr(10)||chr(10))+2),{STRIP}) ELSE c END AS v
 FROM (SELECT req_id, trim(unnest(string_split(body,'--'||ltrim(
    CASE WHEN regexp_extract(ctype,'(?i)boundary=([^\\s;]+)',1)<>'' THEN trim(regexp_extract(ctype,'(?i)boundary=([^\\s;]+)',1),'"')
         ELSE regexp_extract(body,'(-{{2,}}WebKitFormBoundary[\\w\\-]+)',1) END,'-'))), {NL}||'-') AS c
    FROM requests WHERE {ISMULTI} AND body<>'')
 WHERE regexp_matches(c,'(?i)name="[^"]+"'))"""

QP = f"qp AS (SELECT req_id, k, v FROM {unpaired('requests', 'req_id', pairs(QUERY))})"
FP = f"fp AS (SELECT req_id, k, v FROM {unpaired(f'(SELECT * FROM requests WHERE body<>{chr(39)*2} AND NOT {ISJSON} AND NOT {ISMULTI})', 'req_id', pairs('body'))})"
JB = f"jq AS (SELECT req_id, body FROM requests WHERE {ISJSON})"
NORMALIZED = f"""np AS (
 SELECT req_id, 'query' AS location, CASE WHEN k='' THEN 'hpp' ELSE k END AS field, v AS raw FROM qp
 UNION ALL SELECT req_id, 'body', 'raw', body FROM requests WHERE body<>''
 UNION ALL SELECT req_id, 'json', k, v FROM leaves
 UNION ALL SELECT req_id, 'multipart', k, v FROM mp
 UNION ALL SELECT req_id, 'form', CASE WHEN k='' THEN 'field' ELSE k END, v FROM fp)"""
PARTS = ", ".join([COOKIES, QP, FP, MULTI, JB, flat("jq", "req_id"), NORMALIZED, f"""
basic AS (
 SELECT req_id, 'query' AS location, k AS field, v AS raw FROM qp
 UNION ALL SELECT req_id, 'header', h.k, h.v FROM (SELECT req_id, unnest({HEADERS}) AS h FROM requests) WHERE h.k NOT IN ('Accept','Content-Type')
 UNION ALL SELECT req_id, 'cookie', key, val FROM ck
 UNION ALL SELECT req_id, 'body', 'raw', body FROM requests WHERE body<>'' AND NOT {ISMULTI}
 UNION ALL SELECT req_id, 'json', k, v FROM ({top('jq', 'req_id')})
 UNION ALL SELECT req_id, 'form', k, v FROM fp),
parts AS (
 SELECT * FROM basic
 UNION ALL SELECT req_id, 'multipart', k, v FROM mp
 UNION ALL SELECT * FROM (SELECT DISTINCT n.* FROM np n JOIN requests r USING (req_id) WHERE r.body<>'' AND NOT {ISMULTI.replace('ctype', 'r.ctype').replace('(body', '(r.body')}) a
   ANTI JOIN basic b USING (req_id, location, field, raw))"""])

SQL = {
    "req_build": with_requests("SELECT req_id, method, url, body, 5::BIGINT AS n_headers, (SELECT max(val) FROM ck WHERE ck.req_id=r.req_id AND key='sid') AS sid, 'api' AS origin FROM requests r", COOKIES),
    "req_cookies": with_requests("SELECT req_id, key, val FROM ck", COOKIES),
    "req_query_parts": with_requests(
        f"""SELECT req_id, origin, (row_number() OVER (PARTITION BY origin, req_id ORDER BY f, i)-1)::BIGINT AS pos, k AS field, v AS raw
        FROM (SELECT *, min(i) OVER (PARTITION BY origin, req_id, k) AS f FROM {unpaired('src', 'req_id, origin', pairs(QUERY))})""",
        """src AS (SELECT page_id AS req_id, 'page' AS origin, CASE WHEN page_id%3=0 THEN url||CASE WHEN contains(url,'?') THEN '&' ELSE '?' END||'b=1&a=2&b=%20x+y&c' ELSE url END AS url FROM pages
        UNION ALL SELECT req_id, 'request', url FROM requests)"""),
    "req_path_parts": f"""SELECT req_id, 'path' AS location, 'segment' AS field, s AS raw FROM (
        SELECT page_id AS req_id, {dec("unnest(string_split(regexp_extract(CASE WHEN page_id%2=0 THEN regexp_replace(url,'(\\.[a-z]+)/','\\1/%3Cscript%3E/','g') ELSE url END,'^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)',1),'/'))")} AS s FROM pages)
        WHERE length(s)>=3 AND regexp_matches(s,'(?i)(union|select|script|alert|onerror|\\.\\./|etc/passwd|<|>|%27|%22)')""",
    "req_header_parts": with_requests(f"SELECT req_id, h.k AS field, h.v AS raw FROM (SELECT req_id, unnest({HEADERS}) AS h FROM requests) WHERE h.k NOT IN ('Accept','Content-Type')"),
    "req_cookie_parts": with_requests("SELECT req_id, 'cookie' AS location, key AS field, val AS raw FROM ck", COOKIES),
    "req_body_raw_form": with_requests(
        f"""SELECT req_id, 0::BIGINT AS pos, 'body' AS location, 'raw' AS field, body AS raw FROM requests WHERE body<>''
        UNION ALL SELECT req_id, i::BIGINT, 'form', k, v FROM {unpaired(f"(SELECT * FROM requests WHERE body<>'' AND NOT {ISJSON} AND NOT {ISMULTI})", 'req_id', pairs('body'))}"""),
    "req_json_top": with_requests(f"SELECT req_id, origin, k AS field, v AS raw FROM ({top('jb', 'req_id, origin')})", JSON_BODIES),
    "req_json_flatten": with_requests("SELECT req_id, origin, k AS field, v AS raw FROM leaves", JSON_BODIES + ", " + flat("jb", "req_id, origin"), recursive=True),
    "req_multipart": with_requests("SELECT req_id, k AS field, v AS raw FROM mp", MULTI),
    "req_hpp_pairs": f"""SELECT req_id, (i-1)::BIGINT AS pos, CASE WHEN k='' THEN 'hpp' ELSE k END AS field, v AS raw FROM {unpaired(
        "(SELECT page_id AS req_id, " + QUERY + "||'&id=1&&id=2&flag&id='||page_id AS q FROM pages)", 'req_id', pairs('q'))}""",
    "req_normalized_parts": with_requests("SELECT * FROM np", ", ".join([QP, FP, MULTI, JB, flat("jq", "req_id"), NORMALIZED]), recursive=True),
    "req_merge_parts": with_requests("SELECT * FROM parts", PARTS, recursive=True),
    "job_decompose_summary": with_requests("SELECT location, count(*) AS n_parts, sum(length(raw))::BIGINT AS chars FROM parts GROUP BY 1", PARTS, recursive=True),
    "req_protocol_score": with_requests(
        f"""SELECT r.req_id, greatest(CASE WHEN coalesce(rep,false) THEN 0.35 ELSE 0.0 END,
          CASE WHEN {ISJSON} THEN CASE WHEN try_cast(body AS JSON) IS NULL THEN 0.2 ELSE greatest(CASE WHEN nest THEN 0.25 ELSE 0.0 END, CASE WHEN nl>3 THEN 0.15 ELSE 0.0 END) END ELSE 0.0 END,
          CASE WHEN body<>'' AND {ISMULTI} THEN 0.3 ELSE 0.0 END)::DOUBLE AS score
        FROM requests r LEFT JOIN (SELECT req_id, count(*)<>count(DISTINCT k) AS rep FROM qp GROUP BY 1) USING (req_id)
        LEFT JOIN (SELECT req_id, bool_or(regexp_matches(k,'[.\\[]')) AS nest, count(*) AS nl FROM leaves GROUP BY 1) USING (req_id)""",
        ", ".join([QP, JB, flat("jq", "req_id")]), recursive=True),
    "req_eval_transport": with_requests("SELECT req_id AS row_id, method, url, body FROM requests"),
    "req_source_key": with_requests("SELECT req_id, src AS src_key, src||':'||json_extract_string(props,'$.k') AS session_key FROM requests"),
    "req_aggregate_text": with_requests(
        f"SELECT req_id, enc AS encoded, replace({dec('enc')},chr(0),'<NUL>') AS decoded FROM (SELECT req_id, CASE WHEN body<>'' THEN body WHEN regexp_matches(q,'^p=[^&]*$') THEN substr(q,3) ELSE q END AS enc FROM (SELECT *, {QUERY} AS q FROM requests))"),
}
