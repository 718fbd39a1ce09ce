"""Shared DuckDB view text for the derived tables."""

from paysieve.templates import ROWS


def q(s: str) -> str:
    """SQL string literal; control characters go through chr()."""
    if s == "":
        return "''"
    out, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            if buf:
                out.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            out.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf:
        out.append("'" + buf.replace("'", "''") + "'")
    return "(" + "||".join(out) + ")" if len(out) > 1 else out[0]


def values(rows) -> str:
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return q(v)
    return "VALUES " + ",".join("(" + ",".join(one(v) for v in r) + ")" for r in rows)


PAYLOADS = f"""tpl(pid,tpl,label,kind) AS ({values(ROWS)}),
payload_rows AS MATERIALIZED (
 SELECT event_id AS row_id, ts, user_id::VARCHAR AS src,
  replace(replace(tpl,'{{n}}',event_id::VARCHAR),'{{u}}',user_id::VARCHAR) AS payload,
  label, kind, event_type||':'||kind AS source, props
 FROM events JOIN tpl ON event_id % 64 = pid)"""

REQUESTS = PAYLOADS + """,
requests AS MATERIALIZED (
 SELECT row_id AS req_id, ts, src,
  CASE WHEN post THEN 'POST' ELSE 'GET' END AS method,
  'http://eval.local/test' || CASE WHEN post THEN '' ELSE '?p='||url_encode(payload) END AS url,
  CASE WHEN post THEN payload ELSE '' END AS body,
  ctype, 'sid='||coalesce(json_extract_string(props,'$.k'),'none')||'; theme ='||kind||'; flag' AS cookie,
  'http://site.test/'||split_part(source,':',1) AS referer,
  payload, label, kind, source, props
 FROM (SELECT *, (contains(payload,'&') OR contains(payload,chr(10)) OR contains(payload,chr(13))
        OR length(payload)>1800 OR starts_with(payload,'{')) AS post,
       CASE WHEN starts_with(payload,'------WebKit') THEN 'multipart/form-data; boundary=----WebKitFormBoundaryQ7x'
            WHEN starts_with(payload,'{') THEN 'application/json' ELSE '' END AS ctype
       FROM payload_rows))"""


def with_payloads(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{PAYLOADS}{', ' + extra if extra else ''} {body}"


def with_requests(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{REQUESTS}{', ' + extra if extra else ''} {body}"
