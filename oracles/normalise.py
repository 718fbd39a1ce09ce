"""DuckDB text for the normalise job.  The fixpoint is a recursive CTE, one level per round."""

from oracles.base import q, with_payloads
from paysieve.functions.text import NAMED_ENTITIES

NUL = "chr(0)"


def vis(e):
    return f"replace({e}, {NUL}, '<NUL>')"


def ud_plus(e):
    return f"url_decode(replace({e},'+',' '))"


def ud_round(e):
    return f"url_decode({ud_plus(e)})"


def ud3(e):
    return ud_round(ud_round(ud_round(e)))


def strip(e):
    return f"trim({e}, ' '||chr(9)||chr(10)||chr(13)||chr(11)||chr(12))"


def fold(e, pattern, token):
    """token: SQL over t giving the decoded text (null keeps the token)."""
    return (f"list_reduce(list_reverse_sort(list_distinct(regexp_extract_all({e},{q(pattern)}))),"
            f" lambda acc, t: replace(acc, t, coalesce({token}, t)), {e})")


def chr_ok(num):
    return f"(CASE WHEN {num} <= 1114111 AND {num} NOT BETWEEN 55296 AND 57343 THEN chr(({num})::INT) END)"


NUM_TOKEN = ("(CASE WHEN regexp_matches(t,'^&#[xX]') THEN CASE WHEN length(regexp_extract(t,'^&#[xX]([0-9a-fA-F]+)',1))<=6 THEN "
             + chr_ok("('0x'||regexp_extract(t,'^&#[xX]([0-9a-fA-F]+)',1))::BIGINT")
             + " END ELSE CASE WHEN length(regexp_extract(t,'^&#([0-9]+)',1))<=9 THEN "
             + chr_ok("regexp_extract(t,'^&#([0-9]+)',1)::BIGINT") + " END END)")


def numeric(e, tail=";?"):
    return fold(e, f"&#(?:[xX][0-9a-fA-F]+|[0-9]+){tail}", NUM_TOKEN)


def unescape(e):
    for name, ch in NAMED_ENTITIES:
        e = f"replace({e},{q(name)},{q(ch)})"
    return f"replace({numeric(e)},'&amp;','&')"


def js_unicode(e):
    return fold(e, r"\\u[0-9a-fA-F]{4}", chr_ok("('0x'||substr(t,3,4))::BIGINT"))


def hex_escape(e):
    return fold(e, r"\\x[0-9a-fA-F]{2}", "chr(('0x'||substr(t,3,2))::INT)")


def b64(e):
    return (f"(CASE WHEN length({e})%4=0 AND regexp_matches({e},'^[A-Za-z0-9+/]+={{0,2}}$') THEN try(decode(from_base64({e}))) END)")


def b64_whole(e):
    d = b64(e)
    return (f"(CASE WHEN regexp_matches({e},'^[A-Za-z0-9+/=]{{8,}}$') AND regexp_matches({d},'^(?:[^\\p{{C}}\\p{{Z}}]| )+$') THEN {d} END)")


def atob(e):
    m = f"regexp_extract({e},{q(chr(40)+'?i)atob' + chr(92) + '(['+chr(39)+chr(34)+']([A-Za-z0-9+/=]+)['+chr(39)+chr(34)+']'+chr(92)+')')},1)"
    return f"(CASE WHEN {m}<>'' THEN {b64(m)} END)"


def pct(e):
    return f"(length({e})-length(replace({e},'%','')))"


def enc_null(e):
    return f"regexp_replace({e},'%(?:25)*00',{NUL},'g')"


FW_FROM = "(SELECT string_agg(chr(i::INT),'' ORDER BY i) FROM range(65281,65375) r(i))"
FW_TO = "(SELECT string_agg(chr((i-65248)::INT),'' ORDER BY i) FROM range(65281,65375) r(i))"


def fullwidth(e):
    return f"translate({e}, {FW_FROM}||chr(12288), {FW_TO}||' ')"


# One decode round as a lateral chain over column "cur": s = stripped, then candidates.
def decode_round(src, cur="cur"):
    cands = [
        ("atob_decode", "contains(lower(s),'atob(')", atob("s")),
        ("triple_url_decode", f"contains(s,'%') AND (contains(s,'%2525') OR {pct('s')}>=6)", ud3("s")),
        ("url_decode", "contains(s,'%')", ud_round("s")),
        ("encoded_null_byte", "regexp_matches(s,'%(?:25)*00')", enc_null("s")),
        ("html_entity", "contains(s,'&') AND contains(s,';')", unescape("s")),
        ("js_unicode", "contains(lower(s),'\\u')", js_unicode("s")),
        ("hex_escape", "contains(lower(s),'\\x')", hex_escape("s")),
        ("base64", "true", b64_whole("s")),
    ]
    cols = ", ".join(f"CASE WHEN {g} THEN {c} END AS c{i}" for i, (_, g, c) in enumerate(cands))
    step = "CASE " + " ".join(f"WHEN c{i} IS NOT NULL AND c{i}<>s THEN '{n}'" for i, (n, _, _) in enumerate(cands)) + " END"
    val = "CASE " + " ".join(f"WHEN c{i} IS NOT NULL AND c{i}<>s THEN c{i}" for i in range(len(cands))) + " ELSE s END"
    return f"SELECT *, {step} AS step, {val} AS nxt FROM (SELECT *, {cols} FROM (SELECT *, {strip(cur)} AS s FROM {src}))"


def fixpoint_ctes(src: str, rounds: int = 8) -> str:
    """CTEs fx(txt, dec, chain): distinct texts of ``src`` (column txt) decoded."""
    return f"""
dtx AS (SELECT DISTINCT txt FROM {src}),
fx0 AS (SELECT txt, {fullwidth('txt')} AS cur FROM dtx),
fxr AS (
 SELECT txt, cur, CASE WHEN cur<>txt THEN ['fullwidth_norm'] ELSE []::VARCHAR[] END AS chain, 0 AS r, false AS done FROM fx0
 UNION ALL
 SELECT txt, nxt, CASE WHEN step IS NULL THEN chain ELSE list_append(chain, step) END, r+1, nxt=cur
 FROM ({decode_round("(SELECT * FROM fxr WHERE NOT done AND r<" + str(rounds) + ")")})),
fx1 AS (SELECT txt, cur, chain FROM (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY r DESC) rn FROM fxr) WHERE rn=1),
fx2 AS (SELECT txt, chain, cur AS c0, CASE WHEN length(cur)-length(replace(cur,{NUL},''))>=3
   AND (length(cur)-length(replace(cur,{NUL},'')))/greatest(length(cur),1)>=0.08 THEN replace(cur,{NUL},'') ELSE cur END AS c1 FROM fx1),
fx3 AS (SELECT *, {magic('c1')} AS c2, {magic_name('c1')} AS mstep FROM fx2),
fx4 AS (SELECT *, {numeric('c2', ';')} AS e1 FROM fx3),
fx5 AS (SELECT *, {numeric('e1', ';')} AS e2 FROM fx4),
fx6 AS (SELECT *, {numeric('e2', ';')} AS e3 FROM fx5),
fx7 AS (SELECT *, {numeric('e3', ';')} AS e4 FROM fx6),
fx AS (SELECT txt, e4 AS dec, chain || CASE WHEN c1<>c0 THEN ['null_interleave_strip'] ELSE [] END
   || CASE WHEN mstep IS NOT NULL THEN [mstep] ELSE [] END
   || CASE WHEN e1<>c2 THEN ['xml_entity_expand'] ELSE [] END || CASE WHEN e2<>e1 THEN ['xml_entity_expand'] ELSE [] END
   || CASE WHEN e3<>e2 THEN ['xml_entity_expand'] ELSE [] END || CASE WHEN e4<>e3 THEN ['xml_entity_expand'] ELSE [] END AS chain FROM fx7)"""


MAGIC = ["chr(255)||chr(216)||chr(255)||chr(219)", "chr(255)||chr(216)||chr(255)||chr(224)",
         "chr(255)||chr(216)||chr(255)||chr(238)", "chr(137)||'PNG'||chr(13)||chr(10)||chr(26)||chr(10)", "'GIF89a'"]
LTRIM = "chr(0)||chr(13)||chr(10)||chr(9)||' '"


def magic(e):
    w = " ".join(f"WHEN starts_with({e},{m}) THEN ltrim(substr({e},length({m})+1),{LTRIM})" for m in MAGIC)
    return f"CASE {w} WHEN instr(lower({e}),'<?xml') BETWEEN 2 AND 65 THEN substr({e},instr(lower({e}),'<?xml')) ELSE {e} END"


def magic_name(e):
    w = " ".join(f"WHEN starts_with({e},{m}) THEN 'upload_magic_strip'" for m in MAGIC)
    return f"CASE {w} WHEN instr(lower({e}),'<?xml') BETWEEN 2 AND 65 THEN 'binary_prefix_strip' END"


def char_list(quote):
    body = ("array_to_string(list_transform(list_filter(list_transform(string_split(regexp_extract(t,'\\(([\\d,\\s]+)\\)',1),','),"
            " lambda x: trim(x)), lambda x: x<>''), lambda n: coalesce(CASE WHEN length(n)<=7 THEN "
            + chr_ok("n::BIGINT") + " END,'')),'')")
    return f"({q(quote)}||{body}||{q(quote)})" if quote else body


def charcode(e):
    return fold(e, r"(?i)String\.fromCharCode\([\d,\s]+\)", char_list('"'))


def sql_char(e):
    return fold(e, r"(?i)char\([\d,\s]+\)", char_list(""))


def join_lits(e):
    """RE2 has no back-references: one alternative per quote pair, same left-to-right single pass."""
    for _ in range(10):
        e = (f"regexp_replace({e}, '(?:''([^''\n]*?)''|\"([^\"\n]*?)\")\\s*\\+\\s*(?:''([^''\n]*?)''|\"([^\"\n]*?)\")','\\1\\2\\3\\4','g')")
    return e


def eval_inner(e):
    p = "(?is)eval\\s*\\(\\s*(.+?)\\s*\\)"
    return f"CASE WHEN regexp_matches({e},'{p}') THEN trim(trim({strip(f'''regexp_extract({e},'{p}',1)''')},'\"'),'''') ELSE {e} END"


def normal_ctes(src: str) -> str:
    """Adds nm(txt, norm, chain) after the fixpoint (string joins resolved by the portable pattern)."""
    return fixpoint_ctes(src) + f""",
nm1 AS (SELECT txt, chain, dec, {charcode('dec')} AS a FROM fx),
nm2 AS (SELECT *, {sql_char('a')} AS b FROM nm1),
nm3 AS (SELECT *, {join_lits('b')} AS e FROM nm2),
nm4 AS (SELECT *, {eval_inner('e')} AS f FROM nm3),
nm AS MATERIALIZED (SELECT txt, f AS norm, chain || CASE WHEN a<>dec THEN ['js_charcode'] ELSE [] END || CASE WHEN b<>a THEN ['sql_char'] ELSE [] END
  || CASE WHEN e<>b THEN ['string_concat'] ELSE [] END || CASE WHEN f<>e THEN ['eval_unwrap'] ELSE [] END AS chain FROM nm4)"""


PSRC = "(SELECT payload AS txt FROM payload_rows)"


def keyed(expr, prep="payload"):
    return with_payloads(f"SELECT row_id, {expr} AS value FROM (SELECT row_id, {prep} AS x FROM payload_rows)")


def log4j(e):
    tok = "CASE WHEN lower(substr(t,3,1))='l' THEN lower(substr(t,-2,1)) ELSE upper(substr(t,-2,1)) END"
    return fold(fold(e, r"(?i)\$\{(?:lower|upper):[^}]\}", tok), r"(?i)\$\{(?:lower|upper):[^}]\}", tok)


def variants_sql():
    lv = ", ".join(f"d{i} AS (SELECT *, url_decode(v{i - 1}) AS v{i} FROM d{i - 1})" for i in range(1, 7))
    arr = "[" + ",".join(f"v{i}" for i in range(7)) + "]"
    # order-keeping distinct: keep the first position of each value
    keep = f"list_filter(l, lambda v, i: list_position(l, v)=i AND v<>'')"
    return with_payloads(
        f"SELECT row_id, {vis(f'array_to_string({keep}, chr(9246))')} AS value FROM (SELECT row_id, {arr}||[{log4j('v6')}, {log4j('v0')}] AS l FROM d6)",
        f"d0 AS (SELECT row_id, payload AS v0 FROM payload_rows), {lv}")


DEPTH = "d0 AS (SELECT row_id, payload AS v0 FROM payload_rows), " + ", ".join(
    f"d{i} AS (SELECT *, {ud_plus(f'v{i - 1}')} AS v{i} FROM d{i - 1})" for i in range(1, 7))

SQL = {
    "nrm_fullwidth": keyed(fullwidth("x")),
    "nrm_url_decode": keyed(vis(ud_round("x"))),
    "nrm_triple_url": keyed(vis(f"CASE WHEN contains(x,'%2525') OR {pct('x')}>=6 THEN {ud3('x')} ELSE x END")),
    "nrm_encoded_null": keyed(vis(enc_null("x"))),
    "nrm_js_unicode": keyed(js_unicode("x")),
    "nrm_hex_escape": keyed(hex_escape("x")),
    "nrm_base64_whole": keyed(b64_whole("x")),
    "nrm_atob": keyed(atob("x"), "'eval(atob('''||to_base64(encode(payload))||'''))'"),
    "nrm_decode_once": with_payloads(
        f"SELECT row_id, coalesce(step,'-')||'|'||{vis('nxt')} AS value FROM ({decode_round('(SELECT row_id, payload AS cur FROM payload_rows)')})"),
    "nrm_null_strip": keyed(f"CASE WHEN length(x)-length(replace(x,{NUL},''))>=3 AND (length(x)-length(replace(x,{NUL},'')))/greatest(length(x),1)>=0.08 THEN replace(x,{NUL},'') ELSE x END",
                            f"array_to_string(list_transform(regexp_extract_all(payload,'(?s).'), lambda c: c||{NUL}),'')"),
    "nrm_charcode": keyed(charcode("x")),
    "nrm_sql_char": keyed(sql_char("x"), "'x=ChAr('||(length(payload)%26+65)||', 66)'||payload"),
    "nrm_string_concat": keyed(join_lits("x"), "regexp_replace(payload,'([a-z]{3})([a-z]{2})','''\\1'' + ''\\2''','g')"),
    "nrm_eval_unwrap": keyed(eval_inner("x")),
    "nrm_homoglyph_fold": keyed(f"translate(x, {FW_FROM}||chr(1077)||chr(1086)||chr(1072)||chr(65533), {FW_TO}||'eoa')"),
    "nrm_concat_reassemble": keyed("regexp_replace(regexp_replace(x,'''\\s*\\+\\s*''','','g'),'\\s*\\+\\s*','','g')",
                                   "regexp_replace(payload,'([a-z]{3})([a-z]{2})','\\1'' + ''\\2','g')"),
    "nrm_log4j_expand": keyed(log4j("x"), "regexp_replace(payload,'([jJ])(n)','${lower:\\1}${upper:\\2}','g')"),
    "nrm_decode_variants": variants_sql(),
    "nrm_encoding_depth": with_payloads(
        "SELECT row_id, (" + "+".join(f"(v{i}<>v{i - 1})::BIGINT" for i in range(1, 7)) + ")::BIGINT AS value FROM d6", DEPTH),
    "nrm_crs_layers": keyed(vis("url_decode(url_decode(url_decode(x)))")),
    "nrm_html_unescape": with_payloads(
        f"SELECT page_id AS row_id, 'page' AS origin, {unescape('html')} AS value FROM pages UNION ALL "
        f"SELECT row_id, 'payload', {unescape('payload')} FROM payload_rows"),
    "nrm_magic_prefix": with_payloads(
        f"SELECT row_id, {magic('x')} AS value, {magic_name('x')} AS step FROM (SELECT row_id, CASE row_id%3 WHEN 0 THEN 'GIF89a'||chr(13)||chr(10) WHEN 1 THEN 'junk' ELSE '' END||'<?XML v?>'||payload AS x FROM payload_rows)"),
    "nrm_xml_entities": with_payloads(
        "SELECT row_id, e4 AS value, ((e1<>e0)::INT+(e2<>e1)::INT+(e3<>e2)::INT+(e4<>e3)::INT)::BIGINT AS changed FROM x4",
        "x0 AS (SELECT row_id, payload||'&#38;#65;' AS e0 FROM payload_rows), "
        + ", ".join(f"x{i} AS (SELECT *, {numeric(f'e{i - 1}', ';')} AS e{i} FROM x{i - 1})" for i in range(1, 5))),
    "nrm_decode_fixpoint": with_payloads(
        f"SELECT row_id, {vis('dec')} AS value, array_to_string(chain,'>') AS chain FROM payload_rows JOIN fx ON txt=payload",
        fixpoint_ctes(PSRC), recursive=True),
    "nrm_normalize": with_payloads(
        f"SELECT row_id, {vis('norm')} AS norm, array_to_string(chain,'>') AS chain FROM payload_rows JOIN nm ON txt=payload",
        normal_ctes(PSRC), recursive=True),
    "job_normalise_summary": with_payloads(
        "SELECT kind, array_to_string(chain,'>') AS chain, count(*) AS n, count(*) FILTER (norm<>payload) AS changed FROM payload_rows JOIN nm ON txt=payload GROUP BY ALL",
        normal_ctes(PSRC), recursive=True),
}
