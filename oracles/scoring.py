"""DuckDB form of the text views and score stages."""

import re

from oracles.base import PAYLOADS, q
from oracles.decompose import pairs
from oracles.normalise import FW_FROM, FW_TO, js_unicode, magic, normal_ctes, numeric, strip, unescape
from paysieve.functions import rules as R

NUL = "chr(0)"


def duck_sql(text: str) -> str:
    text = re.sub(r"(?<![\w.])(\d+(?:\.\d+)?)D\b", r"(\1::DOUBLE)", text)
    return R.render(text, q, lambda c, p: f"regexp_matches({c},{p})", lambda c, p: f"len(regexp_extract_all({c},{p}))")


def fold(e):
    return f"translate({e}, {FW_FROM}||chr(1077)||chr(1086)||chr(1072)||chr(65533), {FW_TO}||'eoa')"


def canon(e):
    return f"regexp_replace(replace({strip(e)},{NUL},''),'(?:%00)+','','g')"


def rep(e, items):
    for a, b in items:
        e = f"replace({e},{q(a)},{q(b)})"
    return e


def names(e, group=1):
    return f"regexp_extract_all(replace({e},'?','&'),{q(R.PATTERNS['PARAM_NAME'])},{group})"


def dup(e):
    return f"(len({names(e)})>len(list_distinct({names(e)})))"


def hient(t):
    s = strip(t)
    return (f"(regexp_matches({s},'^[A-Za-z0-9]{{20,40}}$') AND regexp_matches({s},'[A-Z]') AND regexp_matches({s},'[a-z]') AND regexp_matches({s},'[0-9]')"
            f" AND len(list_distinct(split({s},'')))>=8)")


def b64pad(t):
    s = f"rtrim({t},'=')"
    return (f"(CASE WHEN length({s})%4<>1 AND regexp_matches({s},'^[A-Za-z0-9+/]+$') THEN try(decode(from_base64({s}||repeat('=',((4-length({s})%4)%4)::INT)))) END)")


ATOB_TOKEN = "regexp_extract(raw," + q("(?i)atob\\s*\\(\\s*['\"]([A-Za-z0-9+/=]+)['\"]\\s*\\)") + ",1)"
ADDR = [("+", " "), ("%20", " "), ("%2b", " "), ("%ef%bf%bd", "a"), ("�", "a"), ("%2c", ",")]
PLUS = [("%252b", " "), ("%2b", " "), ("%252c", ","), ("%2c", ","), ("+", " "), ("%252f", "/"), ("%2f", "/")]
VIEWS = {
    "klow": f"lower({fold('low')})", "folded": f"lower({fold('raw')})", "dform": "lower(url_decode(replace(raw,'+',' ')))",
    "uraw": f"lower({js_unicode('raw')})", "ulow": f"lower({js_unicode('low')})", "xm": canon("raw||' '||low"), "xl": canon("low"),
    "addr": rep(strip("low"), ADDR), "low_sp": "replace(low,'+',' ')", "raw_low_pp": rep(strip("raw_low"), PLUS), "low_pp": rep(strip("low"), PLUS),
    "mbody": "CASE WHEN contains(raw,chr(10)||chr(10)) THEN substr(raw,instr(raw,chr(10)||chr(10))+2) ELSE raw END",
    "reasm": "lower(regexp_replace(regexp_replace(raw,'''\\s*\\+\\s*''','','g'),'\\s*\\+\\s*','','g'))",
    "b64": f"CASE WHEN regexp_matches(raw,'(?i)atob') THEN coalesce(lower({b64pad(ATOB_TOKEN)}),'') ELSE '' END",
    "nocomment": "replace(raw_low,'/**/','')",
    "inner_low": f"lower(replace(regexp_extract(raw,{q(R.PATTERNS['JSON_NESTED'])},1),'\\\"','\"'))",
    "dup_raw_low": dup("raw_low"), "dup_low": dup("low"),
    "hient_any": f"len(list_filter({names('raw', 2)}, lambda t: {hient('t')}))>0",
}
XD = lambda e: numeric(numeric(numeric(numeric(e, ";"), ";"), ";"), ";")
VIEWS_2 = {
    "xd": XD("xmm"), "xld": XD("xlm"),
    "addr_name": "replace(replace(addr,'%27',''),'''','')", "addr_np": "regexp_replace(addr,'%[0-9a-f]{2}',' ','g')",
    "b64u": "lower(url_decode(url_decode(b64)))",
}
STAGES = R.SCORE_STAGES + [R.REASM, R.REASM2, R.REASM3, R.REASM4, R.SPECIAL, R.RESCUE]


def score_ctes(src: str, out: str, *wanted: str, stages=None) -> str:
    """CTE chain from ``src`` (raw, norm, depth) to ``out`` with the wanted columns."""
    stages = R.needed(list(wanted), STAGES if stages is None else stages)
    used = set(re.findall(r"\w+", " ".join(e for st in stages for _, e in st))) | set(wanted)
    need2 = {n for n in VIEWS_2 if n in used} | ({"b64u"} if "blob" in used else set())
    deps = {"xd": "xm", "xld": "xl", "addr_name": "addr", "addr_np": "addr", "b64u": "b64"}
    need1 = {n for n in VIEWS if n in used} | {deps[n] for n in need2}
    parts = [f"{out}_a AS (SELECT *, lower(raw) AS raw_low, lower(norm) AS low FROM {src})"]
    prev = f"{out}_a"

    def add(cols: dict[str, str], tag: str):
        nonlocal prev
        if cols:
            parts.append(f"{out}_{tag} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + f" FROM {prev})")
            prev = f"{out}_{tag}"
    add({n: e for n, e in VIEWS.items() if n in need1}, "b")
    add({n: magic(s) for n, s, k in (("xmm", "xm", "xd"), ("xlm", "xl", "xld")) if k in need2}, "c")
    add({n: e for n, e in VIEWS_2.items() if n in need2}, "d")
    if "blob" in used:
        add({"blob": "b64||' '||b64u||' '||raw_low"}, "e")
    for i, st in enumerate(stages):
        add({n: duck_sql(e) for n, e in st}, f"s{i}")
    parts.append(f"{out} AS MATERIALIZED (SELECT * FROM {prev})")
    return ", ".join(parts)


NSRC = "np0 AS MATERIALIZED (SELECT p.*, payload AS raw, norm, chain, len(chain)::INT AS depth FROM payload_rows p JOIN nm ON txt=payload)"


def scored_payloads(body: str, *wanted: str, extra: str = "", stages=None) -> str:
    """Query over payload rows scored as ``sc``."""
    return (f"WITH RECURSIVE {PAYLOADS}, {normal_ctes('(SELECT payload AS txt FROM payload_rows)')}, {NSRC}, "
            f"{score_ctes('np0', 'sc', *wanted, stages=stages)}{', ' + extra if extra else ''} {body}")


def b64_tokens(e):
    found = f"regexp_extract_all({e},'(?:^|[^A-Za-z0-9+/])([A-Za-z0-9+/]{{16,}}={{0,2}})',1)"
    return f"array_to_string(list_filter(list_transform({found}, lambda t: coalesce({b64pad('t')},'')), lambda t: t<>''),' ')"
