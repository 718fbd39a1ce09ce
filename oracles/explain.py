"""DuckDB text for explain and request-level decisions."""

from oracles.base import REQUESTS, q, with_requests
from oracles.decide import VERDICTS, verdicts
from oracles.decompose import ISJSON, ISMULTI, JB, LEAF, PARTS, QP, QUERY, dec, flat
from oracles.evaluate import P
from oracles.featurise import MARKERS9
from oracles.scoring import duck_sql, score_ctes
from paysieve.functions import rules as R
from paysieve.operators import explain as E
from paysieve.plans.explain import NAMES
from paysieve.plans.featurise import ATTACK_SHAPES


def m(t, p):
    return f"regexp_extract({t},{q(p)},0)"


def cand(i, cls, p, prio, padded, t="norm"):
    s, e = f"(instr({t},{m(t, p)})-1)", f"(instr({t},{m(t, p)})-1+length({m(t, p)}))"
    if padded:
        s, e = f"greatest({s}-2,0)", f"least({e}+10,length({t}))"
    cond = f"{m(t, p)}<>''" + (f" AND pred='{cls}'" if cls else "")
    if cls and E.needs_anchor(i):
        cond += " AND (" + " OR ".join(f"contains(lower({m(t, p)}),{q(a)})" for a in E.ANCHORS[cls]) + ")"
    return f"CASE WHEN {cond} THEN {{'prio':{prio}::DOUBLE,'short':({s}-{e})::BIGINT,'o':{-i},'s':{s}::BIGINT,'e':{e}::BIGINT}} END"


CANDS = ", ".join(cand(i, *c) for i, c in enumerate(E.candidates()))
SPEC = q(E.SPECIAL)
SPOS = f"CASE WHEN regexp_matches(norm,{SPEC}) THEN instr(norm,regexp_extract(norm,{SPEC},0)) ELSE 0 END"
LOC = (f"lo0 AS MATERIALIZED (SELECT *, list_filter([{CANDS}], lambda c: c IS NOT NULL) AS cs, {SPOS} AS sp FROM pr WHERE hit), "
       "lo1 AS (SELECT *, CASE WHEN len(cs)>0 THEN list_sort(cs)[len(cs)] END AS b FROM lo0), "
       "lo AS MATERIALIZED (SELECT row_id, label, pred, kind, norm, depth, conf, CASE WHEN b IS NOT NULL THEN b.prio WHEN sp>0 THEN 0.0 ELSE -1.0 END AS prio, CASE WHEN b IS NOT NULL THEN b.s WHEN sp>0 THEN greatest(sp-3,0) ELSE 0 END AS s0, "
       "CASE WHEN b IS NOT NULL THEN b.e WHEN sp>0 THEN least(sp+11,length(norm)) ELSE least(40,length(norm)) END AS e0 FROM lo1)")


def refine():
    out = []
    for p in (r"(?i)union\s+select", r"(?i)ignore\s+previous", "(?i)entity"):
        out.append((f"{m('sub', p)}<>''", m("sub", p)))
    for cls, words in E.ANCHORS.items():
        for w in sorted(words, key=len, reverse=True):
            esc = "(?i)" + "".join("\\" + ch if ch in ".\\;|" else ch for ch in w)
            out.append((f"pred='{cls}' AND length(sub)>={len(w)} AND {m('sub', esc)}<>''", m("sub", esc)))
    return "CASE " + " ".join(f"WHEN {c} THEN {e}" for c, e in out) + " END"


FINE = (LOC + ", fi0 AS (SELECT *, substr(norm,s0+1,e0-s0) AS sub FROM lo), fi1 AS (SELECT *, CASE WHEN prio BETWEEN 0.1 AND 5.999 THEN " + refine() + " END AS r FROM fi0), "
        "fi AS MATERIALIZED (SELECT *, CASE WHEN r IS NOT NULL THEN s0+instr(sub,r)-1 ELSE s0 END AS s, CASE WHEN r IS NOT NULL THEN s0+instr(sub,r)-1+length(r) ELSE e0 END AS e FROM fi1), "
        "sp AS MATERIALIZED (SELECT *, substr(norm,s+1,e-s) AS span FROM fi)")
LEG = []
for cls_, ps_ in E.SPAN_PATTERNS.items():
    for p_ in ps_:
        mm_ = m("norm", f"(?i){p_}")
        LEG.append(f"WHEN pred='{cls_}' AND {mm_}<>'' THEN {{'span':{mm_},'s':(instr(norm,{mm_})-1)::BIGINT,'e':(instr(norm,{mm_})-1+length({mm_}))::BIGINT}}")
LEGACY = ("le0 AS (SELECT *, regexp_extract_all(norm,'[^\\s]+') AS tk FROM pr WHERE hit), le1 AS (SELECT *, list_filter(range(1,len(tk)+1), lambda i: regexp_matches(tk[i],'[<>''\";%]')) AS hi FROM le0), "
          "le AS MATERIALIZED (SELECT *, CASE " + " ".join(LEG) + " WHEN len(hi)>0 THEN {'span':tk[hi[1]],'s':(hi[1]-1)::BIGINT,'e':hi[1]::BIGINT} ELSE {'span':substr(norm,1,40),'s':0::BIGINT,'e':0::BIGINT} END AS g FROM le1)")


def vis(e):
    return f"replace({e},chr(0),'<NUL>')"


RISK = "CASE WHEN pred='Normal' THEN 'low' WHEN conf>=0.85 THEN 'high' WHEN conf>=0.6 THEN 'medium' ELSE 'low' END"
WANT = "CASE " + " ".join(f"WHEN pred='{k}' THEN instr(lower(norm),{q(w[0])})" for k, w in E.ANCHORS.items()) + " END"
WLEN = "CASE " + " ".join(f"WHEN pred='{k}' THEN {len(w[0])}" for k, w in E.ANCHORS.items()) + " END"


def iou(s, e):
    i = f"greatest(0,least({e},we)-greatest({s},ws))"
    return f"({i}/greatest(({e}-{s})+(we-ws)-{i},1))"


HITS = "+".join(f"CASE WHEN label='{k}' THEN " + "+".join(f"contains(lower(raw),{q(w)})::INT" for w in ws) + " ELSE 0 END" for k, ws in E.ANCHORS.items())
MARK = "(" + "+".join(f"contains(lower(raw),{q(x)})::INT" for x in MARKERS9) + "+len(regexp_extract_all(raw,'[＀-￯]')))"
ENC = f"ar AS MATERIALIZED (SELECT req_id, enc, {dec('enc')} AS dec FROM (SELECT req_id, CASE WHEN body<>'' THEN body WHEN regexp_matches(q,'^p=[^&]*$') THEN substr(q,3) ELSE q END AS enc FROM (SELECT *, {QUERY} AS q FROM requests)))"
PSC = (f"psc AS (SELECT r.req_id, greatest(CASE WHEN coalesce(rep,false) THEN 0.35 ELSE 0.0 END, CASE WHEN {ISJSON} THEN CASE WHEN try_cast(body AS JSON) IS NULL THEN 0.2 ELSE greatest(CASE WHEN nest THEN 0.25 ELSE 0.0 END, CASE WHEN nl>3 THEN 0.15 ELSE 0.0 END) END ELSE 0.0 END, "
       f"CASE WHEN body<>'' AND {ISMULTI} THEN 0.3 ELSE 0.0 END)::DOUBLE AS pscore FROM requests r LEFT JOIN (SELECT req_id, count(*)<>count(DISTINCT k) AS rep FROM qp GROUP BY 1) USING (req_id) LEFT JOIN (SELECT req_id, bool_or(regexp_matches(k,'[.\\[]')) AS nest, count(*) AS nl FROM leaves GROUP BY 1) USING (req_id))")


def frame(body):
    src = "ag AS (SELECT req_id, enc, dec AS raw, dec AS norm, 1 AS depth FROM ar)"
    return verdicts(body).replace("WITH RECURSIVE " + VERDICTS, "WITH RECURSIVE " + VERDICTS + ", " + ENC + ", " + PSC + ", " + src + ", " + score_ctes("ag", "s2", "bctx", "kw_peak", "kw_best", "kw_Normal")
                                  + ", fr AS (SELECT v.req_id, v.pred, v.conf, v.mal, s2.enc, s2.raw AS araw, s2.bctx, s2.kw_peak, s2.kw_best, s2.kw_Normal AS kw_n, pscore FROM rv v JOIN s2 USING (req_id) JOIN psc USING (req_id))")


SHAPE = "(contains(enc,chr(0)) OR regexp_matches(enc,'[＀-￯]') OR " + " OR ".join(f"contains(lower(enc),'{x}')" for x in ATTACK_SHAPES) + ")"
UP = "(pscore>=0.3 AND NOT mal AND NOT bctx AND round(kw_peak,6)>=0.18 AND least(0.85,conf+pscore*0.18)>=0.38)"
HEXED = f"(regexp_matches(araw,{q(R.PATTERNS['ONLY_P_HEX'])}) AND NOT bctx AND mal AND conf<0.82)"
BEN = f"(bctx AND NOT {SHAPE} AND (NOT mal OR (conf<0.80 AND conf-round(kw_n,6)<0.60)))"

SQL = {
    "exp_locate_legacy": P(f"SELECT row_id, {vis('g.span')} AS span, g.s AS s, g.e AS e FROM le", LEGACY),
    "exp_locate_span": P("SELECT row_id, prio, s0 AS s, e0 AS e FROM lo", LOC),
    "exp_refine": P(f"SELECT row_id, s, e, {vis('span')} AS span FROM sp", FINE),
    "exp_highlight": P(f"SELECT row_id, {vis('''CASE WHEN s<0 OR e<=s OR norm='' THEN norm ELSE substr(norm,1,s)||'<mark class=''mal''>'||substr(norm,s+1,e-s)||'</mark>'||substr(norm,e+1) END''')} AS html FROM sp", FINE),
    "exp_sentence": P("SELECT row_id, 'The query field holds a '||CASE pred " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + f" ELSE pred END||' pattern ('||{vis('span')}||') '||CASE WHEN depth>0 THEN 'after '||depth||' decoding steps' ELSE 'without encoding' END||': '||{RISK}||' risk, confidence '||floor(round(conf*10000)/100)::BIGINT||'%.' AS sentence FROM sp", FINE),
    "agg_iou": P(f"SELECT pred, count(*) AS n, round(avg(({iou('s', 'e')}>0)::INT),4) AS hit, round(avg({iou('s', 'e')}),4) AS iou, round(avg({iou('g.s', 'g.e')}),4) AS iou_old FROM (SELECT sp.*, le.g, {WANT.replace('norm', 'sp.norm').replace('pred', 'sp.pred')}-1 AS ws, {WANT.replace('norm', 'sp.norm').replace('pred', 'sp.pred')}-1+{WLEN.replace('pred', 'sp.pred')} AS we FROM sp JOIN le USING (row_id)) WHERE ws>=0 GROUP BY 1", FINE + ", " + LEGACY),
    "job_explain_summary": P("SELECT pred, kind, count(*) AS n, round(avg(e-s),3) AS mean_len FROM sp GROUP BY 1,2", FINE),
    "sco_field_contrib": with_requests(f"SELECT req_id, location, field, round(w/sum(w) OVER (PARTITION BY req_id),3) AS share FROM (SELECT req_id, location, field, max(round((0.1::DOUBLE+0.25::DOUBLE*({HITS})+0.15::DOUBLE*least(4,{MARK}))::DOUBLE,3)) AS w FROM parts JOIN (SELECT req_id, label FROM requests) USING (req_id) GROUP BY 1,2,3)", PARTS, recursive=True),
    "fus_request_rescue": with_requests("SELECT req_id, arg_min(lab,o) AS verdict, round(arg_min(cf,o),6) AS conf FROM (SELECT req_id, CASE WHEN lab IS NOT NULL THEN o END AS o, lab, cf FROM (SELECT req_id, o, coalesce(xxe_label,rescue_label) AS lab, coalesce(xxe_conf,rescue_conf)::DOUBLE AS cf FROM sc)) GROUP BY 1",
        ENC + ", ag AS (SELECT req_id, 0 AS o, enc AS raw, dec AS norm, 1 AS depth FROM ar UNION ALL SELECT req_id, 1, dec, dec, 1 FROM ar), " + score_ctes("ag", "sc", "rescue_label", "rescue_conf", "xxe_label", "xxe_conf")),
    "fus_request_benign_flip": frame(f"SELECT req_id, CASE WHEN {HEXED} OR {BEN} THEN 'Normal' ELSE pred END AS verdict, CASE WHEN {HEXED} THEN 0.82 WHEN {BEN} THEN 0.88 ELSE conf END::DOUBLE AS conf FROM fr"),
    "fus_protocol_boost": frame(f"SELECT req_id, CASE WHEN {UP} THEN kw_best ELSE pred END AS verdict, round(CASE WHEN {UP} THEN least(0.85,conf+pscore*0.18) ELSE conf END::DOUBLE,6) AS conf FROM fr"),
}
