"""Late-fusion and decision stages (same notation as ``rules``).

Inputs besides the score stages: ml_* (class probabilities of a model), anom (series anomaly),
g_std / g_edge / g_high (byte-grid texture), cs_rate (case alternation), view_label / view_conf /
discrepant (semantic views), mem_* / mem_hit / mem_exact (memory lookup).
"""

from __future__ import annotations

from paysieve.functions.rules import ATTACKS, LABELS, best, cascade, peak, scaled, term

# Fusion weights (base, semantic, multimodal, series) per regime, gates and limits.
WEIGHTS_OBFUSCATED = (0.42, 0.32, 0.04, 0.12)
WEIGHTS_BENIGN = (0.34, 0.24, 0.22, 0.10)
VISION_WEIGHT = 0.30
THRESHOLD = 0.38
GATE_BASE, GATE_LOW, GATE_BOOST = 0.45, 0.25, 1.5
MEMORY_WEIGHT, MEMORY_OBF, MEMORY_BENIGN, MEMORY_FORCE = 0.28, 0.42, 0.12, 0.92
GUARD_BASE_MAX, GUARD_CONF_MIN = 0.32, 0.55

SEM_BOOST = [(f"sb_{k}", f"least(1.0D, rp_{k}+" + {
    "SQLi": term(("contains(low,'union') AND contains(low,'select')", .15)), "XSS": term(("contains(low,'<script') OR contains(low,'onerror')", .15)),
    "XXE": term(("contains(low,'<!entity') OR contains(low,'&xxe')", .15)), "PromptInjection": term(("anyof(low,SEM_PROMPT)", .15))}.get(k, "0D") + ")") for k in LABELS]

_AMP = "least((length(raw)-length(replace(raw,'&','')))/20.0D,1.0D)"
_PCTR = "pct/greatest(length(raw),1)"
PROTOCOL = [("pb_Normal", "0D"),
            ("pb_SQLi", term((f"dup_raw_low OR {_AMP}>0.3", .35), ("contains(raw_low,'%00')", .25), ("least(pct/30.0D,1.0D)>0.4 AND obf", .2), ("depth>=2", .15), (f"{_PCTR}>0.15 AND obf", .2))),
            ("pb_XSS", term(("webkit", .3), ("least(pct/30.0D,1.0D)>0.4 AND obf", .2), ("depth>=2", .15), (f"{_PCTR}>0.15 AND obf", .2))),
            ("pb_CMD", term(("webkit", .2), ("contains(raw_low,'%00')", .15)))] + [(f"pb_{k}", "0D") for k in ATTACKS[3:]]
PROTOCOL2 = [("pq_Normal", "pb_Normal")] + [(f"pq_{k}", f"pb_{k}+CASE WHEN depth>=2 THEN 0.15D*kw_{k} ELSE 0D END+0.2D*st_{k}") for k in ATTACKS]
PROTOCOL3 = scaled("pro", "pq")

VISION = [("vb_Normal", "0D"),
          ("vb_SQLi", term(("g_std>0.15 AND obf", .25), ("g_high>0.08", .2), ("depth>=2", .15), (f"{_PCTR}>0.15", .2), ("rx(raw_low,HEX_OR_PCT)", .15), ("cs_rate>0.35", .1),
                           ("contains(low,'union') OR contains(low,'select')", .25))),
          ("vb_XSS", term(("g_std>0.15 AND obf", .2), ("g_edge>0.12", .2), ("depth>=2", .15), (f"{_PCTR}>0.15", .2), ("cs_rate>0.35", .15), ("contains(low,'<script') OR contains(low,'alert')", .3))),
          ("vb_CMD", term(("g_edge>0.12", .15), ("rx(raw_low,HEX_OR_PCT)", .1)))] + [(f"vb_{k}", "0D") for k in ATTACKS[3:]]
VISION2 = scaled("vis", "vb")
MULTI = [(f"mq_{k}", f"{1 - VISION_WEIGHT}D*pro_{k}+{VISION_WEIGHT}D*vis_{k}") for k in LABELS]
MULTI2 = scaled("mm", "mq") + [("mm_peak", "greatest(" + ",".join(f"mq_{k}" for k in ATTACKS) + ")")]

BASE = [(f"b_{k}", f"CASE WHEN rp_peak>=0.45 THEN rp_{k} WHEN rp_peak>=0.4 THEN 0.3D*ml_{k}+0.7D*rp_{k} ELSE 0.6D*ml_{k}+0.4D*rp_{k} END") for k in LABELS]
BASE2 = [("b_peak", peak("b")), ("b_best", best("b"))]
BASE3 = [("b_label0", "CASE WHEN b_Normal>=b_peak THEN 'Normal' ELSE b_best END"), ("b_conf0", "greatest(b_Normal,b_peak)")]
_bm = "(b_label0<>'Normal' AND b_conf0>=0.35)"
_b = cascade([(f"NOT {_bm} AND strong AND depth>=2 AND kw_peak>=0.3", "kw_best", "greatest(b_peak,kw_peak,0.45D)"),
              (f"NOT {_bm} AND strong AND st_peak>=0.5 AND kw_peak>=0.15", "st_best", "greatest(b_peak,st_peak,0.48D)"), ("TRUE", "b_label0", "b_conf0")])
BASE4 = [("base_label", _b[0]), ("base_conf", _b[1])]
BASE5 = [("base_mal", "base_label<>'Normal' AND base_conf>=0.35")]


def _weight(i: int) -> str:
    o, n = WEIGHTS_OBFUSCATED, WEIGHTS_BENIGN
    return f"CASE WHEN obf THEN {o[i]}D/{sum(o)}D ELSE {n[i]}D/{sum(n)}D END"


WEIGHTS = [(n, _weight(i)) for i, n in enumerate(["cw_base", "cw_sem", "cw_mm", "cw_dl"])]
_gate = f"(b_peak>={GATE_BASE} OR obf)"
_quiet = f"(NOT dup_raw_low AND NOT obf AND least(pct/30.0D,1.0D)<0.2 AND b_peak<{GATE_LOW} AND mm_peak<0.15)"
GATE = [("w_base", f"CASE WHEN {_gate} THEN cw_base+cw_mm*0.6D ELSE cw_base END"), ("w_sem", f"CASE WHEN {_gate} THEN cw_sem+cw_mm*0.4D ELSE cw_sem END"),
        ("w_mm", f"CASE WHEN {_gate} THEN 0.0D WHEN {_quiet} THEN cw_mm*{GATE_BOOST}D ELSE cw_mm END"), ("w_dl", "cw_dl")]
LATE = [(f"lq_{k}", f"w_base*b_{k}+w_sem*sem_{k}+w_mm*mm_{k}+" + (f"w_dl*anom*greatest(mm_{k},sem_{k},b_{k})" if k != "Normal" else "w_dl*(1.0D-anom)*0.5D")) for k in LABELS]
LATE2 = scaled("lf", "lq")
BOOST = [("boost", "obf AND (strong OR depth>=2 OR b_peak>=0.20 OR ev_peak>=0.50)")]
BOOST2 = [("oq_Normal", "lf_Normal")] + [
    (f"oq_{k}", f"CASE WHEN boost THEN (0.55D*lf_{k}+0.25D*kw_{k}+0.2D*st_{k}+0.15D*ev_{k})*CASE WHEN depth>=2 THEN 1.15D ELSE 1.0D END ELSE lf_{k} END") for k in ATTACKS]
BOOST3 = scaled("ob", "oq")
THRESH = [("ob_peak", peak("ob")), ("ob_best", best("ob"))]
THRESH2 = [("th_label", f"CASE WHEN ob_Normal>=ob_peak AND ob_peak<{THRESHOLD} THEN 'Normal' ELSE ob_best END")]
THRESH3 = [("th_conf", "CASE WHEN th_label='Normal' THEN ob_Normal ELSE ob_peak END"), ("th_mal", f"th_label<>'Normal' AND ob_peak>={THRESHOLD}")]
_gatefb = "NOT th_mal AND (strong OR (obf AND depth>=1) OR ev_peak>=0.40 OR (contains(raw_low,'%00') AND obf) OR (contains(raw_low,'eval(atob') AND depth>=1))"
FALLBACK_RULES = [(f"{_gatefb} AND {c}", lab, conf) for c, lab, conf in [
    ("depth>=2 AND cmd_raw_low AND st_peak>=0.35", "st_best", "greatest(th_conf,st_peak,0.42D)"),
    ("depth>=2 AND kw_peak>=0.28", "kw_best", f"greatest(th_conf,kw_peak,{THRESHOLD}D)"),
    ("strong AND st_peak>=0.48 AND kw_peak>=0.15", "st_best", f"greatest(th_conf,st_peak,{THRESHOLD}D)"),
    ("fw AND obf AND st_peak>=0.35", "st_best", "greatest(th_conf,st_peak,0.55D)"),
    ("depth>=2 AND st_peak>=0.52 AND kw_peak>=0.18", "st_best", f"greatest(th_conf,st_peak,{THRESHOLD}D)"),
    ("depth>=1 AND contains(raw_low,'%252') AND st_peak>=0.35 AND kw_peak>=0.10", "st_best", "greatest(th_conf,st_peak,0.40D)"),
    ("ev_peak>=0.40 AND (kw_peak>=0.08 OR st_peak>=0.30)", "ev_best", "greatest(th_conf,ev_peak,0.40D)"),
    ("contains(raw_low,'%00') AND obf AND st_peak>=0.28", "st_best", "greatest(th_conf,st_peak,0.40D)"),
    ("contains(raw_low,'eval(atob') AND depth>=1 AND kw_peak>=0.08", "kw_best", "greatest(th_conf,kw_peak,0.42D)"),
    ("ev_peak>=0.50 AND (kw_peak>=0.10 OR st_peak>=0.35)", "ev_best", f"greatest(th_conf,ev_peak,{THRESHOLD}D)")]]
_f = cascade(FALLBACK_RULES + [("TRUE", "th_label", "th_conf")])
_hit = " OR ".join(f"({c})" for c, _, _ in FALLBACK_RULES)
FALLBACK = [("fb_label", _f[0]), ("fb_conf", _f[1]), ("fb_mal", f"th_mal OR {_hit}")]

# Memory: weight by regime, skipped on the benign fast path.
MEMORY = [("fast", "NOT obf AND NOT strong AND NOT hexw AND depth<2 AND ((length(raw)<=16 AND NOT rx(raw,NON_ASCII) AND pct<2) OR (b_peak<0.22 AND length(raw)<120))"),
          ("lam0", f"CASE WHEN obf THEN {MEMORY_OBF}D WHEN hexw THEN 0.55D WHEN NOT strong AND b_peak<0.35 THEN {MEMORY_BENIGN}D ELSE {MEMORY_WEIGHT}D END")]
MEMORY2 = [("lam", "CASE WHEN fast THEN 0.0D WHEN hexw AND coalesce(mem_exact,'Normal')<>'Normal' THEN greatest(lam0,0.85D) WHEN hexw THEN least(lam0,0.12D)"
            " WHEN b_Normal>0.45 AND b_peak<0.28 THEN lam0*0.5D ELSE lam0 END")]
MEMORY3 = [(f"xq_{k}", f"(1.0D-lam)*ob_{k}+lam*mem_{k}") for k in LABELS]
MEMORY4 = scaled("mx", "xq")
MEMORY5 = [("mx_peak", peak("mx")), ("mx_best", best("mx"))]
MEMORY6 = [("mx_arg", "CASE WHEN mx_Normal>=mx_peak THEN 'Normal' ELSE mx_best END")]
_exact = "NOT fast AND coalesce(mem_exact,'Normal')<>'Normal' AND (hexw OR obf OR strong OR depth>=1)"
_force = f"NOT fast AND mem_hit>={MEMORY_FORCE} AND mx_arg<>'Normal' AND (strong OR b_peak>=0.30)"
MEMORY7 = [("mf_label", f"CASE WHEN fast THEN fb_label WHEN {_exact} THEN mem_exact ELSE mx_arg END"),
           ("mf_conf", f"CASE WHEN fast THEN fb_conf WHEN {_exact} THEN greatest(mx_peak,mx_Normal,0.88D) WHEN {_force} THEN greatest(mx_peak,mem_hit*0.9D) ELSE greatest(mx_peak,mx_Normal) END"),
           ("mf_mal", f"CASE WHEN fast THEN fb_mal WHEN {_exact} OR {_force} THEN TRUE WHEN mx_arg<>'Normal' AND mx_peak>={THRESHOLD} THEN TRUE ELSE fb_mal END")]
_keep = ("((obf AND (strong OR depth>=2) AND (kw_peak>=0.12 OR st_peak>=0.40 OR ev_peak>=0.40)) OR (ev_peak>=0.50 AND (kw_peak>=0.10 OR st_peak>=0.35))"
         " OR (contains(raw_low,'%252') AND cmd_raw_low AND st_peak>=0.35) OR (contains(raw_low,'%00') AND (st_peak>=0.38 OR kw_peak>=0.10)) OR (webkit AND st_peak>=0.45))")
GUARD = [("flip", f"mf_mal AND mf_label<>'Normal' AND NOT {_keep} AND base_label='Normal' AND b_peak<{GUARD_BASE_MAX} AND NOT strong AND depth<2"
          f" AND mf_conf<{GUARD_CONF_MIN} AND mem_hit<{MEMORY_FORCE} AND ev_peak<0.45")]
GUARD2 = [("gd_label", "CASE WHEN flip THEN 'Normal' ELSE mf_label END"), ("gd_conf", "CASE WHEN flip THEN greatest(mx_Normal,b_Normal) ELSE mf_conf END"), ("gd_mal", "mf_mal AND NOT flip")]
_full = "(contains(raw_low,'%3d') AND NOT contains(raw,'=') AND anyof(raw_low,FULL_NAMES2))"
OVERRIDE = [("rs_label", "CASE WHEN gd_mal THEN gd_label WHEN rescue_label IS NOT NULL THEN rescue_label WHEN atob_label IS NOT NULL THEN atob_label ELSE gd_label END"),
            ("rs_conf", "CASE WHEN gd_mal THEN gd_conf WHEN rescue_label IS NOT NULL THEN rescue_conf WHEN atob_label IS NOT NULL THEN greatest(gd_conf,atob_conf) ELSE gd_conf END"),
            ("rs_mal", "gd_mal OR rescue_label IS NOT NULL OR atob_label IS NOT NULL"),
            ("excuse", f"rescue_label IS NULL AND NOT {_full} AND NOT casep AND NOT fw AND bctx AND atob_label IS NULL AND ((bform_raw_low AND kw_peak<0.35 AND st_peak<0.70 AND b_peak<0.62)"
                       " OR (NOT bform_raw_low AND kw_peak<0.22 AND st_peak<0.45 AND b_peak<0.32))")]
_sem = "(NOT (rs_mal AND NOT excuse) AND xxe_label IS NULL AND (obf OR strong OR depth>=1 OR discrepant) AND view_label<>'Normal' AND view_conf>=0.72 AND NOT bctx)"
OVERRIDE2 = [("ov_label", f"CASE WHEN xxe_label IS NOT NULL THEN xxe_label WHEN {_sem} THEN view_label WHEN rs_mal AND excuse THEN 'Normal' ELSE rs_label END"),
             ("ov_conf", f"CASE WHEN xxe_label IS NOT NULL THEN xxe_conf WHEN {_sem} THEN greatest(view_conf,rs_conf) WHEN rs_mal AND excuse THEN greatest(mx_Normal,CASE WHEN bform_raw_low THEN 0.62D ELSE 0.60D END) ELSE rs_conf END"),
             ("ov_mal", f"xxe_label IS NOT NULL OR {_sem} OR (rs_mal AND NOT excuse)")]


def arbitration(lab: str, conf: str, p: str) -> list[tuple[str, str, str]]:
    """Ordered corrections between attack classes; Normal is never changed."""
    cmdm = "(cmd_raw_low OR cmd_low)"
    shell = "(anyof(raw_low,SHELLISH) OR anyof(low,SHELLISH))"
    xss = "(anyof(raw_low,XSS_MARK) OR anyof(low,XSS_MARK))"
    path = "(anyof(raw_low,PATH_MARK) OR anyof(low,PATH_MARK))"
    inc = "(anyof(raw_low,FI_MARK) OR anyof(low,FI_MARK))"
    sql = "((contains(low,'union') AND contains(low,'select')) OR contains(low,'information_schema'))"
    nosql = "NOT contains(low,'union') AND NOT contains(low,'select')"
    return [
        (f"{lab}='Normal'", "'Normal'", conf),
        ("atob_label='CMD'", "'CMD'", f"greatest({conf},atob_conf)"),
        (f"{lab}='SQLi' AND ({cmdm} OR {shell} OR kw_CMD>=0.45 OR st_CMD>=0.40) AND (kw_CMD>=kw_SQLi+0.12D OR st_CMD>=st_SQLi+0.08D OR ({cmdm} AND kw_CMD>=0.35) OR ({shell} AND {nosql}))",
         "'CMD'", f"greatest({conf},0.72D,kw_CMD,st_CMD)"),
        (f"{lab}='SQLi' AND {p}_CMD>={p}_SQLi+0.05D AND (kw_CMD>=0.30 OR {cmdm})", "'CMD'", f"greatest({conf},{p}_CMD,0.70D)"),
        (f"{lab}='CMD' AND {sql} AND NOT {cmdm} AND kw_SQLi>=kw_CMD+0.15D", "'SQLi'", f"greatest({conf},0.70D,kw_SQLi)"),
        (f"{lab} IN ('SQLi','CMD') AND ({xss} OR kw_XSS>=0.45 OR st_XSS>=0.40) AND (kw_XSS>=kw_SQLi+0.08D OR st_XSS>=st_SQLi+0.08D OR ({xss} AND {nosql})"
         f" OR {p}_XSS>=CASE WHEN {lab}='SQLi' THEN {p}_SQLi ELSE {p}_CMD END+0.05D)", "'XSS'", f"greatest({conf},0.72D,kw_XSS,st_XSS,{p}_XSS)"),
        (f"{lab}='FileInclusion' AND {path} AND NOT {inc} AND kw_PathTraversal+st_PathTraversal>=kw_FileInclusion+st_FileInclusion+0.05D", "'PathTraversal'", f"greatest({conf},0.70D,kw_PathTraversal,st_PathTraversal)"),
        (f"{lab}='PathTraversal' AND {inc} AND (kw_FileInclusion+st_FileInclusion>=kw_PathTraversal+st_PathTraversal OR contains(low,'php://') OR contains(low,'expect://'))",
         "'FileInclusion'", f"greatest({conf},0.72D,kw_FileInclusion,st_FileInclusion)"),
        (f"{lab}='XSS' AND {sql} AND NOT {xss} AND kw_SQLi>=kw_XSS+0.12D", "'SQLi'", f"greatest({conf},0.70D,kw_SQLi)"),
        ("TRUE", lab, conf),
    ]


_ar = cascade(arbitration("ov_label", "ov_conf", "mx"))
ARBITRATE = [("ar_label", f"CASE WHEN ov_mal THEN {_ar[0]} ELSE ov_label END"), ("ar_conf", f"CASE WHEN ov_mal THEN {_ar[1]} ELSE ov_conf END")]
_pl = "CASE " + " ".join(f"WHEN ar_label='{k}' THEN mx_{k}" for k in LABELS) + " END"
_tie = f"(ov_mal AND ar_label<>'Normal' AND view_label<>'Normal' AND view_conf>=0.55 AND view_label<>ar_label AND view_conf>=greatest({_pl},ar_conf)-0.12D)"
TIEBREAK = [("fin_label", f"CASE WHEN {_tie} THEN view_label ELSE ar_label END"), ("fin_conf", f"CASE WHEN {_tie} THEN greatest(ar_conf,view_conf) ELSE ar_conf END"), ("fin_mal", "ov_mal")]

FUSION_STAGES = [SEM_BOOST, PROTOCOL, PROTOCOL2, PROTOCOL3, VISION, VISION2, MULTI, MULTI2, BASE, BASE2, BASE3, BASE4, BASE5, WEIGHTS, GATE, LATE, LATE2, BOOST, BOOST2, BOOST3,
                 THRESH, THRESH2, THRESH3, FALLBACK, MEMORY, MEMORY2, MEMORY3, MEMORY4, MEMORY5, MEMORY6, MEMORY7, GUARD, GUARD2, OVERRIDE, OVERRIDE2, ARBITRATE, TIEBREAK]
