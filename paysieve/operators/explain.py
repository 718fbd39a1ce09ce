"""Explain job: malicious span of a text for a class, as in-row candidate choice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paysieve.functions.text import let

# Span patterns and anchors per class.
SPAN_PATTERNS = {
    "SQLi": [r"union\s+select", r"or\s+1\s*=\s*1", r"sleep\s*\(", r"benchmark\s*\("],
    "XSS": [r"<script[^>]*>", r"onerror\s*=", r"javascript:", r"alert\s*\("],
    "CMD": [r"[;&|]`", r"\$\(", r"wget\s+", r"curl\s+", r"\$\{jndi:"],
    "PathTraversal": [r"\.\./", r"\.\.\\", r"/etc/passwd"],
    "FileInclusion": [r"php://", r"file://", r"include\s*\("],
    "XXE": [r"<!entity[^>]+file://", r"<!doctype[^>]*\[", r"file:///[^\s\"'>]+", r"<!entity\s+%"],
    "PromptInjection": [r"ignore\s+previous", r"system\s+prompt", r"jailbreak"],
}
ANCHORS = {
    "SQLi": ["union", "select", "or 1=1", "sleep"], "XSS": ["script", "onerror", "alert", "svg"], "CMD": ["wget", "curl", "jndi", ";"],
    "PathTraversal": ["../", "..\\", "passwd"], "FileInclusion": ["php://", "include"], "XXE": ["entity", "system", "xxe"],
    "PromptInjection": ["ignore", "prompt", "jailbreak", "disregard"],
}
# Fixed values: (pattern, priority) of obfuscation spans (padded) and of class-specific spans.
OBFUSCATION_SPANS = [(r"%00|%2500|\x00", 7.2), (r"(?:\\u[0-9a-f]{4}){2,}", 7.0), (r"\\u[0-9a-f]{4}", 6.9), (r"%252[0-9a-f]{2}", 6.8),
                     (r"&#x?[0-9a-f]+;", 6.6), (r"/\*\*/", 6.4), (r"[|?](?:$|[,+\s])", 6.2), ("[！-～]{1,8}", 6.0)]
CLASS_SPANS = [("SQLi", r"union\s+select", 5.0), ("XSS", r"<script[^>]*>", 5.5), ("PromptInjection", r"ignore", 5.8), ("PromptInjection", r"ignore\s+previous", 5.0),
               ("XXE", r"<!ENTITY\s+%[^>]+file:///", 6.5), ("XXE", r"<!ENTITY\s+&#x25;[^>]+SYSTEM", 6.4), ("XXE", r"<!DOCTYPE[^>]*\[", 6.0), ("XXE", r"file:///[^\s\"'>]+", 5.8), ("XXE", r"<!ENTITY[^>]+>", 5.0)]
SPECIAL = "['\"<>%;！-～]"
PAD_BEFORE, PAD_AFTER = 2, 10


def candidates() -> list[tuple[str | None, str, float, bool]]:
    """(class, pattern, priority, padded) in order; a class pattern counts only if it holds an anchor of its class."""
    out: list[tuple[str | None, str, float, bool]] = [(None, f"(?i){p}", w, True) for p, w in OBFUSCATION_SPANS]
    out += [(c, f"(?is){p}", w, False) for c, p, w in CLASS_SPANS]
    for c, ps in SPAN_PATTERNS.items():
        out += [(c, f"(?i){p}", 2.0 if p.startswith("alert") else 4.0, False) for p in ps]
    for c, words in ANCHORS.items():
        out += [(c, "(?i)" + "".join("\\" + ch if ch in ".\\;|" else ch for ch in w), 3.5, False) for w in words]
    return out


def needs_anchor(i: int) -> bool:
    lo = len(OBFUSCATION_SPANS) + len(CLASS_SPANS)
    return lo <= i < lo + sum(len(p) for p in SPAN_PATTERNS.values())


def has_anchor(span: Column, label: str) -> Column:
    out = F.lit(False)
    for a in ANCHORS[label]:
        out = out | F.lower(span).contains(a)
    return out


def first_span(text: Column, pattern: str) -> Column:
    """struct(s, e, span) of the first match, null without a match; zero-based, end exclusive."""
    return let(F.regexp_extract(text, pattern, 0), lambda m: F.when(m != "", let(
        F.position(m, text),
        lambda at: F.struct((at - 1).alias("s"), (at - 1 + F.length(m)).alias("e"), m.alias("span")))))


def locate(text: Column, label: Column) -> Column:
    """struct(prio, s, e): highest priority, then shortest, then first candidate."""
    found = []
    n = F.length(text)
    for i, (cls, pattern, prio, padded) in enumerate(candidates()):
        def cand(sp: Column, i=i, prio=prio, padded=padded) -> Column:
            s = F.greatest(sp["s"] - PAD_BEFORE, F.lit(0)) if padded else sp["s"]
            e = F.least(sp["e"] + PAD_AFTER, n) if padded else sp["e"]
            return F.struct(F.lit(prio).alias("prio"), (s - e).alias("short"), F.lit(-i).alias("o"), s.cast("int").alias("s"), e.cast("int").alias("e"))
        one = let(first_span(text, pattern), _guard(cand, cls if needs_anchor(i) else None))
        found.append(F.when(label == cls, one) if cls else one)
    at = F.regexp_instr(text, F.lit(SPECIAL))
    special = F.when(at > 0, F.struct(F.lit(0.0).alias("prio"), F.lit(0).alias("short"), F.lit(0).alias("o"), F.greatest(at - 3, F.lit(0)).cast("int").alias("s"), F.least(at + 11, n).cast("int").alias("e")))
    head = F.struct(F.lit(-1.0).alias("prio"), F.lit(0).alias("short"), F.lit(0).alias("o"), F.lit(0).alias("s"), F.least(F.lit(40), n).cast("int").alias("e"))
    best = F.coalesce(F.array_max(F.array_compact(F.array(*found))), special, head)
    return let(best, lambda b: F.struct(b["prio"].alias("prio"), b["s"].alias("s"), b["e"].alias("e")))


def _guard(cand, cls: str | None):
    def go(sp: Column) -> Column:
        ok = sp.isNotNull() if cls is None else sp.isNotNull() & has_anchor(sp["span"], cls)
        return F.when(ok, cand(sp))
    return go


def refine(text: Column, label: Column, s: Column, e: Column) -> Column:
    """struct(s, e): tightest anchor inside the span."""
    sub = F.substr(text, s + 1, e - s)

    def inside(pattern: str) -> Column:
        return let(first_span(sub, pattern), lambda sp: F.when(sp.isNotNull(), F.struct((s + sp["s"]).cast("int").alias("s"), (s + sp["e"]).cast("int").alias("e"))))
    picks = [inside(r"(?i)union\s+select"), inside(r"(?i)ignore\s+previous"), inside("(?i)entity")]
    for cls, words in ANCHORS.items():
        for w in sorted(words, key=len, reverse=True):
            esc = "(?i)" + "".join("\\" + ch if ch in ".\\;|" else ch for ch in w)
            picks.append(F.when((label == cls) & (F.length(sub) >= len(w)), inside(esc)))
    return F.coalesce(*picks, F.struct(s.cast("int").alias("s"), e.cast("int").alias("e")))


def legacy(text: Column, label: Column) -> Column:
    """First pattern span of the class, else the first token with a special character (token index range)."""
    picks = []
    for cls, ps in SPAN_PATTERNS.items():
        for p in ps:
            picks.append(F.when(label == cls, let(first_span(text, f"(?i){p}"), lambda sp: F.when(sp.isNotNull(), F.struct(sp["span"].alias("span"), sp["s"].cast("int").alias("s"), sp["e"].cast("int").alias("e"))))))
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    hit = let(F.filter(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].rlike("[<>'\";%]")),
              lambda hs: F.when(F.size(hs) > 0, F.struct(hs[0]["t"].alias("span"), hs[0]["i"].cast("int").alias("s"), (hs[0]["i"] + 1).cast("int").alias("e"))))
    return F.coalesce(*picks, hit, F.struct(F.substring(text, 1, 40).alias("span"), F.lit(0).alias("s"), F.lit(0).alias("e")))


def highlight(text: Column, s: Column, e: Column) -> Column:
    n = F.length(text)
    a = F.greatest(F.lit(0), F.least(s, n))
    b = F.greatest(a, F.least(e, n))
    marked = F.concat(F.substr(text, F.lit(1), a), F.lit("<mark class='mal'>"), F.substr(text, a + 1, b - a), F.lit("</mark>"), F.substr(text, b + 1))
    return F.when((s < 0) | (e <= s) | (text == ""), text).otherwise(marked)
