"""Label inference and small label cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered label patterns, first match wins.
LABEL_PATTERNS = [
    (r"(?i)ignore\s+previous|jailbreak|system\s+prompt|do\s+anything\s+now", "PromptInjection"),
    (r"(?i)<!entity|&xxe;|<!doctype[^>]+entity", "XXE"),
    (r"(?i)php://|file://|expect://|zip://|data://", "FileInclusion"),
    (r"(?i)\.\./|/etc/passwd|/proc/self|%2e%2e", "PathTraversal"),
    (r"(?i);\s*(wget|curl|bash|sh|nc|cat|ls|id)\b|\|cat\b|\$\{jndi|&&\s*\w+", "CMD"),
    (r"(?i)<script|onerror\s*=|onload\s*=|javascript:|<svg|<img[^>]+on\w+\s*=", "XSS"),
    (r"(?i)union\s+select|'\s*or\s+'|;\s*drop\s+|insert\s+into|sleep\s*\(|benchmark\s*\(|extractvalue\s*\(|updatexml\s*\(|'\s*=\s*'|information_schema", "SQLi"),
]
# Raw label spellings.
BENIGN_SPELLINGS = ["Normal", "norm", "0", "benign", "good"]
UNTYPED_ATTACK_SPELLINGS = ["anom", "1", "attack", "malicious"]
UNTYPED_DEFAULT = "SQLi"


def first_match(pairs: list[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    start = F.when(pairs[0][0], pairs[0][1])
    out = reduce(lambda acc, p: acc.when(p[0], p[1]), pairs[1:], start)
    return out.otherwise(default) if default is not None else out


def infer_label(text: Column, raw: Column | None = None, untyped_default: str = UNTYPED_DEFAULT) -> Column:
    raw = F.lit("") if raw is None else F.trim(F.coalesce(raw, F.lit("")))
    untyped = raw.isin(UNTYPED_ATTACK_SPELLINGS)
    by_text = first_match([(text.rlike(p), F.lit(lab)) for p, lab in LABEL_PATTERNS],
                          F.when(untyped, untyped_default).otherwise("Normal"))
    return first_match([
        (raw.isin(BENIGN_SPELLINGS), F.lit("Normal")),
        ((raw != "") & ~untyped, raw),
        (F.coalesce(text, F.lit("")).rlike(r"^\s*$"), F.lit("Normal")),
    ], by_text)
