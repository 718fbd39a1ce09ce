"""Regex rules behind an index of required literals.

Of each pattern the longest literal that every match holds is found, and one of its three-character grams becomes the
rule's key.  A text's grams are intersected with the keys of all rules; only rules whose gram occurs are run, besides
those without a literal.  So the cost of a text grows with its length and the rules that may match it, not with the table.

Rules are user data of a bounded size: ``bounded_rules`` collects them and refuses tables of more than ``MAX_RULES`` rows or
``MAX_RULE_CHARS`` characters of pattern.  They reach the tasks as constants of the plan.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_parse as parser

MAX_RULES, MAX_RULE_CHARS, GRAM = 5000, 1 << 20, 3
GRAMS = r"(?s)(?=(.{3}))"  # every place of a text


def _runs(tree, fold: bool) -> list[str]:
    """Literals that stand in every match of a parsed pattern."""
    runs, run = [], ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL" and (not fold or arg < 128):
            run += chr(arg).lower() if fold else chr(arg)
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):  # of no width: what stands around it is adjacent
            continue
        runs.append(run)
        run = ""
        if name == "SUBPATTERN" and not arg[1] and not arg[2]:
            runs += _runs(arg[3], fold)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            runs += _runs(arg[2], fold)
    return [*runs, run]


def required_literal(pattern: str) -> str | None:
    """The longest literal in every match of a pattern on lower-cased text; None where there is none of ``GRAM`` characters."""
    if pattern.startswith("\\Q") and pattern.endswith("\\E") and "\\E" not in pattern[2:-2]:
        runs = [pattern[2:-2]]
    else:
        try:
            tree = parser.parse(pattern)
        except (re.error, OverflowError):  # syntax of the other engine only: such a rule is always run
            return None
        if tree.state.flags & (re.VERBOSE | re.MULTILINE):
            return None
        runs = _runs(tree, bool(tree.state.flags & re.IGNORECASE))
    best = max(runs, key=len)
    return best if len(best) >= GRAM else None


def bounded_rules(rules: DataFrame) -> list:
    """Rows of a rule table that stays within its bounds."""
    rows = rules.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES or sum(len(r.pattern) for r in rows) > MAX_RULE_CHARS:
        raise ValueError(f"a rule table holds at most {MAX_RULES} rules and {MAX_RULE_CHARS} characters of pattern")
    return rows


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def matching(patterns: list[str], *texts: str) -> Column:
    """Ascending numbers of the patterns found in any of the (lower-cased) text columns."""
    none = F.expr("cast(array() as array<int>)")
    if not patterns:
        return none
    literals = [required_literal(p) for p in patterns]
    common = Counter(g for x in literals if x for g in {x[i:i + GRAM] for i in range(len(x) - GRAM + 1)})
    always, by_gram = [], {}
    for n, x in enumerate(literals):
        if x is None:
            always.append(n)
        else:  # the gram that fewest rules hold
            gram = min((x[i:i + GRAM] for i in range(len(x) - GRAM + 1)), key=lambda g: (common[g], g))
            by_gram.setdefault(gram, []).append(n)
    candidates = _constant(always, "array<int>")
    if by_gram:
        grams = F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(GRAMS), 1) for t in texts]))
        hits = F.array_intersect(_constant(sorted(by_gram), "array<string>"), grams)
        numbers = _constant(by_gram, "map<string,array<int>>")
        candidates = F.array_sort(F.concat(candidates, F.flatten(F.transform(hits, lambda g: F.element_at(numbers, g)))))
    table = _constant(patterns, "array<string>")

    def found(n: Column) -> Column:
        out = F.lit(False)
        for t in texts:
            out = out | F.coalesce(F.regexp_like(F.col(t), F.get(table, n)), F.lit(False))
        return out

    return F.filter(candidates, found)
