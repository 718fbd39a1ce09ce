"""Staged rule expressions (``rules``, ``fusion_rules``) as one program over Arrow batches.

``compile_stages`` parses the definitions into a list of steps in which equal sub-expressions stand once; ``evaluate`` runs it
over the columns of a batch.  Values, nulls (three-valued logic) and patterns mean what the Spark expressions mean: patterns are
rewritten so that RE2 matches what ``java.util.regex`` matches (ASCII case folding, ``.``, ``\\s``, ``$`` and ``\\b``).
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paysieve.functions import rules as R

TOKEN = re.compile(r"\s*('(?:[^']|'')*'|\d+(?:\.\d+)?D?|\w+|<>|>=|<=|[=<>+\-*/(),])")
COMPARE = {"=": "equal", "<>": "not_equal", ">=": "greater_equal", "<=": "less_equal", ">": "greater", "<": "less"}
ARITHMETIC = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide"}

# --- patterns ----------------------------------------------------------------------------------
BLANK = "\\t-\\r "
TERMINATORS = "\\n\\r\\x{85}\\x{2028}\\x{2029}"
WORD = "\\p{L}\\p{Nd}\\p{Mn}_"
ATOM = re.compile(r"\\x[0-9a-fA-F]{2}|\\p\{\w+\}|\\.|\[\^?(?:\\.|[^\]\\])+\]|\(\?[a-z]*:|\{\d+(?:,\d*)?\}|(?s:.)")


def _both_cases(body: str) -> str:
    """A character class with the letters of the other case."""
    extra = ""
    for item in re.findall(r"\\x[0-9a-fA-F]{2}|\\.|[A-Za-z]-[A-Za-z]|(?s:.)", body):
        if re.fullmatch(r"[A-Za-z](-[A-Za-z])?", item):
            extra += item.swapcase()
    return body + extra


def re2_pattern(java: str) -> str:
    """The RE2 form of a pattern that is only asked whether, or how often, it occurs."""
    flags = re.match(r"\(\?([a-z]+)\)", java)
    fold, dotall = (x in (flags[1] if flags else "") for x in "is")
    atoms = ATOM.findall(java[flags.end() if flags else 0:])
    out: list[str] = []
    for i, a in enumerate(atoms):
        before, after = (out[-1] if out else "("), (atoms[i + 1] if i + 1 < len(atoms) else "")
        if a == "\\b":
            if before in ("(", "|") or before.endswith(":"):
                # In front of a word; as an alternative of its own, behind one.
                a = f"(?:\\A|[^{WORD}])" if after not in ("|", ")") else f"(?:\\z|[^{WORD}])"
            else:
                a = "" if after == "\\s" else f"(?:\\z|[^{WORD}])"
        elif a == "\\s":
            a = f"[{BLANK}]"
        elif a == ".":
            a = "(?s:.)" if dotall else f"[^{TERMINATORS}]"
        elif a == "$":
            a = f"(?:\\r\\n|[{TERMINATORS}])?\\z"
        elif a == "^":
            a = "\\A"
        elif a.startswith("[") and len(a) > 1:
            body = a[2:-1] if a[1] == "^" else a[1:-1]
            a = ("[^" if a[1] == "^" else "[") + (_both_cases(body) if fold else body).replace("\\s", BLANK) + "]"
        elif fold and re.fullmatch("[A-Za-z]", a):
            a = f"[{a.lower()}{a.upper()}]"
        out.append(a)
    return "".join(out)


def any_literal(words) -> str:
    return "|".join(re.escape(w) for w in words)


# --- parser ------------------------------------------------------------------------------------
class Program(NamedTuple):
    steps: list          # (operation, arguments); arguments that are steps come as their numbers
    outputs: list        # step of each wanted column
    columns: list        # input columns
    free: list           # steps no longer needed after a step


class _Parser:
    def __init__(self) -> None:
        self.steps: list = []
        self.known: dict = {}
        self.names: dict = {}

    def node(self, *step) -> int:
        if step not in self.known:
            self.known[step] = len(self.steps)
            self.steps.append(step)
        return self.known[step]

    def value(self, v) -> int:
        return self.node("value", v, type(v).__name__)  # 1, 1.0 and TRUE are different values

    def name(self, n: str) -> int:
        return self.names[n] if n in self.names else self.node("column", n)

    def parse(self, text: str) -> int:
        self.tokens, self.at, text = [], 0, text.strip()
        pos = 0
        while pos < len(text):
            m = TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"cannot read {text[pos:pos + 40]!r}")
            self.tokens.append(m[1])
            pos = m.end()
        out = self.either()
        if self.at != len(self.tokens):
            raise ValueError(f"left over: {self.tokens[self.at:self.at + 8]}")
        return out

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *expected: str) -> str:
        t = self.peek()
        if expected and t not in expected:
            raise ValueError(f"{t!r} instead of {expected}")
        self.at += 1
        return t

    def ahead(self, *tokens: str) -> bool:
        if self.peek() in tokens:
            self.at += 1
            return True
        return False

    def either(self) -> int:
        out = self.both()
        while self.ahead("OR"):
            out = self.node("or_kleene", out, self.both())
        return out

    def both(self) -> int:
        out = self.negated()
        while self.ahead("AND"):
            out = self.node("and_kleene", out, self.negated())
        return out

    def negated(self) -> int:
        return self.node("invert", self.negated()) if self.ahead("NOT") else self.compared()

    def compared(self) -> int:
        left = self.added()
        if self.peek() in COMPARE:
            op = COMPARE[self.take()]
            return self.node(op, left, self.added())
        if self.ahead("IS"):
            negative = self.ahead("NOT")
            self.take("NULL")
            return self.node("is_valid" if negative else "is_null", left)
        if self.ahead("IN"):
            self.take("(")
            out = self.node("equal", left, self.added())
            while self.take(",", ")") == ",":
                out = self.node("or_kleene", out, self.node("equal", left, self.added()))
            return out
        if self.ahead("BETWEEN"):
            low = self.node("greater_equal", left, self.added())
            self.take("AND")
            return self.node("and_kleene", low, self.node("less_equal", left, self.added()))
        return left

    def added(self) -> int:
        out = self.multiplied()
        while self.peek() in ("+", "-"):
            op = self.take()
            out = self.arithmetic(op, out, self.multiplied())
        return out

    def multiplied(self) -> int:
        out = self.primary()
        while self.peek() in ("*", "/"):
            op = self.take()
            out = self.arithmetic(op, out, self.primary())
        return out

    def arithmetic(self, op: str, a: int, b: int) -> int:
        # length(x) - length(replace(x, t, '')) counts t
        if op == "-" and self.steps[a][0] == self.steps[b][0] == "length" and self.steps[self.steps[b][1]][0] == "replace":
            _, x, token, to = self.steps[self.steps[b][1]]
            if x == self.steps[a][1] and to == "":
                return self.node("count", x, token)
        return self.node(ARITHMETIC[op], a, b)

    def primary(self) -> int:
        t = self.take()
        if t == "(":
            out = self.either()
            self.take(")")
            return out
        if t in ("TRUE", "NULL"):
            return self.value(True if t == "TRUE" else None)
        if t == "CASE":
            return self.case()
        if t[0] == "'":
            return self.value(t[1:-1].replace("''", "'"))
        if t[0].isdigit():
            return self.value(float(t.rstrip("D")) if "." in t or t[-1] == "D" else int(t))
        if self.ahead("("):
            return self.call(t)
        return self.name(t)

    def case(self) -> int:
        rows, other = [], self.value(None)
        while self.ahead("WHEN"):
            condition = self.either()
            self.take("THEN")
            rows.append((condition, self.either()))
        if self.ahead("ELSE"):
            other = self.either()
        self.take("END")
        for condition, value in reversed(rows):
            other = value if self.steps[condition] == ("value", True, "bool") else self.node("choose", condition, value, other)
        return other

    def text(self) -> str:
        t = self.take()
        if t[:1] != "'":
            raise ValueError(f"{t!r} is no literal")
        return t[1:-1].replace("''", "'")

    def call(self, f: str) -> int:
        if f in ("rx", "nrx", "anyof", "nof"):
            column = self.name(self.take())
            self.take(",")
            name = self.take()
            self.take(")")
            if f == "anyof":
                return self.node("any", column, name)
            if f == "nof":
                return self.node("some", column, name)
            return self.node(f, column, name, self.gate(column, name))
        if f == "lower":
            out = self.node("column", f"lower_{self.take()}")  # Java's lower case, made by Spark
            self.take(")")
            return out
        args = [self.either()]
        while self.take(",", ")") == ",":
            if f == "contains":
                args.append(self.text())
            elif f == "replace":
                args.append(self.text())
            else:
                args.append(self.either())
        if f not in ("contains", "replace", "length", "ltrim", "rtrim", "trim", "right", "substr", "greatest", "least", "coalesce"):
            raise ValueError(f"no function {f}")
        return self.node(f, *args)

    def gate(self, column: int, name: str) -> int:
        """Step that is true wherever the pattern may match, or -1."""
        found = -1
        for word in R.GATES.get(name, ()) if len(R.GATES.get(name, ())) <= 3 else ():
            hit = self.node("contains", column, word)
            found = hit if found < 0 else self.node("or_kleene", found, hit)
        return self.node("wide", column) if found < 0 and name in R.WIDE else found


STEPS_OF = {"column": (), "value": (), "any": (1,), "some": (1,), "rx": (1, 3), "nrx": (1, 3), "contains": (1,), "replace": (1,), "count": (1,)}


def arguments(step: tuple) -> list[int]:
    places = STEPS_OF.get(step[0], range(1, len(step)))
    return [step[i] for i in places if step[i] >= 0]


def compile_stages(stages: list, wanted: list[str]) -> Program:
    """Program for the wanted columns; each stage sees the columns of earlier ones."""
    p = _Parser()
    for stage in R.needed(wanted, stages):
        p.names.update({n: p.parse(text) for n, text in stage})
    outputs = [p.name(n) for n in wanted]
    used, todo = set(), list(outputs)
    while todo:
        i = todo.pop()
        if i not in used:
            used.add(i)
            todo += arguments(p.steps[i])
    order = sorted(used)
    number = {old: new for new, old in enumerate(order)}

    def renumbered(step: tuple) -> tuple:
        places = STEPS_OF.get(step[0], range(1, len(step)))
        return tuple(number[x] if i in places and x >= 0 else x for i, x in enumerate(step))
    steps = [renumbered(p.steps[i]) for i in order]
    outputs = [number[i] for i in outputs]
    last = {}
    for i, step in enumerate(steps):
        last.update(dict.fromkeys([i, *arguments(step)], i))
    free = [[] for _ in steps]
    for i, at in last.items():
        if i not in outputs:
            free[at].append(i)
    return Program(steps, outputs, sorted(s[1] for s in steps if s[0] == "column"), free)


# --- evaluation --------------------------------------------------------------------------------
def _where(hit: pa.Array, column: pa.Array, find, kind) -> pa.Array:
    """``find`` on the rows of a column where ``hit`` is true; zero elsewhere and null for null texts."""
    rows = np.flatnonzero(hit.fill_null(False).to_numpy(zero_copy_only=False))
    out = np.zeros(len(column), kind)
    if rows.size:
        out[rows] = find(column.take(pa.array(rows))).to_numpy(zero_copy_only=False)
    return pa.array(out, mask=column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None)


def _number(x):
    return x if pa.types.is_floating(x.type) else pc.cast(x, pa.float64())


def _divide(a, b):
    return pc.divide(_number(a), _number(b))


def _choose(hit, a, b):
    if isinstance(hit, pa.Scalar):
        return a if hit.as_py() else b
    if a.type != b.type:
        kind = a.type if pa.types.is_null(b.type) else b.type if pa.types.is_null(a.type) else pa.float64()
        a, b = (x if x.type == kind else x.cast(kind) for x in (a, b))
    return pc.if_else(hit.fill_null(False) if hit.null_count else hit, a, b)


def _count(x, token: str):
    n = pc.count_substring(x, token)
    return n if len(token) == 1 else pc.multiply(n, len(token))


def _some(x, name: str):
    words = R.MARKERS[name]

    def total(found):
        out = np.zeros(len(found), np.int32)
        for w in words:
            out += pc.match_substring(found, w).to_numpy(zero_copy_only=False)
        return pa.array(out)
    return _where(pc.match_substring_regex(x, any_literal(words)), x, total, np.int32)


def _matches(x, name: str, gate):
    if gate is None:
        return pc.match_substring_regex(x, PATTERN[name])
    return _where(gate, x, lambda t: pc.match_substring_regex(t, PATTERN[name]), bool)


def _times(x, name: str, gate):
    def count(t):
        return pc.count_substring_regex(t, PATTERN[name])
    return pc.cast(count(x), pa.int32()) if gate is None else _where(gate, x, count, np.int32)


class _Patterns(dict):
    def __missing__(self, name):
        self[name] = re2_pattern(R.PATTERNS[name])
        return self[name]


PATTERN = _Patterns()
OPERATIONS = {
    "any": lambda x, name: pc.match_substring_regex(x, any_literal(R.MARKERS[name])), "some": _some,
    "contains": lambda x, word: pc.match_substring(x, word), "replace": lambda x, a, b: pc.replace_substring(x, a, b), "count": _count,
    "wide": lambda x: pc.not_equal(pc.binary_length(x), pc.utf8_length(x)), "length": pc.utf8_length,
    "trim": lambda x: pc.utf8_trim(x, " "), "ltrim": lambda x: pc.utf8_ltrim(x, " "), "rtrim": lambda x: pc.utf8_rtrim(x, " "),
    "right": lambda x, n: pc.utf8_slice_codeunits(x, -n.as_py()), "substr": lambda x, at, n: pc.utf8_slice_codeunits(x, at.as_py() - 1, at.as_py() - 1 + n.as_py()),
    "greatest": lambda *x: pc.max_element_wise(*x), "least": lambda *x: pc.min_element_wise(*x), "coalesce": lambda *x: pc.coalesce(*[v for v in x if not pa.types.is_null(v.type)]),
    "divide": _divide, "choose": _choose, "is_null": lambda x: x.is_null(), "is_valid": lambda x: x.is_valid(),
    **{f: getattr(pc, f) for f in (*COMPARE.values(), "add", "subtract", "multiply", "and_kleene", "or_kleene", "invert")},
}


def evaluate(program: Program, columns: dict[str, pa.Array], rows: int) -> list[pa.Array]:
    """Arrays of the wanted columns."""
    values: list = [None] * len(program.steps)
    for i, step in enumerate(program.steps):
        op = step[0]
        if op == "column":
            values[i] = columns[step[1]]
        elif op == "value":
            values[i] = pa.scalar(step[1])
        elif op in ("rx", "nrx"):
            values[i] = (_matches if op == "rx" else _times)(values[step[1]], step[2], values[step[3]] if step[3] >= 0 else None)
        elif op in STEPS_OF:
            values[i] = OPERATIONS[op](values[step[1]], *step[2:])
        else:
            values[i] = OPERATIONS[op](*[values[j] for j in step[1:]])
        for j in program.free[i]:
            values[j] = None
    return [pa.repeat(values[i], rows) if isinstance(values[i], pa.Scalar) else values[i] for i in program.outputs]


def score_batches(program: Program, keep: int, derived, prefix: str):
    """Function over record batches: the first ``keep`` columns unchanged, then the wanted ones as out_*.

    The other columns are inputs under ``prefix``; ``derived`` makes further inputs of them.
    """
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            inputs = {c[len(prefix):]: x for c, x in zip(names[keep:], batch.columns[keep:], strict=True)}
            found = evaluate(program, {**inputs, **derived(inputs)}, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *found], [*names[:keep], *[f"out_{i}" for i in range(len(found))]])
    return run
