"""Bounded decoding as Spark columns (used by the normalise job).

Every function maps a Column to a Column.  ``let`` binds an intermediate value inside one
expression, so that a decode result which is both compared and kept is evaluated once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
STRAY_PERCENT = "%(?![0-9A-Fa-f]{2})"
WHITESPACE = " \t\n\r\x0b\x0c"

# Named character references handled by the entity step.
NAMED_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
    ("&lpar;", "("), ("&rpar;", ")"), ("&colon;", ":"), ("&sol;", "/"), ("&equals;", "="),
    ("&Tab;", "\t"), ("&NewLine;", "\n"),
]

# Upload signatures in front of disguised XML (as ISO-8859-1 text).
UPLOAD_MAGIC = ["ÿØÿÛ", "ÿØÿà", "ÿØÿî",
                "\u0089PNG\r\n\u001a\n", "GIF89a"]

FULLWIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(WHITESPACE))


def count_of(c: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal token."""
    n = F.length(c) - F.length(F.replace(c, F.lit(token), F.lit("")))
    return n if len(token) == 1 else (n / len(token)).cast("int")


def translated(c: Column, beyond_ascii: str, to: str) -> Column:
    """``translate`` of characters beyond ASCII; a text with as many bytes as characters has none."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.translate(c, beyond_ascii, to))


def fullwidth_to_ascii(c: Column) -> Column:
    return translated(c, FULLWIDTH + "　", ASCII + " ")


def url_plus(c: Column) -> Column:
    return F.url_decode(F.regexp_replace(c, STRAY_PERCENT, "%25"))


def url_percent(c: Column) -> Column:
    return F.url_decode(F.replace(F.regexp_replace(c, STRAY_PERCENT, "%25"), F.lit("+"), F.lit("%2B")))


def url_round(c: Column) -> Column:
    """One URL round is two decodes; runs of the replacement character become one."""
    return F.regexp_replace(url_percent(url_plus(c)), "�+", "�")


def url_triple(c: Column) -> Column:
    return url_round(url_round(url_round(c)))


def needs_triple(c: Column) -> Column:
    return c.contains("%2525") | (count_of(c, "%") >= 6)


def _fold_tokens(c: Column, pattern: str, decode: Callable[[Column], Column]) -> Column:
    """Replace each distinct token; longer tokens of a common prefix go first."""
    tokens = F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))), asc=False)
    return F.aggregate(tokens, c, lambda acc, t: F.replace(acc, t, F.coalesce(decode(t), t)))


def _char_from_hex(digits: Column) -> Column:
    """Character for a hex code point; null when it is not a valid scalar value."""
    padded = F.lpad(digits, 8, "0")
    ok = (F.length(digits) <= 6) & (padded <= "0010ffff") & ~padded.rlike("^0000d[89a-f]")
    return F.when(ok, F.decode(F.unhex(padded), "UTF-32"))


def _numeric_entity(token: Column) -> Column:
    body = F.lower(F.regexp_extract(token, "^&#[xX]?([0-9a-fA-F]+);?$", 1))
    is_hex = token.rlike("^&#[xX]")
    digits = F.when(is_hex, body).when(F.length(body) <= 9, F.lower(F.hex(body.cast("bigint"))))
    return _char_from_hex(digits)


def numeric_entities(c: Column, optional_semicolon: bool = True) -> Column:
    tail = ";?" if optional_semicolon else ";"
    return F.when(~c.contains("&#"), c).otherwise(_fold_tokens(c, f"&#(?:[xX][0-9a-fA-F]+|[0-9]+){tail}", _numeric_entity))


def html_unescape(c: Column) -> Column:
    for name, ch in NAMED_ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(ch))
    return F.replace(numeric_entities(c), F.lit("&amp;"), F.lit("&"))


def js_unicode(c: Column) -> Column:
    return F.when(~c.contains("\\u"), c).otherwise(_fold_tokens(c, r"\\u[0-9a-fA-F]{4}", lambda t: _char_from_hex(F.lower(F.substring(t, 3, 4)))))


def hex_escape(c: Column) -> Column:
    return F.when(~c.contains("\\x"), c).otherwise(_fold_tokens(c, r"\\x[0-9a-fA-F]{2}", lambda t: F.decode(F.unhex(F.substring(t, 3, 2)), "ISO-8859-1")))


def base64_text(c: Column) -> Column:
    """UTF-8 text of a strict base64 string, else null."""
    raw = F.when((F.length(c) % 4 == 0) & c.rlike("^[A-Za-z0-9+/]+={0,2}$"), F.try_to_binary(c, F.lit("base64")))
    return let(raw, lambda b: F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")))


def base64_whole(c: Column) -> Column:
    ok = c.rlike("^[A-Za-z0-9+/=]{8,}$")
    return F.when(ok, let(base64_text(c), lambda d: F.when(d.rlike(r"^(?:[^\p{C}\p{Z}]| )+$"), d)))


def atob_inner(c: Column) -> Column:
    """Text inside a quoted atob(...) call, decoded; null when absent or not decodable."""
    token = F.regexp_extract(c, r"(?i)atob\(['\"]([A-Za-z0-9+/=]+)['\"]\)", 1)
    return F.when(token != "", base64_text(token))


def encoded_nulls(c: Column) -> Column:
    return F.regexp_replace(c, "%(?:25)*00", "\u0000")


def decode_once(c: Column) -> Column:
    """struct(cur, step): the first step that changes the stripped text wins."""
    def changed(s: Column, gate: Column, candidate: Column, step: str) -> Column:
        return F.when(gate, let(candidate, lambda v: F.when(v != s, F.struct(v.alias("cur"), F.lit(step).alias("step")))))

    def pick(s: Column) -> Column:
        low = F.lower(s)
        return F.coalesce(
            changed(s, low.contains("atob("), atob_inner(s), "atob_decode"),
            changed(s, s.contains("%") & needs_triple(s), url_triple(s), "triple_url_decode"),
            changed(s, s.contains("%"), url_round(s), "url_decode"),
            changed(s, s.rlike("%(?:25)*00"), encoded_nulls(s), "encoded_null_byte"),
            changed(s, s.contains("&") & s.contains(";"), html_unescape(s), "html_entity"),
            changed(s, low.contains("\\u"), js_unicode(s), "js_unicode"),
            changed(s, low.contains("\\x"), hex_escape(s), "hex_escape"),
            changed(s, s.rlike("^[A-Za-z0-9+/=]{8,}$"), base64_whole(s), "base64"),
            F.struct(s.alias("cur"), F.lit(None).cast("string").alias("step")),
        )
    return let(strip(c), pick)


def null_interleaved(c: Column) -> Column:
    n = count_of(c, "\u0000")
    return (n >= 3) & (n / F.greatest(F.length(c), F.lit(1)) >= 0.08)


def strip_nulls(c: Column) -> Column:
    return F.when(null_interleaved(c), F.replace(c, F.lit("\u0000"), F.lit(""))).otherwise(c)


def magic_step(c: Column) -> Column:
    """struct(cur, step) for the upload-signature / binary-prefix strip."""
    def out(v: Column, step: str) -> Column:
        return F.struct(v.alias("cur"), F.lit(step).alias("step"))
    branches = None
    for magic in UPLOAD_MAGIC:
        rest = F.ltrim(F.substring(c, len(magic) + 1, 2 ** 31 - 1), F.lit("\u0000\r\n\t "))
        cond = F.startswith(c, F.lit(magic))
        branches = F.when(cond, out(rest, "upload_magic_strip")) if branches is None \
            else branches.when(cond, out(rest, "upload_magic_strip"))
    at = F.locate("<?xml", F.lower(c))
    branches = branches.when((at > 1) & (at <= 65), out(F.substr(c, at), "binary_prefix_strip"))
    return branches.otherwise(F.struct(c.alias("cur"), F.lit(None).cast("string").alias("step")))


def xml_entities(c: Column, rounds: int = 4) -> Column:
    """struct(cur, n): numeric references expanded until stable, n = rounds that changed the text."""
    zero = F.struct(c.alias("cur"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(st: Column, _i: Column) -> Column:
        return F.when(st["done"], st).otherwise(let(
            numeric_entities(st["cur"], optional_semicolon=False),
            lambda v: F.struct(v.alias("cur"), (st["n"] + (v != st["cur"]).cast("int")).alias("n"),
                               (v == st["cur"]).alias("done"))))
    plain = F.struct(c.alias("cur"), F.lit(0).alias("n"))
    return F.when(~c.contains("&#"), plain).otherwise(let(
        F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, step),
        lambda st: F.struct(st["cur"].alias("cur"), st["n"].alias("n"))))


def _chain(*items: Column) -> Column:
    return F.array_compact(F.array(*[i.cast("string") for i in items]))


# Text without any of these marks cannot be changed by a decode round (strip excepted).
MAY_DECODE = r"[%&\\]|(?i:atob\()|^\s*[A-Za-z0-9+/=]{8,}\s*$"


def decode_fixpoint(raw: Column, rounds: int = ROUNDS) -> Column:
    """struct(cur, chain): full-width fold, then up to ``rounds`` decode rounds, then clean-up."""
    empty = F.array().cast("array<string>")

    def run(fw: Column) -> Column:
        zero = F.struct(fw.alias("cur"), empty.alias("chain"), F.lit(False).alias("done"))

        def body(st: Column, _i: Column) -> Column:
            return F.when(st["done"], st).otherwise(let(
                decode_once(st["cur"]),
                lambda r: F.struct(
                    r["cur"].alias("cur"),
                    F.when(r["step"].isNull(), st["chain"]).otherwise(F.concat(st["chain"], F.array(r["step"]))).alias("chain"),
                    (r["cur"] == st["cur"]).alias("done"))))
        return F.when(fw.rlike(MAY_DECODE), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, body)) \
            .otherwise(F.struct(strip(fw).alias("cur"), empty.alias("chain"), F.lit(True).alias("done")))

    def clean(fw: Column, st: Column) -> Column:
        return let(strip_nulls(st["cur"]), lambda nn: let(magic_step(nn), lambda mg: let(xml_entities(mg["cur"]), lambda xe: F.struct(
            xe["cur"].alias("cur"),
            F.concat(
                _chain(F.when(fw != raw, "fullwidth_norm")), st["chain"],
                _chain(F.when(nn != st["cur"], "null_interleave_strip"), mg["step"]),
                F.array_repeat(F.lit("xml_entity_expand"), xe["n"])).alias("chain")))))
    return let(fullwidth_to_ascii(raw), lambda fw: let(run(fw), lambda st: clean(fw, st)))


def _char_list(token: Column, quote: str) -> Column:
    nums = F.filter(F.transform(F.split(F.regexp_extract(token, r"\(([\d,\s]+)\)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(F.transform(nums, lambda n: F.coalesce(
        F.when(F.length(n) <= 7, _char_from_hex(F.lower(F.hex(n.cast("bigint"))))), F.lit(""))), "")
    return F.concat(F.lit(quote), text, F.lit(quote)) if quote else text


def charcode_text(c: Column) -> Column:
    return F.when(~F.lower(c).contains("fromcharcode("), c).otherwise(
        _fold_tokens(c, r"(?i)String\.fromCharCode\([\d,\s]+\)", lambda t: _char_list(t, '"')))


def sql_char_text(c: Column) -> Column:
    return F.when(~F.lower(c).contains("char("), c).otherwise(
        _fold_tokens(c, r"(?i)char\([\d,\s]+\)", lambda t: _char_list(t, "")))


def join_literals(c: Column) -> Column:
    """'a'+'b' becomes ab, at most ten passes."""
    pattern = "(['\"])(.*?)\\1\\s*\\+\\s*(['\"])(.*?)\\3"
    loop = F.aggregate(F.sequence(F.lit(1), F.lit(10)), c, lambda acc, _i: F.regexp_replace(acc, pattern, "$2$4"))
    return F.when(c.rlike("['\"]\\s*\\+\\s*['\"]"), loop).otherwise(c)


def eval_inner(c: Column) -> Column:
    hit = c.rlike(r"(?is)eval\s*\(\s*.+?\s*\)")
    inner = F.regexp_extract(c, r"(?is)eval\s*\(\s*(.+?)\s*\)", 1)
    return F.when(hit, F.trim(F.trim(strip(inner), F.lit('"')), F.lit("'"))).otherwise(c)


# Every step of ``decoded`` needs one of these marks (a character beyond ASCII, NUL, % & ( + \\, a markup or upload
# signature, or a whole base64 text); without them only the strip is left.
MARKED = r"[^\x01-\x24\x27\x29\x2a\x2c-\x5b\x5d-\x7f]|<\?|GIF89a|^\s*[A-Za-z0-9+/=]{8,}\s*$"


def normalise(raw: Column, rounds: int = ROUNDS) -> Column:
    """struct(norm, chain): decode fixpoint followed by the four code-level restorers."""
    plain = F.struct(strip(raw).alias("norm"), F.array().cast("array<string>").alias("chain"))
    return F.when(~raw.rlike(MARKED), plain).otherwise(decoded(raw, rounds))


def decoded(raw: Column, rounds: int = ROUNDS) -> Column:
    """``normalise`` step by step, for a text with any marks."""
    def restore(d: Column) -> Column:
        return let(charcode_text(d["cur"]), lambda a: let(sql_char_text(a), lambda b: let(join_literals(b), lambda e: let(
            eval_inner(e), lambda f: F.struct(f.alias("norm"), F.concat(d["chain"], _chain(
                F.when(a != d["cur"], "js_charcode"), F.when(b != a, "sql_char"),
                F.when(e != b, "string_concat"), F.when(f != e, "eval_unwrap"))).alias("chain"))))))
    return let(decode_fixpoint(raw, rounds), restore)


def fold_homoglyphs(c: Column) -> Column:
    return translated(c, FULLWIDTH + "еоа�", ASCII + "eoa")


def concat_reassembled(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"'\s*\+\s*'", ""), r"\s*\+\s*", "")


def log4j_expand(c: Column) -> Column:
    def token(t: Column) -> Column:
        ch = F.substring(t, -2, 1)
        return F.when(F.lower(F.substring(t, 3, 1)) == "l", F.lower(ch)).otherwise(F.upper(ch))
    loop = F.aggregate(F.sequence(F.lit(1), F.lit(16)), c,
                       lambda acc, _i: _fold_tokens(acc, r"(?i)\$\{(?:lower|upper):[^}]\}", token))
    return F.when(F.lower(c).rlike(r"\$\{(?:lower|upper):"), loop).otherwise(c)


def decode_variants(c: Column) -> Column:
    """Distinct list: raw, up to six successive percent decodes, expanded forms of last and raw."""
    zero = F.array(c)
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(6)), zero,
                        lambda acc, _i: let(url_percent(F.element_at(acc, -1)),
                                            lambda v: F.when(v == F.element_at(acc, -1), acc).otherwise(F.concat(acc, F.array(v)))))
    plain = F.array(c)
    walked = F.when(c.contains("%"), steps).otherwise(plain)
    full = let(walked, lambda a: F.concat(a, F.array(log4j_expand(F.element_at(a, -1)), log4j_expand(c))))
    return F.filter(F.array_distinct(full), lambda v: v != "")


def encoding_depth(c: Column) -> Column:
    zero = F.struct(c.alias("cur"), F.lit(0).alias("n"))
    loop = F.aggregate(F.sequence(F.lit(1), F.lit(6)), zero, lambda st, _i: let(
        url_plus(st["cur"]),
        lambda v: F.when(v == st["cur"], st).otherwise(F.struct(v.alias("cur"), (st["n"] + 1).alias("n")))))
    return F.when(c.rlike("[%+]"), loop["n"]).otherwise(F.lit(0))


def percent_layers(c: Column, rounds: int = 3) -> Column:
    for _ in range(rounds):
        c = url_percent(c)
    return c
