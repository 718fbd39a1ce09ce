"""Secret scan: three fixed patterns, and a pair of character Markov models for what the patterns miss.

The models are chains over character pairs: one of random strings, one of ordinary identifiers.  Their labelled
samples come from the texts themselves: values that the patterns found are random, long runs of letters and digits
outside any found span are ordinary.  Pairs are counted over all documents (one row per pair and class, whatever the
input), and become one array literal of log-likelihood ratios, indexed by the pair's two codes.  A candidate run is a
secret if the mean ratio over its pairs, and the whole run's ratio, pass their thresholds.

Everything is DataFrame expressions over one row; only the pair counts shuffle.  Positions are code points: the text
is split at the matches, so a match starts after the lengths of all pieces and matches before it.

Defined cases: null text is empty and has no span; without samples of both classes the models add nothing; repeated
rows are scanned one by one; columns not named in ``keep`` are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.llm.common import saved

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_VALUE, MIN_ACCESS = 12, 18
# Candidates of the models: runs with letters and digits mixed; ordinary ones may be letters only.
CANDIDATE = r"[A-Za-z0-9_+/=-]{16,}"
CODES, ORDINARY, RANDOM = 128, "ordinary", "random"
MEAN_RATIO, RUN_RATIO = 0.5, 12.0
SPAN = "struct<kind:int,start:int,end:int,value:string>"


def _matches(text: Column, pattern: str, kind: int, keep, gate: str) -> Column:
    """Spans of all leftmost matches that ``keep`` accepts; nothing is split where the gate does not match."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    # Lengths of piece i and match i, summed from the left.
    steps = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("value")))
    placed = F.aggregate(
        F.filter(steps, lambda s: s["value"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + F.length(s["value"])).alias("at"),
            F.when(keep(s["value"]), F.concat(acc["out"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + F.length(s["value"])).alias("end"), s["value"].alias("value")))))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(gate), placed).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, in order of kind, then start; a span's value is what is secret in it."""
    assign = _matches(text, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= MIN_VALUE, ASSIGN)
    assign = F.transform(assign, lambda s: F.struct(s["kind"], s["start"], s["end"], F.regexp_extract(s["value"], ASSIGN_VALUE, 1).alias("value")))
    access = _matches(text, ACCESS, 1, lambda m: F.length(m) >= MIN_ACCESS, "AKIA[A-Z0-9]{14}")
    hexes = _matches(text, HEX, 2, lambda m: F.length(m) >= 16, HEX)
    return F.concat(assign, access, hexes)


def _outside(spans: Column, s: Column) -> Column:
    return ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def candidates(text: Column, spans: Column) -> Column:
    """Long runs that do not lie fully inside a pattern span."""
    inside = lambda s: F.exists(spans, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    return F.filter(_matches(text, CANDIDATE, 3, lambda m: F.lit(True), CANDIDATE), lambda s: ~inside(s))


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_base`` and ``_runs``; a one-row ``inline`` keeps both evaluated once for whatever reads them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    based = docs.select("*", F.inline(F.array(F.struct(base_spans(text).alias("_base")))))
    return based.select("*", F.inline(F.array(F.struct(candidates(text, F.col("_base")).alias("_runs")))))


def code_pairs(value: Column) -> Column:
    """first code * CODES + second code for all neighbours of a value, in time linear in its length."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    return F.get(F.transform(F.array(codes), lambda a: F.zip_with(
        F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x * CODES + y)), F.lit(0))


def pair_counts(scanned: DataFrame) -> DataFrame:
    """label, pair (first code * 128 + second code) and its count over all samples of all documents."""
    random = F.transform(F.col("_base"), lambda s: F.struct(F.lit(RANDOM).alias("label"), s["value"].alias("value")))
    # A run that touches a span is no ordinary sample.
    plain = F.transform(F.filter(F.col("_runs"), lambda s: _outside(F.col("_base"), s)), lambda s: F.struct(F.lit(ORDINARY).alias("label"), s["value"].alias("value")))
    # Runs that mix digits into letters are what the models have to judge; they are no labelled samples.
    plain = F.filter(plain, lambda s: ~(s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")))
    samples = scanned.select(F.inline(F.concat(random, plain)))
    return samples.where(F.length("value") > 1).select("label", F.explode(code_pairs(F.col("value"))).alias("pair")).groupBy("label", "pair").count()


def fit(docs: DataFrame) -> list[float] | None:
    """Log-likelihood ratio per pair of codes (128 x 128, a fixed size), from add-one smoothed transitions."""
    rows = saved(pair_counts(with_spans(docs.select("text")))).where(f"pair between 0 and {CODES * CODES - 1}").collect()
    counts = {ORDINARY: [0] * (CODES * CODES), RANDOM: [0] * (CODES * CODES)}
    for r in rows:
        counts[r.label][r.pair] += r["count"]
    if not all(map(any, counts.values())):
        return None
    alphabet = 64
    out = []
    sums = {k: [sum(v[a * CODES:(a + 1) * CODES]) for a in range(CODES)] for k, v in counts.items()}
    for pair in range(CODES * CODES):
        first = pair // CODES
        random, plain = ((counts[k][pair] + 1) / (sums[k][first] + alphabet) for k in (RANDOM, ORDINARY))
        out.append(round(math.log(random / plain), 6))
    return out


def markov_spans(runs: Column, ratios: list[float] | None) -> Column:
    """Runs that mix letters and digits and look random to the models."""
    if ratios is None:
        return F.expr(f"cast(array() as array<{SPAN}>)")
    table = F.from_json(F.lit(str(ratios)), "array<double>")  # folded to one constant

    def ratio(v: Column) -> Column:
        return F.aggregate(code_pairs(v), F.lit(0.0), lambda acc, pair: acc + F.get(table, pair))

    mixed = F.filter(runs, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rated = F.transform(mixed, lambda s: F.struct(s.alias("span"), ratio(s["value"]).alias("ratio")))
    good = F.filter(rated, lambda r: (r["ratio"] >= RUN_RATIO) & (r["ratio"] >= MEAN_RATIO * (F.length(r["span"]["value"]) - 1)))
    return F.transform(good, lambda r: r["span"])


def scan(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, ``base`` and ``spans``: arrays of (start, kind, end), sorted by start, then kind."""
    ratios = fit(docs)
    rows = with_spans(docs.select(*dict.fromkeys([*keep, "text"])))
    ordered = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return rows.select(*keep, F.inline(F.array(F.struct(ordered(F.col("_base")).alias("base"), ordered(F.concat("_base", markov_spans(F.col("_runs"), ratios))).alias("spans")))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every found span replaced by ``mask``; overlapping spans make one replacement."""
    done = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
