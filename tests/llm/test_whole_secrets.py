"""Secrets that reach beyond a pattern's span."""

import random
import string

from pyspark.sql import functions as F

from paysieve.llm import secrets


def test_a_run_that_only_overlaps_a_pattern_is_scored_and_masked_whole(docs_frame):
    r = random.Random(4)
    rnd = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    names = ["internationalization", "getUserAccountName", "configurationManager", "responseHandlerFactory", "maximumConnectionCount"]
    rows = [(i, f"token={rnd(32)} then {r.choice(names)}Of{r.choice(names)}") for i in range(300)]
    hexed, access = f"{rnd(20)}Z9c0de42d1f8a7b3e6Q{rnd(20)}", f"AKIA{'Q7ZK2M9X4T1B8W5R'}{rnd(30).lower()}"
    rows += [(1000, f"see {hexed} there"), (1001, f"see {access} there"), (1002, "see 0123456789abcdef there")]
    out = {x.doc_id: x.masked for x in secrets.scan(docs_frame(rows), "doc_id", "text").select("doc_id", secrets.masked(F.col("text"), F.col("spans")).alias("masked")).collect()}
    assert out[1000] == out[1001] == out[1002] == "see [secret] there"


def test_few_samples_do_not_switch_the_models_off(docs_frame):
    assert secrets.fit(docs_frame([(1, "token=Ab3dE5gH7jK9 and getUserAccountName")])) is not None
    assert secrets.fit(docs_frame([(1, "getUserAccountName only")])) is None


def test_models_equal_plain_loops(spark, docs_frame):
    """Pair counts, ratios and the spans that follow from them; a run of a megabyte takes seconds."""
    import math
    import random
    import re
    import time

    r = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    token = lambda n: "".join(r.choice(letters) for _ in range(n))
    name = lambda: "".join(r.choice(["get", "set", "user", "value", "index", "table", "count"]).capitalize() for _ in range(5)) + str(r.randrange(10))
    texts = [f"token={token(30)} then {token(40)} and {name()} or {name()[:-1]} end" for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = docs_frame(rows)
    scanned = secrets.with_spans(docs).cache()
    counts = {(x.label, x.pair): x["count"] for x in secrets.pair_counts(scanned).collect()}
    plain = {}
    for x in scanned.select("_base", "_runs").collect():
        samples = [(secrets.RANDOM, b.value) for b in x._base]
        for s in x._runs:
            touches = any(b.start < s.end and s.start < b.end for b in x._base)
            if not touches and not (re.search("[0-9]", s.value) and re.search("[A-Za-z]", s.value)):
                samples.append((secrets.ORDINARY, s.value))
        for label, v in samples:
            for a, b in zip(v, v[1:]):
                key = (label, ord(a) * secrets.CODES + ord(b))
                plain[key] = plain.get(key, 0) + 1
    assert counts == plain and any(k[0] == secrets.ORDINARY for k in plain)
    ratios = secrets.fit(docs)
    sums = {}
    for (label, pair), n in plain.items():
        sums[label, pair // secrets.CODES] = sums.get((label, pair // secrets.CODES), 0) + n
    share = lambda label, pair: (plain.get((label, pair), 0) + 1) / (sums.get((label, pair // secrets.CODES), 0) + 64)
    for pair in range(0, secrets.CODES ** 2, 7):
        assert abs(ratios[pair] - math.log(share(secrets.RANDOM, pair) / share(secrets.ORDINARY, pair))) < 1e-5
    found = {x.doc_id: [tuple(s) for s in x.spans] for x in secrets.scan(docs, "doc_id").collect()}
    runs = {x.doc_id: (x._base, x._runs) for x in scanned.select("doc_id", "_base", "_runs").collect()}
    for i, (base, own) in runs.items():
        want = [(b.start, b.kind, b.end) for b in base]
        for s in own:
            score = sum(ratios[ord(a) * secrets.CODES + ord(b)] for a, b in zip(s.value, s.value[1:]))
            if re.search("[0-9]", s.value) and re.search("[A-Za-z]", s.value) and score >= secrets.RUN_RATIO and score >= secrets.MEAN_RATIO * (len(s.value) - 1):
                want.append((s.start, s.kind, s.end))
        assert found[i] == sorted(want)
    assert any(s[1] == 3 for spans in found.values() for s in spans)
    long = token(1_000_000)
    began = time.time()
    table = secrets.F.from_json(secrets.F.lit(str(ratios)), "array<double>")
    score = secrets.F.aggregate(secrets.code_pairs(secrets.F.col("text")), secrets.F.lit(0.0), lambda acc, pair: acc + secrets.F.get(table, pair))
    got = docs_frame([(999, long)]).select(score.alias("score")).first().score
    assert abs(got - sum(ratios[ord(a) * secrets.CODES + ord(b)] for a, b in zip(long, long[1:]))) < 1e-3
    secrets.scan(docs_frame([(999, long)]), "doc_id").collect()
    assert time.time() - began < 60
