"""Operators over the corpus: near duplicates, decontamination, toxicity, pipeline, SQL."""

import random
import re
import string
from zlib import crc32

import numpy as np
import pytest

from paysieve.llm import decontaminate, near_dup, toxicity
from paysieve.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute_groups(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        if w and i is not None:
            sets.setdefault(i, []).append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))})
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in sets}


def edited(r, words, share):
    return [r.choice("pqrs") + str(r.randrange(1000)) if r.random() < share else w for w in words]


def test_components_equal_brute_force(docs_frame, edge_rows):
    """Copies, near copies around the limit, chains, one large group, and texts that share much but too little."""
    r = random.Random(4)
    rows, n = list(edge_rows), 100
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(3, 300))]
        for _ in range(r.randrange(1, 8)):
            words = edited(r, words, r.choice([0, 0.005, 0.01, 0.03]))
            rows.append((n, " ".join(words)))
            n += 1
    hub = [f"h{i}" for i in range(120)]
    for _ in range(120):
        rows.append((n, " ".join(edited(r, hub, r.choice([0, 0.01, 0.02, 0.04])))))
        n += 1
    out = near_dup.groups(docs_frame(rows)).collect()
    assert len(out) == len(rows)
    expected = brute_groups(rows)
    for x in out:
        assert x.component_id == (None if x.doc_id is None else expected.get(x.doc_id, x.doc_id)), x
        assert x.kept == (x.doc_id is None or x.doc_id == x.component_id)
    assert near_dup.groups(docs_frame([])).collect() == []


def test_small_blocks_find_the_same(docs_frame, monkeypatch):
    r = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(r, base, 0.03))) for i in range(150)]
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    expected = brute_groups(rows)
    assert {x.doc_id: x.component_id for x in near_dup.groups(docs_frame(rows)).collect()} == expected


def test_odd_sketches_estimate_similarity():
    r = random.Random(1)
    for share in (0.95, 0.85, 0.75, 0.65):
        errors = []
        for _ in range(40):
            common = [r.getrandbits(63) for _ in range(int(600 * share))]
            rest = 600 - len(common)
            a, b = (np.unique(np.array(common + [r.getrandbits(63) for _ in range(rest // 2)], dtype=np.uint64)) for _ in range(2))
            x, y = (near_dup.odd_sketch(near_dup.signature(v)).view(np.uint64) for v in (a, b))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(near_dup.estimate(int(np.bitwise_count(x ^ y).sum())) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.07


def spans(words):
    return {tuple(words[i:i + 13]) for i in range(len(words) - 12)} if len(words) >= 13 else ({tuple(words)} if words else set())


def test_contamination_equals_brute_force(spark, docs_frame, edge_rows):
    r = random.Random(6)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 3, 7, 12, 13, 14, 20, 40, 60, 13, 7])] + [(50, None), (None, "v1 v2"), (9, "v3"), (51, "a a a a a a a a a a a a a a a")]
    rows = list(edge_rows)
    for n in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            source = r.choice(items)[1] or ""
            w = source.split()
            a = r.randrange(len(w) + 1)
            parts += w[a:a + r.choice([5, 12, 13, 14, 25, 60])] + [r.choice(vocabulary + ["a"]) for _ in range(r.randrange(6))]
        rows.append((200 + n, ", ".join(parts)))
    rows.append((900, "A a a a a a a a a a a a a a a a a a a a b"))
    frame = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, key int")
    out = decontaminate.judge(docs_frame(rows), frame).collect()
    assert len(out) == len(rows)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(spans(split(t)))
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t)
    for x in out:
        fits = False
        for t in texts[x.doc_id]:
            w = split(t)
            hit, ids = set(), set()
            for i, s in wanted.items():
                for one in s:
                    for a in range(len(w) - len(one) + 1):
                        if tuple(w[a:a + len(one)]) == one:
                            hit |= set(range(a, a + len(one)))
                            ids.add(str(i))
            fits |= (x.n_words, x.n_hit, list(x["items"]), x.contaminated) == (len(w), len(hit), sorted(ids), len(hit) > 0 and 20 * len(hit) >= len(w))
        assert fits, x
    assert decontaminate.judge(docs_frame([]), frame).collect() == []
    assert not any(x.contaminated for x in decontaminate.judge(docs_frame(rows), frame.limit(0)).collect())


def toxic_corpus(r, n):
    stems = ["groll", "zarfe", "mukto"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice(["ba", "ki", "lo", "ne", "ti", "su"]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(5, 60))]
        bad = i % 3 == 0
        for _ in range(2 if bad else 0):
            words[r.randrange(len(words))] = r.choice(stems) + r.choice(["", "en", "ist", "ba", "tio"])
        rows.append((i, " ".join(words), r.choice(["en", "de"])))
        labels.append((i, int(bad)))
    return rows, labels


def test_classifier_learns_from_its_own_rows_only(spark, docs_frame, edge_rows):
    rows, labels = toxic_corpus(random.Random(12), 900)
    lab = spark.createDataFrame([(*x, 1, "z") for x in labels] + [(None, 1, 1, "z"), (3, None, 1, "z")], "doc_id long, toxic int, quality int, lang string")
    net = toxicity.train(docs_frame(rows), lab)
    flipped = lab.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert np.array_equal(net.table, toxicity.train(docs_frame(rows), flipped).table)
    scored = toxicity.score(docs_frame(rows), net, "doc_id", "lang")
    found, truth = {r.doc_id: r.score for r in scored.collect()}, dict(labels)
    held = [i for i in truth if crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(found[i] >= toxicity.CUT) == truth[i] for i in held]) > 0.95
    cuts = toxicity.language_thresholds(scored, lab)
    assert set(cuts) == {None, "en", "de"} and all(0 < c < 1 for c in cuts.values())
    edge = toxicity.score(docs_frame(edge_rows), net, "doc_id").collect()
    assert len(edge) == len(edge_rows) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(docs_frame([]), net, "doc_id").collect() == []
    blank = toxicity.train(docs_frame(rows), lab.limit(0))
    assert {r.score for r in toxicity.score(docs_frame(rows[:5]), blank, "doc_id").collect()} == {0.0}


def test_scores_equal_plain_loops(monkeypatch):
    """Hashed rows, filters at every place, maxima and the logistic layer, word by word; groups of any size."""
    net, r = toxicity.TextCnn(3), np.random.default_rng(3)
    net.fitted, net.bias = True, r.normal(0, 0.3, net.bias.shape).astype("f4")
    texts = ["", None, "one", "Two words", "äö ü ßé a1b2 c", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 7)}" for i in range(200)), "a b c d"]

    def plain(text):
        words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        vectors = [np.mean([net.table[x].astype("f8") for x in toxicity.word_rows(w) if x < toxicity.BUCKETS], axis=0) for w in words]
        z = float(net.base)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                places = [sum(float(vectors[i + o] @ net.filters[k][o, :, f]) for o in range(width) if i + o < len(words)) + float(net.bias[k, f]) for i in range(len(words))]
                z += float(net.out[k * toxicity.FILTERS + f]) * max([0.0, *places])
        return 1 / (1 + np.exp(-z))
    want = [plain(t) for t in texts]
    for most in (3, 400_000):
        monkeypatch.setattr(toxicity, "TRAIN_WORDS", most)
        assert np.allclose(toxicity.Scorer(net).scores(texts), want, atol=1e-5)


def test_thresholds_shrink_toward_all_languages(spark):
    """Many labels set a language's own threshold, few hardly move it from the common one."""
    r = random.Random(6)
    rows = [(i, "big" if i % 2 else "other", min(0.999, max(0.0, r.gauss(0.75 if i % 10 == 0 else 0.2, 0.05)))) for i in range(6000)]
    rows += [(i, "shifted", min(0.999, max(0.0, r.gauss(0.95 if i % 10 == 0 else 0.6, 0.03)))) for i in range(6000, 9000)]
    rows += [(9000 + i, "few", 0.1 * i) for i in range(5)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0 and i < 9000)) for i, _, _ in rows], "doc_id long, toxic int")
    cuts = toxicity.language_thresholds(spark.createDataFrame(rows, "doc_id long, lang string, score double"), labels)
    assert set(cuts) == {None, "big", "other", "shifted", "few"}
    assert cuts["shifted"] > 0.65 and cuts["big"] < cuts["shifted"] and abs(cuts["few"] - cuts[None]) < 0.05
    assert toxicity.language_thresholds(spark.createDataFrame(rows, "doc_id long, lang string, score double"), labels.where("toxic = 0")) == {None: toxicity.CUT}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_pipeline_on_planted_rows(spark, docs_frame, edge_rows, tmp_path):
    import corpus_pipeline
    rows, labels = toxic_corpus(random.Random(13), 900)
    r = random.Random(14)
    clean = lambda: " ".join(f"c{r.randrange(3000)}" for _ in range(80))
    item, copy = clean(), clean()
    planted = [(5000, copy), (5001, copy), (5001, copy), (5002, copy + " end"), (5003, item), (5004, f"{clean()} token=abcdefABCDEF1234 tail"), (5005, clean()), (5006, " ".join(["grollen"] * 9 + ["kilo"] * 9))]
    folder = str(tmp_path / "sf")
    docs_frame(rows + planted + edge_rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    toxic_ids = {i for i, y in labels if y}
    left = {i for i, _ in seen["toxicity"]}
    assert 5006 not in left and len(left & toxic_ids) < 0.05 * len(toxic_ids) and {5000, 5001, 5002, 5003, 5004, 5005} <= left
    ids = [i for i, _ in seen["near_dedup"]]
    assert 5000 in ids and not {5001, 5002} & set(ids) and {5003, 5004, 5005, 1, 2, 3, None} <= set(ids) and ids.count(6) == 1 and ids.count(7) == 1
    assert {i for i, _ in seen["near_dedup"]} - {i for i, _ in seen["decontamination"]} == {5003}
    masked = dict(seen["secret_scans"])
    assert "abcdefABCDEF1234" not in masked[5004] and masked[5004].endswith("[secret] tail") and len(masked) == len(dict(seen["decontamination"]))
    packed = docs.groupBy("doc_id").agg(toxicity.F.sum("length").alias("n"), toxicity.F.max("doc_tokens").alias("m")).collect()
    assert all(x.n == x.m for x in packed) and {x.doc_id for x in packed} == set(masked)
