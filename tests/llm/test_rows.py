"""Row-wise operators on edge rows and against brute force."""

import hashlib
import random
import re
import re._parser as parser
import string
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paysieve.llm import host_rules, license_rules, licenses, secrets, tokens, url_trust, warc
from paysieve.llm.queries import QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(x):
    return tuple((v is None, v) for v in x)


def test_measures_follow_their_definitions():
    assert host_rules.measure(None) == (0, 0, 0, 0, 0)
    assert host_rules.measure("a b c a b c x\nq\n\nq\nq#$ ") == (10, 12, 2, 1, 6)
    r = random.Random(3)
    for _ in range(200):
        words = [r.choice("abc") for _ in range(r.randrange(12))]
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        counts = Counter(windows)
        covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
        assert host_rules.repeated_words(words) == len(covered)


def test_host_rules_on_edge_rows(docs_frame, edge_rows):
    out = host_rules.judge(docs_frame(edge_rows)).collect()
    assert len(out) == len(edge_rows)
    by = {r.doc_id: r for r in out if r.doc_id not in (6, 7)}
    assert by[1].base_failed and not by[1].kept and by[1].n_words == 0
    assert by[5].n_words == 120_000
    assert by[8].host_rate is None
    assert host_rules.judge(docs_frame([])).collect() == []


def test_a_failing_host_takes_its_documents_along(docs_frame):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "en", "fine") for i in range(300)] + [(1000 + i, "too short", "en", "bad") for i in range(300)] + [(5000, good, "en", "bad"), (5001, good, None, None)]
    out = {r.doc_id: r for r in host_rules.judge(docs_frame(rows)).collect()}
    assert not out[5000].base_failed and not out[5000].kept
    assert out[5001].kept and all(out[i].kept for i in range(300))


def places(text):
    a = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    out = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_secret_patterns_equal_brute_force(docs_frame, edge_rows):
    r = random.Random(5)
    bits = ["password", "Secret", "token", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "abc", "zz-9", "é", "\U0001f600", "\n", "12345678901234"]
    rows = edge_rows + [(100 + i, "".join(r.choice(bits) for _ in range(r.randrange(1, 30)))) for i in range(300)]
    out = secrets.scan(docs_frame(rows), "doc_id", "text").select("text", "base").collect()
    assert len(out) == len(rows)
    for x in out:
        assert [tuple(s) for s in x.base] == places(x.text or "")


def test_markov_models_add_random_strings(docs_frame):
    r = random.Random(9)
    rnd = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    names = ["internationalization", "getUserAccountName", "configurationManager", "responseHandlerFactory", "maximumConnectionCount"]
    rows = [(i, f"token={rnd(32)} then {r.choice(names)}Of{r.choice(names)} and {r.choice(names)}") for i in range(300)]
    hidden = rnd(30) + "7a"
    rows += [(1000, f"see {hidden} there"), (1001, "see internationalization2configurationManager there"), (1002, "plain words only")]
    out = {x.doc_id: x for x in secrets.scan(docs_frame(rows), "doc_id", "text").withColumn("masked", secrets.masked(F.col("text"), F.col("spans"))).collect()}
    assert [tuple(s) for s in out[1000].spans] == [(4, 3, 4 + len(hidden))]
    assert out[1000].masked == "see [secret] there"
    assert not out[1001].spans and out[1002].masked == "plain words only"
    assert secrets.scan(docs_frame([]), "doc_id").collect() == []


def test_every_signature_needs_its_keyword_and_second_word():
    table = license_rules.rules()
    assert len(table) > 300 and len({r["pattern"] for r in table}) > 250
    said = ["released under the mit license", "licensed under the apache license version 2 0", "cc by sa 4 0", "spdx license identifier mit", "gnu general public license v3", "bsd 3 clause license",
            "creative commons attribution 4 0 international license", "mozilla public license 2 0", "permission is hereby granted free of charge to any person obtaining a copy of this software"]
    for text in said:
        found = [r for r in table if re.search(r["pattern"], f" {text} ", re.A)]
        assert found
        words = text.split()
        assert any(r["keyword"] in words and r["also"] in f" {text} " for r in found)
        # The same pattern stands once for each spelling of its keyword; one of them has to let the text in.
        for pattern in {r["pattern"] for r in found}:
            assert any(r["keyword"] in words and r["also"] in f" {text} " for r in found if r["pattern"] == pattern)


def test_license_scan_equals_brute_force(docs_frame, edge_rows):
    r = random.Random(11)
    bits = ["CC BY", "cc by-sa 4.0", "All rights reserved", "General Public License", "GNU General Public License version 3", "released under the", "MIT License", "Apache License, Version 2.0", "licensed under",
            "the", "foo", "copyright 2020", "public domain", "dedicated to the", "SPDX-License-Identifier:", "no rights reserved", "BSD 3-Clause", "\n", "ü"]
    rows = edge_rows + [(100 + i, " ".join(r.choice(bits) for _ in range(r.randrange(1, 14)))) for i in range(150)]
    table = [(x, re.compile(x["pattern"], re.A)) for x in license_rules.rules()]
    out = licenses.scan(docs_frame(rows), "doc_id", "text").collect()
    assert len(out) == len(rows)
    for row in out:
        words = WORD.findall((row.text or "").translate(LOWER))
        text = f" {' '.join(words)} " if words else ""
        found = []
        for rule, p in table:
            if rule["keyword"] in words:
                for m in p.finditer(text):
                    start = text[:m.start()].count(" ") - 1
                    found.append((start, start + m[0].count(" ") + 1, rule))
        kept = [(a, b, x["no"]) for a, b, x in found if x["base"] or not any(
            c <= a and d >= b and (y["priority"], d - c, -y["no"]) > (x["priority"], b - a, -x["no"]) and y["priority"] >= x["priority"] for c, d, y in found)]
        assert row.n_words == len(words)
        assert sorted((x["start"], -x["minus_end"], x["no"]) for x in row.found) == sorted(kept)


def samples(tree, limit=300):
    """Texts that a parsed pattern matches: every branch, optional parts left out and put in."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            found = [chr(arg)]
        elif name == "IN":
            found = [chr(a) if str(o) == "LITERAL" else chr(a[0]) if str(o) == "RANGE" else "7" for o, a in arg if str(o) != "NEGATE"]
        elif name in ("NOT_LITERAL", "ANY"):
            found = ["x"]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            found = [""] * (arg[0] == 0) + [t * max(arg[0], 1) for t in samples(arg[2], limit)]
        elif name == "SUBPATTERN":
            found = samples(arg[3], limit)
        elif name == "BRANCH":
            found = [t for b in arg[1] for t in samples(b, limit)]
        else:
            assert name in ("ASSERT", "ASSERT_NOT", "AT"), name
            found = [""]
        out = [a + b for a in out for b in found]
        out = [out[i * len(out) // limit] for i in range(limit)] if len(out) > limit else out
    return out


def test_every_text_of_a_signature_passes_a_gate():
    table, seen = license_rules.rules(), 0
    same = {}
    for r in table:
        same.setdefault((r["label"], r["pattern"]), []).append(r)
    for (label, pattern), rows in same.items():
        for text in samples(parser.parse(pattern)):
            text = f" {' '.join(text.split())} "
            if re.search(pattern, text):
                seen += 1
                assert any(r["keyword"] in text.split() and r["also"] in text for r in rows), (label, text)
    assert seen > 10 * len(table)


def test_cached_ids_equal_the_tokenizer():
    encoder = tokens.IdEncoder(tokens.tokenizer_path())
    r = random.Random(2)
    bits = ["word", " ", " ", "\n", "Ünder", ",", ".", "'s", "12", "  ", "\t", "\x85", " ", "漢字", "\U0001f600", "<|endoftext|>", "\x00", "-", "a"]
    texts = ["", "a b", "\n", " x", "x\n", *("".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(1500))]
    for at in range(0, len(texts), 300):
        group = [*texts[at:at + 300], None]
        ids, offsets = encoder.encode(pa.array(group), 7)
        assert offsets[-1] == len(ids) and ids.dtype == encoder.dtype
        for t, i, j in zip(group, offsets, offsets[1:], strict=False):
            assert ids[i:j].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7], repr(t)
    assert encoder.fresh_bytes and encoder.steady_bytes
    encoder.forget()
    assert not encoder.fresh and encoder.steady
    ids, offsets = encoder.encode(pa.array([None, "x"]).slice(1), 7)
    assert ids.tolist() == [*encoder.tokenizer.encode("x", add_special_tokens=False).ids, 7] and offsets.tolist() == [0, 2]


def test_kept_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_BYTES", 1000)
    encoder = tokens.IdEncoder(tokens.tokenizer_path())
    for n in range(50):
        texts = [f"some word{n * 7 + k} other{k}" + "!" * (n % 11) + f" w{n % 9}" for k in range(7)]
        ids, offsets = encoder.encode(pa.array(texts), 7)
        assert [ids[i:j].tolist() for i, j in zip(offsets, offsets[1:])] == [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in texts]
        assert max(encoder.fresh_bytes, encoder.steady_bytes) < 1000 + 20 * (tokens.CHUNK_COST + 20)


def test_token_files_round_trip(spark, docs_frame, edge_rows):
    encoder = tokens.IdEncoder(tokens.tokenizer_path())
    folder = tokens.new_folder(spark)
    parts = tokens.write_ids(docs_frame(edge_rows), folder, tokens.tokenizer_path(), 2, parts=3)
    out = sorted(tokens.read_ids(parts, folder).collect(), key=lambda r: r.start)
    assert len(out) == len(edge_rows)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in out] == sorted((x[0] for x in edge_rows), key=lambda v: (v is not None, v))
    expected = sorted(key((i, tuple([*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]))) for i, t, *_ in edge_rows)
    assert sorted(key((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()))) for r in out) == expected
    empty = tokens.new_folder(spark)
    assert tokens.read_ids(tokens.write_ids(docs_frame([]), empty, tokens.tokenizer_path(), 2), empty).collect() == []


def test_token_queries_return_what_the_tokenizer_says(spark, docs_frame, edge_rows, tmp_path):
    """Every column of the queries, repeated and missing ids included."""
    docs_frame(edge_rows).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = tokens.IdEncoder(tokens.tokenizer_path()).tokenizer
    crc = lambda ids: crc32(np.array(ids, "<u4").tobytes())
    truth = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in edge_rows]
    files = sorted(QUERIES["op5_token_files"](spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.start for r in files] == [0, *np.cumsum([r.n_tokens for r in files]).tolist()][:-1]
    assert [r.doc_id for r in files] == sorted((i for i, _ in truth), key=lambda v: (v is not None, v))
    assert sorted(key(r[:1] + r[2:]) for r in files) == sorted(key((i, len(ids) + 1, crc([*ids, 2]))) for i, ids in truth)
    pieces = QUERIES["op9_packing"](spark, str(tmp_path)).collect()
    expected = []
    for i, ids in truth:
        ids, at = [*ids, 0], 0
        for n in tokens.pieces_of(len(ids), 1024):
            expected.append(key((i, at, n, crc(ids[at:at + n]), len(ids), 0)))
            at += n
    assert sorted(key((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset)) for r in pieces) == sorted(expected)
    assert sorted(r.sequence_id for r in pieces) == list(range(len(pieces)))


def test_pieces_of_many_lengths():
    lengths = np.arange(0, 300)
    doc, start, length = tokens.all_pieces(lengths, 64)
    assert [(d, n) for d, n in zip(doc.tolist(), length.tolist())] == [(int(d), n) for d in lengths for n in tokens.pieces_of(int(d), 64)]
    assert all(s == 0 or s == p + n for s, p, n in zip(start[1:].tolist(), start.tolist(), length.tolist()))


def test_pieces_rebuild_documents(docs_frame, edge_rows):
    encoder = tokens.IdEncoder(tokens.tokenizer_path())
    out = tokens.pack(docs_frame(edge_rows), tokens.tokenizer_path(), 0, limit=64).collect()
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert all(r.length <= 64 and r.length & (r.length - 1) == 0 and r.offset == 0 and r.bucket == r.length.bit_length() - 1 for r in out)
    assert [r.bucket for r in sorted(out, key=lambda r: r.sequence_id)] == sorted(r.bucket for r in out)
    for i, t in [(x[0], x[1]) for x in edge_rows if x[0] not in (6, 7, None)]:
        ids = [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [v for r in own for v in np.frombuffer(r.ids, "<u2").tolist()] == ids and own[0].doc_tokens == len(ids)
    assert tokens.pieces_of(2 * 64 + 37, 64) == [64, 64, 32, 4, 1]
    with pytest.raises(ValueError):
        tokens.pack(docs_frame([]), tokens.tokenizer_path(), 0, limit=100)
    assert tokens.pack(docs_frame([]), tokens.tokenizer_path(), 0).collect() == []


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")


def test_rules_and_flows_of_hosts(spark):
    link = lambda h: f'<a class=x HREF="https://{h}/x">t</a>'
    rows = [(1, None, None), (2, "no scheme", ""), (3, "HTTP://WWW.Example.COM/en/x?q", link("hub.org")), (4, "https://shop.example.com/en/1#a", ""), (5, "https://example.com", ""), (6, "http://spam.net/es/", ""),
            (7, "http://linker.org/a", link("spam.net") * 3), (8, "http://hub.org/", ""), (9, "http://alone.org/", ""), (9, "http://alone.org/", ""), (10, "http://xnet/es/", "")]
    out = sorted(url_trust.judge(pages(spark, rows)).collect(), key=lambda r: r.page_id)
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("", "", None, "allow")
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (by[4].rule, by[4].verdict) == ("example.com/en/", "block")
    assert (by[5].path, by[5].rule) == ("", None)
    assert (by[6].rule, by[6].verdict) == ("net/es/", "block")
    assert by[7].verdict == "block" and by[7].distrust_share == 1.0  # distrust flows against its link
    assert by[8].verdict == "allow" and by[8].distrust_share < 0.5  # trust flows along the link
    assert by[9].verdict == "allow" and by[9].distrust_share is None
    assert by[10].rule is None
    assert url_trust.judge(pages(spark, [])).collect() == []


def test_warc_records_round_trip(spark, tmp_path):
    html = "<html><head><title>T  x</title><style>p{}</style></head><body><!-- c --><p>A &amp; b&lt;c<br>ü</p><a href='/q'>go</a></body></html>"
    found = warc.responses(pages(spark, [(1, "http://a.b/c", html), (2, None, None), (2, None, None)]))
    rows = warc.derive(found).collect()
    assert len(rows) == 6
    response = {r.page_id: r for r in found.collect()}
    text = next(r for r in rows if r.page_id == 1 and r.type == "conversion")
    assert text.block == "A & b<c\nü\ngo" and text.refers_to == response[1].record_id
    assert text.source_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and text.content_length == len(text.block.encode())
    about = next(r for r in rows if r.page_id == 1 and r.type == "metadata")
    assert "title: T x\r\n" in about.block and "links: 1\r\n" in about.block and "source-header: Content-Type: text/html; charset=utf-8\r\n" in about.block
    files = warc.write_records(warc.derive(found), str(tmp_path / "w"))
    assert sum(r.n_records for r in files.collect()) == 6
    back = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert sorted((r.headers["WARC-Record-ID"], r.block) for r in back) == sorted((r.record_id, r.block) for r in rows)
    assert all(r.headers["WARC-Refers-To"] in {x.record_id for x in response.values()} for r in back)
    assert warc.derive(warc.responses(pages(spark, []))).collect() == []
