"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysieve.llm.common import saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(f):
    QUERIES[f.__name__] = f
    return f


@register
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by the text CNN; ``rejected`` uses the thresholds calibrated by language."""
    from paysieve.llm import toxicity as t
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    scored = saved(t.score(docs, t.train(docs, labels), "doc_id", "lang"))
    cut = t.threshold_column(t.language_thresholds(scored, labels), F.col("lang"))
    return scored.select("doc_id", F.coalesce(t.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= t.CUT).cast("int").alias("predicted"),
                         cut.alias("threshold"), (F.col("score") >= cut).alias("rejected"))


@register
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rules over whole texts, shrunk failure rates by host (the source), verdicts joined back."""
    from paysieve.llm.host_rules import MEASURES, judge
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


@register
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and Markov-model spans of every whole text, as digests of their positions."""
    from paysieve.llm import secrets as s
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = s.scan(docs, "doc_id")

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{s.KINDS[kind]}")

    return found.select("doc_id", count(0), count(1), count(2), F.sha2(s.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), s.listed(F.col("spans")).alias("spans"))


@register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a 13-word span of a benchmark item, found by winnowing."""
    from paysieve.llm import decontaminate as d
    found = d.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLES["op6_decontamination"] = r"""
WITH split AS (
  SELECT doc_id AS id, 0 AS side, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT item_id, 1, row_number() OVER (), text FROM benchmark WHERE item_id IS NOT NULL),
words AS (
  SELECT id, side, r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split),
spans AS (
  SELECT DISTINCT id AS item_id, array_to_string(w[i:i + least(12, len(w) - 1)], ' ') AS span, least(13, len(w)) AS n
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM words WHERE side = 1 AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM spans),
places AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE side = 0 AND len(w) >= n)),
hit AS (SELECT p.r, p.i, p.n, s.item_id FROM places p JOIN spans s ON p.n = s.n AND p.span = s.span),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, cast(item_id AS varchar) AS item_id FROM hit) GROUP BY r)
SELECT w.id AS doc_id, cast(len(w.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit_words h ON w.r = h.r LEFT JOIN hit_items i ON w.r = i.r WHERE w.side = 0
"""


@register
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 0.75 or more between five-word shingle sets."""
    from paysieve.llm.near_dup import groups
    return groups(table(spark, sf_dir, "documents"))


@register
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document written to flat binary files in doc_id order and read back through memory maps."""
    from paysieve.llm import tokens as t
    folder = t.new_folder(spark)
    parts = t.write_ids(table(spark, sf_dir, "documents"), folder, t.tokenizer_path(), end_id=2)
    return t.digested(t.read_ids(parts, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into power-of-two pieces, one per sequence, numbered by length bucket."""
    from paysieve.llm import tokens as t
    return t.pack(table(spark, sf_dir, "documents"), t.tokenizer_path(), end_id=0, ids=False).drop("bucket")


@register
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page url judged by the longest rule, else by trust and distrust spread over the graph of hosts."""
    from paysieve.llm import url_trust as u
    return u.judge(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", "verdict")


def _url_sql() -> str:
    from paysieve.llm import url_trust as u
    fits = []
    for rule, verdict in sorted(u.RULES, key=lambda r: -len(r[0])):
        host, _, path = rule.partition("/")
        fits.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    low = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    rounds = "".join(f""",
s{i + 1} AS (SELECT flow, host, sum(mass) AS mass FROM (
  SELECT t.flow, t.dst AS host, s.mass * t.share AS mass FROM steps t JOIN s{i} s ON t.flow = s.flow AND t.src = s.host
  UNION ALL SELECT flow, host, mass * {1 - u.DAMPING} FROM s0) GROUP BY flow, host)""" for i in range(u.ROUNDS))
    return rf"""
WITH urls AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), {low}) AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (SELECT page_id, html, host, path, CASE {' '.join(fits)} END AS found FROM urls),
hosts AS (SELECT host, count(*) FILTER (found.verdict = 'allow') AS a, count(*) FILTER (found.verdict = 'block') AS b FROM judged WHERE host <> '' GROUP BY host),
raw AS (SELECT host AS src, unnest(regexp_extract_all(html, '{u.LINK.replace("'", "''")}', 1)) AS dst FROM judged),
links AS (SELECT src, regexp_replace(translate(dst, {low}), '^[^@]*@|:\d*$', '', 'g') AS dst FROM raw),
pairs AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
known AS (SELECT host FROM hosts UNION SELECT src FROM pairs UNION SELECT dst FROM pairs),
family AS (SELECT c.host AS child, k.host AS parent FROM known c JOIN known k ON regexp_extract(c.host, '^[^.]*\.(.+)$', 1) = k.host AND k.host <> ''),
edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM pairs UNION ALL SELECT child, parent, 1 FROM family UNION ALL SELECT parent, child, 1 FROM family) GROUP BY src, dst),
flows AS (SELECT 'trust' AS flow, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
steps AS (SELECT flow, src, dst, n / sum(n) OVER (PARTITION BY flow, src) * {u.DAMPING} AS share FROM flows),
s0 AS (SELECT 'trust' AS flow, host, a / (SELECT greatest(sum(a), 1) FROM hosts) AS mass FROM hosts WHERE a > 0 UNION ALL SELECT 'distrust', host, b / (SELECT greatest(sum(b), 1) FROM hosts) FROM hosts WHERE b > 0){rounds},
shares AS (SELECT host, round(sum(mass) FILTER (flow = 'distrust') / sum(mass), 9) AS share FROM s{u.ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, found.rule AS rule, coalesce(found.verdict, CASE WHEN coalesce(share, 0) > {u.MAX_SHARE} THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN shares s ON j.host = s.host
"""


ORACLES["op2_url_filters"] = _url_sql()


@register
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of a response per page, as identifiers and digests of the written records."""
    from paysieve.llm import warc as w
    found = w.derive(w.responses(table(spark, sf_dir, "pages")))
    return found.select("page_id", "type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest", "content_length", F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256"))


def _warc_sql() -> str:
    from paysieve.llm import warc as w
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    text = "coalesce(html, '')"
    for pattern, by in w.TEXT_STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by) if by != chr(10) else 'chr(10)'}, 'g')"
    for name, char in w.ENTITIES:
        text = f"replace({text}, {quoted(name)}, {quoted(char)})"
    for pattern, by in w.SPACE_STEPS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by) if by != chr(10) else 'chr(10)'}, 'g')"
    uuid = lambda s: f"(SELECT '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' FROM (SELECT md5({s}) AS h))"
    end = "chr(13) || chr(10)"
    line = lambda name, value: f"'{name}: ' || {value} || {end}"
    head = " || ".join(line(n, v) for n, v in (
        ("WARC-Type", "type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", f"'{w.DATE}'"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
        ("WARC-Refers-To-Date", f"'{w.DATE}'"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")))
    about = " || ".join([line("title", r"regexp_replace(regexp_extract(body, '(?is)<title\b[^>]*>(.*?)</title', 1), '\s+', ' ', 'g')"), line("links", r"len(regexp_extract_all(body, '(?i)<a\s[^>]*?href\s*='))"),
                         line("source-payload-digest", "source_digest"), line("source-length", "strlen(body)"), f"'source-header: HTTP/1.1 200 OK' || {end}",
                         line("source-header: Content-Type", "'text/html; charset=utf-8'"), line("source-header: Content-Length", "strlen(body)")])
    return rf"""
WITH responses AS (SELECT page_id, {uuid("'response|' || coalesce(cast(page_id AS varchar), '') || '|' || coalesce(url, '')")} AS refers_to, coalesce(url, '') AS target_uri, coalesce(html, '') AS body, {text} AS plain,
  'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
blocks AS (SELECT page_id, refers_to, target_uri, source_digest, 'metadata' AS type, 'application/warc-fields' AS content_type, {about} AS block FROM responses
  UNION ALL SELECT page_id, refers_to, target_uri, source_digest, 'conversion', 'text/plain; charset=utf-8', plain FROM responses),
named AS (SELECT *, {uuid("type || '|' || refers_to")} AS record_id, 'sha256:' || sha256(block) AS block_digest, cast(strlen(block) AS bigint) AS content_length FROM blocks)
SELECT page_id, type, record_id, refers_to, target_uri, source_digest, block_digest, content_length,
  sha256('WARC/1.1' || {end} || {head} || {end} || block || {end} || {end}) AS record_sha256 FROM named
"""


ORACLES["op7_warc_derivatives"] = _warc_sql()


@register
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every whole text; the score is the best confidence of what stays."""
    from paysieve.llm import licenses as s
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = F.filter("found", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return s.scan(docs, "doc_id").select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        s.labels(base).alias("base_labels"), s.labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["confidence"])), F.lit(0.0)).alias("score"))


ORACLES["op3_quality_rules"] = r"""
WITH t AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, source, cast(len(w) AS bigint) AS n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS bigint) AS word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM t LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS k, sum(f / n * f) AS q, sum(n * n) AS n2 FROM hosts),
spread AS (SELECT m, CASE WHEN n - n2 / n > 0 THEN greatest(0, (q - n * m * m - (k - 1) * m * (1 - m)) / (n - n2 / n)) ELSE 0 END AS tau FROM sums),
prior AS (SELECT m, CASE WHEN tau > 0 THEN least(1000, greatest(2, m * (1 - m) / tau - 1)) ELSE 1000 END AS s FROM spread),
rates AS (SELECT source, (f + greatest(1e-6, m * s)) / (n + greatest(1e-6, m * s) + greatest(1e-6, (1 - m) * s)) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) < 0.8 AS kept FROM judged LEFT JOIN rates USING (source)
"""


@register
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of the covariance of all, scaled to unit variance."""
    from paysieve.llm.whitening import whiten
    out = whiten(table(spark, sf_dir, "embeddings"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", parts).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")


@register
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, from ball trees over all documents."""
    from paysieve.llm.ball_tree import ranked
    items = table(spark, sf_dir, "benchmark")
    kind = dict(items.dtypes)["item_id"]
    return ranked(table(spark, sf_dir, "documents"), items).select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")


ORACLES["op12_ranked_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id IS NOT NULL),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, cast(sum(len(w)) AS bigint) AS n_terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
weight AS (SELECT term, cast(floor(1000 * ln(((2 * n_docs + 2)::DOUBLE) / (2 * count(*) + 1))) AS bigint) AS w FROM tf, total GROUP BY term, n_docs),
impact AS (SELECT tf.r, d.doc_id, tf.term, weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_terms))) AS part FROM tf JOIN d ON tf.r = d.r JOIN weight ON weight.term = tf.term, total WHERE d.doc_id IS NOT NULL),
scores AS (SELECT item_id, r, doc_id, cast(sum(part) AS bigint) AS score FROM i JOIN impact USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, cast(rank AS integer) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""


@register
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows of every twentieth row, by inner product, from vantage-point trees over all rows."""
    from paysieve.llm import vantage as v
    return v.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % v.EVERY == 0)
