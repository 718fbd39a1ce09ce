"""Quality rules by host: document rules, failures summed by host, shrunk rates, verdicts joined back.

Every document is measured over its whole text.  Failures are counted by host (a partial aggregate, so a hot
host costs one row per task), the spread of the rates between hosts gives a beta prior (method of moments), and
a host whose shrunk failure rate reaches ``max_rate`` takes its remaining documents with it.

Defined cases: null and empty texts have no word and fail; a null host has no verdict, only the document's own
rules count; repeated rows are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm.common import saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
MAX_HOST_RATE = 0.8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside any window of ``window`` words that occurs twice or more in the text, the first one included."""
    windows = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, reach = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + window - max(i, reach)
            reach = i + window
    return covered


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _measure_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = pd.DataFrame([measure(t) for t in b["text"]], columns=MEASURES, dtype="int64")
        yield pd.concat([b[["doc_id", "host"]].reset_index(drop=True), found], axis=1)


def document_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the five measures and base_failed per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    found = rows.mapInPandas(_measure_batches, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def host_rates(rules: DataFrame) -> DataFrame:
    """host, n_docs, n_failed and the failure rate shrunk by the beta prior that the hosts themselves give."""
    hosts = rules.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = saved(hosts)
    # One row of sums over hosts, whatever their number: pooled rate m, and the spread of the rates around it.
    s = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.expr("n_failed / n_docs * n_failed")).alias("q"),
                  F.sum(F.expr("cast(n_docs as double) * n_docs")).alias("n2")).first()
    if not s.n:
        alpha, beta = 1.0, 1.0
    else:
        m = s.f / s.n
        between = s.q - s.n * m * m  # sum of n (rate - m)^2
        noise = (s.k - 1) * m * (1 - m)
        size = s.n - s.n2 / s.n
        tau = max(0.0, (between - noise) / size) if size > 0 else 0.0
        strength = min(1000.0, max(2.0, m * (1 - m) / tau - 1)) if tau > 0 else 1000.0
        alpha, beta = max(1e-6, m * strength), max(1e-6, (1 - m) * strength)
    return hosts.withColumn("rate", (F.col("n_failed") + alpha) / (F.col("n_docs") + alpha + beta))


def judge(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: measures, base_failed, the host's shrunk rate (null without a host) and kept."""
    rules = saved(document_rules(docs, host))
    verdicts = host_rates(rules).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    joined = rules.join(verdicts, rules["host"] == verdicts["_host"], "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) < max_rate))
