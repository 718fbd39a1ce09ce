"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of hashed rows for the word and its prefixes, so that unseen inflections share their
stem's row.  Filters of several widths slide over the word vectors, each filter keeps its maximum over the text, and
a logistic layer reads the maxima.  As a filter is linear, its value at a place is a sum of one projected vector per
word; the projections are kept by word, and scoring a text is gathering, adding and taking maxima.

Labels come from rows with crc32(doc_id) mod 3 other than 1, at most ``MAX_TRAIN`` of them (the lowest hashes of
their ids in each class, a documented bound of the fit only); scores, thresholds and verdicts cover every row.
``language_thresholds`` counts scored labelled rows by language and score bin; a language's error rates are shrunk
toward those of all languages by ``PRIOR`` rows, so the fewer labels it has the closer its threshold is to the common one.

Defined cases: null or empty text is scored as a text without words; a null language, or one without labels, uses the
threshold of all languages; without labelled rows of both classes every score is 0 (nothing is known to be toxic); an id
with several labels counts as toxic if one of them is, and with several texts the least of them trains; repeated rows
are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 6000
WIDTHS, FILTERS, DIM, BUCKETS = (1, 2, 3), 6, 12, 1 << 16
PREFIXES = (3, 4, 5, 6)
TEXTS_PER_JOB = 250  # labelled texts that one job hands to the driver
UPDATES, BATCH, RATE = 1125, 32, 0.02  # batches, whatever the sample's size; MAX_TRAIN rows pass six times
WARM = 188  # first batches, at twice the rate
TRAIN_WORDS = 50_000  # words held at once while scoring; a longer text is a group of its own
CUT = 0.7
WORD = re.compile(r"[^\W\d_]+")
VOCABULARY = 200_000  # projected words that a task keeps before it starts anew
BINS, PRIOR, MAX_FALSE_RATE = 1000, 200.0, 0.01


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def word_rows(word: str) -> list[int]:
    """Hashed rows of a word: the word itself and its prefixes; a prefix it does not have is the empty row BUCKETS."""
    return [crc32(f"{word}$".encode()) % BUCKETS, *(crc32(word[:n].encode()) % BUCKETS if len(word) >= n else BUCKETS for n in PREFIXES)]


def rows_of(words: Iterable[str]) -> np.ndarray:
    """Hashed rows, one line per word, without a Python list for each."""
    return np.fromiter((r for w in words for r in word_rows(w)), dtype="i4").reshape(-1, len(PREFIXES) + 1)


class TextCnn:
    """Embedding table, filters by width, logistic layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.1, (BUCKETS + 1, DIM)).astype("f4")
        self.table[BUCKETS] = 0
        self.filters = [r.normal(0, 0.5, (w, DIM, FILTERS)).astype("f4") for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), "f4")
        self.out = r.normal(0, 0.5, len(WIDTHS) * FILTERS).astype("f4")
        self.base = np.float32(-1.0)
        self.fitted = False

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows].sum(axis=1) / (rows < BUCKETS).sum(axis=1, keepdims=True).astype("f4")

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Per word: its share in every filter at every offset, flat."""
        v = self.vectors(rows)
        return np.concatenate([v @ f[o] for f in self.filters for o in range(len(f))], axis=1)

    def maxima(self, shares: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter maxima per text and the places where they stand; ``shares`` holds the texts one after the other."""
        total, texts = len(shares), len(lengths)
        best = np.zeros((texts, len(WIDTHS), FILTERS), "f4")
        at = np.full((texts, len(WIDTHS), FILTERS), -1, "i8")
        full, column = lengths > 0, 0
        ends = (starts + lengths)[full]
        for k, w in enumerate(WIDTHS):
            # A place past the text's end adds nothing: a zero row stands there.
            s = np.zeros((total, FILTERS), "f4")
            room = np.repeat(ends, lengths[full]) - np.arange(total)
            for o in range(w):
                part = shares[o:, column:column + FILTERS]
                s[:total - o] += np.where((room[:total - o] > o)[:, None], part, 0)
                column += FILTERS
            s += self.bias[k]
            if full.any():
                top = np.maximum.reduceat(s, starts[full], axis=0)
                best[full, k] = np.maximum(top, 0)
                if self.training:
                    for t, (i, n) in zip(np.flatnonzero(full), zip(starts[full], lengths[full], strict=True), strict=True):
                        at[t, k] = i + s[i:i + n].argmax(axis=0)
        return best, at

    training = False

    def logits(self, best: np.ndarray) -> np.ndarray:
        return best.reshape(len(best), -1) @ self.out + self.base


def _split(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Words text by text, so that a caller holds no more of them than it wants to."""
    for t in texts:
        yield WORD.findall(t.lower()) if t else []


def _layout(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words], dtype="i8")
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> TextCnn:
    """Adagrad over minibatches in which both classes weigh the same; only the rows of words at filter maxima move."""
    net, y = TextCnn(seed), np.asarray(toxic, dtype="f4")
    if len(set(toxic)) < 2:
        return net
    net.training = True
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words], dtype="i4") for words in _split(texts)]
    rows = rows_of(index)
    del index
    r = np.random.default_rng(seed)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    grown = [np.full_like(p, 1e-6) for p in (net.table, *net.filters, net.bias, net.out)]
    grown_base = 1e-6
    order = np.zeros(0, "i8")
    for update in range(UPDATES):
        rate = RATE * (2 if update < WARM else 1)
        if not len(order):
            order = r.permutation(len(docs))
        batch, order = order[:BATCH], order[BATCH:]
        starts, lengths = _layout([docs[j] for j in batch])
        if not lengths.sum():
            continue
        words, ids = np.unique(np.concatenate([docs[j] for j in batch]), return_inverse=True)
        own = rows[words]
        vec = net.vectors(own)
        shares = np.concatenate([vec @ f[o] for f in net.filters for o in range(len(f))], axis=1)[ids]
        best, at = net.maxima(shares, starts, lengths)
        flat_best = best.reshape(len(best), -1)
        p = 1 / (1 + np.exp(-net.logits(best)))
        g = ((p - y[batch]) * weight[batch] / len(batch)).astype("f4")
        g_out = flat_best.T @ g + 1e-5 * net.out
        g_best = (g[:, None] * net.out).reshape(best.shape) * (best > 0)
        g_filters = [np.zeros_like(f) for f in net.filters]
        g_vec = np.zeros_like(vec)
        for k, w in enumerate(WIDTHS):
            t, f = np.nonzero((at[:, k] >= 0) & (g_best[:, k] != 0))
            place, slope = at[t, k, f], g_best[t, k, f]
            for o in range(w):
                inside = place + o < starts[t] + lengths[t]
                word = ids[place[inside] + o]
                np.add.at(g_filters[k], (o, slice(None), f[inside]), slope[inside, None] * vec[word])
                np.add.at(g_vec, word, slope[inside, None] * net.filters[k][o][:, f[inside]].T)
        hit = np.flatnonzero(np.abs(g_vec).sum(axis=1))
        if len(hit):
            real = own[hit] < BUCKETS
            step = np.repeat((g_vec[hit] / real.sum(axis=1, keepdims=True))[:, None], own.shape[1], axis=1)[real]
            uniq, back = np.unique(own[hit][real], return_inverse=True)
            g_rows = np.zeros((len(uniq), DIM), "f4")
            np.add.at(g_rows, back, step.astype("f4"))
            grown[0][uniq] += g_rows ** 2
            net.table[uniq] -= 5 * rate * g_rows / np.sqrt(grown[0][uniq])
        for p_, g_, s_ in zip((*net.filters, net.bias, net.out), (*g_filters, g_best.sum(axis=0), g_out), grown[1:], strict=True):
            s_ += g_ ** 2
            p_ -= rate * g_ / np.sqrt(s_)
        grown_base += g.sum() ** 2
        net.base -= np.float32(rate * g.sum() / np.sqrt(grown_base))
    net.training, net.fitted = False, True
    del docs, rows, grown
    # The base moves so that the fixed cut lies midway between the edges of the two classes.
    z = Scorer(net).logits(texts)
    middle = (np.quantile(z[y == 1], 0.01) + np.quantile(z[y == 0], 0.995)) / 2
    net.base += np.float32(np.log(CUT / (1 - CUT)) - middle)
    return net


class Scorer:
    """Scores texts in bounded groups of words; projected words are kept between groups."""

    def __init__(self, net: TextCnn):
        self.net, self.index, self.shares = net, {}, np.empty((0, FILTERS * sum(WIDTHS)), "f4")

    def _group(self, docs: list[list[str]]) -> np.ndarray:
        new = {w for d in docs for w in d if w not in self.index}
        if len(self.index) + len(new) > VOCABULARY and self.index:
            self.index = {}
            new = {w for d in docs for w in d}
        if new:
            n, names = len(self.index), sorted(new)
            self.index.update({w: n + k for k, w in enumerate(names)})
            if n + len(names) > len(self.shares):  # only while there are none; room that is not filled takes no memory
                self.shares = np.empty((max(VOCABULARY, len(names)), self.shares.shape[1]), "f4")
            self.shares[n:n + len(names)] = self.net.project(rows_of(names))
        starts, lengths = _layout(docs)
        if not lengths.sum():
            return np.zeros((len(docs), len(WIDTHS), FILTERS), "f4")
        get = self.index.__getitem__
        ids = np.fromiter((get(w) for d in docs for w in d), dtype="i8", count=int(lengths.sum()))
        return self.net.maxima(self.shares[ids], starts, lengths)[0]

    def logits(self, texts: Iterable[str | None]) -> np.ndarray:
        out, group, held = [], [], 0
        for words in _split(texts):
            if group and held + len(words) > TRAIN_WORDS:
                out.append(self._group(group))
                group, held = [], 0
            group.append(words)
            held += len(words)
        if group:
            out.append(self._group(group))
        return self.net.logits(np.concatenate(out)).astype("f8") if out else np.zeros(0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -40, 40))) if self.net.fitted else np.zeros(len(texts))


def _own_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of the ids that are not held out."""
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    return own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> TextCnn:
    """Fit on at most ``limit`` labelled rows that are not held out, half of them toxic where there are enough."""
    own = _own_labels(labels)
    chosen = None
    for kind in (0, 1):
        part = own.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # at most ``limit`` ids
    rows = rows.coalesce(max(1, -(-limit // TEXTS_PER_JOB)))  # a job for each part, whatever the number of shuffle partitions
    sample = sorted((r.doc_id, r.text, r.toxic) for r in rows.toLocalIterator())
    return fit([t for _, t, _ in sample], [y for _, _, y in sample])


def score(docs: DataFrame, net: TextCnn, *keep: str) -> DataFrame:
    """Columns ``keep`` and score, the probability that the whole text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the table has BUCKETS rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in batches:
            yield b[list(keep)].assign(score=scorer.scores(b["text"].tolist()))

    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double")


def language_thresholds(scored: DataFrame, labels: DataFrame) -> dict[str | None, float]:
    """Lowest score bin per language at which at most MAX_FALSE_RATE of the clean training rows are rejected.

    ``scored`` has doc_id, lang and score.  Counts are made by (language, bin, label), so what reaches the driver
    is bounded by languages x BINS; the entry None is the threshold over all languages.
    """
    bins = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
    counts = scored.join(_own_labels(labels), "doc_id").groupBy("lang", bins.alias("bin"), "toxic").count().collect()
    tables: dict[str | None, np.ndarray] = {None: np.zeros((2, BINS))}
    for c in counts:
        tables.setdefault(c.lang, np.zeros((2, BINS)))
        for table in {id(t): t for t in (tables[None], tables[c.lang])}.values():
            table[c.toxic, c.bin] += c["count"]
    out: dict[str | None, float] = {}
    every = tables[None].sum(axis=1)
    if not every.all():
        return {None: CUT}
    # From the top: share of the clean rows and of the toxic ones at or above each bin.
    above = {lang: np.cumsum(t[:, ::-1], axis=1)[:, ::-1] for lang, t in tables.items()}
    common = above[None] / every[:, None]
    for lang, seen in above.items():
        n = tables[lang].sum(axis=1)[:, None]
        false, caught = common if lang is None else (seen + PRIOR * common) / (n + PRIOR)
        loss = np.where(false <= MAX_FALSE_RATE, false + 1 - caught, np.inf)
        best = np.flatnonzero(loss == loss.min())
        out[lang] = float((best[0] + best[-1] + 1) / 2 / BINS)  # the middle of the bins that do equally well
    return out


def threshold_column(thresholds: dict[str | None, float], lang: Column) -> Column:
    c = F.lit(thresholds.get(None, CUT))
    for name, cut in sorted((k, v) for k, v in thresholds.items() if k is not None):
        c = F.when(lang == name, F.lit(cut)).otherwise(c)
    return c
