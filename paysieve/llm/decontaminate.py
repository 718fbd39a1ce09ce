"""Benchmark decontamination by winnowing, as DataFrame expressions.

Of all k-gram hashes in each sliding window of ``SPAN - k + 1`` places the minimum is kept.  Two texts that share
``SPAN`` consecutive words share a whole window, and so its minimum: no shared span of that length is missed.
Fingerprints of documents and items are joined; around each hit, the words are compared to both sides, and every
``SPAN`` words that are equal are marked.  An item of fewer words is one span: its length's grams are all kept.

Passes: (1) fingerprints of all documents against the items' fingerprints, (2) only documents with a common
fingerprint are read again for the comparison of words.  Item fingerprints and candidate keys are broadcast only
while they count at most ``BROADCAST_ROWS`` rows; beyond, the same joins shuffle.

Defined cases: null and empty texts have no words and are clean; items without words or id are no items; items of one
id count once; repeated document rows get the same result each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysieve.llm.common import row_key, saved, word_array

SPAN, GRAM = 13, 7
BROADCAST_ROWS = 200_000  # rows of a few hundred bytes at most
LONGS = "cast(array() as array<bigint>)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _neighbours(a: Column, step: int, f: Callable[[Column, Column], Column]) -> Column:
    """f of each element and the one ``step`` places on."""
    def zipped(x: Column) -> Column:
        n = F.greatest(F.size(x) - step, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(1 + step), n), f)
    return let(a, zipped)


def _sliding(a: Column, width: int, f: Callable[[Column, Column], Column]) -> Column:
    """Reduce every ``width`` neighbours by doubling; the last step may overlap."""
    done = 1
    while done < width:
        step = min(done, width - done)
        a, done = _neighbours(a, step, f), done + step
    return a


def grams(words: Column, k: int) -> Column:
    """Hash of the k words from each place on, tagged by k."""
    hashes = F.transform(words, lambda w: F.xxhash64(w, F.lit(k)))
    return _sliding(hashes, k, lambda a, b: F.xxhash64(a, b))


def winnowed(gram_hashes: Column, k: int, span: int = SPAN) -> Column:
    """Distinct minima of the sliding windows that cover ``span`` words."""
    return F.array_distinct(_sliding(gram_hashes, span - k + 1, lambda a, b: F.least(a, b)))


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table, marked for broadcast if it is small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def item_seeds(items: DataFrame) -> DataFrame:
    """fp, item_id, ahead (words between the span's start and the gram), span: one row per gram and span around it."""
    rows = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), word_array(F.col("text")).alias("words"))
    whole = rows.where((F.size("words") > 0) & (F.size("words") < SPAN))
    short = None
    for k in sorted(r.n for r in whole.select(F.size("words").alias("n")).distinct().collect()):
        part = whole.where(F.size("words") == k).select(F.get(grams(F.col("words"), k), F.lit(0)).alias("fp"), "item_id", F.lit(0).alias("ahead"), F.array_join("words", " ").alias("span"), F.lit(k).alias("k"))
        short = part if short is None else short.unionByName(part)
    long = rows.where(F.size("words") >= SPAN).select("item_id", "words", F.inline(F.array(F.struct(grams(F.col("words"), GRAM).alias("g")))))
    long = long.select("item_id", "words", F.inline(F.array(F.struct("g", winnowed(F.col("g"), GRAM).alias("kept")))))
    long = long.select("item_id", "words", "kept", F.posexplode("g").alias("place", "fp")).where(F.array_contains("kept", F.col("fp")))
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - (SPAN - GRAM)), F.least(F.col("place"), F.size("words") - SPAN))
    long = long.select("item_id", "words", "place", "fp", F.explode(starts).alias("start"))
    long = long.select("fp", "item_id", (F.col("place") - F.col("start")).alias("ahead"), F.array_join(F.slice("words", F.col("start") + 1, F.lit(SPAN)), " ").alias("span"), F.lit(GRAM).alias("k"))
    return saved((long if short is None else long.unionByName(short)).distinct())


def _prints(words: Column, short: list[int]) -> Column:
    parts = [winnowed(grams(words, GRAM), GRAM), *(F.array_distinct(grams(words, k)) for k in short)]
    return F.array_distinct(F.concat(*parts)) if short else parts[0]


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, item_id, start, end: every place where a span of an item stands in a document (words from 0, end exclusive)."""
    seeds = item_seeds(items)
    lengths = {r.n: r.k for r in seeds.select("k", F.size(F.split("span", " ")).alias("n")).distinct().collect()}  # at most SPAN values
    short = sorted(n for n in lengths if n < SPAN)
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "text")
    wanted = bounded(saved(seeds.select("fp").distinct()))
    prints = rows.select("key", F.explode(_prints(word_array(F.col("text")), short)).alias("fp"))
    candidates = bounded(saved(prints.join(wanted, "fp").groupBy("key").agg(F.collect_set("fp").alias("common"))))
    again = rows.join(candidates, "key").select("key", "common", F.inline(F.array(F.struct(word_array(F.col("text")).alias("words")))))

    def places(k: int) -> Column:
        """Places of common grams of k words, with the words around them."""
        before, length = (SPAN - k, 2 * SPAN - k) if k == GRAM else (0, k)
        found = F.transform(grams(F.col("words"), k), lambda g, i: F.struct(g.alias("fp"), i.alias("place"), F.lit(k).alias("k")))
        found = F.filter(found, lambda x: F.array_contains("common", x["fp"]))
        return F.transform(found, lambda x: F.struct(
            x["fp"].alias("fp"), x["k"].alias("k"), x["place"].alias("place"), F.greatest(F.lit(0), x["place"] - before).alias("from"),
            F.slice("words", F.greatest(F.lit(0), x["place"] - before) + 1, F.least(x["place"], F.lit(before)) + length - before).alias("around")))

    # Long spans and short items of GRAM words use the same grams, so those items' places are found with the long ones.
    kinds = [GRAM, *(k for k in short if k != GRAM)]
    spots = again.select("key", F.inline(F.concat(*[places(k) for k in kinds]) if len(kinds) > 1 else places(GRAM)))
    near = spots.join(bounded(seeds), ["fp", "k"])
    n = F.size(F.split("span", " "))
    start = F.col("place") - F.col("ahead")
    same = F.array_join(F.slice("around", F.greatest(start - F.col("from") + 1, F.lit(1)), n), " ") == F.col("span")
    return near.where((start >= F.col("from")) & same).select("key", "item_id", start.alias("start"), (start + n).alias("end")).distinct()


def judge(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row: doc_id, key, n_words, n_hit, item ids (sorted strings), contaminated (hit words are a twentieth or more)."""
    docs = docs.select("doc_id", "text")
    by_doc = hits(docs, items).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["reach"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], s["end"]).alias("reach")), lambda acc: acc["n"])
    found = bounded(saved(by_doc.select("key", covered.cast("long").alias("n_hit"), "items")))
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(found, "key", "left").select("doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
