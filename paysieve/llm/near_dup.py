"""Near-duplicate groups: MinHash bands find candidates, odd sketches estimate them, full sets confirm them.

A document's set is its distinct five-word shingles (64-bit hashes).  Of 512 MinHash samples the first 128 make 32 band
keys of four samples, and all are folded into an odd sketch: 1,024 parity bits; the bits in which two sketches differ
estimate how many samples differ.  Documents with equal sets form a class, represented by its smallest doc_id.

Candidates never become all pairs of a bucket:
1. every class is compared with hubs only: a bucket's hubs are its smallest and its largest member, and a class takes
   the ``HUBS`` it shares most buckets with;
2. in buckets that then still hold several components, the sketches of classes outside the bucket's main component are
   compared with those of members of other components, and every pair that may be a link is confirmed, so that no link
   between components is lost.  A pair that shares several such buckets comes out of the smallest one only.
Comparing sketches inside a bucket is a join with a condition on the sketches' words, salted by bucket size: it streams,
and only pairs that pass come out.  Links are confirmed on both full sets (``confirm``): a task holds the sets of a block
of hubs while the sets of their members pass.

Links become components by alternating large-star and small-star steps, checkpointed in the shared folder.

Defined cases: null, empty and blank texts have no set and are linked with nothing; fewer than five words are one
shingle; rows without doc_id are linked with nothing and kept; rows that share a doc_id count as one document, linked
where any of its texts is; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysieve.llm.common import saved

SHINGLE, SIMILAR_PERCENT = 5, 75
SAMPLES, BANDED, BAND_ROWS, SKETCH_BITS = 512, 128, 4, 1024
MIN_ESTIMATE = 0.67  # the standard error of the estimate is about 0.023 at 0.75
HUBS = 2
BLOCK = 4000  # members of a bucket, or of a block of hubs, per salt
HUB_BLOCK = 512  # hubs whose sets a task holds while members pass
LINKS_PER_TASK = 100_000  # in a star step
BROADCAST_BYTES = 32 << 20
WORDS64 = SKETCH_BITS // 64
SKETCH = [f"s{i}" for i in range(WORDS64)]

_R = np.random.default_rng(20)
_XOR, _ODD = _R.integers(0, 1 << 32, SAMPLES, dtype=np.uint32), _R.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _P + h[i:i + len(out)]
    return np.unique(_mix(out))


def signature(found: np.ndarray) -> np.ndarray:
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    best = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), 128):
        np.minimum(best, ((low[i:i + 128, None] ^ _XOR) * _ODD).min(axis=0), out=best)
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:BANDED].reshape(-1, BAND_ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = _mix(key * _P + rows[:, i])
    return key.view(np.int64)


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    place = _mix(np.arange(SAMPLES, dtype=np.uint64) * _P + sig.astype(np.uint64)) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def estimate(differing: int) -> float:
    """Similarity that ``differing`` sketch bits stand for."""
    left = 1 - 2 * differing / SKETCH_BITS
    return 1 + SKETCH_BITS / (4 * SAMPLES) * float(np.log(left)) if left > 0 else 0.0


MAX_DIFFERING = max(d for d in range(SKETCH_BITS // 2) if estimate(d) >= MIN_ESTIMATE)


def _digest_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, t in zip(b["doc_id"], b["text"], strict=True):
            found = shingles(t)
            if len(found):
                sig = signature(found)
                out.append((i, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), band_keys(sig), *odd_sketch(sig).tolist()))
            else:
                out.append((i, 0, None, None, *[0] * WORDS64))
        frame = pd.DataFrame(out, columns=["doc_id", "n_shingles", "same", "bands", *SKETCH])
        yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (128-bit hash of the set), bands and the sketch's words per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_digest_batches, "doc_id long, n_shingles long, same binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def _placed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with the node's set for every place it has to go to."""
    for b in batches:
        for row in b.to_pylist():
            found, places = shingles(row["text"]).tobytes(), row["places"]
            cols = {k: [p[k] for p in places] for k in ("block", "salt", "side", "hubs")}
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols["block"], pa.int32()), pa.array(cols["salt"], pa.int32()), pa.array(cols["side"], pa.int32()), pa.array([row["node"]] * len(places), pa.int64()),
                 pa.array(cols["hubs"], pa.list_(pa.int64())), pa.array([found] * len(places), pa.binary())], names=["block", "salt", "side", "node", "hubs", "found"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets of distinct hashes reach the limit."""
    if 100 * min(len(x), len(y)) < SIMILAR_PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILAR_PERCENT * (len(x) + len(y) - both)


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (block, salt, side): the sets of a block's hubs (side 0) are held while its members (side 1) pass."""
    place, held = None, {}
    for b in batches:
        links = []
        for row in b.to_pylist():
            if (row["block"], row["salt"]) != place:
                place, held = (row["block"], row["salt"]), {}
            own = np.frombuffer(row["found"], np.uint64)
            if row["side"] == 0:
                held.setdefault(row["node"], []).append(own)
            else:
                links += [(row["node"], h) for h in row["hubs"] if any(similar(own, x) for x in held.get(h, ()))]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "y"])


def confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) among pairs (node, hub) whose full sets are similar enough.

    Hubs are dealt to blocks of about ``HUB_BLOCK``.  A node's set goes once to every block that holds hubs of its, and a
    hub's set once to every salt of its block, so that no set is written once per pair and no block with many members is
    one task.  Only the texts of nodes in pairs are cut into shingles again; the list of those nodes is broadcast while its
    size, counted in bytes, stays below ``BROADCAST_BYTES``.
    """
    pairs = saved(pairs)
    hubs = pairs.select("hub").distinct()
    blocks = max(1, -(-hubs.count() // HUB_BLOCK))
    block = F.pmod(F.xxhash64("hub"), F.lit(blocks)).cast("int").alias("block")
    asked = saved(pairs.groupBy(block, "node").agg(F.collect_set("hub").alias("hubs")))  # at most the hubs of a block
    salts = asked.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    if blocks <= BROADCAST_BYTES // 64:
        salts = F.broadcast(salts)
    members = asked.join(salts, "block").select("node", F.struct("block", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "hubs").alias("place"))
    holders = hubs.select("hub", block).join(salts, "block").select("block", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    holders = holders.select("node", F.struct("block", "salt", F.lit(0).alias("side"), F.lit(None).cast("array<long>").alias("hubs")).alias("place"))
    places = saved(members.unionByName(holders).groupBy("node").agg(F.collect_list("place").alias("places")))
    n_places, size = places.agg(F.coalesce(F.sum(F.size("places")), F.lit(0)), F.coalesce(F.sum(64 + 40 * F.size("places") + 8 * F.aggregate("places", F.lit(0), lambda s, p: s + F.coalesce(F.size(p["hubs"]), F.lit(0)))), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        places = F.broadcast(places)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    sets = rows.join(places, rows["doc_id"] == places["node"]).select("node", "text", "places").mapInArrow(_placed_sets, "block int, salt int, side int, node long, hubs array<long>, found binary")
    parts = max(1, min(n_places, -(-n_places // HUB_BLOCK) + blocks))
    met = sets.repartition(parts, "block", "salt").sortWithinPartitions("block", "salt", "side")
    return saved(met.mapInArrow(_confirm_batches, "x long, y long").select(*_pair("x", "y")).distinct())


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over edges (u, v): v's side hangs on the smallest node that u sees.

    Its stages have ``tasks`` tasks, or twice as many, whatever the number of shuffle partitions: steps are many and links
    short, and the driver keeps metrics of every task.
    """
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        hung = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.coalesce(tasks).distinct().coalesce(tasks)
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return hung.coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): every node of a link and the smallest node it can reach."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = state
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-state[0] // LINKS_PER_TASK))
        edges = saved(_star(_star(edges.coalesce(tasks), True, tasks), False, tasks))


def _differing(a: str, b: str) -> Column:
    out = F.lit(0)
    for s in SKETCH:
        out = out + F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}")))
    return out


def _near(members: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """node, hub: nodes of one bucket but of different components, one of them outside its main one, whose sketches allow a link."""
    known = members.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    sizes = known.groupBy("key", "comp").agg(F.count("*").alias("n"))
    buckets = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1")
    buckets = buckets.select("key", F.col("top.comp").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("salts"))
    rows = known.join(buckets, "key")
    mixed = rows.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most the bands of a class
    rows = saved(rows.join(mixed, "node").join(sketches, "node"))
    all_rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).alias("y")
    outside = rows.where("comp <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("x")
    same_place = (F.col("x.key") == F.col("y.key")) & (F.col("x.salt") == F.col("y.salt"))
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    pairs = outside.join(all_rows, same_place & (F.col("x.comp") != F.col("y.comp")) & (_differing("x", "y") <= MAX_DIFFERING) & first)
    return pairs.select(F.col("x.node").alias("node"), F.col("y.node").alias("hub")).distinct()


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, one row per input row."""
    rows = saved(digests(docs))
    classes = saved(rows.where("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same").agg(
        F.min("doc_id").alias("node"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in SKETCH]))
    sketches = classes.select("node", *SKETCH)
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1")
    members = saved(keys.join(shared, "key").select("key", "node", "low", "high"))

    # 1. hubs
    votes = members.select("node", F.explode(F.array_distinct(F.array("low", "high"))).alias("hub")).where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    ranked = votes.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "hub"))).where(F.col("rank") <= HUBS)
    pairs = ranked.select(F.col("node").alias("own"), "hub")
    x, y = sketches.alias("x"), sketches.alias("y")
    rated = pairs.join(x, F.col("own") == F.col("x.node")).join(y, F.col("hub") == F.col("y.node")).where(_differing("x", "y") <= MAX_DIFFERING)
    labels = components(confirm(docs, rated.select(F.col("own").alias("node"), "hub")))

    # 2. what is still apart
    links = confirm(docs, _near(members, labels, sketches))
    labels = components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))))

    named = classes.select("same", "node").join(labels, "node", "left").select("same", F.coalesce("comp", "node").alias("comp"))
    out = rows.select("doc_id", "n_shingles", "same").join(named, "same", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
