"""Scalar features of a payload text."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paysieve.functions.text import let

# Keyword families.
KEYWORDS = {
    "sqli_score": ["union", "select", "sleep", "benchmark", "or 1=1", "drop", "insert", "update"],
    "xss_score": ["script", "onerror", "svg", "iframe", "javascript", "alert", "onload"],
    "cmd_score": [";", "|", "&&", "`", "$(", "wget", "curl", "bash"],
    "path_score": ["../", "..\\", "/etc/passwd", "windows/system32"],
    "file_score": ["php://", "file://", "include", "require"],
    "xxe_score": ["<!entity", "system", "file://", "&xxe;", "<!doctype"],
    "prompt_score": ["ignore previous", "ignore all", "disregard", "system prompt", "jailbreak", "dan mode", "developer mode", "绕过", "忽略之前"],
}
# Weight of a part location (feature) and of the protocol vector.
LOCATION_WEIGHT = {"query": 1.0, "body": 0.8, "header": 0.6, "cookie": 0.7, "json": 0.75}
PROTOCOL_LOCATION = {"query": 1.0, "body": 0.85, "header": 0.7, "cookie": 0.75, "json": 0.8}
EMBED_DIM = 384
GRID = (32, 64)


def entropy(t: Column) -> Column:
    chars = F.array_distinct(F.split(t, ""))
    n = F.length(t)
    probs = F.transform(F.filter(chars, lambda c: c != ""), lambda c: (n - F.length(F.replace(t, c, F.lit("")))) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(probs, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def count_char(t: Column, ch: str) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))


def statistical(t: Column) -> dict[str, Column]:
    n = F.greatest(F.length(t), F.lit(1))
    return {
        "length": n.cast("double"),
        "digit_ratio": F.regexp_count(t, F.lit(r"\p{Nd}")) / n,
        "special_ratio": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}]")) / n,
        "entropy": entropy(t),
        "paren_count": (count_char(t, "(") + count_char(t, ")")).cast("double"),
        "encoded_ratio": count_char(t, "%") / n,
        "upper_ratio": F.regexp_count(t, F.lit(r"\p{Lu}")) / n,
    }


def hits(low: Column, words: list[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total.cast("double")


def semantic(t: Column) -> dict[str, Column]:
    out = {name: hits(F.lower(t), words) for name, words in KEYWORDS.items()}
    out["tag_count"] = F.regexp_count(t, F.lit("<[^>]+>")).cast("double")
    return out


def nesting_depth(t: Column) -> Column:
    """Deepest open bracket / tag level; unmatched closers do not go below zero."""
    marks = F.regexp_extract_all(t, F.lit(r"[(\[{<)\]}>]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    return F.aggregate(marks, zero, lambda a, c: let(
        F.greatest(F.lit(0), a["d"] + F.when(F.instr(F.lit("([{<"), c) > 0, 1).otherwise(-1)),
        lambda d: F.struct(d.alias("d"), F.greatest(a["m"], d).alias("m"))))["m"].cast("double")


def structural(t: Column) -> dict[str, Column]:
    return {
        "ast_depth": nesting_depth(t),
        "html_nodes": F.regexp_count(t, F.lit("<[a-zA-Z][^>]*>")).cast("double"),
        "js_calls": F.regexp_count(t, F.lit(r"\w+\s*\(")).cast("double"),
        "xml_entities": F.regexp_count(t, F.lit(r"&\w+;")).cast("double"),
        "angle_bracket_ratio": count_char(t, "<") / F.greatest(F.length(t), F.lit(1)),
    }


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def all_features(t: Column, location: Column, depth: Column) -> dict[str, Column]:
    """Feature columns in model order: statistical, location, depth, keyword, structural."""
    return {**statistical(t), "location_weight": lookup(location, LOCATION_WEIGHT, 0.5), "decode_depth": depth.cast("double"),
            **semantic(t), **structural(t)}


def protocol_vector(raw: Column, location: Column, depth: Column, obfuscated: Column, repeated: Column) -> dict[str, Column]:
    low = F.lower(raw)
    return {
        "proto_location": lookup(location, PROTOCOL_LOCATION, 0.6),
        "proto_decode_depth": F.least(depth, F.lit(6)) / 6.0,
        "proto_obfuscated": obfuscated.cast("double"),
        "proto_multipart": low.contains("webkitformboundary").cast("double"),
        "proto_repeat": repeated.cast("double"),
        "proto_ampersand_density": F.least(count_char(raw, "&") / 20.0, F.lit(1.0)),
        "proto_pct_density": F.least(count_char(raw, "%") / 30.0, F.lit(1.0)),
        "proto_null_byte": low.contains("%00").cast("double"),
    }


def case_switch_rate(t: Column) -> Column:
    """Share of adjacent letter pairs that change case (texts with at least eight letters)."""
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    flags = F.regexp_replace(F.regexp_replace(letters, r"\p{Lu}", "1"), "[^1]", "0")
    # a switch is a border between runs, so count runs
    runs = F.regexp_count(flags, F.lit("1+|0+"))
    n = F.length(letters)
    return F.when(n >= 8, (runs - 1) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)


def marker_score(t: Column) -> Column:
    # Markers of the span annotator.
    markers = ["%00", "%252", "\\u00", "&#", "%2b", "/**/", "<script", "union", "select"]
    return hits(F.lower(t), markers).cast("int") + F.regexp_count(t, F.lit("[＀-￯]"))


def payload_hash(t: Column) -> Column:
    return F.substring(F.sha2(t, 256), 1, 16)


GRID_TYPE = T.StructType([T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("edge", T.DoubleType()),
                          T.StructField("high", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])


GRID_ROWS = 128   # texts whose cells are held at once


def laid_over(b: np.ndarray, cells: int) -> np.ndarray:
    """Cell means of a text longer than the grid, over the tiles that reach each cell."""
    full, rest = divmod(b.size, cells)
    total = b[: full * cells].reshape(full, cells).sum(0, dtype=np.float64)
    total[:rest] += b[full * cells:]
    tiles = np.full(cells, full)
    tiles[:rest] = full + 1
    return total / tiles


def grid_arrays(texts) -> tuple[np.ndarray, ...]:
    """Vectors, edge energies, high-byte shares, means and deviations of texts.

    A text fills the first cells of its grid and leaves the others zero; only the filled ones are visited."""
    rows, cols = GRID
    cells, n = rows * cols, len(texts)
    codes = [(t or "").encode("utf-8") for t in texts]
    m = np.minimum(np.array([len(c) for c in codes], dtype=np.int64), cells)
    filled = [laid_over(np.frombuffer(c, dtype=np.uint8), cells) if len(c) > cells else np.frombuffer(c, dtype=np.uint8) for c in codes]
    v = np.concatenate(filled) / 255.0 if n else np.zeros(0)
    text = np.repeat(np.arange(n), m)
    at = np.arange(len(v)) - np.repeat(np.cumsum(m) - m, m)

    def count(hit: np.ndarray) -> np.ndarray:
        return np.bincount(text[hit], minlength=n)
    mean = np.bincount(text, v, n) / cells
    std = np.sqrt((np.bincount(text, (v - mean[text]) ** 2, n) + (cells - m) * mean ** 2) / cells)
    head = np.column_stack([mean, std, count(v > 0.6) / cells, (count(v < 0.05) + cells - m) / cells])
    # Means of 4x4 blocks, of which the vector takes the first ones.
    block = at // (4 * cols) * (cols // 4) + at % cols // 4
    kept = block < 60
    blocks = np.bincount(text[kept] * 60 + block[kept], v[kept], n * 60).reshape(n, 60) / 16
    vec = np.hstack([head, blocks])
    norm = np.linalg.norm(vec, axis=1, keepdims=True)
    vec = np.divide(vec, norm, out=vec.copy(), where=norm > 1e-8)
    # Steps between neighbours of a grid row; the neighbour of a text's last cell is zero.
    after = np.append(v[1:], 0.0) if len(v) else v
    after = np.where(at + 1 < m[text], after, 0.0)
    edge = np.bincount(text, np.where(at % cols < cols - 1, np.abs(after - v), 0.0), n) / cells
    return vec, edge, count(v > 0.8) / cells, mean, std


def grid_moments(texts: pd.Series) -> pd.DataFrame:
    vec, edge, high, mean, std = grid_arrays(texts)
    return pd.DataFrame({"vec": list(vec), "edge": edge, "high": high, "mean": mean, "std": std})


def grid_texture(texts: list) -> tuple[np.ndarray, ...]:
    """Second value of the vector, edge energy and high-byte share of each text, in groups of GRID_ROWS texts."""
    found = [grid_arrays(texts[at:at + GRID_ROWS]) for at in range(0, max(len(texts), 1), GRID_ROWS)]
    return tuple(np.concatenate([f(x) for x in found]) for f in (lambda x: x[0][:, 1], lambda x: x[1], lambda x: x[2]))


@lru_cache(maxsize=1 << 16)
def _surprise(count: int, n: int) -> float:
    p = count / n
    return p * (math.log(p) / math.log(2.0))


def text_entropies(texts: list) -> np.ndarray:
    """``entropy`` of each text, NaN for null."""
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        if t is None:
            out[i] = np.nan
        else:
            a, n = 0.0, len(t)
            for c in Counter(t).values():
                a -= _surprise(c, n)
            out[i] = a
    return out


def series_anomaly(series: np.ndarray, width: int = 4) -> np.ndarray:
    """Anomaly of each row (see ``operators.decide``): mean distance to the centred moving average, its slope and the fourth value."""
    n = series.shape[1]
    trend = np.zeros_like(series)
    for i in range(n):
        for j in range(max(i - 2, 0), min(i + 2, n)):
            trend[:, i] += series[:, j]
    trend /= width
    resid = np.zeros(len(series))
    for i in range(n):
        resid += np.abs(series[:, i] - trend[:, i])
    return 1.0 / (1.0 + np.exp(-(resid / n * 2.0 + np.abs(trend[:, -1] - trend[:, 0]) + series[:, 3] * 0.1)))


@F.pandas_udf(GRID_TYPE)
def byte_grid(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """32x64 byte grid: moments and 4x4 block means cut to 64 values with unit length, plus
    edge energy and high-byte share by name.

    The whole text is laid over the grid in tiles of 2,048 bytes; a cell is the mean over the tiles that reach it.
    A batch is worked off in groups of GRID_ROWS texts, so that their cells (16 KB at most for each) stay in the processor's cache."""
    for s in texts:
        found = [grid_moments(s.iloc[at:at + GRID_ROWS]) for at in range(0, max(len(s), 1), GRID_ROWS)]
        yield pd.concat(found, ignore_index=True) if len(found) > 1 else found[0]


@lru_cache(maxsize=1 << 17)
def hash_bucket(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % EMBED_DIM


@lru_cache(maxsize=1 << 17)
def gram_bucket(packed: int) -> int:
    """Bucket of three code points of 21 bits each."""
    return hash_bucket(chr(packed >> 42) + chr(packed >> 21 & 0x1FFFFF) + chr(packed & 0x1FFFFF))


def embed_texts(texts: pd.Series) -> np.ndarray:
    """Hashed character trigrams (weight 1) and words (weight .5), unit length, one row per text.

    Trigrams are counted in numpy over code points; only distinct ones of a text are hashed.
    """
    out = np.zeros((len(texts), EMBED_DIM))
    for row, t in zip(out, texts):
        low = (t or "").lower()
        points = np.frombuffer(low.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        grams, counts = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
        words = Counter(w for w in low.split() if len(w) >= 3)
        buckets = [*map(gram_bucket, grams.tolist()), *map(hash_bucket, words)]
        weights = np.concatenate([counts, 0.5 * np.array(list(words.values()))])
        row += np.bincount(np.array(buckets, dtype=np.int64), weights, EMBED_DIM)
        n = np.linalg.norm(row)
        if n > 1e-8:
            row /= n
    return out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def trigram_embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series(list(embed_texts(s).astype(np.float32)))
