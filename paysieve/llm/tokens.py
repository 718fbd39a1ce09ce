"""Token ids of whole texts with a public byte-level BPE, and their flat binary files.

``IdEncoder`` encodes with the tokenizers library.  The tokenizer cuts a text into pieces before it merges bytes, and a
single blank or line break before a visible character always starts a new piece; so a chunk of such a text always has
the same ids.  A group of texts is cut into chunks and made distinct in Arrow, the chunks that the task has not met are
encoded together, one per line, and the ids of all texts are gathered by chunk number in numpy.  Texts with any other
white space go to the tokenizer whole.  What is kept is bounded (``KEPT_BYTES``), and chunks met once are freed with their task.

Files of ``write_ids``: documents are sorted by doc_id (rows of one id by length and hash of their texts) across range
partitions.  Every partition writes a flat file of unsigned ids (the narrowest type that holds the vocabulary), a file of
64-bit offsets (one more than documents, in ids from the partition's start) and a file of 64-bit doc_ids.  A partition's
base, the number of ids in all before it, is a prefix sum over one row per partition.  ``read_ids`` maps the files into
memory, task by task (off a local file system they are read).  A task writes under an attempt's own name and renames, so
a repeated task leaves the same files.

Defined cases: null text is empty and has only the end id; a null doc_id sorts first and is read back as null; repeated
doc_ids keep all their rows, ordered by text; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm.common import saved, shared_folder

TOKENIZER = "byte_bpe_50k.json"
KEPT_BYTES = 24 << 20  # most bytes of kept chunks, counted with CHUNK_COST each: once for new ones, once for steady ones
CHUNK_COST = 150
GROUP_BYTES = 2 << 20  # text encoded at once, besides a longer single text
# What sends a text to the tokenizer whole: its special token, NUL, white space other than single blanks and line breaks.
UNEVEN = (r"<\|endoftext\|>|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
          r"|[ \n][ \n]|^[ \n]|[ \n]$")
# A letter or digit and a sign that is no apostrophe never share a piece; a cut there makes far fewer chunks differ.
SIGN = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([!-&(-/:-@\[-`{-~])"
NO_ID = -(1 << 63)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class IdEncoder:
    """Texts to ids of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.newline = self._ids("\n")
        # The short way needs the cut at blanks and line breaks that byte-level tokenizers make.
        cut = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str("a b\nc.d1\u00e9%")] if self.tokenizer.pre_tokenizer else []
        self.short = self.tokenizer.normalizer is None and len(cut) == 9 and len(self.newline) == 1
        self.steady: dict[str, bytes] = {}
        self.steady_bytes = 0
        self.forget()

    def forget(self) -> None:
        """Drop the chunks that were met in one group only; those met again stay for the worker's next task."""
        self.fresh: dict[str, bytes] = {}
        self.fresh_bytes = 0
        pa.default_memory_pool().release_unused()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks as bytes.  A chunk that a second group holds becomes a steady one."""
        if self.fresh_bytes > KEPT_BYTES:
            self.forget()
        if self.steady_bytes > KEPT_BYTES:
            self.steady, self.steady_bytes = {}, 0
        steady, fresh, unknown = self.steady, self.fresh, []
        for c in chunks:
            if c not in steady:
                if c in fresh:
                    steady[c] = fresh.pop(c)
                    self.steady_bytes += len(c) + CHUNK_COST
                elif c:
                    unknown.append(c)
        if unknown:
            self._learn(unknown)
        return [steady.get(c) or fresh[c] if c else b"" for c in chunks]

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks; a chunk that ends in a line break keeps it, the rest hold none."""
        joined = "\n".join([c.rstrip("\n") for c in chunks])
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
        size, flat, line = self.dtype.itemsize, ids.tobytes(), self.newline.tobytes()
        ends = np.flatnonzero(ids == self.newline[0])
        for c, i, j in zip(chunks, [0, *((ends + 1) * size).tolist()], [*(ends * size).tolist(), len(flat)], strict=True):
            self.fresh[c] = flat[i:j] + line if c[-1] == "\n" else flat[i:j]
        self.fresh_bytes += sum(map(len, chunks)) + CHUNK_COST * len(chunks)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and the offsets of the texts in them."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False) if self.short else np.ones(len(texts), bool)
        even = pc.if_else(pa.array(whole), "", texts)
        marked = pc.replace_substring(pc.replace_substring(even, "\n", "\n\0"), " ", "\0 ")
        marked = pc.replace_substring_regex(marked, SIGN, "\\1\0\\2")
        lists = pc.split_pattern(pc.binary_join_element_wise(marked, "", "\0"), "\0")  # an empty chunk ends every text
        starts = lists.offsets.to_numpy().astype("i8") - lists.offsets[0].as_py()
        chunks = lists.flatten().dictionary_encode()
        names, at = chunks.dictionary.to_pylist(), chunks.indices.to_numpy().copy()

        end = self.dtype.type(end_id).tobytes()
        store = [ids if c else end for c, ids in zip(names, self._ids_of(names), strict=True)]
        # A text without a cut, or without a word, is one chunk of its own before its end.
        alone = np.flatnonzero(whole | (np.diff(starts) == 2) & (pc.binary_length(even).to_numpy(zero_copy_only=False) == 0))
        at[starts[alone]] = len(store) + np.arange(len(alone))
        store += [self._ids(texts[int(i)].as_py()).tobytes() if whole[i] else b"" for i in alone]
        taken = pa.array(store, pa.binary()).take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], "i4")[:len(at) + 1].astype("i8") // self.dtype.itemsize
        return np.frombuffer(taken.buffers()[2], self.dtype)[:ends[-1]], ends[starts]

    def groups(self, batch: pa.RecordBatch, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Parts of a batch with the ids and offsets of their texts, in groups of bounded size."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype("i8"))
        first = 0
        while first < len(ends):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + GROUP_BYTES, side="right")))
            part = batch.slice(first, last - first)
            yield part, *self.encode(part.column("text"), end_id)
            first = last


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@functools.cache
def encoder_for(path: str) -> IdEncoder:
    """One encoder per Python worker: the tokenizer is read once, steady chunks serve its later tasks."""
    return IdEncoder(path)


class _SharedFile:
    """A file of a shared folder that is written in pieces and appears whole or not at all."""

    def __init__(self, folder: str, name: str):
        own = f".{name}.{uuid.uuid4().hex}"
        if path := _local(folder):
            os.makedirs(path, exist_ok=True)
            self.out, self.finish = open(f"{path}/{own}", "wb"), lambda: os.replace(f"{path}/{own}", f"{path}/{name}")  # noqa: SIM115
        else:
            from pyarrow import fs
            files, base = fs.FileSystem.from_uri(folder)
            files.create_dir(base, recursive=True)
            self.out, self.finish = files.open_output_stream(f"{base}/{own}"), lambda: files.move(f"{base}/{own}", f"{base}/{name}")
        self.write = self.out.write

    def commit(self) -> None:
        self.out.close()
        self.finish()


def _mapped(folder: str, name: str, dtype) -> np.ndarray:
    if path := _local(folder):
        return np.memmap(f"{path}/{name}", dtype=dtype, mode="r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, dtype)
    from pyarrow import fs
    files, base = fs.FileSystem.from_uri(folder)
    with files.open_input_file(f"{base}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> DataFrame:
    """Encode and write all documents; returns the written partitions: part, name, n_docs, n_ids, base, type.

    One row per partition is what the prefix sum and the driver see.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder = encoder_for(tokenizer)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}"
        flat, lengths, names = None, [], []
        for b in batches:
            for rows, ids, offsets in encoder.groups(b, end_id):
                flat = flat or _SharedFile(folder, f"{name}.bin")
                flat.write(ids.tobytes())
                lengths.append(np.diff(offsets))
                names.append(pc.fill_null(rows.column("doc_id"), NO_ID).to_numpy())
        encoder.forget()
        if not flat:
            return
        flat.commit()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<u8")
        for end_of_name, data in (("idx", offsets), ("doc", np.concatenate(names).astype("<i8"))):
            file = _SharedFile(folder, f"{name}.{end_of_name}")
            file.write(data.tobytes())
            file.commit()
        row = {"part": pa.array([part], pa.int32()), "name": [name], "n_docs": [len(offsets) - 1], "n_ids": [int(offsets[-1])], "type": [encoder.dtype.str]}
        yield pa.RecordBatch.from_pydict(row)

    order = [F.col("doc_id"), F.length("text"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    written = saved(rows.mapInArrow(run, "part int, name string, n_docs long, n_ids long, type string"))
    base, out = 0, []
    for p in sorted(written.collect()):
        out.append((*p, base))
        base += p.n_ids
    return spark.createDataFrame(out, "part int, name string, n_docs long, n_ids long, type string, base long")


def read_ids(parts: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (bytes of little-endian unsigned 32-bit ids) per document, from the mapped files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.to_pylist():
                ids = _mapped(folder, f"{p['name']}.bin", np.dtype(p["type"]))
                offsets, names = _mapped(folder, f"{p['name']}.idx", "<u8").astype("i8"), _mapped(folder, f"{p['name']}.doc", "<i8")
                for i in range(0, len(names), 500):
                    j = min(i + 500, len(names))
                    cuts, wide = 4 * (offsets[i:j + 1] - offsets[i]), ids[offsets[i]:offsets[j]].astype("<u4")
                    own = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(wide)]).cast(pa.binary())
                    cols = {"doc_id": pa.array(names[i:j], mask=names[i:j] == NO_ID), "start": p["base"] + offsets[i:j], "n_tokens": np.diff(offsets[i:j + 1]), "ids": own}
                    yield pa.RecordBatch.from_pydict(cols)

    n = max(1, parts.count())
    return parts.repartitionByRange(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digested(read: DataFrame) -> DataFrame:
    """Adds ids_crc32, the unsigned crc32 of a document's ids."""
    return read.withColumn("ids_crc32", F.crc32("ids"))


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"


# ---- packing by powers of two


def pieces_of(length: int, limit: int) -> list[int]:
    """Lengths of the pieces of a document: whole sequences first, then the binary digits of the rest, descending."""
    whole, rest = divmod(length, limit)
    return [limit] * whole + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if rest >> k & 1]


def all_pieces(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the document, start and length of every piece, in order; the pieces of each are those of ``pieces_of``."""
    numbers, whole = np.arange(len(lengths)), lengths // limit
    nth = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    doc, start, length = [np.repeat(numbers, whole)], [nth * limit], [np.full(len(nth), limit, "i8")]
    for k in range(limit.bit_length() - 2, -1, -1):
        own = numbers[lengths >> k & 1 == 1]
        doc.append(own)
        start.append(lengths[own] >> k + 1 << k + 1)
        length.append(np.full(len(own), 1 << k, "i8"))
    doc, start, length = np.concatenate(doc), np.concatenate(start), np.concatenate(length)
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


def pack(docs: DataFrame, tokenizer: str, end_id: int, limit: int = 1024, ids: bool = True) -> DataFrame:
    """Cut every document into pieces of power-of-two lengths and number the sequences bucket by bucket.

    A piece fills its sequence, so none crosses documents and none is padded.  Returns per piece doc_id, start, length,
    ids_crc32, doc_tokens, bucket (log2 of the length), sequence_id, offset (0) and, if asked for, ids: the piece's ids as
    little-endian unsigned bytes of the narrowest type, of 2 bytes each where the vocabulary has at most 65,536 entries.
    Within a task the pieces of a bucket are counted up; a prefix sum over (bucket, task) counts gives each its base, so
    the sequences of one length have consecutive ids.  ``limit`` must be a power of two.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        from pyspark import TaskContext
        encoder, part, seen = encoder_for(tokenizer), TaskContext.get().partitionId(), {}
        for b in batches:
            for rows, found, offsets in encoder.groups(b, end_id):
                doc, start, length = all_pieces(np.diff(offsets), limit)
                bucket, place = np.log2(length).astype("i4"), np.zeros(len(length), "i8")
                for k in np.unique(bucket).tolist():
                    own = bucket == k
                    place[own] = seen.get(k, 0) + np.arange(own.sum())
                    seen[k] = seen.get(k, 0) + int(own.sum())
                wide, ends = memoryview(found.astype("<u4")).cast("B"), 4 * np.cumsum(length)
                sums = [crc32(wide[i:j]) for i, j in zip((ends - 4 * length).tolist(), ends.tolist(), strict=True)]
                if ids:
                    cuts = (np.concatenate([[0], np.cumsum(length)]) * encoder.dtype.itemsize).astype("i8")
                    own_ids = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(cuts), pa.py_buffer(found.tobytes())]).cast(pa.binary())
                else:
                    own_ids = pa.nulls(len(length), pa.binary())
                cols = {"part": np.full(len(length), part, "i4"), "bucket": bucket, "place": place, "doc_id": rows.column("doc_id").take(pa.array(doc)), "start": start,
                        "length": length, "ids_crc32": pa.array(sums, pa.int64()), "doc_tokens": np.diff(offsets)[doc], "ids": own_ids}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols.values()], names=list(cols))
        encoder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = saved(rows.mapInArrow(run, "part int, bucket int, place long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"))
    counts = cut.groupBy("bucket", "part").agg(F.count("*").alias("n")).collect()  # tasks x buckets
    base, bases = 0, []
    for r in sorted(counts):
        bases.append((r.bucket, r.part, base))
        base += r.n
    bases = docs.sparkSession.createDataFrame(bases, "bucket int, part int, base long")
    out = cut.join(F.broadcast(bases), ["bucket", "part"])  # one row per bucket and task
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", (F.col("base") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if ids else []))
