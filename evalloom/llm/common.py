"""Shared helpers: shared folders, byte-level word splitting in numpy, and a lookup join that survives hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles at a time; bounds the memory of the temporary arrays.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder, as a URI, that the driver and all executors can reach.

    It lies under ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (as in tests) a local one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = _own_folder()
    # a path without a scheme belongs to the cluster's file system, which only Hadoop's configuration knows
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{whole.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="evalloom-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing still to be run reads."""
    for t in tables:
        if path := t.__dict__.get("_written"):
            remove(t.sparkSession, path)


def tidied(run):
    """A function of Arrow batches that gives freed memory back to the system when its task ends: workers live on."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return inner


def filesystem(uri: str):
    """(file system, path) of pyarrow for a URI of the shared folder; used inside tasks."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, *parts: bytes) -> None:
    """Write a file under its final name in one step, so a repeated task never leaves half a file to read.

    A file system with real folders renames in one step; an object store shows an object when it is whole, and knows no
    renaming but copy and deletion. Attempts of one task write the same bytes, so it doesn't matter which one stays.
    """
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    renames = urlparse(uri).scheme in ("", "file", "hdfs", "viewfs")
    part = f"{path}.{uuid.uuid4().hex}.tmp" if renames else path
    with system.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    if renames:
        system.move(part, path)


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder or file of the shared folder; called by the driver, when no task can need it again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_array(uri: str, dtype) -> np.ndarray:
    """A flat array file, memory-mapped. Where the shared folder isn't mounted, a copy is mapped that leaves no file behind."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return np.memmap(parsed.path, dtype=dtype, mode="r") if os.path.getsize(parsed.path) else np.zeros(0, dtype)
    system, path = filesystem(uri)
    with system.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
        shutil.copyfileobj(f, copy)
        copy.flush()
        return np.memmap(copy, dtype=dtype, mode="r") if copy.tell() else np.zeros(0, dtype)


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return raw, ends - (ends[0] if len(ends) else 0)


def slices(texts: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``most`` bytes each; a longer text is a range of its own. No text is cut."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))))
        yield start, stop
        start = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the index of its first word (and a last one)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", _UNBASE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, from a prefix sum of a polynomial over random byte values; A-Z lower-cased if asked.

    Goes through the words about ``SLICE_BYTES`` at a time, so a very long text takes no more memory than a short one.
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")))
        part = data[starts[i] : ends[j - 1]]
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        up, down = _power(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[_LOWER[part] if lower else part] * up, out=sums[1:])
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def words_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves as a binary array."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    take = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[take])])


def hot_lookup(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "left", share: int = 1000) -> DataFrame:
    """Join ``left`` with ``right``, which has one row a key and, in ``n_rows``, how many rows of ``left`` have it.

    Keys with more than 1/``share`` of ``rows`` are joined by broadcast: there can be no more than ``share`` of them, whatever
    the size of the input. All others take the ordinary shuffled join, in which none of them can load a task. Without such
    keys this is an ordinary join. ``right`` is read twice, so it should be a written table.
    """
    least = max(1000, rows // share)
    if not right.where(F.col("n_rows") > least).head(1):
        return left.join(right.drop("n_rows"), key, how)
    hot = right.where(F.col("n_rows") > least)
    rest = right.where(F.col("n_rows") <= least)
    flags = hot.select(F.col(key).alias("_hot_key")).withColumn("_hot", F.lit(True))
    marked = left.join(F.broadcast(flags), F.col(key) == F.col("_hot_key"), "left").drop("_hot_key")
    a = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot.drop("n_rows")), key, "inner")
    b = marked.where(F.col("_hot").isNull()).drop("_hot").join(rest.drop("n_rows"), key, how)
    return a.unionByName(b)


#: Bits of the table that tells rows which surely have no partner, and of one of its pieces (4 KB each).
PARTNER_BITS, PIECE_BITS = 26, 15


def with_partner(df: DataFrame, hashed: str, partners: DataFrame, column: str = "_met") -> DataFrame:
    """``df`` and whether its 64-bit hash may be among the ``partners`` (one column): false means that it surely isn't.

    A table of 2^26 bits by the hash's lower part, 8 MB whatever the size of the input, is broadcast in pieces. Rows that can
    only be without a partner so need no shuffle; the more partners there are, the more others go through it in vain.
    """
    slot = lambda c: c.bitwiseAND((1 << PARTNER_BITS) - 1)
    piece, place = (lambda c: F.shiftright(slot(c), PIECE_BITS)), (lambda c: slot(c).bitwiseAND((1 << PIECE_BITS) - 1))
    key = F.col(partners.columns[0])
    bits = partners.where(key.isNotNull()).groupBy(piece(key).alias("_piece")).agg(F.bitmap_construct_agg(place(key)).alias("_bits"))
    at = place(F.col(hashed))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    return df.withColumn("_piece", piece(F.col(hashed))).join(F.broadcast(bits), "_piece", "left").withColumn(column, F.coalesce(bit, F.lit(False))).drop("_piece", "_bits")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed: sorted keys as differences have mostly zero planes."""
    codec, out, sizes = pa.Codec("zstd", 1), [], []
    for a in arrays:
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes()
        part = codec.compress(raw, asbytes=True)
        sizes.append((a.dtype.str, len(a), len(part)))
        out.append(part)
    head = json.dumps(sizes).encode()
    return b"".join([len(head).to_bytes(4, "little"), head, *out])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    at, out, codec = 4 + n, [], pa.Codec("zstd")
    for kind, count, size in json.loads(blob[4 : 4 + n]):
        dtype = np.dtype(kind)
        raw = codec.decompress(blob[at : at + size], count * dtype.itemsize, asbytes=True)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, count).T).reshape(-1).view(dtype))
        at += size
    return out


def differences(keys: np.ndarray) -> np.ndarray:
    out = keys.copy()
    out[1:] -= keys[:-1]
    return out
