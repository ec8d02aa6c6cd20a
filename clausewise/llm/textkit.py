"""Words, word hashes and shingles of Arrow text columns, for code that runs inside Spark tasks.

Words are runs of anything but the six ASCII white-space characters, after lower-casing A-Z only. A null text has
no words. Everything works on slices of a few megabytes, so a task holds one slice (or one very long text) at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

SLICE_BYTES = 6 << 20


def prepare(spark: SparkSession, batch_bytes: int = 16 << 20) -> SparkSession:
    """Small Arrow batches: rows may hold very long texts, and a task keeps a few batches in memory, on both sides of the pipe."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def give_back() -> None:
    """Return freed memory to the system: Arrow and the C library keep it otherwise, in the driver for as long as it lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


def free(columns: list[str], name: str) -> str:
    """A column name that is not taken yet."""
    while name in columns:
        name += "_"
    return name


def slices(batches, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds at most ``limit`` bytes of text or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def lowered(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.ascii_lower(texts.cast(pa.string())), "")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column in order (binary), and the offsets of each row's words in them."""
    parts = pc.ascii_split_whitespace(lowered(texts))
    row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))
    flat = parts.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(flat), 0)
    row = row[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real), np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(parts)))))


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as numbers into the list of distinct words of the slice."""
    seen = flat.dictionary_encode()
    return seen.indices.to_numpy(), seen.dictionary


def hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), np.uint64, len(distinct))


LONG_WORD = 64
KEPT_BYTES = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word (binary), eight bytes of all words at a time; words above ``LONG_WORD`` bytes one by one."""
    if not len(flat):
        return np.zeros(0, np.uint64)
    _, offsets, data = flat.buffers()
    ends = np.frombuffer(offsets, np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    begin, size = ends[:-1], np.diff(ends)
    padded = np.concatenate((np.frombuffer(data, np.uint8)[: ends[-1]], np.zeros(8, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the eight bytes from every place on
    out = mixed(size.astype(np.uint64) + np.uint64(17))
    live = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        out[live] = mixed(out[live] ^ (eight[begin[live] + at] & KEPT_BYTES[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(flat[i].as_py())
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` neighbouring word hashes; it depends on their order and on ``n``."""
    count = max(0, len(h) - n + 1)
    out = np.full(count, n, np.uint64)
    for j in range(n):
        out = mixed(out) + h[j : j + count]
    return mixed(out)


def shingle_sets(h: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row with fewer than ``n`` words has its whole sequence as one."""
    every, out = sequences(h, n), []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            found = np.sort(every[a : b - n + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:
            out.append(sequences(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def text_shingles(texts: pa.Array, n: int) -> list[np.ndarray]:
    flat, offsets = words(texts)
    return shingle_sets(word_hashes(flat), offsets, n)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy rows."""
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))
