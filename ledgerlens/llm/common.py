"""Shared helpers: staged tables, session settings and vectorised text kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; any other master is refused, since executors would not
    see the driver's local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dirs[sc.applicationId]


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows that one Arrow batch hands to Python, for this session: texts can be long. A lower bound that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "0") or 0)
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


# ---------------------------------------------------------------- vectorised text kernels

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_SEQ = _rng.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_byte = np.arange(256)
#: Bytes of words separated by [\x20\x09-\x0D].
SPACED = ~((_byte == 32) | ((_byte >= 9) & (_byte <= 13)))
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (every byte of a non-ASCII character counts).
ALNUM = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for i, b in enumerate((_BASE, _BASE_INV)):
            out = np.full(size + 1, b, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts, about `limit` bytes each; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, a run of bytes for which inside[byte]; words never span texts."""
    is_word = inside[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:] = is_word
    after[:-1] = is_word
    before[offsets] = False
    after[offsets] = False
    starts = np.flatnonzero(is_word & ~before[:-1])
    ends = np.flatnonzero(is_word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], a polynomial over random byte values."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = out + words[k : len(words) - n + 1 + k] * _SEQ[k]
    return mix(out)


@lru_cache(maxsize=1)
def keep_freed() -> None:
    """Let this worker keep up to 256 MB of freed memory for its next arrays, where the C library is glibc.

    Otherwise every large array gets new pages from the kernel, which costs more than filling them.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD, at its most
    mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


# ---------------------------------------------------------------- arrays that travel between tasks


def pack(x: np.ndarray) -> bytes:
    """The bytes of an array, the i-th of every element together: sorted or small numbers then shrink in a shuffle."""
    if not len(x):
        return b""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize)
    out = np.empty((x.itemsize, len(x)), np.uint8)
    for i in range(x.itemsize):
        out[i] = raw[:, i]
    return out.tobytes()


def unpack(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(dtype).reshape(-1)
