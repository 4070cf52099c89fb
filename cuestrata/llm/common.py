"""Helpers shared by the operators of this subpackage: row keys, Arrow text buffers, numpy hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestrata.session import scratch

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Bytes of text that one numpy pass works on; bounds a Python worker's memory.
SLICE_BYTES = 1 << 19
#: Powers in the one table of ``span_hashes``; longer spans are hashed piece by piece.
POWERS = 1 << 17
#: Stands for a null doc_id where an order is needed: such rows come after all others.
LAST_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Hash that tells apart rows which share a doc_id; null and empty texts differ."""
    return F.coalesce(F.xxhash64(F.col(name)), F.lit(0)) + F.when(F.col(name).isNull(), 1).otherwise(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder, well compressed, and read again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Freed memory to the system: workers are reused and live beside the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Batches) -> Batches:
    """``run``, after which the worker keeps no freed memory."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], (off - off[0]).astype(np.int64)


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def byte_values(seed: int) -> np.ndarray:
    """A 64-bit value for each byte, from a rule."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def multiplier(seed: int) -> int:
    """An odd multiplier, from a rule."""
    return int(mix(np.array([seed + 77], np.uint64))[0]) | 1


@lru_cache(2)
def powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the seed's multiplier and of its inverse modulo 2**64: two tables of a fixed size."""
    m = multiplier(seed)
    out = []
    for base in (m, pow(m, -1, 1 << 64)):
        p = np.full(POWERS, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def long_hash(part: np.ndarray, seed: int) -> np.uint64:
    """Polynomial of a span that is longer than half the table, piece by piece."""
    p, m, total = powers(seed)[0], multiplier(seed), 0
    for at in range(0, len(part), POWERS):
        piece = part[at : at + POWERS]
        total += int((byte_values(seed)[piece] * p[: len(piece)]).sum(dtype=np.uint64)) * pow(m, at, 1 << 64)
    return np.uint64(total & (1 << 64) - 1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes, wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    p, inv = powers(seed)
    half = POWERS // 2
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = int(np.searchsorted(starts, lo + half, "left"))
        a, b = starts[at:to] - lo, ends[at:to] - lo
        long = np.flatnonzero(b - a > half)
        b = np.minimum(b, a + half)
        n = int(b.max())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_values(seed)[buf[lo : lo + n]] * p[:n], out=sums[1:])
        whole = (sums[b] - sums[a]) * inv[a]
        for i in long.tolist():
            whole[i] = long_hash(buf[starts[at + i] : ends[at + i]], seed)
        out[at:to] = mix(whole + (ends[at:to] - starts[at:to]).astype(np.uint64))
        at = to
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, its first word."""
    solid = ~_SPACE[buf]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    head = np.empty(len(buf), bool)
    head[0] = True
    head[1:] = ~solid[:-1]
    tail = np.empty(len(buf), bool)
    tail[-1] = True
    tail[:-1] = ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(buf))]
    head[inner] = True
    tail[inner - 1] = True
    starts, ends = np.flatnonzero(solid & head), np.flatnonzero(solid & tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hash of each n consecutive values; empty if there are fewer."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    c = np.uint64(multiplier(1000 + n))
    out = values[: len(values) - n + 1].copy()
    for k in range(1, n):
        out *= c
        out += values[k : len(values) - n + 1 + k]
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    upper = (buf >= 65) & (buf <= 90)
    return buf + (upper.astype(np.uint8) << 5)


def by_row(counts: np.ndarray) -> np.ndarray:
    """Row number of each element, where row r has ``counts[r]`` of them."""
    return np.repeat(np.arange(len(counts)), counts)
