"""Helpers shared by the text operators: row keys, bounded text blocks and vectorised word hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlab.session import materialize

#: Stands for a null doc_id inside row keys.
NO_ID = -(2**63)
#: Text handled at once inside a task, in bytes; a longer document is handled alone.
BLOCK_BYTES = 1 << 21
#: Code points 9 to 13 and 32.
SPACES = b"\t\n\x0b\x0c\r "


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def keyed_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, text): id and text hash name a row; null text counts as empty, a null id as ``NO_ID``.

    Only the two input columns are read, so further columns, whatever their names, do no harm.
    """
    return df.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"),
        text_hash(text).alias("th"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def public_id(column: str = "id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def free_name(name: str, taken: Sequence[str]) -> str:
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


#: Row keys (16 bytes each, with one number) that may be sent to every executor; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def join_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Inner join of texts with (id, th, ..) rows of few bytes: texts stay where they are if the keys are counted to be
    at most BROADCAST_KEYS, else both sides are shuffled."""
    keys = materialize(keys, "keys")
    small = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return texts.join(F.broadcast(keys) if small else keys, ["id", "th"])


def keep_rows(df: DataFrame, kept: DataFrame, doc_id: str = "doc_id", text: str = "text", *, once: bool) -> DataFrame:
    """Rows of ``df`` whose (id, th) is in ``kept``, all columns unchanged; of repeated rows one stays if ``once``."""
    i, t, n = (free_name(x, df.columns) for x in ("_id", "_th", "_n"))
    left = df.withColumns({i: F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), t: text_hash(text)})
    right = kept.select(F.col("id").alias(i), F.col("th").alias(t))
    out = left.join(right, [i, t], "left_semi")
    if once:
        out = out.withColumn(n, F.row_number().over(Window.partitionBy(i, t).orderBy(i))).filter(F.col(n) == 1).drop(n)
    return out.drop(i, t)


def blocks(sizes: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to at most ``limit``; a larger row stands alone."""
    start = total = 0
    for k, n in enumerate(sizes.tolist()):
        if k > start and total + n > limit:
            yield start, k
            start = k
            total = 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    last = int(offsets[-1]) if len(offsets) else 0
    return bytes_[first:last], offsets.astype(np.int64) - first


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads differences over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial read off prefix sums, mixed with the length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))[: len(data)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(data))[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def spans(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run never crosses a position in ``cuts``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = cuts[cuts < len(inside)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    last = cuts[cuts > 0] - 1
    after[last] = False
    return starts, np.flatnonzero(inside & ~after) + 1


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
NOT_SPACE = ~_SPACE
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed_words(texts: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(row, word hashes, starts, ends, text bytes) of each row; words are runs of bytes for which ``inside`` is true."""
    data, offsets = utf8(texts)
    for a, b in blocks(np.diff(offsets)):
        base = offsets[a]
        part = data[base : offsets[b]]
        starts, ends = spans(inside[part], offsets[a:b] - base)
        hashes = span_hashes(part, starts, ends)
        at = np.searchsorted(starts, offsets[a : b + 1] - base)
        for k in range(a, b):
            lo, hi = at[k - a], at[k - a + 1]
            yield k, hashes[lo:hi], starts[lo:hi] + base - offsets[k], ends[lo:hi] + base - offsets[k], data[offsets[k] : offsets[k + 1]]
