"""Exact deduplication by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of its bytes says so, so equal texts are cut alike. Chunks
are deduplicated to identifiers: every distinct chunk travels once per task to the task of its hash, where its bytes
are compared; a hash that two different chunks share gets a variant number, so an identifier stands for exactly one
content. A document then is the ordered list of its identifiers (16 bytes a chunk), and only these lists are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import NO_ID, SPACES, keep_rows, keyed_texts
from flowlab.session import materialize

MIN_CHUNK = 512
MAX_CHUNK = 8192
#: A cut falls on about one byte in so many (a power of two).
AVERAGE_CHUNK = 1024
_SLICE = 1 << 20
_WINDOW = 32

_gear = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_hash(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: after at least MIN_CHUNK bytes at the next hash cut, else after MAX_CHUNK.

    The hash at a byte looks at the 32 bytes up to it, so cuts depend on content alone.
    """
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    cuts = []
    for lo in range(0, n, _SLICE):
        first = max(0, lo - _WINDOW)
        h = _gear[raw[first : lo + _SLICE]]
        for shift in (1, 2, 4, 8, 16):
            h[shift:] += h[:-shift] << np.uint32(shift)
        at = np.flatnonzero((h >> np.uint32(16)) % AVERAGE_CHUNK == 0) + first
        cuts += (at[at >= lo] + 1).tolist()
    ends, start = [], 0
    for cut in [*cuts, n]:
        while cut - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if cut - start >= MIN_CHUNK and cut != n:
            ends.append(cut)
            start = cut
    if start < n:
        ends.append(n)
    return ends


def _stripped(text: str) -> bytes:
    return text.encode().translate(None, SPACES)


def _chunks(data: bytes) -> Iterator[bytes]:
    start = 0
    for end in chunk_ends(data):
        yield data[start:end]
        start = end


def _distinct_chunks(texts: DataFrame, hasher: Callable[[bytes], bytes]) -> DataFrame:
    """(h, chunk): distinct chunk contents. Copies collapse inside a batch, then map-side, then by shuffle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for text in batch.column(0):
                seen.update(_chunks(_stripped(text.as_py())))
            chunks = list(seen)
            for k in range(0, max(len(chunks), 1), 4096):
                part = chunks[k : k + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hasher(c) for c in part], pa.binary()), pa.array(part, pa.binary())], names=["h", "chunk"]
                )

    return texts.select("text").mapInArrow(cut, "h binary, chunk binary").distinct()


def shared_hashes(texts: DataFrame, hasher: Callable[[bytes], bytes] = chunk_hash) -> dict[bytes, list[bytes]]:
    """Hashes that different chunks share, with their contents in order; empty but for a collision of 128-bit hashes."""
    distinct = _distinct_chunks(texts, hasher)
    several = distinct.groupBy("h").count().filter("count > 1").select("h").collect()
    if not several:
        return {}
    hashes = [bytes(r.h) for r in several]
    found: dict[bytes, list[bytes]] = {}
    for row in distinct.filter(F.col("h").isin(hashes)).orderBy("h", "chunk").toLocalIterator():
        found.setdefault(bytes(row.h), []).append(bytes(row.chunk))
    return found


def recipes(texts: DataFrame, shared: dict[bytes, list[bytes]], hasher: Callable[[bytes], bytes] = chunk_hash) -> DataFrame:
    """(id, th, n_chars, text_sha256, recipe): recipe is the ordered list of verified chunk identifiers, as bytes."""
    variants = {h: {c: k for k, c in enumerate(contents)} for h, contents in shared.items()}

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, lists = [], []
            for text in batch.column(2):
                data = _stripped(text.as_py())
                shas.append(hashlib.sha256(data).hexdigest())
                ids = []
                for chunk in _chunks(data):
                    h = hasher(chunk)
                    ids.append(h)
                    if variants:  # then every identifier ends in four bytes that tell contents of one hash apart
                        ids.append(variants.get(h, {}).get(chunk, 0).to_bytes(4, "little"))
                lists.append(b"".join(ids))
            n = pc.utf8_length(batch.column(2)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n, pa.array(shas, pa.string()), pa.array(lists, pa.binary())],
                names=["id", "th", "n_chars", "text_sha256", "recipe"],
            )

    return texts.mapInArrow(describe, "id long, th long, n_chars long, text_sha256 string, recipe binary")


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, hasher: Callable[[bytes], bytes] = chunk_hash) -> DataFrame:
    """One row per input row: (id, th, keep_id, group_size, kept, text_sha256, n_chars).

    Texts are equal when identical without white space (code points 9 to 13 and 32). Of equal texts the row with most
    code points stays, then the smallest id (null last); of whole repeated rows exactly one. Null text counts as
    empty, and all texts that are empty or blank are equal. An empty table gives no rows.
    """
    texts = keyed_texts(df, doc_id, text)
    shared = shared_hashes(texts, hasher)
    rows = recipes(texts, shared, hasher).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "recipes")
    rank = F.struct(-F.col("n_chars"), F.col("id") == F.lit(NO_ID), "id", "uid")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), F.min(rank).alias("first"))
    several = groups.filter("group_size > 1").select("recipe", "group_size", F.col("first.id").alias("keep"), F.col("first.uid").alias("keep_uid"))
    joined = rows.join(several, "recipe", "left")
    return joined.select(
        "id",
        "th",
        F.coalesce("keep", "id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.coalesce("keep_uid", "uid") == F.col("uid")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the rows that :func:`exact_groups` drops; columns unchanged."""
    kept = exact_groups(df, doc_id, text).filter("kept")
    return keep_rows(df, kept, doc_id, text, once=True)
