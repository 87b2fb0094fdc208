"""Sharding by sampled splitters.

Records are keyed by (hash of the text, id), so equal texts are neighbours. Keys are sampled with a chance in proportion
to their size, quantiles of the sample become range boundaries, and a range that turns out overfull is sampled again and
subdivided, at text borders first and inside one text only where the text alone overfills it. Exact running sizes inside
the ranges then cut the ordered records into shards of nearly equal bytes. Texts never move, and no range is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import keyed_texts
from flowlab.session import materialize

SHARDS = 16
#: Ranges per shard at the start.
RANGES = 16
#: Sampled keys per range wanted.
SAMPLES = 24
#: Records of a range, at most about.
RANGE_ROWS = 100_000
#: A text group above this share of a shard may be cut; smaller ones stay together.
WHOLE = 1 / 64


def sized_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, size, text_crc32): UTF-8 bytes plus 1, and the unsigned CRC-32 of the text; null counts as empty."""
    return keyed_texts(df, doc_id, text).select(
        "id", "th", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")
    )


def _keys(th: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Order-preserving 16-byte keys."""
    both = np.stack([th, id_], 1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _in_ranges(keys: DataFrame, splitters: np.ndarray) -> DataFrame:
    """Adds ``range``: the number of splitters at or below the key."""
    shared = keys.sparkSession.sparkContext.broadcast(splitters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("th", "id")))
            at = np.searchsorted(shared.value, key, "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    return keys.mapInArrow(run, "id long, th long, size long, text_crc32 long, range int")


def _cuts(th: np.ndarray, id_: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """Up to parts - 1 quantile boundaries of a weighted sample: at text borders, unless there is one text only."""
    order = np.lexsort((id_, th))
    th, id_, total = th[order], id_[order], np.cumsum(weight[order])
    at = np.searchsorted(total, np.arange(1, parts) * total[-1] / parts)
    at = np.unique(np.minimum(np.concatenate([at, at + 1]), len(th) - 1))  # also behind a record larger than a part
    if th[0] == th[-1]:
        return _keys(th[at], id_[at])
    return _keys(th[at], np.full(len(at), -(2**63)))


def _sample(rows: DataFrame, rate: float, seed: int) -> tuple[np.ndarray, ...]:
    """(th, id, weight) of keys drawn with chance size x rate, by hash, so that a rerun draws the same."""
    chance = F.least(F.col("size") * rate, F.lit(1.0))
    drawn = F.pmod(F.xxhash64("id", "th", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) < chance
    found = rows.filter(drawn).select("th", "id", (F.col("size") / chance).alias("w"), *(["range"] if "range" in rows.columns else [])).toPandas()
    return tuple(found[c].to_numpy() for c in found.columns)


def ranged_keys(keys: DataFrame, total: int, rows: int, shards: int = SHARDS) -> DataFrame:
    """``keys`` with ``range``, ascending with the key; no range is overfull unless it is copies of one row."""
    parts = max(shards * RANGES, -(-rows // RANGE_ROWS) * 2)
    most = max(1.0, total / parts * 2)
    rate = min(1.0, parts * SAMPLES / total) if total else 1.0
    th, id_, weight = _sample(keys, rate, 0)
    splitters = np.unique(_cuts(th, id_, weight, parts)) if len(th) else np.zeros(0, "S16")
    for round_ in range(1, 40):
        ranged = _in_ranges(keys, splitters)
        stats = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(F.struct("th", "id")).alias("lo"), F.max(F.struct("th", "id")).alias("hi"))
        over = stats.filter(((F.col("bytes") > most) | (F.col("n") > RANGE_ROWS)) & (F.col("lo") != F.col("hi")))
        over = over.select("range", "bytes", "n").toPandas()
        if over.empty:
            return ranged
        wanted = ranged.filter(F.col("range").isin(over["range"].tolist()))
        weight_all = float(over["bytes"].sum())
        th, id_, weight, where = _sample(wanted, min(1.0, len(over) * SAMPLES * 8 / weight_all) if round_ < 20 else 1.0, round_)
        new = [splitters]
        for r, size, n in over.itertuples(index=False):
            mine = where == r
            if mine.any():
                new.append(_cuts(th[mine], id_[mine], weight[mine], int(max(size / most, n / RANGE_ROWS)) + 2))
        splitters = np.unique(np.concatenate(new))
    return ranged


def assign_shards(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, th, size, text_crc32, shard, slot) per row: sizes of shards nearly equal, slots gapless from 0.

    Equal texts share a shard unless their group is larger than WHOLE of one. Null text counts as empty and has size 1;
    repeated rows are records of their own. With fewer records than shards some shards stay empty.
    """
    keys = materialize(sized_keys(df, doc_id, text), "keys")
    whole = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, rows = int(whole.b or 0), int(whole.n)
    ranged = materialize(ranged_keys(keys, total, rows, shards), "ranges")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    order = Window.partitionBy("range").orderBy("th", "id")
    group = Window.partitionBy("range", "th")
    own = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = ranged.withColumn("own", own).withColumn("line", F.row_number().over(order) - 1)
    placed = placed.withColumns({"head": F.min("own").over(group), "group_bytes": F.sum("size").over(group)})
    per = total / shards if total else 1.0
    # a record or a small group goes where its middle falls
    at = F.col("b0") + F.when(F.col("group_bytes") <= per * WHOLE, F.col("head") + F.col("group_bytes") / 2).otherwise(F.col("own") + F.col("size") / 2)
    shard = F.least(F.floor(at / per), F.lit(shards - 1)).cast("int")
    out = placed.join(starts, "range").select("id", "th", "size", "text_crc32", shard.alias("shard"), (F.col("n0") + F.col("line")).alias("line"))
    out = materialize(out, "shards")
    first = out.groupBy("shard").agg(F.min("line").alias("first"))  # one row a shard
    return out.join(F.broadcast(first), "shard").select("id", "th", "size", "text_crc32", "shard", (F.col("line") - F.col("first")).cast("long").alias("slot"))
