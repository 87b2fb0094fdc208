"""Leakage hygiene: overlap between a training pool and a reference set, by row content."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions.keys import numeric_struct, row_hash
from flowlab.schema import FEATURES, quoted
from flowlab.session import materialize

#: A reference above either bound is met by its hashes first: a choice of plan, the rows are the same.
BROADCAST_REFERENCE_ROWS = 500_000
BROADCAST_REFERENCE_BYTES = 256 << 20
#: Hashes of 8 bytes each that may be sent to every executor.
BROADCAST_HASHES = 2_000_000


def _content(df: DataFrame, columns: Sequence[str], numeric: bool):
    """(hash, content) join key. Numbers compare as doubles with null and NaN alike; other columns as they are."""
    if numeric:
        return row_hash(columns), numeric_struct(columns)
    values = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return F.xxhash64(F.to_json(values, {"ignoreNullFields": "false"})), values


def distinct_rows(df: DataFrame, columns: Sequence[str] = FEATURES, *, numeric: bool = True) -> DataFrame:
    """Distinct row contents as (``_hash``, ``_row``). Copies collapse map-side before the shuffle."""
    hashed, content = _content(df, columns, numeric)
    return df.select(hashed.alias("_hash"), content.alias("_row")).distinct()


def _reference_rows(reference: DataFrame, columns: Sequence[str], numeric: bool, max_rows: int) -> tuple[DataFrame, bool]:
    """Distinct reference rows, written once, and whether they are measured to be within both bounds."""
    rows = materialize(distinct_rows(reference, columns, numeric=numeric), "reference")
    measured = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json("_row"))), F.lit(0))).first()
    return rows, measured[0] <= max_rows and measured[1] <= BROADCAST_REFERENCE_BYTES


def _reference_side(reference: DataFrame, columns: Sequence[str], numeric: bool, max_rows: int) -> DataFrame:
    """Distinct reference rows; broadcast when small, shuffled otherwise."""
    rows, small = _reference_rows(reference, columns, numeric, max_rows)
    return F.broadcast(rows) if small else rows


def _hash_side(hashes: DataFrame) -> DataFrame:
    hashes = materialize(hashes, "hashes")
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes


def _without(pool: DataFrame, rows: DataFrame, hashed: Column, content: Column) -> DataFrame:
    """Pool rows whose content is not among ``rows``: contents are compared only where hashes meet.

    A hash all of whose pool contents occur in ``rows`` removes its rows by itself; for one shared by different contents
    the contents decide. So no row of the pool is carried along a second time as its own key.
    """
    keyed = pool.select(hashed.alias("_hash"), content.alias("_row"))
    met = keyed.join(_hash_side(rows.select("_hash").distinct()), "_hash", "left_semi").distinct()
    met = materialize(met.join(rows.withColumn("_hit", F.lit(True)), ["_hash", "_row"], "left"), "met")
    by_hash = met.groupBy("_hash").agg(F.count("_hit").alias("hits"), F.count("*").alias("all"))
    left = pool.withColumn("_hash", hashed)
    kept = left.join(_hash_side(by_hash.filter("hits = all").select("_hash")), "_hash", "left_anti")
    mixed = by_hash.filter("hits BETWEEN 1 AND all - 1").select("_hash")
    collided = materialize(met.filter("_hit").join(mixed, "_hash", "left_semi").select("_hash", "_row"), "collided")
    if not collided.isEmpty():
        kept = kept.withColumn("_row", content).join(collided, ["_hash", "_row"], "left_anti")
    return kept.drop("_hash", "_row")


def exclude_overlap(
    pool: DataFrame,
    reference: DataFrame,
    columns: Sequence[str] = FEATURES,
    *,
    numeric: bool = True,
    max_broadcast_rows: int = BROADCAST_REFERENCE_ROWS,
) -> DataFrame:
    """Pool rows whose content does not occur in the reference; duplicates among kept rows stay.

    A reference measured to be small is broadcast, so the pool is filtered where it lies in one pass. A large one is met
    by its hashes first and by contents only where hashes meet, in two passes over the pool.
    """
    hashed, content = _content(pool, columns, numeric)
    rows, small = _reference_rows(reference, columns, numeric, max_broadcast_rows)
    if not small:
        return _without(pool, rows, hashed, content)
    left = pool.withColumn("_hash", hashed).withColumn("_row", content)
    return left.join(F.broadcast(rows), ["_hash", "_row"], "left_anti").drop("_hash", "_row")


def exclude_stream_overlap(
    stream: DataFrame, reference: DataFrame, columns: Sequence[str] = FEATURES, *, numeric: bool = True
) -> DataFrame:
    """The same exclusion for a streaming pool; stateless. The reference is as it stands now: micro-batches do not
    compute it again."""
    hashed, content = _content(stream, columns, numeric)
    right = _reference_side(reference, columns, numeric, BROADCAST_REFERENCE_ROWS)
    left = stream.withColumn("_hash", hashed).withColumn("_row", content)
    return left.join(right, ["_hash", "_row"], "left_anti").drop("_hash", "_row")


def overlap_audit(
    pool: DataFrame,
    reference: DataFrame,
    columns: Sequence[str] = FEATURES,
    *,
    numeric: bool = True,
    max_broadcast_rows: int = BROADCAST_REFERENCE_ROWS,
) -> DataFrame:
    """Rows before, removed and kept. The pool is reduced to (content, copies) before it meets the reference."""
    hashed, content = _content(pool, columns, numeric)
    copies = pool.groupBy(hashed.alias("_hash"), content.alias("_row")).agg(F.count("*").alias("_n"))
    right = _reference_side(reference, columns, numeric, max_broadcast_rows).withColumn("_hit", F.lit(True))
    joined = copies.join(right, ["_hash", "_row"], "left")
    before = F.coalesce(F.sum("_n"), F.lit(0))
    removed = F.coalesce(F.sum(F.when(F.col("_hit"), F.col("_n"))), F.lit(0))
    return joined.agg(
        before.alias("rows_before"), removed.alias("rows_removed"), (before - removed).alias("rows_kept")
    )


@dataclass
class Overlap:
    """What a pool shares with a reference, from one shuffle. ``report`` is one row; ``shared`` (``_hash``, ``_row``) the
    contents that occur on both sides."""

    report: DataFrame
    shared: DataFrame


def overlap(pool: DataFrame, reference: DataFrame, columns: Sequence[str] = FEATURES, *, numeric: bool = True) -> Overlap:
    """Distinct rows on each side, their intersection, and the pool's rows before, removed and kept if it were cleaned.

    Each side carries a bit; one aggregation over both, copies counted map-side, is written once and all else is read from
    it.
    """

    def side(df: DataFrame, bit: int) -> DataFrame:
        hashed, content = _content(df, columns, numeric)
        return df.select(hashed.alias("_hash"), content.alias("_row"), F.lit(bit).alias("_bit"))

    both = side(pool, 1).unionByName(side(reference, 2)).groupBy("_hash", "_row")
    merged = materialize(both.agg(F.bit_or("_bit").alias("_sides"), F.count_if(F.col("_bit") == 1).alias("_n")), "sides")
    shared = F.col("_sides") == 3
    removed = F.coalesce(F.sum(F.when(shared, F.col("_n"))), F.lit(0))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    report = merged.agg(
        F.count_if(F.col("_sides") != 2).alias("unique_a"),
        F.count_if(F.col("_sides") != 1).alias("unique_b"),
        F.count_if(shared).alias("overlap"),
        rows.alias("rows_before"),
        removed.alias("rows_removed"),
        (rows - removed).alias("rows_kept"),
    )
    report = report.select(
        "unique_a", "unique_b", "overlap", F.try_divide("overlap", "unique_a").alias("overlap_share_a"),
        F.try_divide("overlap", "unique_b").alias("overlap_share_b"), "rows_before", "rows_removed", "rows_kept",
    )
    return Overlap(report, merged.where(shared).select("_hash", "_row"))


def without_shared(pool: DataFrame, shared: DataFrame, columns: Sequence[str] = FEATURES, *, numeric: bool = True) -> DataFrame:
    """``pool`` less the rows whose content is among ``shared`` (of ``overlap``): filtered where it lies if these are
    measured to be few, else by hash first."""
    hashed, content = _content(pool, columns, numeric)
    measured = shared.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json("_row"))), F.lit(0))).first()
    if measured[0] > BROADCAST_REFERENCE_ROWS or measured[1] > BROADCAST_REFERENCE_BYTES:
        return _without(pool, shared, hashed, content)
    left = pool.withColumn("_hash", hashed).withColumn("_row", content)
    return left.join(F.broadcast(shared), ["_hash", "_row"], "left_anti").drop("_hash", "_row")


def overlap_report(
    a: DataFrame, b: DataFrame, columns: Sequence[str] = FEATURES, *, numeric: bool = True
) -> DataFrame:
    """Distinct rows on each side, their intersection, and its share of each side (null for an empty side).

    Each side carries a bit; one aggregation over both collapses copies map-side and shuffles contents once.
    """
    def side(df: DataFrame, bit: int) -> DataFrame:
        hashed, content = _content(df, columns, numeric)
        return df.select(hashed.alias("_hash"), content.alias("_row"), F.lit(bit).alias("_bit"))

    merged = side(a, 1).unionByName(side(b, 2)).groupBy("_hash", "_row").agg(F.bit_or("_bit").alias("_sides"))
    return merged.agg(
        F.count_if(F.col("_sides") != 2).alias("unique_a"),
        F.count_if(F.col("_sides") != 1).alias("unique_b"),
        F.count_if(F.col("_sides") == 3).alias("overlap"),
    ).select(
        "*",
        F.try_divide("overlap", "unique_a").alias("overlap_share_a"),
        F.try_divide("overlap", "unique_b").alias("overlap_share_b"),
    )


def shared_rows(
    a: DataFrame, b: DataFrame, columns: Sequence[str] = FEATURES, *, numeric: bool = True
) -> DataFrame:
    """Distinct row contents that occur on both sides."""
    return distinct_rows(a, columns, numeric=numeric).intersect(distinct_rows(b, columns, numeric=numeric))
