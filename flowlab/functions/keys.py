"""Reproducible order keys and content keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.schema import quoted, ticked


def order_key(seed: int, columns: Sequence[str]) -> Column:
    """Seeded 32-digit hexadecimal key; sorting by it is a reproducible shuffle.

    It depends on the row only, never on partitioning, and any SQL engine can compute it:
    ``md5(concat_ws('|', seed, columns...))``. Use integer or string columns that identify the row.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[quoted(c).cast("string") for c in columns]))


def content_key(df: DataFrame) -> Column:
    """Hexadecimal key over every column, null-aware: equal for exact copies of a row only."""
    names = ", ".join(ticked(c) for c in df.columns)
    return F.expr(f"md5(to_json(struct({names}), map('ignoreNullFields', 'false')))")


def _number(name: str) -> str:
    """SQL text: the column as a double, NaN taken as null."""
    return f"nanvl(CAST({ticked(name)} AS DOUBLE), CAST(NULL AS DOUBLE))"


def numeric_struct(columns: Sequence[str]) -> Column:
    """The columns as doubles in one struct, NaN and null alike, for null-safe equality of whole rows.

    Two structs are equal when all fields are equal or null on both sides, so one join key replaces
    as many null-safe conditions as there are columns.
    """
    fields = ", ".join(f"'c{i}', {_number(c)}" for i, c in enumerate(columns))
    return F.expr(f"named_struct({fields})")


def row_hash(columns: Sequence[str]) -> Column:
    """64-bit hash of the row content. Each value is hashed beside its null flag, so moving a null changes the
    hash. A prefilter only: equality is always decided on the values."""
    parts = ", ".join(f"{_number(c)} IS NULL, coalesce({_number(c)}, 0.0D) + 0.0D" for c in columns)
    return F.expr(f"xxhash64({parts})")
