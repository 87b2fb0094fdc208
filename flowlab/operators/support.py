"""Class support, rare labels and balanced weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.small import small_side
from flowlab.schema import LABEL, labelled, quoted


def class_support(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per label: one map-side combined count."""
    return df.groupBy(quoted(label)).agg(F.count("*").alias("support"))


def rare_labels(support: DataFrame, threshold: int = 500) -> DataFrame:
    """Labels whose support is at most ``threshold``."""
    return support.where((F.col("support") <= threshold) & (F.col("support") > 0))


def label_count(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Number of distinct labels and of rows, from one count per label rather than a distinct over rows."""
    return class_support(labelled(df, label), label).agg(
        F.count("*").alias("labels"), F.coalesce(F.sum("support"), F.lit(0)).alias("rows")
    )


def family_pool_counts(df: DataFrame, family: str = "family") -> DataFrame:
    return df.groupBy(family).agg(F.count("*").alias("rows")).orderBy(family)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    support = class_support(labelled(df, label), label)
    everything = Window.partitionBy()  # one row per class
    weighted = F.sum("support").over(everything) / (F.count("*").over(everything) * F.col("support"))
    return support.select(quoted(label), "support", weighted.alias("weight"))


def class_table(df: DataFrame, label: str = LABEL, max_classes: int = 10_000) -> list[tuple[str, int]]:
    """(label, support) on the driver, in label order; more than ``max_classes`` classes is an error."""
    rows = class_support(labelled(df, label), label).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"More than {max_classes} classes in column '{label}'")
    return sorted((str(r[0]), int(r[1])) for r in rows)


def balanced(table: Sequence[tuple[str, int]]) -> dict[str, float]:
    """Balanced weights of a class table."""
    total = sum(n for _, n in table)
    return {name: total / (len(table) * n) for name, n in table}


def mapped(column: Column, values: dict[str, float | int]) -> Column:
    """Look up a literal map of bounded size; null for other keys."""
    if not values:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


def attach_weights(df: DataFrame, weights: DataFrame, label: str = LABEL) -> DataFrame:
    """Join class weights to rows; one row per class, so the side is broadcast behind a size check."""
    return df.join(small_side(weights.select(quoted(label), "weight")), label)
