"""Label to family lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.operators.small import small_side
from flowlab.schema import LABEL, TAXONOMY, quoted


def taxonomy_table(spark: SparkSession, mapping: Mapping[str, str] = TAXONOMY) -> DataFrame:
    """The taxonomy as (position, label, family) rows."""
    rows = [(i, label, family) for i, (label, family) in enumerate(mapping.items())]
    return spark.createDataFrame(rows, "position int, label string, family string")


def with_family(
    df: DataFrame,
    taxonomy: DataFrame | None = None,
    label: str = LABEL,
    family: str = "family",
) -> DataFrame:
    """Add the family of each label. A label outside the taxonomy ends the job with its name.

    The taxonomy (columns ``label``, ``family``; one row per label) is broadcast behind a size check.
    """
    table = taxonomy if taxonomy is not None else taxonomy_table(df.sparkSession)
    lookup = table.select(F.col("label").alias("_label"), F.col("family").alias("_family"))
    joined = df.join(small_side(lookup), quoted(label) == F.col("_label"), "left")
    message = F.concat(F.lit("No family mapping for label: "), F.coalesce(quoted(label), F.lit("null")))
    checked = F.when(F.col("_family").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("_family"))
    return joined.withColumn(family, checked).drop("_label", "_family")


def families_in_order(taxonomy: DataFrame) -> DataFrame:
    """Families by first appearance in the taxonomy, with their labels sorted by name.

    One group per family holds that family's labels: dimension rows, not data rows.
    """
    return (
        taxonomy.groupBy("family")
        .agg(
            F.min("position").alias("first_position"),
            F.count("*").alias("label_count"),
            F.sort_array(F.collect_list("label")).alias("labels"),
        )
        .orderBy("first_position")
    )


def labels_for_family(taxonomy: DataFrame, family: str) -> DataFrame:
    return taxonomy.where(F.col("family") == family).select("position", "label").orderBy("position")


def families_of(mapping: Mapping[str, str] = TAXONOMY) -> dict[str, list[str]]:
    """Driver-side view for planning: family -> labels, both in first-seen order."""
    grouped: dict[str, list[str]] = {}
    for label, family in mapping.items():
        grouped.setdefault(family, []).append(label)
    return grouped


def family_slice(df: DataFrame, family: str, column: str = "family") -> DataFrame:
    return df.where(F.col(column) == family)


def family_correct(df: DataFrame, predicted: str = "predicted_family", truth: str = "family") -> DataFrame:
    """Rows whose predicted family is the true one."""
    return df.where(F.col(predicted) == F.col(truth))
