"""Threshold configuration as JSON."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions.decisions import ThresholdConfig
from flowlab.schema import ABSTAIN_LABEL, UNCERTAINTY_FLOOR

CONFIG_SCHEMA = """
    enabled boolean, model_name string, rare_support_threshold int, min_recall_ratio double,
    uncertainty_floor double, tuning_scope string, fallback_to_next_rank boolean,
    abstain_on_low_confidence_rare boolean, abstain_label string, rare_classes array<string>,
    thresholds map<string,double>
"""


def read_config_table(spark: SparkSession, path: str) -> DataFrame:
    """The configuration as one row, with defaults for absent entries.

    A configuration that exists is enabled unless it says otherwise; its rare classes default to those with a threshold.
    """
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
    thresholds = F.coalesce("thresholds", F.create_map().cast("map<string,double>"))
    return raw.select(
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        thresholds.alias("thresholds"),
        F.coalesce("rare_classes", F.map_keys(thresholds)).alias("rare_classes"),
        F.coalesce("fallback_to_next_rank", F.lit(True)).alias("fallback_to_next_rank"),
        F.coalesce("abstain_on_low_confidence_rare", F.lit(False)).alias("abstain_on_low_confidence_rare"),
        F.coalesce("abstain_label", F.lit(ABSTAIN_LABEL)).alias("abstain_label"),
        F.coalesce("uncertainty_floor", F.lit(UNCERTAINTY_FLOOR)).alias("uncertainty_floor"),
    )


def load_threshold_config(spark: SparkSession, path: str | None) -> ThresholdConfig:
    """The configuration at ``path``; a disabled default when there is none."""
    if path is None:
        return ThresholdConfig()
    try:
        table = read_config_table(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return ThresholdConfig()
        raise
    row = table.first()
    return ThresholdConfig(**row.asDict()) if row is not None else ThresholdConfig()


def config_table(
    spark: SparkSession,
    config: ThresholdConfig,
    *,
    model_name: str,
    rare_support_threshold: int,
    min_recall_ratio: float,
    tuning_scope: str,
) -> DataFrame:
    row = (
        config.enabled,
        model_name,
        rare_support_threshold,
        min_recall_ratio,
        config.uncertainty_floor,
        tuning_scope,
        config.fallback_to_next_rank,
        config.abstain_on_low_confidence_rare,
        config.abstain_label,
        list(config.rare_classes),
        dict(config.thresholds),
    )
    return spark.createDataFrame([row], CONFIG_SCHEMA)


ABSTENTION = ["abstain_rate", "abstain_on_rare_truth_rate", "abstain_on_nonrare_truth_rate"]


def metric_blocks(metrics: DataFrame) -> DataFrame:
    """One row with the blocks of the ``metrics`` entry, from one row per (split, variant).

    Per split, in lower case with underscores: ``<split>_baseline`` and ``<split>_thresholded`` hold the metrics,
    ``<split>_changed_fraction`` is a number and ``<split>_abstention`` holds the rates of the thresholded variant.
    """
    apart = [c for c in ABSTENTION if c in metrics.columns]
    plain = [c for c in metrics.columns if c not in ("split", "variant", "changed_fraction", *apart)]
    blocks = []
    for (split,) in metrics.select("split").distinct().orderBy("split").collect():
        name = split.lower().replace(" ", "_")

        def of(variant: str, value: Column) -> Column:
            return F.first(F.when((F.col("split") == split) & (F.col("variant") == variant), value), ignorenulls=True)

        blocks += [of(v, F.struct(*plain)).alias(f"{name}_{v}") for v in ("baseline", "thresholded")]
        if "changed_fraction" in metrics.columns:
            blocks.append(of("thresholded", F.col("changed_fraction")).alias(f"{name}_changed_fraction"))
        if apart:
            blocks.append(of("thresholded", F.struct(*apart)).alias(f"{name}_abstention"))
    return metrics.agg(F.struct(*blocks).alias("metrics"))


def save_threshold_config(
    spark: SparkSession, path: str, config: ThresholdConfig, metrics: DataFrame | None = None, **about
) -> None:
    """Write the configuration as one JSON object, with ``metric_blocks`` of ``metrics`` nested under ``metrics``."""
    table = config_table(spark, config, **about)
    if metrics is not None:
        table = table.withColumn("_one", F.lit(1)).join(metric_blocks(metrics).withColumn("_one", F.lit(1)), "_one").drop("_one")
    table.coalesce(1).write.mode("overwrite").json(path)
