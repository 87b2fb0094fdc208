"""Summary reports over predictions and scored splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.operators.metrics import OFFICIAL_TEST, overfit_gap, selection_score
from flowlab.schema import ABSTAIN_LABEL


def alert_tiles(predictions: DataFrame) -> DataFrame:
    """Total rows, high alerts, uncertain rows and mean confidence, in one aggregation."""
    return predictions.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("alert_level") == "HIGH_ALERT").alias("high_alerts"),
        F.count_if("uncertain").alias("uncertain_rows"),
        F.avg("confidence").alias("avg_confidence"),
    )


def alert_distribution(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("alert_level").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "alert_level")


def top_attack_types(predictions: DataFrame, k: int = 10) -> DataFrame:
    counts = predictions.groupBy("predicted_class").agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "predicted_class").limit(k)


def first_rows(predictions: DataFrame, row_id: str, k: int = 20) -> DataFrame:
    """The first rows by id: a per-task top-k and one merge, not a sort."""
    return predictions.orderBy(row_id).limit(k)


def mean_confidence(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.avg("family_confidence").alias("family_confidence_mean"),
        F.avg("subtype_confidence").alias("subtype_confidence_mean"),
    )


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def abstention_stats(
    predictions: DataFrame,
    rare_labels: Sequence[str],
    *,
    truth: str = "label",
    predicted: str = "predicted_class",
    abstain_label: str = ABSTAIN_LABEL,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Abstention share overall, among rare truth and among the rest; 0 for an empty subset."""
    abstained = F.col(predicted) == abstain_label
    rare = F.coalesce(F.col(truth).isin([str(x) for x in rare_labels]), F.lit(False)) if rare_labels else F.lit(False)
    return predictions.groupBy(*keys).agg(
        F.coalesce(_share(abstained), F.lit(0.0)).alias("abstain_rate"),
        F.coalesce(_share(F.when(rare, abstained)), F.lit(0.0)).alias("abstain_on_rare_truth_rate"),
        F.coalesce(_share(F.when(~rare, abstained)), F.lit(0.0)).alias("abstain_on_nonrare_truth_rate"),
    )


def decision_effects(
    predictions: DataFrame,
    *,
    baseline: str = "base_predicted_class",
    tuned: str = "predicted_class",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Shares of changed, uncertain and fallback decisions."""
    return predictions.groupBy(*keys).agg(
        _share(F.col(baseline) != F.col(tuned)).alias("changed_fraction"),
        _share(F.col("uncertain")).alias("uncertain_rate"),
        _share(F.col("selected_rank") > 1).alias("fallback_rate"),
    )


def hard_share(flagged: DataFrame, flag: str = "is_hard") -> DataFrame:
    return flagged.agg(
        F.count("*").alias("rows"), F.count_if(flag).alias("hard_rows"), _share(F.col(flag)).alias("hard_share")
    )


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def tuning_table(scores: DataFrame, name: str = "candidate", order: str | None = None) -> DataFrame:
    """One row per candidate with train and validation macro F1, gap and selection score, best first.

    ``scores`` holds (candidate, split, macro_f1); ``order`` names a column that breaks ties, earlier first.
    """
    extra = [order] if order else []
    wide = scores.groupBy(name, *extra).pivot("split", ["TRAIN", "VAL"]).agg(F.first("macro_f1"))
    train, val = F.col("TRAIN"), F.col("VAL")
    return wide.select(
        name,
        *extra,
        train.alias("train_macro_f1"),
        val.alias("val_macro_f1"),
        overfit_gap(train, val).alias("gap"),
        selection_score(train, val).alias("score"),
    ).orderBy(F.desc("score"), *(extra or [name]))


def best_candidate(table: DataFrame, name: str = "candidate", order: str | None = None) -> DataFrame:
    return table.orderBy(F.desc("score"), order or name).limit(1)


def model_summary(evaluations: DataFrame) -> DataFrame:
    """One row per model from (model, split, macro_f1, rare_*) rows; null where a split is absent."""
    splits = {"TRAIN": "train", "VAL": "val", OFFICIAL_TEST: "test"}

    def at(split: str, column: str) -> Column:
        return F.first(F.when(F.col("split") == split, F.col(column)), ignorenulls=True)

    wide = evaluations.groupBy("model").agg(
        *[at(split, "macro_f1").alias(f"{name}_macro_f1") for split, name in splits.items()],
        at(OFFICIAL_TEST, "rare_mean_precision").alias("rare_precision"),
        at(OFFICIAL_TEST, "rare_mean_recall").alias("rare_recall"),
        at(OFFICIAL_TEST, "rare_mean_auprc").alias("rare_auprc"),
    )
    return wide.select(
        "model",
        "train_macro_f1",
        "val_macro_f1",
        "test_macro_f1",
        (F.col("train_macro_f1") - F.col("val_macro_f1")).alias("train_val_gap"),
        (F.col("val_macro_f1") - F.col("test_macro_f1")).alias("val_test_gap"),
        "rare_precision",
        "rare_recall",
        "rare_auprc",
    ).orderBy("model")
