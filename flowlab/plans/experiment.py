"""The threshold experiment: learn on validation rows, compare decisions on validation and test rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.functions.decisions import ThresholdConfig, tune_decision
from flowlab.functions.ranking import ranked_classes
from flowlab.operators.metrics import in_labels, per_class, rare_metrics, summary_metrics
from flowlab.operators.small import pin
from flowlab.operators.tuning import MIN_TOP1_ROWS, tune_thresholds
from flowlab.schema import ABSTAIN_LABEL, LABEL, UNCERTAINTY_FLOOR, quoted
from flowlab.session import materialize

KEYS = ["split", "variant"]


@dataclass
class Experiment:
    thresholds: dict[str, float]
    config: ThresholdConfig
    metrics: DataFrame


def decision_counts(
    scored: DataFrame,
    classes: Sequence[str],
    thresholds: Mapping[str, float],
    rare: Sequence[str],
    *,
    probs: str = "probs",
    label: str = LABEL,
    floor: float = UNCERTAINTY_FLOOR,
    abstain_on_rare: bool = False,
) -> DataFrame:
    """Rows reduced once to counts per (split, truth, baseline decision, thresholded decision)."""
    ranked = scored.select("split", quoted(label).alias("y_true"), F.col(probs).alias("_p"))
    ranked = ranked.withColumn("_ranked", ranked_classes(F.col("_p"), classes))
    both = tune_decision(
        tune_decision(ranked, "_ranked", {}, floor=floor, prefix="base_"),
        "_ranked",
        thresholds,
        floor=floor,
        rare_labels=rare,
        abstain_on_rare=abstain_on_rare,
    )
    return both.groupBy("split", "y_true", "base_predicted_class", "predicted_class").agg(
        F.count("*").alias("n"),
        F.count_if("base_uncertain").alias("base_uncertain"),
        F.count_if("uncertain").alias("uncertain"),
        F.count_if(F.col("selected_rank") > 1).alias("fallback"),
    )


def experiment_metrics(counts: DataFrame, rare: Sequence[str]) -> DataFrame:
    """One row per (split, variant) with metrics, abstention and decision effects, from ``decision_counts``."""
    zero = F.lit(0).cast("long")
    baseline = F.struct(
        F.lit("baseline").alias("variant"),
        F.col("base_predicted_class").alias("y_pred"),
        F.col("base_uncertain").alias("uncertain"),
        zero.alias("fallback"),
        zero.alias("changed"),
    )
    changed = F.when(F.col("base_predicted_class") != F.col("predicted_class"), F.col("n")).otherwise(zero)
    tuned = F.struct(
        F.lit("thresholded").alias("variant"),
        F.col("predicted_class").alias("y_pred"),
        F.col("uncertain").alias("uncertain"),
        F.col("fallback").alias("fallback"),
        changed.alias("changed"),
    )
    rows = counts.select("split", "y_true", "n", F.explode(F.array(baseline, tuned)).alias("e"))
    rows = rows.select("split", "y_true", "n", "e.*")
    classes = per_class(rows.groupBy(*KEYS, "y_true", "y_pred").agg(F.sum("n").alias("n")), KEYS)

    is_rare_truth = F.coalesce(F.col("y_true").isin([str(x) for x in rare]), F.lit(False)) if rare else F.lit(False)
    abstained = F.col("y_pred") == ABSTAIN_LABEL

    def share(part, whole):
        rate = F.try_divide(F.sum(F.when(part & whole, F.col("n")).otherwise(0)), F.sum(F.when(whole, F.col("n"))))
        return F.coalesce(rate, F.lit(0.0))

    everything = F.lit(True)
    effects = rows.groupBy(*KEYS).agg(
        F.try_divide(F.sum("uncertain"), F.sum("n")).alias("uncertain_rate"),
        F.try_divide(F.sum("changed"), F.sum("n")).alias("changed_fraction"),
        F.try_divide(F.sum("fallback"), F.sum("n")).alias("fallback_rate"),
        share(abstained, everything).alias("abstain_rate"),
        share(abstained, is_rare_truth).alias("abstain_on_rare_truth_rate"),
        share(abstained, ~is_rare_truth).alias("abstain_on_nonrare_truth_rate"),
    )
    return (
        summary_metrics(classes, KEYS)
        .drop("macro_precision")
        .join(rare_metrics(classes, in_labels(rare), KEYS).drop("rare_mean_f1", "rare_classes"), KEYS)
        .join(effects, KEYS)
    )


def tuning_experiment(
    scored: DataFrame,
    classes: Sequence[str],
    rare: Sequence[str],
    *,
    validation: str = "VALIDATION",
    probs: str = "probs",
    label: str = LABEL,
    min_recall_ratio: float = 0.85,
    floor: float = UNCERTAINTY_FLOOR,
    abstain_on_rare: bool = False,
    hard_only: bool = True,
    min_rows: int = MIN_TOP1_ROWS,
    write_scored: bool = True,
) -> Experiment:
    """``scored`` holds ``split``, the label and ``probs``; thresholds are learned on the validation split only.

    Scored rows are read more than once, so they are written first; ``write_scored=False`` leaves that out for rows that
    are already stored.
    """
    if write_scored:
        scored = materialize(scored.select("split", quoted(label), probs), "scored")
    learned, small = pin(
        tune_thresholds(
            scored.where(F.col("split") == validation),
            classes,
            rare,
            probs=probs,
            truth=label,
            min_recall_ratio=min_recall_ratio,
            min_rows=min_rows,
            hard_only=hard_only,
        )
    )
    assert small, "thresholds hold at most one row per class"
    thresholds = {r["label"]: float(r["threshold"]) for r in learned.collect()}
    counts, _ = pin(
        decision_counts(
            scored,
            classes,
            thresholds,
            rare,
            probs=probs,
            label=label,
            floor=floor,
            abstain_on_rare=abstain_on_rare,
        )
    )
    config = ThresholdConfig(
        enabled=True,
        thresholds=thresholds,
        rare_classes=[str(x) for x in rare],
        fallback_to_next_rank=not abstain_on_rare,
        abstain_on_low_confidence_rare=abstain_on_rare,
        uncertainty_floor=floor,
    )
    return Experiment(thresholds, config, experiment_metrics(counts, rare))
