"""Classification metrics from confusion counts.

Rows are reduced once to (keys, y_true, y_pred, n): at most classes x classes entries per key, combined map-side. All
metrics are small aggregations over that table. Macro means run over every label that is true *or* predicted, so a class
that is only ever predicted counts with F1 = 0; weighted means use true supports; 0/0 is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.schema import quoted

OFFICIAL_TEST = "OFFICIAL TEST"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(
    df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", keys: Sequence[str] = ()
) -> DataFrame:
    """Row counts per (keys, truth, prediction)."""
    return df.groupBy(*keys, quoted(truth).alias("y_true"), quoted(predicted).alias("y_pred")).agg(
        F.count("*").alias("n")
    )


def per_class(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, predicted count, hits, precision, recall and F1 per label over the union of both label sets."""
    hit = F.when(F.col("y_true").eqNullSafe(F.col("y_pred")), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")
    as_truth = F.struct(
        F.col("y_true").alias("label"),
        F.col("n").cast("long").alias("support"),
        zero.alias("predicted"),
        hit.cast("long").alias("tp"),
    )
    as_prediction = F.struct(
        F.col("y_pred").alias("label"),
        zero.alias("support"),
        F.col("n").cast("long").alias("predicted"),
        zero.alias("tp"),
    )
    sides = counts.select(*keys, F.explode(F.array(as_truth, as_prediction)).alias("_side")).select(*keys, "_side.*")
    totals = sides.groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    return totals.select(
        "*",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def summary_metrics(classes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro precision, macro F1 and weighted F1 from ``per_class`` rows."""
    return classes.groupBy(*keys).agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def is_rare(threshold: int) -> Column:
    """Rare by support among ``per_class`` rows."""
    return (F.col("support") > 0) & (F.col("support") <= threshold)


def in_labels(labels: Sequence[str]) -> Column:
    return F.col("label").isin([str(x) for x in labels]) if len(labels) else F.lit(False)


def rare_metrics(classes: DataFrame, rare: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted precision, recall and F1 means over the rare classes; null when there is none.

    Precision counts false positives from all rows, as ``per_class`` does.
    """
    return classes.groupBy(*keys).agg(
        F.avg(F.when(rare, F.col("precision"))).alias("rare_mean_precision"),
        F.avg(F.when(rare, F.col("recall"))).alias("rare_mean_recall"),
        F.avg(F.when(rare, F.col("f1"))).alias("rare_mean_f1"),
        F.coalesce(F.sum(F.when(rare, F.col("support"))), F.lit(0)).alias("rare_support_total"),
        F.array_sort(F.collect_list(F.when(rare, F.col("label")))).alias("rare_classes"),
    )


def evaluation_summary(
    classes: DataFrame, *, rare_support_threshold: int = 500, keys: Sequence[str] = ("split",)
) -> DataFrame:
    """Summary plus rare metrics per key; rare metrics only on the official test split, null elsewhere."""
    rare = is_rare(rare_support_threshold)
    official = F.upper(F.col("split")) == OFFICIAL_TEST
    joined = summary_metrics(classes, keys).join(rare_metrics(classes, rare, keys), list(keys))
    gated = [
        F.when(official, F.col(c)).alias(c) for c in ("rare_mean_precision", "rare_mean_recall", "rare_mean_f1")
    ]
    labels = F.when(official, F.col("rare_classes")).otherwise(F.array().cast("array<string>"))
    return joined.select(
        *keys, "accuracy", "macro_precision", "macro_f1", "weighted_f1", *gated, labels.alias("rare_classes")
    )


def classification_report(classes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-class rows followed by accuracy, macro avg and weighted avg, in the usual report layout."""
    body = classes.select(*keys, F.lit(0).alias("section"), "label", "precision", "recall", "f1", "support")
    total = F.sum("support")
    accuracy = _ratio(F.sum("tp"), total)
    weighted = [_ratio(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in ("precision", "recall", "f1")]
    rows = [
        (1, "accuracy", [accuracy.alias(m) for m in ("precision", "recall", "f1")]),
        (2, "macro avg", [F.avg(m).alias(m) for m in ("precision", "recall", "f1")]),
        (3, "weighted avg", weighted),
    ]
    report = body
    for section, name, columns in rows:
        line = classes.groupBy(*keys).agg(*columns, total.alias("support"))
        line = line.withColumn("section", F.lit(section)).withColumn("label", F.lit(name))
        report = report.unionByName(line)
    return report.orderBy(*keys, "section", "label")


def fbeta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    weight = F.lit(beta * beta)
    score = (1 + weight) * precision * recall / (weight * precision + recall)
    return F.when((precision == 0) & (recall == 0), 0.0).otherwise(score)


def overfit_gap(train_f1: Column, val_f1: Column) -> Column:
    return train_f1 - val_f1


def selection_score(train_f1: Column, val_f1: Column, penalty: float = 0.75) -> Column:
    """Validation macro F1 less a penalty on a positive train-validation gap."""
    return val_f1 - penalty * F.greatest(F.lit(0.0), overfit_gap(train_f1, val_f1))
