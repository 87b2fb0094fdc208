"""Evaluation of scored rows and models: all models and splits in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions.ranking import argmax_class
from flowlab.operators.average_precision import average_precision
from flowlab.operators.metrics import (
    OFFICIAL_TEST,
    classification_report,
    confusion,
    evaluation_summary,
    is_rare,
    per_class,
)
from flowlab.operators.small import pin
from flowlab.operators.support import mapped
from flowlab.plans.models import FlatModel, HierarchicalModel
from flowlab.schema import LABEL, TAXONOMY, conform, quoted
from flowlab.session import materialize

#: Levels of a two-level evaluation.
FAMILY, DECIDED_FAMILY, SUBTYPE, FAMILY_CORRECT = "family", "decided family", "subtype", "subtype, family correct"


def union_of(splits: Mapping[str, DataFrame]) -> DataFrame:
    """The splits' rows with the name of each in ``split``."""
    union: DataFrame | None = None
    for name, rows in splits.items():
        named = rows.withColumn("split", F.lit(name))
        union = named if union is None else union.unionByName(named)
    return union


def side_by_side(models: Mapping[str, FlatModel], rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` with the probabilities of every model beside them, and the column of each; map-only.

    Models that read the same features in the same way share one feature vector.
    """
    columns = {name: f"_probs_{i}" for i, name in enumerate(models)}
    shared = len({(tuple(m.features), m.filling) for m in models.values()}) == 1
    if shared:
        rows = next(iter(models.values())).assemble(rows)
    for name, model in models.items():
        rows = model.score(rows, columns[name], assembled=shared)
    return rows.drop("_features"), columns


def stacked_confusion(
    scored: DataFrame, columns: Mapping[str, str], classes: Mapping[str, Sequence[str]], *, label: str = LABEL, split: str = "split"
) -> DataFrame:
    """Counts per (model, split, truth, prediction) from rows that hold the probabilities of all models: one aggregation."""
    said = [F.struct(F.lit(name).alias("model"), argmax_class(F.col(c), classes[name]).alias("y_pred")) for name, c in columns.items()]
    rows = scored.select(quoted(split).alias("split"), quoted(label).alias("y_true"), F.explode(F.array(*said)).alias("_m"))
    return confusion(rows.select("split", "y_true", "_m.*"), keys=["model", "split"])


def _aligned(probs: str, classes: Sequence[str], common: Sequence[str]) -> Column:
    place = {c: i for i, c in enumerate(classes)}
    return F.array(*[F.get(F.col(probs), F.lit(place[c])) if c in place else F.lit(None).cast("double") for c in common])


def _average_precisions(scored: DataFrame, columns: Mapping[str, str], classes: Mapping[str, Sequence[str]], only: Sequence[str] | None) -> DataFrame:
    """(model, class, average_precision) of the classes each model knows."""
    common = list(dict.fromkeys(c for name in columns for c in classes[name]))
    stacked = [F.struct(F.lit(name).alias("model"), _aligned(c, classes[name], common).alias("probs")) for name, c in columns.items()]
    rows = scored.select("_label", F.explode(F.array(*stacked)).alias("_m")).select("_label", "_m.*")
    table = average_precision(rows, common, truth="_label", only=only, keys=["model"], write_rows=False)
    known = F.create_map(*[x for name in columns for x in (F.lit(name), F.array(*[F.lit(c) for c in classes[name]]))])
    return table.where(F.array_contains(F.try_element_at(known, F.col("model")), F.col("class")))


@dataclass
class Evaluation:
    """One row per (model, split), and the per-class report of each."""

    rows: DataFrame
    reports: DataFrame


def evaluate_stacked(
    scored: DataFrame,
    columns: Mapping[str, str],
    classes: Mapping[str, Sequence[str]],
    *,
    label: str = LABEL,
    split: str = "split",
    rare_support_threshold: int = 500,
    all_classes: bool = False,
) -> Evaluation:
    """Accuracy, macro and weighted metrics of every model on every split; rare metrics and average precision on the
    official test split only.

    ``scored`` holds each model's probabilities in the column that ``columns`` names, in the order of its ``classes``. It
    is written once and read for the counts and for the test split's scores. ``all_classes`` adds the macro average
    precision over every class a model knows; otherwise only rare classes are unfolded. A rare class that a model does not
    know counts as 0.
    """
    held = scored.select(quoted(split).alias("split"), quoted(label).alias("_label"), *columns.values())
    held = materialize(held, "scored")
    keys = ["model", "split"]
    counts, _ = pin(stacked_confusion(held, columns, classes, label="_label"))
    table = per_class(counts, keys)
    rows = evaluation_summary(table, rare_support_threshold=rare_support_threshold, keys=keys)
    official = F.upper("split") == OFFICIAL_TEST
    rare = pin(table.where(official & is_rare(rare_support_threshold)).select(*keys, F.col("label").alias("class")))[0]
    rare_names = sorted({r["class"] for r in rare.select("class").distinct().collect() if r["class"] is not None})
    areas = rows.select(*keys, F.lit(None).cast("double").alias("rare_mean_auprc"), F.lit(None).cast("double").alias("macro_auprc"))
    if rare_names or all_classes:
        test = held.where(official)
        ap, _ = pin(_average_precisions(test, columns, classes, None if all_classes else rare_names))
        of_rare = rare.join(ap, ["model", "class"], "left").groupBy(*keys).agg(F.avg(F.coalesce("average_precision", F.lit(0.0))).alias("rare_mean_auprc"))
        of_all = ap.groupBy("model").agg((F.avg("average_precision") if all_classes else F.lit(None).cast("double")).alias("macro_auprc"))
        areas = rows.select(*keys).where(official).join(of_rare, keys, "left").join(of_all, "model", "left")
    rows = rows.join(areas, keys, "left")
    ordered = [c for c in rows.columns if c != "rare_classes"]
    return Evaluation(pin(rows.select(*ordered, "rare_classes"))[0], classification_report(table, keys))


def evaluate_scored(
    scored: DataFrame,
    classes: Sequence[str],
    *,
    probs: str = "probs",
    label: str = LABEL,
    split: str = OFFICIAL_TEST,
    rare_support_threshold: int = 500,
    name: str = "model",
    all_classes: bool = False,
) -> DataFrame:
    """``evaluate_stacked`` for one model on one split."""
    rows = scored.select(quoted(label).alias("_truth"), F.col(probs).alias("_probs")).withColumn("_split", F.lit(split))
    found = evaluate_stacked(
        rows,
        {name: "_probs"},
        {name: classes},
        label="_truth",
        split="_split",
        rare_support_threshold=rare_support_threshold,
        all_classes=all_classes,
    )
    return found.rows


def evaluate_model(
    model: FlatModel | HierarchicalModel,
    df: DataFrame,
    *,
    label: str = LABEL,
    rare_support_threshold: int = 500,
    name: str = "model",
    split: str = OFFICIAL_TEST,
) -> DataFrame:
    """A saved model on a labelled table. A hierarchical model has no probability matrix, hence no AP."""
    if isinstance(model, HierarchicalModel):
        rows = conform(df, model.family.features, label=label)
        predicted = model.score(rows).select(F.lit(name).alias("model"), F.lit(split).alias("split"), quoted(label).alias("y_true"), F.col("predicted_class").alias("y_pred"))
        keys = ["model", "split"]
        table = per_class(pin(confusion(predicted, keys=keys))[0], keys)
        row = evaluation_summary(table, rare_support_threshold=rare_support_threshold, keys=keys)
        empty = F.lit(None).cast("double")
        return row.withColumns({"rare_mean_auprc": empty, "macro_auprc": empty})
    scored = model.score(conform(df, model.features, label=label)).select(quoted(label), "probs")
    return evaluate_scored(
        scored,
        model.classes,
        label=label,
        rare_support_threshold=rare_support_threshold,
        name=name,
        split=split,
        all_classes=True,
    )


@dataclass
class TwoLevelEvaluation:
    """``rows``: one per (level, split). ``reports``: the decided family's and the subtype's on the official test split.
    ``confidences``: mean family and subtype confidence per split."""

    rows: DataFrame
    reports: DataFrame
    confidences: DataFrame


def evaluate_two_level(
    model: HierarchicalModel,
    splits: Mapping[str, DataFrame],
    *,
    taxonomy: Mapping[str, str] = TAXONOMY,
    label: str = LABEL,
    rare_support_threshold: int = 500,
) -> TwoLevelEvaluation:
    """Both levels of a model on every split, from one scoring pass and one aggregation by grouping sets.

    ``family`` is what the family model says alone, on all splits; ``subtype`` the class decided end to end, on all but
    TRAIN; ``subtype, family correct`` the same over the test rows whose decided family is right. Rare metrics are given
    on the official test split only.
    """
    features = list(dict.fromkeys(f for m in (model.family, *model.subtypes.values()) for f in m.features))
    rows = union_of({name: conform(df, features, label=label) for name, df in splits.items()})
    scored = model.score(model.family.predict(rows, "_said", "_said_probs").drop("_said_probs"))
    scored = scored.select(
        "split",
        quoted(label).alias("_label"),
        mapped(quoted(label), dict(taxonomy)).alias("_family"),
        "_said",
        F.col("predicted_family").alias("_decided"),
        F.col("predicted_class").alias("_class"),
        F.coalesce(mapped(quoted(label), dict(taxonomy)) == F.col("predicted_family"), F.lit(False)).alias("_right"),
        "family_confidence",
        "subtype_confidence",
    )
    sets = [["split", "_family", "_said"], ["split", "_family", "_decided"], ["split", "_label", "_class", "_right"]]
    every = list(dict.fromkeys(c for s in sets for c in s))
    cells = scored.groupingSets(sets, *every).agg(
        F.count("*").alias("n"),
        F.sum("family_confidence").alias("_family_sum"),
        F.sum("subtype_confidence").alias("_subtype_sum"),
        F.when(F.grouping("_said") == 0, FAMILY).when(F.grouping("_decided") == 0, DECIDED_FAMILY).otherwise(SUBTYPE).alias("level"),
    )
    cells, _ = pin(cells)
    of_class = F.col("level") == SUBTYPE
    truth = F.when(of_class, F.col("_label")).otherwise(F.col("_family"))
    said = F.when(of_class, F.col("_class")).when(F.col("level") == FAMILY, F.col("_said")).otherwise(F.col("_decided"))
    levels = F.when(of_class & F.col("_right"), F.array(F.lit(SUBTYPE), F.lit(FAMILY_CORRECT))).otherwise(F.array("level"))
    long = cells.select("split", F.explode(levels).alias("level"), truth.alias("y_true"), said.alias("y_pred"), "n")
    keys = ["level", "split"]
    counts = long.groupBy(*keys, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    table = per_class(counts, keys)
    official = F.upper("split") == OFFICIAL_TEST
    wanted = (F.col("level") == FAMILY) | (F.col("level") == SUBTYPE) & (F.col("split") != "TRAIN") | (F.col("level") == FAMILY_CORRECT) & official
    summary = evaluation_summary(table.where(wanted), rare_support_threshold=rare_support_threshold, keys=keys)
    reports = classification_report(table.where(official & F.col("level").isin(DECIDED_FAMILY, SUBTYPE)), keys)
    sums = cells.where(of_class).groupBy("split").agg(
        (F.sum("_family_sum") / F.sum("n")).alias("mean_family_confidence"), (F.sum("_subtype_sum") / F.sum("n")).alias("mean_subtype_confidence")
    )
    return TwoLevelEvaluation(summary, reports, sums)
