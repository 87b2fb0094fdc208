"""Scoring jobs: the same row-local plan serves batch tables and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.functions.decisions import ThresholdConfig, serve_decision
from flowlab.functions.ranking import ranked_classes
from flowlab.plans.models import DEFAULT_MODEL, FlatModel, HierarchicalModel, load_model, threshold_path
from flowlab.schema import BENIGN_CLASS, conform
from flowlab.sources.config import load_threshold_config


def decide_flat(
    scored: DataFrame,
    classes: Sequence[str],
    config: ThresholdConfig = ThresholdConfig(),
    *,
    probs: str = "probs",
    benign: str = BENIGN_CLASS,
    strict_fallback: bool = False,
) -> DataFrame:
    """Replace ``probs`` by the 15 flat output columns."""
    ranked = scored.withColumn("_ranked", ranked_classes(F.col(probs), classes, 3)).drop(probs)
    return serve_decision(ranked, "_ranked", config, strict_fallback=strict_fallback, benign=benign)


def score_with(
    df: DataFrame,
    model: FlatModel | HierarchicalModel,
    config: ThresholdConfig = ThresholdConfig(),
    *,
    carry: Sequence[str] = (),
    benign: str = BENIGN_CLASS,
) -> DataFrame:
    """Score rows with a model. ``carry`` names the columns that link a prediction back to its row."""
    features = model.family.features if isinstance(model, HierarchicalModel) else model.features
    rows = conform(df, features, carry=carry)
    if isinstance(model, HierarchicalModel):
        return model.score(rows, benign=benign).drop(*[f for f in features if f not in carry])
    scored = model.score(rows).drop(*[f for f in features if f not in carry])
    return decide_flat(scored, model.classes, config, benign=benign)


def predict(
    spark: SparkSession,
    df: DataFrame,
    root: str,
    model_name: str = DEFAULT_MODEL,
    *,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Score rows with a saved model and, for a flat model, its saved thresholds."""
    model = load_model(spark, root, model_name)
    return score_with(df, model, load_threshold_config(spark, threshold_path(root, model_name)), carry=carry)
