"""Training jobs on Spark ML: flat classifiers, candidate sweeps and sanity checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.metrics import confusion, per_class, summary_metrics
from flowlab.operators.reports import tuning_table
from flowlab.operators.sampling import permute_labels
from flowlab.operators.support import balanced, class_table, mapped
from flowlab.plans.evaluation import side_by_side, stacked_confusion, union_of
from flowlab.plans.missing import assembling_stages
from flowlab.plans.models import FlatModel
from flowlab.plans.stopping import PATIENCE, best_round, first_rounds, staged_log_loss
from flowlab.schema import FEATURES, LABEL, conform, labelled, quoted
from flowlab.session import materialize

# --- Fixed values: boosting presets. Rows are not subsampled: the original settings name a row fraction but no
# bagging frequency, which turns bagging off. ---
FLAT_PRESETS = {
    "balanced_baseline": dict(maxIter=1000, stepSize=0.05, maxDepth=8, leaves=23, minInstancesPerNode=100, columns=0.80),
    "stable_medium": dict(maxIter=1200, stepSize=0.03, maxDepth=6, leaves=15, minInstancesPerNode=140, columns=0.70),
    "stable_strong": dict(
        maxIter=1400, stepSize=0.025, maxDepth=5, leaves=11, minInstancesPerNode=200, columns=0.70, minInfoGain=0.05, maxBins=127
    ),
    "stable_ultra": dict(
        maxIter=1600, stepSize=0.02, maxDepth=4, leaves=9, minInstancesPerNode=260, columns=0.65, minInfoGain=0.10, maxBins=127
    ),
}
FLAT_DEFAULT = dict(maxIter=1000, stepSize=0.05, maxDepth=10, leaves=31, minInstancesPerNode=50, columns=0.80)
FAMILY_PRESETS = {
    "family_balanced_baseline": dict(maxIter=1200, stepSize=0.03, maxDepth=6, leaves=15, minInstancesPerNode=140, columns=0.70),
    "family_stable_medium": dict(
        maxIter=1400, stepSize=0.025, maxDepth=5, leaves=11, minInstancesPerNode=180, columns=0.65, minInfoGain=0.05, maxBins=127
    ),
    "family_stable_strong": dict(
        maxIter=1600, stepSize=0.02, maxDepth=4, leaves=9, minInstancesPerNode=240, columns=0.60, minInfoGain=0.10, maxBins=127
    ),
}
SUBTYPE_PRESET = dict(maxIter=1200, stepSize=0.03, maxDepth=6, leaves=15, minInstancesPerNode=120, columns=0.70)
# --- End of fixed values ---

DEFAULT_BINS = 255
FIT_THREADS = 4
#: Rows that a distinct one stands for on average, at least, where boosting works on distinct rows and their counts.
COPIES = 4

Fit = Callable[[DataFrame, DataFrame | None], FlatModel]


def _prepared(
    df: DataFrame, features: Sequence[str], label: str, classes: Sequence[str], weights: Mapping[str, float] | None
) -> DataFrame:
    """Features, class index ``_y`` and weight ``_w``; both looked up in literal maps, so no join."""
    rows = conform(labelled(df, label), features, label=label)
    index = mapped(quoted(label), {c: float(i) for i, c in enumerate(classes)})
    rows = rows.withColumn("_y", index)
    return rows.withColumn("_w", mapped(quoted(label), dict(weights)) if weights else F.lit(1.0))


def fit_logreg(
    train: DataFrame,
    *,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    max_iter: int = 300,
    inverse_penalty: float = 1.0,
) -> FlatModel:
    """Standardised multinomial logistic regression with balanced class weights."""
    table = class_table(train, label)
    classes, rows = [c for c, _ in table], sum(n for _, n in table)
    data = _prepared(train, features, label, classes, balanced(table))
    scaler = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True)
    model = LogisticRegression(
        featuresCol="_scaled",
        labelCol="_y",
        weightCol="_w",
        family="multinomial",
        maxIter=max_iter,
        regParam=1.0 / (inverse_penalty * rows),
        predictionCol="",
    )
    fitted = Pipeline(stages=[*assembling_stages(data, features), scaler, model]).fit(data)
    return FlatModel(classes, list(features), fitted)


def fit_forest(
    train: DataFrame,
    *,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    trees: int = 220,
    max_depth: int = 14,
    min_rows_per_leaf: int = 10,
    weights: Mapping[str, float] | None = None,
    bootstrap: bool = True,
    seed: int = 42,
) -> FlatModel:
    classes = [c for c, _ in class_table(train, label)]
    data = _prepared(train, features, label, classes, weights)
    model = RandomForestClassifier(
        featuresCol="_features",
        labelCol="_y",
        weightCol="_w",
        numTrees=trees,
        maxDepth=max_depth,
        minInstancesPerNode=min_rows_per_leaf,
        bootstrap=bootstrap,
        seed=seed,
        predictionCol="",
        cacheNodeIds=True,  # deep trees are not sent and walked again in each pass
    )
    fitted = Pipeline(stages=[*assembling_stages(data, features), model]).fit(data)
    return FlatModel(classes, list(features), fitted)


def _distinct_rows(rows: DataFrame, settings: dict, weighted: bool, total: int) -> DataFrame:
    """``rows`` to boost on, with ``_n``, how many a row stands for.

    Each round of boosting passes over all rows several times. Where features take few values, equal rows are one row of
    their summed weight: the trees are the same, since all sums in them are weighted. The least rows of a leaf are then
    asked for as weight, so with other weights than counts they must be one. Rows stay as they are if they seldom repeat.
    """
    columns, least = [quoted(c) for c in rows.columns], settings.get("minInstancesPerNode", 1)
    countable = settings.get("subsamplingRate", 1.0) == 1.0 and (least == 1 or not weighted and total >= 2 * least)
    if countable:
        seen, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*columns))).first()
    if not countable or seen < COPIES * distinct:
        return rows.withColumn("_n", F.lit(1.0))
    if least > 1:
        share = (least - 0.5) / total  # whole counts: half a row less is safe from rounding
        settings.update(minInstancesPerNode=1, minWeightFractionPerNode=max(share, settings.get("minWeightFractionPerNode", 0.0)))
    return rows.groupBy(*columns).agg(F.count("*").cast("double").alias("_n"))


def fit_boosted(
    train: DataFrame,
    val: DataFrame | None = None,
    *,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    preset: Mapping | None = None,
    max_iter: int | None = None,
    weights: Mapping[str, float] | None = None,
    patience: int = PATIENCE,
    seed: int = 42,
) -> FlatModel:
    """Boosted trees, one binary model per class, stopped early on ``val`` when it is given.

    Without a preset the default settings apply, with balanced weights. With ``val`` boosting ends when the joint log loss
    over it has not fallen for ``patience`` rounds, and the model is that of the best round. The first fit has twice as many
    rounds as ``patience``; where it does not stop, the next has twice as many, up to ``maxIter``: a fit of more rounds
    begins with the same trees, so this costs at most as much again as the last fit. Spark has no leaf limit: a preset's
    ``leaves`` caps the depth at their binary logarithm, rounded up. The class models are independent jobs, a few at a time.
    Rows that repeat are fitted and validated once, with their count as weight.
    """
    table = class_table(train, label)
    classes = [c for c, _ in table]
    if preset is None:
        preset, weights = FLAT_DEFAULT, weights or balanced(table)
    settings = dict(preset)
    if max_iter is not None:
        settings["maxIter"] = max_iter
    columns, leaves = settings.pop("columns", None), settings.pop("leaves", None)
    if leaves is not None:
        settings["maxDepth"] = min(settings["maxDepth"], (leaves - 1).bit_length())
    data = _prepared(train, features, label, classes, weights).withColumn("_val", F.lit(False))
    pipeline = PipelineModel(stages=assembling_stages(data, features))
    if val is not None:
        held = _prepared(val, features, label, classes, weights).where(F.col("_y").isNotNull())
        data = data.unionByName(held.withColumn("_val", F.lit(True)))
    data = _distinct_rows(data.select(*map(quoted, features), "_y", "_w", "_val"), settings, bool(weights), sum(n for _, n in table))
    rows = materialize(pipeline.transform(data).select("_features", "_y", "_w", "_val", "_n"), "boosting")

    most = settings.pop("maxIter")

    def fit_class(index: int, rounds: int) -> GBTClassificationModel:
        booster = GBTClassifier(
            featuresCol="_features",
            labelCol="_target",
            weightCol="_w",
            seed=seed,
            maxBins=settings.get("maxBins", DEFAULT_BINS),
            featureSubsetStrategy=str(columns) if columns else "all",
            maxIter=rounds,
            **{k: v for k, v in settings.items() if k != "maxBins"},
        )
        return booster.fit(fitting.withColumn("_target", (F.col("_y") == index).cast("double")))

    def fit_all(rounds: int) -> list[GBTClassificationModel]:
        with ThreadPoolExecutor(FIT_THREADS) as pool:
            return list(pool.map(lambda index: fit_class(index, rounds), range(len(classes))))

    fitting, held = rows.where("NOT _val").withColumn("_w", F.col("_w") * F.col("_n")), rows.where("_val")
    if val is None or held.isEmpty():
        return FlatModel(classes, list(features), pipeline, fit_all(most))
    rounds = min(most, 2 * patience)
    while True:
        models = fit_all(rounds)
        losses = staged_log_loss(held, models, count="_n")
        kept, stopped = best_round(losses, patience)
        if stopped or rounds == most:
            return FlatModel(classes, list(features), pipeline, [first_rounds(m, kept) for m in models], losses)
        rounds = min(most, 2 * rounds)


def split_confusion(model: FlatModel, splits: Mapping[str, DataFrame], *, label: str = LABEL) -> DataFrame:
    """Confusion counts of one model over several splits, in one job."""
    rows = union_of({split: conform(df, model.features, label=label) for split, df in splits.items()})
    predicted = model.predict(rows).select("split", quoted(label).alias("y_true"), "y_pred")
    return confusion(predicted, keys=["split"])


@dataclass
class Sweep:
    """A tuning table, best candidate first, and the fitted model of that candidate."""

    table: DataFrame
    best_name: str
    best_model: FlatModel


def sweep(candidates: Mapping[str, Fit], train: DataFrame, val: DataFrame, *, label: str = LABEL) -> Sweep:
    """Fit every candidate, score train and validation by all of them in one pass, select by validation macro F1 less the
    overfit penalty."""
    with ThreadPoolExecutor(FIT_THREADS) as pool:  # independent fits, a few at a time
        models = dict(zip(candidates, pool.map(lambda fit: fit(train, val), candidates.values())))
    features = list(dict.fromkeys(f for m in models.values() for f in m.features))
    rows = union_of({"TRAIN": conform(train, features, label=label), "VAL": conform(val, features, label=label)})
    scored, columns = side_by_side(models, rows)
    counts = stacked_confusion(scored, columns, {name: m.classes for name, m in models.items()}, label=label)
    position = mapped(F.col("model"), {name: i for i, name in enumerate(candidates)})
    counts = counts.withColumn("candidate_idx", position).withColumnRenamed("model", "candidate")
    keys = ["candidate", "candidate_idx", "split"]
    scores = materialize(summary_metrics(per_class(counts, keys), keys).select(*keys, "macro_f1"), "sweep")
    table = tuning_table(scores, order="candidate_idx")
    best = table.first()["candidate"]
    return Sweep(table, best, models[best])


def boosted_candidates(
    presets: Mapping[str, Mapping] = FLAT_PRESETS,
    *,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    max_iter: int | None = None,
    weights: Mapping[str, float] | None = None,
    seed: int = 42,
) -> dict[str, Fit]:
    def candidate(preset: Mapping) -> Fit:
        return lambda train, val: fit_boosted(
            train,
            val,
            features=features,
            label=label,
            preset=preset,
            max_iter=max_iter,
            weights=weights,
            seed=seed,
        )

    return {name: candidate(preset) for name, preset in presets.items()}


def shuffled_label_check(
    fit: Callable[[DataFrame], FlatModel],
    train: DataFrame,
    splits: Mapping[str, DataFrame],
    *,
    key_columns: Sequence[str],
    label: str = LABEL,
    seed: int = 42,
) -> DataFrame:
    """Refit on permuted labels and score the given splits: results should fall to near chance."""
    model = fit(permute_labels(train, label=label, seed=seed, key_columns=key_columns))
    counts = split_confusion(model, splits, label=label)
    return summary_metrics(per_class(counts, ["split"]), ["split"])
