"""End-to-end jobs: compare flat models, tune thresholds of a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.hygiene import exclude_overlap, overlap, without_shared
from flowlab.operators.reports import model_summary, tuning_table
from flowlab.operators.sampling import balanced_sample, split_train_val
from flowlab.operators.small import pin
from flowlab.operators.support import class_support, rare_labels
from flowlab.plans.evaluation import evaluate_stacked, side_by_side, union_of
from flowlab.plans.experiment import Experiment, tuning_experiment
from flowlab.plans.models import FlatModel
from flowlab.plans.training import FIT_THREADS, Fit, shuffled_label_check
from flowlab.schema import FEATURES, LABEL, conform, labelled, quoted
from flowlab.session import materialize


@dataclass
class TrainingData:
    """Training and validation rows drawn from an archive, and what was removed on the way."""

    train: DataFrame
    val: DataFrame
    audit: DataFrame


def prepare_training_data(
    archive: DataFrame,
    test: DataFrame,
    *,
    key_columns: Sequence[str],
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    max_per_label: int | None = 20_000,
    val_frac: float = 0.15,
    seed: int = 42,
    deoverlap: str | None = "after",
) -> TrainingData:
    """Balanced sample, de-overlap against the test rows, split.

    ``deoverlap="after"`` cleans the sample, ``"before"`` cleans the archive so that caps are filled by clean rows, None
    leaves overlap in place. ``max_per_label`` None takes every labelled row. ``audit`` is one row, from the one overlap job:
    distinct rows and overlap before, rows removed, overlap after.
    """
    pool = exclude_overlap(archive, test, features) if deoverlap == "before" else archive
    if max_per_label is None:
        sample = labelled(pool, label)
    else:
        sample = balanced_sample(pool, label=label, max_per_label=max_per_label, seed=seed, key_columns=key_columns)
    sample = materialize(sample, "sample")  # capped rows per label: small next to the archive
    found = overlap(sample, test, features)
    left = F.col("overlap")
    if deoverlap == "after":
        sample = materialize(without_shared(sample, found.shared, features), "clean")
        left = F.lit(0).cast("long")  # every shared content is gone
    audit = pin(found.report.withColumn("overlap_after", left))[0]
    train, val = split_train_val(sample, val_frac, seed=seed, key_columns=key_columns)
    return TrainingData(materialize(train, "train"), materialize(val, "val"), audit)


@dataclass
class Comparison:
    """Fitted models, one evaluation row and one per-class report per (model, split), and the tables derived from them."""

    models: dict[str, FlatModel]
    evaluations: DataFrame
    reports: DataFrame
    summary: DataFrame
    choice: DataFrame
    audit: DataFrame
    shuffled: dict[str, DataFrame] = field(default_factory=dict)


def compare_models(
    archive: DataFrame,
    test: DataFrame,
    fits: Mapping[str, Fit],
    *,
    key_columns: Sequence[str],
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    rare_support_threshold: int = 500,
    check_shuffled: bool = False,
    seed: int = 42,
    **sampling,
) -> Comparison:
    """Train every model on the same rows and evaluate all of them, in one scoring pass, on TRAIN, VAL and the untouched
    OFFICIAL TEST.

    ``choice`` ranks the models by validation macro F1 less the overfit penalty; the test split plays no part in it.
    """
    data = prepare_training_data(
        archive, test, key_columns=key_columns, features=features, label=label, seed=seed, **sampling
    )
    held_out = conform(test, features, label=label)
    splits = {"TRAIN": data.train, "VAL": data.val, "OFFICIAL TEST": held_out}
    with ThreadPoolExecutor(FIT_THREADS) as pool:  # independent fits, a few at a time
        models = dict(zip(fits, pool.map(lambda fit: fit(data.train, data.val), fits.values())))
    rows = union_of({split: conform(table, features, label=label) for split, table in splits.items()})
    scored, columns = side_by_side(models, rows)
    found = evaluate_stacked(
        scored, columns, {name: m.classes for name, m in models.items()}, label=label, rare_support_threshold=rare_support_threshold
    )
    shuffled: dict[str, DataFrame] = {}
    for name, fit in fits.items() if check_shuffled else ():
        shuffled[name] = shuffled_label_check(
            lambda permuted, fit=fit: fit(permuted, data.val),
            data.train,
            {"VAL": data.val, "OFFICIAL TEST": held_out},
            key_columns=key_columns,
            label=label,
            seed=seed,
        )
    choice = tuning_table(found.rows.where("split IN ('TRAIN', 'VAL')"), "model")
    return Comparison(models, found.rows, found.reports, model_summary(found.rows), choice, data.audit, shuffled)


def tune_model(
    model: FlatModel,
    archive: DataFrame,
    test: DataFrame,
    *,
    key_columns: Sequence[str],
    label: str = LABEL,
    rare_support_threshold: int = 500,
    max_per_label: int = 20_000,
    val_frac: float = 0.15,
    seed: int = 1,
    **experiment,
) -> Experiment:
    """Learn thresholds for a trained model: rebuild its validation split, score, search, compare on both splits.

    Rare classes are those with a test support of at most ``rare_support_threshold``.
    """
    data = prepare_training_data(
        archive,
        test,
        key_columns=key_columns,
        features=model.features,
        label=label,
        max_per_label=max_per_label,
        val_frac=val_frac,
        seed=seed,
    )
    rare_table, small = pin(rare_labels(class_support(test, label), rare_support_threshold), 10_000)
    if not small:
        raise ValueError("More than 10000 rare labels")
    rare = sorted(str(r[0]) for r in rare_table.where(quoted(label).isNotNull()).collect())

    def scored(rows: DataFrame, split: str) -> DataFrame:
        return model.score(conform(rows, model.features, label=label)).select(
            F.lit(split).alias("split"), quoted(label), "probs"
        )

    both = scored(data.val, "VALIDATION").unionByName(scored(test, "OFFICIAL TEST"))
    return tuning_experiment(both, model.classes, rare, label=label, **experiment)
