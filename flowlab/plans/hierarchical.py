"""Two-level training: families first, then subtypes inside each family."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.metrics import OFFICIAL_TEST
from flowlab.operators.sampling import family_capped_sample
from flowlab.operators.support import balanced, class_table, mapped
from flowlab.operators.taxonomy import families_of, family_slice
from flowlab.plans.evaluation import TwoLevelEvaluation, evaluate_two_level
from flowlab.plans.models import FlatModel, HierarchicalModel
from flowlab.plans.training import (
    FAMILY_PRESETS,
    FIT_THREADS,
    SUBTYPE_PRESET,
    Sweep,
    boosted_candidates,
    fit_boosted,
    fit_forest,
    sweep,
)
from flowlab.schema import FEATURES, LABEL, TAXONOMY, quoted
from flowlab.session import materialize

SubtypeFit = Callable[[DataFrame, DataFrame | None], FlatModel]


def forest_family_candidates(
    weights: Mapping[str, float],
    *,
    features: Sequence[str] = FEATURES,
    trees: int = 100,
    depths: Sequence[int] = (6, 5, 4),
    min_rows_per_leaf: Sequence[int] = (140, 180, 240),
    seed: int = 1,
) -> dict[str, Callable]:
    """The three family candidates with forests in place of boosting: same depths and leaf sizes."""

    def candidate(depth: int, leaf: int):
        return lambda train, val: fit_forest(
            train,
            features=features,
            label="family",
            trees=trees,
            max_depth=depth,
            min_rows_per_leaf=leaf,
            weights=weights,
            seed=seed,
        )

    return {name: candidate(d, n) for name, d, n in zip(FAMILY_PRESETS, depths, min_rows_per_leaf)}


def family_pool(
    train: DataFrame,
    *,
    key_columns: Sequence[str],
    taxonomy: Mapping[str, str] = TAXONOMY,
    label: str = LABEL,
    max_per_family: int = 80_000,
    seed: int = 1,
) -> DataFrame:
    """The rows that family models learn from: at most ``max_per_family`` of each family, with the family beside them."""
    rows = train.withColumn("family", mapped(quoted(label), dict(taxonomy)))
    sample = family_capped_sample(rows, max_per_family=max_per_family, seed=seed, key_columns=key_columns)
    return materialize(sample, "pool")


def train_hierarchical(
    train: DataFrame,
    val: DataFrame,
    *,
    key_columns: Sequence[str],
    taxonomy: Mapping[str, str] = TAXONOMY,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    max_per_family: int = 80_000,
    top_k: int = 2,
    learner: str = "forest",
    family_candidates: Mapping[str, Callable] | None = None,
    subtype_fit: SubtypeFit | None = None,
    pool: DataFrame | None = None,
    seed: int = 1,
) -> tuple[HierarchicalModel, Sweep]:
    """Select a family model among candidates, then fit one subtype model per family with several subtypes.

    The pool for family training (``family_pool``, unless one is given) is drawn from ``train`` after the split, so no
    family-training row sits in ``val``. A family with one label, or with one observed label, passes through.
    """
    family_of = mapped(quoted(label), dict(taxonomy))
    train, val = train.withColumn("family", family_of), val.withColumn("family", family_of)
    supports, held = dict(class_table(train, label)), dict(class_table(val, label))
    outside = sorted(set(supports) - set(taxonomy))
    if outside:
        raise ValueError(f"No family mapping for labels: {outside}")

    if pool is None:
        pool = family_pool(train, key_columns=key_columns, taxonomy=taxonomy, label=label, max_per_family=max_per_family, seed=seed)
    weights = balanced(class_table(pool, "family"))
    if family_candidates is None:
        if learner == "boosted":
            family_candidates = boosted_candidates(
                FAMILY_PRESETS, features=features, label="family", weights=weights, seed=seed
            )
        else:
            family_candidates = forest_family_candidates(weights, features=features, seed=seed)
    chosen = sweep(family_candidates, pool, val, label="family")

    if subtype_fit is None:
        if learner == "boosted":
            def subtype_fit(rows, held_rows):
                return fit_boosted(rows, held_rows, features=features, label=label, preset=SUBTYPE_PRESET, seed=seed)
        else:
            def subtype_fit(rows, held_rows):
                return fit_forest(rows, features=features, label=label, max_depth=10, seed=seed)

    fits: dict[str, tuple[DataFrame, DataFrame | None]] = {}
    passthrough: dict[str, str] = {}
    for family, labels in families_of(taxonomy).items():
        observed = [x for x in labels if x in supports]
        if len(labels) == 1:
            passthrough[family] = labels[0]
        elif len(observed) == 1:
            passthrough[family] = observed[0]
        elif observed:
            enough = sum(1 for x in labels if x in held) > 1
            held_rows = family_slice(val, family) if enough else None
            fits[family] = (family_slice(train, family), held_rows)
    with ThreadPoolExecutor(FIT_THREADS) as threads:
        subtypes = dict(zip(fits, threads.map(lambda slices: subtype_fit(*slices), fits.values())))
    return HierarchicalModel(chosen.best_model, subtypes, passthrough, top_k), chosen


@dataclass
class TwoLevelJob:
    """The fitted model, its family candidates best first, and the evaluation of both levels."""

    model: HierarchicalModel
    candidates: Sweep
    evaluation: TwoLevelEvaluation


def two_level_job(
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    *,
    key_columns: Sequence[str],
    taxonomy: Mapping[str, str] = TAXONOMY,
    label: str = LABEL,
    max_per_family: int = 80_000,
    rare_support_threshold: int = 500,
    path: str | None = None,
    seed: int = 1,
    **training,
) -> TwoLevelJob:
    """Fit a two-level model, save it below ``path`` if one is given, and evaluate both levels end to end.

    The family model's TRAIN rows are those of its pool. ``training`` goes to ``train_hierarchical``.
    """
    pool = family_pool(train, key_columns=key_columns, taxonomy=taxonomy, label=label, max_per_family=max_per_family, seed=seed)
    model, candidates = train_hierarchical(
        train, val, key_columns=key_columns, taxonomy=taxonomy, label=label, pool=pool, seed=seed, **training
    )
    if path is not None:
        model.save(path)
    found = evaluate_two_level(
        model, {"TRAIN": pool, "VAL": val, OFFICIAL_TEST: test}, taxonomy=taxonomy, label=label, rare_support_threshold=rare_support_threshold
    )
    return TwoLevelJob(model, candidates, found)


def family_metrics_rows(scored: DataFrame, taxonomy: Mapping[str, str] = TAXONOMY, label: str = LABEL) -> DataFrame:
    """Predictions with their true family beside them."""
    return scored.withColumn("family", F.try_element_at(
        F.create_map(*[F.lit(x) for kv in taxonomy.items() for x in kv]), quoted(label)
    ))
