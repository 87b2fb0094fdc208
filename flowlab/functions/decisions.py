"""Decision rules over ranked class probabilities: pure column expressions, shuffle-free.

``serve_decision`` is the rule applied when scoring, ``tune_decision`` the one used to measure thresholds and
``hierarchical_decision`` the family-then-subtype rule. Serving and tuning differ on purpose: serving looks at
three ranks and reports a low top class even when no other qualifies; tuning looks at all ranks and does not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions.ranking import (
    class_array,
    pad_ranks,
    ranked_classes,
    ranked_indices,
    top_columns,
)
from flowlab.schema import ABSTAIN_LABEL, BENIGN_CLASS, UNCERTAINTY_FLOOR, quoted


@dataclass(frozen=True)
class ThresholdConfig:
    """Per-class decision thresholds. One entry per class at most, hence small enough to be a literal."""

    enabled: bool = False
    thresholds: Mapping[str, float] = field(default_factory=dict)
    rare_classes: Sequence[str] = ()
    fallback_to_next_rank: bool = True
    abstain_on_low_confidence_rare: bool = False
    abstain_label: str = ABSTAIN_LABEL
    uncertainty_floor: float = UNCERTAINTY_FLOOR


def alert_level(predicted: Column, confidence: Column, benign: str = BENIGN_CLASS) -> Column:
    sure = confidence >= 0.90
    benign_level = F.when(sure, "INFO").otherwise("REVIEW")
    attack_level = F.when(sure, "HIGH_ALERT").when(confidence >= 0.60, "MEDIUM_ALERT").otherwise("LOW_ALERT_REVIEW")
    level = F.when(predicted == benign, benign_level).otherwise(attack_level)
    return F.when(predicted.isNotNull() & confidence.isNotNull(), level)


def is_uncertain(confidence: Column, floor: float = UNCERTAINTY_FLOOR) -> Column:
    return confidence < floor


def combined_score(family_probability: Column, subtype_probability: Column) -> Column:
    return family_probability * subtype_probability


def threshold_of(class_name: Column, thresholds: Mapping[str, float]) -> Column:
    """The threshold set for a class, null when there is none."""
    if not thresholds:
        return F.lit(None).cast("double")
    entries = [F.lit(x) for name, value in thresholds.items() for x in (str(name), float(value))]
    return F.try_element_at(F.create_map(*entries), class_name)


def _passes(entry: Column, thresholds: Mapping[str, float]) -> Column:
    limit = threshold_of(entry["class_name"], thresholds)
    return limit.isNull() | (entry["probability"] >= limit)


def _below_threshold(entry: Column, thresholds: Mapping[str, float]) -> Column:
    return F.coalesce(entry["probability"] < threshold_of(entry["class_name"], thresholds), F.lit(False))


def _one_of(value: Column, names: Sequence[str]) -> Column:
    return value.isin([str(n) for n in names]) if len(names) else F.lit(False)


def serve_decision(
    df: DataFrame,
    ranked: str,
    config: ThresholdConfig,
    *,
    strict_fallback: bool = False,
    benign: str = BENIGN_CLASS,
) -> DataFrame:
    """Add the serving columns ``predicted_class`` to ``top_3_prob`` from a ranked list of up to three.

    ``strict_fallback`` makes ``fallback_to_next_rank=False`` really keep the top class; without it that
    setting only documents how the thresholds were tuned.
    """
    top = F.get(F.col(ranked), F.lit(0))
    if config.enabled and config.thresholds:
        low = _below_threshold(top, config.thresholds)
        may_abstain = F.lit(bool(config.abstain_on_low_confidence_rare))
        abstained = may_abstain & low & _one_of(top["class_name"], config.rare_classes)
        three = [F.get(F.col(ranked), F.lit(r)) for r in range(3)]
        passing = F.coalesce(*[F.when(_passes(e, config.thresholds), e) for e in three])
        if strict_fallback and not config.fallback_to_next_rank:
            passing = top
        chosen = F.when(abstained, top).otherwise(F.coalesce(passing, top))
    else:
        low = abstained = F.lit(False)
        chosen = top

    staged = df.withColumn("_pick", F.struct(low.alias("low"), abstained.alias("abstained"), chosen.alias("chosen")))
    pick = F.col("_pick")
    low, abstained, chosen = pick["low"], pick["abstained"], pick["chosen"]
    top_name = F.get(F.col(ranked), F.lit(0))["class_name"]
    predicted = F.when(abstained, F.lit(config.abstain_label)).otherwise(chosen["class_name"])
    confidence = chosen["probability"]
    kept = [quoted(c) for c in df.columns if c != ranked]
    return staged.select(
        *kept,
        predicted.alias("predicted_class"),
        confidence.alias("confidence"),
        F.when(abstained, "REVIEW").otherwise(alert_level(predicted, confidence, benign)).alias("alert_level"),
        (is_uncertain(confidence, config.uncertainty_floor) | low).alias("uncertain"),
        low.alias("threshold_applied"),
        F.when(low & ~abstained, top_name).alias("fallback_from_class"),
        abstained.alias("abstained"),
        F.when(abstained, top_name).alias("abstain_from_class"),
        chosen["rank"].alias("selected_rank"),
        *top_columns(F.col(ranked)),
    )


def tune_decision(
    df: DataFrame,
    ranked: str,
    thresholds: Mapping[str, float],
    *,
    floor: float = UNCERTAINTY_FLOOR,
    rare_labels: Sequence[str] = (),
    abstain_on_rare: bool = False,
    abstain_label: str = ABSTAIN_LABEL,
    prefix: str = "",
) -> DataFrame:
    """Add ``predicted_class, confidence, selected_rank, uncertain`` by searching all ranks of ``ranked``."""
    top = F.get(F.col(ranked), F.lit(0))
    if thresholds:
        low = _below_threshold(top, thresholds)
        abstained = F.lit(bool(abstain_on_rare)) & low & _one_of(top["class_name"], rare_labels)
        passing = F.get(F.filter(F.col(ranked), lambda e: _passes(e, thresholds)), F.lit(0))
        chosen = F.when(low & ~abstained, F.coalesce(passing, top)).otherwise(top)
    else:
        abstained, chosen = F.lit(False), top
    pick = f"_{prefix}pick"
    staged = df.withColumn(pick, F.struct(abstained.alias("abstained"), chosen.alias("chosen")))
    abstained, chosen = F.col(pick)["abstained"], F.col(pick)["chosen"]
    return staged.select(
        *[quoted(c) for c in df.columns],
        F.when(abstained, F.lit(abstain_label)).otherwise(chosen["class_name"]).alias(f"{prefix}predicted_class"),
        chosen["probability"].alias(f"{prefix}confidence"),
        chosen["rank"].alias(f"{prefix}selected_rank"),
        (is_uncertain(chosen["probability"], floor) | abstained | (chosen["rank"] > 1)).alias(f"{prefix}uncertain"),
    )


def hierarchical_decision(
    df: DataFrame,
    family_probs: str,
    families: Sequence[str],
    subtypes: Mapping[str, tuple[str, Sequence[str]]],
    passthrough: Mapping[str, str],
    *,
    top_k: int = 1,
    benign: str = BENIGN_CLASS,
) -> DataFrame:
    """Best (family, subtype) pair among the ``top_k`` families, with the 18 hierarchical output columns.

    ``subtypes`` maps a family to the column holding its subtype probabilities and to that column's class names;
    ``passthrough`` maps a family with a single subtype to it. Only families in the beam are ranked.
    """
    if top_k < 1:
        raise ValueError("top_k must be at least 1")
    families = [str(f) for f in families]
    unknown = [f for f in families if f not in subtypes and f not in passthrough]
    if unknown:
        raise ValueError(f"No subtype model or passthrough label for families: {unknown}")

    beam = df.withColumn("_beam", ranked_indices(F.col(family_probs), len(families), top_k))
    in_beam = F.col("_beam")["i"]

    # One column per family: an array of them would be unfolded again wherever an entry is picked.
    options = {}
    for index, family in enumerate(families):
        chosen = F.array_contains(in_beam, F.lit(index))
        if family in passthrough:
            one = F.struct(
                F.lit(1).alias("rank"),
                F.lit(str(passthrough[family])).alias("class_name"),
                F.lit(1.0).alias("probability"),
            )
            options[f"_ranks_{index}"] = F.when(chosen, F.array(one))
        else:
            column, classes = subtypes[family]
            options[f"_ranks_{index}"] = ranked_classes(F.col(column), classes, 3, chosen)
    staged = beam.withColumns(options)

    names = class_array(families)
    def picked(index: Column) -> Column:
        ranks = F.lit(None)
        for position, option in reversed(list(enumerate(options))):
            ranks = F.when(index == position, F.col(option)).otherwise(ranks)
        return ranks

    entries = [F.get(F.col("_beam"), F.lit(r)) for r in range(min(top_k, len(families)))]
    scores = F.array(*[combined_score(e["p"], picked(e["i"])[0]["probability"]) for e in entries])
    staged = staged.withColumn("_scores", scores)
    # Largest product wins; among equal products the first position, which is the family ranked earlier.
    place = F.array_position("_scores", F.array_max("_scores")).cast("int") - 1
    staged = staged.withColumn("_entry", F.get(F.col("_beam"), place))
    staged = staged.withColumn("_ranks", picked(F.col("_entry")["i"]))
    entry, subtype = F.col("_entry"), F.get(F.col("_ranks"), F.lit(0))
    score = combined_score(entry["p"], subtype["probability"])
    staged = staged.withColumn("_top", pad_ranks(F.col("_ranks"))).withColumn("_score", score)
    hidden = {family_probs, *[column for column, _ in subtypes.values()]}
    kept = [quoted(c) for c in df.columns if c not in hidden]
    return staged.select(
        *kept,
        F.get(names, entry["i"]).alias("predicted_family"),
        entry["p"].alias("family_confidence"),
        subtype["class_name"].alias("predicted_class"),
        subtype["probability"].alias("subtype_confidence"),
        F.col("_score").alias("confidence"),
        alert_level(subtype["class_name"], F.col("_score"), benign).alias("alert_level"),
        is_uncertain(F.col("_score")).alias("uncertain"),
        F.lit(False).alias("threshold_applied"),
        F.lit(None).cast("string").alias("fallback_from_class"),
        F.lit(False).alias("abstained"),
        F.lit(None).cast("string").alias("abstain_from_class"),
        F.when(entry.isNotNull(), F.lit(1)).alias("selected_rank"),
        *top_columns(F.col("_top")),
    )
