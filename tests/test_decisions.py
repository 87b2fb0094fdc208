"""Hand-worked decisions, ranking ties and alert levels."""

import math

import pytest
from pyspark.sql import functions as F

from flowlab.functions.decisions import (
    ThresholdConfig,
    alert_level,
    hierarchical_decision,
    is_uncertain,
    tune_decision,
)
from flowlab.functions.ranking import argmax_index, pad_ranks, ranked_classes, ranked_indices, top_columns
from flowlab.plans.scoring import decide_flat

CLASSES = ["A", "B", "C", "D"]
FIRST = [0.40, 0.30, 0.20, 0.10]
SECOND = [0.60, 0.25, 0.10, 0.05]


def scored(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, probs array<double>")


def test_alert_levels_and_uncertainty(spark):
    cases = [
        ("BenignTraffic", 0.90, "INFO"),
        ("BenignTraffic", 0.8999, "REVIEW"),
        ("XSS", 0.90, "HIGH_ALERT"),
        ("XSS", 0.60, "MEDIUM_ALERT"),
        ("XSS", 0.5999, "LOW_ALERT_REVIEW"),
    ]
    df = spark.createDataFrame(cases, "c string, p double, expected string")
    assert df.where(alert_level(F.col("c"), F.col("p")) != F.col("expected")).count() == 0
    got = spark.range(1).select(is_uncertain(F.lit(0.50)), is_uncertain(F.lit(0.4999))).first()
    assert tuple(got) == (False, True)


# probabilities, thresholds, rare, abstain, enabled -> class, confidence, rank, applied, fallback, abstained, uncertain
SERVE = [
    (FIRST, {"A": 0.5, "B": 0.35}, [], False, True, ("C", 0.20, 3, True, "A", False, True)),
    (FIRST, {"A": 0.5, "B": 0.35, "C": 0.25}, [], False, True, ("A", 0.40, 1, True, "A", False, True)),
    (SECOND, {"A": 0.7, "B": 0.3, "C": 0.2, "D": 0.1}, [], False, True, ("A", 0.60, 1, True, "A", False, True)),
    (SECOND, {"A": 0.7}, ["A"], True, True, ("UNCERTAIN_RARE", 0.60, 1, True, None, True, True)),
    (SECOND, {"A": 0.6}, [], False, True, ("A", 0.60, 1, False, None, False, False)),
    (SECOND, {"A": 0.7}, [], False, False, ("A", 0.60, 1, False, None, False, False)),
]


@pytest.mark.parametrize("probs,thresholds,rare,abstain,enabled,expected", SERVE)
def test_serve_decision(spark, probs, thresholds, rare, abstain, enabled, expected):
    config = ThresholdConfig(enabled, thresholds, rare, True, abstain)
    row = decide_flat(scored(spark, probs), CLASSES, config).first()
    got = (
        row.predicted_class,
        row.confidence,
        row.selected_rank,
        row.threshold_applied,
        row.fallback_from_class,
        row.abstained,
        row.uncertain,
    )
    assert got == expected
    if row.abstained:
        assert row.alert_level == "REVIEW" and row.abstain_from_class == "A"
    assert (row.top_1_class, row.top_2_class, row.top_3_class) == ("A", "B", "C")


def test_serve_column_order(spark):
    names = decide_flat(scored(spark, FIRST), CLASSES).columns
    assert names == (
        "id predicted_class confidence alert_level uncertain threshold_applied fallback_from_class abstained "
        "abstain_from_class selected_rank top_1_class top_1_prob top_2_class top_2_prob top_3_class top_3_prob"
    ).split()


def test_fallback_switch_changes_nothing_unless_strict(spark):
    config = ThresholdConfig(True, {"A": 0.5}, [], fallback_to_next_rank=False)
    assert decide_flat(scored(spark, FIRST), CLASSES, config).first().predicted_class == "B"
    assert decide_flat(scored(spark, FIRST), CLASSES, config, strict_fallback=True).first().predicted_class == "A"


TUNE = [
    (FIRST, {"A": 0.5, "B": 0.35}, [], False, ("C", 0.20, 3, True)),
    (FIRST, {"A": 0.5, "B": 0.35, "C": 0.25}, [], False, ("D", 0.10, 4, True)),
    (SECOND, {"A": 0.7, "B": 0.3, "C": 0.2, "D": 0.1}, [], False, ("A", 0.60, 1, False)),
    (SECOND, {"A": 0.7}, ["A"], True, ("UNCERTAIN_RARE", 0.60, 1, True)),
    (SECOND, {"A": 0.6}, [], False, ("A", 0.60, 1, False)),
]


@pytest.mark.parametrize("probs,thresholds,rare,abstain,expected", TUNE)
def test_tune_decision(spark, probs, thresholds, rare, abstain, expected):
    df = scored(spark, probs).withColumn("r", ranked_classes(F.col("probs"), CLASSES))
    row = tune_decision(df, "r", thresholds, rare_labels=rare, abstain_on_rare=abstain).first()
    assert (row.predicted_class, row.confidence, row.selected_rank, row.uncertain) == expected


def test_tie_rules(spark):
    row = scored(spark, [0.4, 0.4, 0.2]).select(
        ranked_indices(F.col("probs"), 3)["i"].alias("order"),
        argmax_index(F.col("probs")).alias("best"),
    ).first()
    assert row.order == [1, 0, 2] and row.best == 0


def test_unusable_probabilities_give_null(spark):
    rows = decide_flat(scored(spark, [0.5, math.nan, 0.2, 0.1], None), CLASSES).collect()
    assert all(r.predicted_class is None and r.alert_level is None for r in rows)


def test_fewer_than_three_classes(spark):
    row = decide_flat(scored(spark, [0.3, 0.7]), ["A", "B"]).first()
    assert (row.top_2_class, row.top_3_class, row.top_3_prob) == ("A", None, None)
    padded = scored(spark, [0.3, 0.7]).select(
        *top_columns(pad_ranks(ranked_classes(F.col("probs"), ["A", "B"], 3)))
    ).first()
    assert (padded.top_3_class, padded.top_3_prob) == ("B", 0.0)


def hierarchical(spark, family, first, top_k):
    df = spark.createDataFrame([(family, first)], "fam array<double>, f1 array<double>")
    return hierarchical_decision(
        df, "fam", ["F1", "F2", "F3"], {"F1": ("f1", ["x", "y"])}, {"F2": "z", "F3": "q"}, top_k=top_k
    ).first()


def test_hierarchical_beam(spark):
    row = hierarchical(spark, [0.5, 0.4, 0.1], [0.6, 0.4], 2)
    assert (row.predicted_family, row.predicted_class, row.confidence) == ("F2", "z", 0.4)
    assert (row.top_1_prob, row.top_2_class, row.top_2_prob, row.top_3_prob) == (1.0, "z", 0.0, 0.0)
    assert row.alert_level == "LOW_ALERT_REVIEW" and row.uncertain and row.selected_rank == 1
    row = hierarchical(spark, [0.5, 0.4, 0.1], [0.6, 0.4], 1)
    assert (row.predicted_class, round(row.confidence, 9)) == ("x", 0.3)
    assert (row.top_2_class, row.top_2_prob, row.top_3_class, row.top_3_prob) == ("y", 0.4, "x", 0.0)
    row = hierarchical(spark, [0.5, 0.4, 0.1], [0.8, 0.2], 2)
    assert (row.predicted_family, row.predicted_class) == ("F1", "x")  # equal products: the earlier family stays


def test_hierarchical_columns_and_guards(spark):
    row = hierarchical(spark, [0.5, 0.4, 0.1], [0.6, 0.4], 2)
    assert list(row.asDict()) == (
        "predicted_family family_confidence predicted_class subtype_confidence confidence alert_level uncertain "
        "threshold_applied fallback_from_class abstained abstain_from_class selected_rank top_1_class top_1_prob "
        "top_2_class top_2_prob top_3_class top_3_prob"
    ).split()
    with pytest.raises(ValueError):
        hierarchical(spark, [0.5, 0.4, 0.1], [0.6, 0.4], 0)
    assert hierarchical(spark, [math.nan, 0.4, 0.1], [0.6, 0.4], 2).predicted_class is None
