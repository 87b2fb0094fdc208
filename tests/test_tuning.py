"""Threshold search: hand-worked case and brute force over random scored rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlab.operators import tuning
from flowlab.plans.experiment import tuning_experiment

CLASSES = ["c", "d", "e"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "label string, probs array<double>")


def test_hand_worked_search(spark):
    rows = [("c", [0.9, 0.1, 0.0]), ("d", [0.8, 0.2, 0.0]), ("c", [0.7, 0.3, 0.0]), ("c", [0.1, 0.9, 0.0])]
    for ratio, expected in ((0.85, {}), (0.5, {"c": 0.9})):
        table = tuning.tune_thresholds(frame(spark, rows), CLASSES, ["c"], min_recall_ratio=ratio, min_rows=1)
        got = {r.label: r.threshold for r in table.collect()}
        if expected:
            # the lowest candidate above .8 wins: same precision and recall as any higher one
            assert set(got) == {"c"} and 0.8 < got["c"] <= 0.9
        else:
            assert got == {}


def measures(rows, label, threshold):
    """(precision, F0.5, recall) of "the top class is the label and its probability reaches the threshold"."""
    k = CLASSES.index(label)
    picked = [t for t, p in rows if p[k] == max(p) and p[k] not in p[k + 1 :] and p[k] >= threshold]
    hits, support = picked.count(label), sum(t == label for t, _ in rows)
    precision, recall = hits / max(len(picked), 1), hits / max(support, 1)
    return precision, 1.25 * precision * recall / max(0.25 * precision + recall, 1e-12), recall


def expected_threshold(rows, label, ratio, min_rows):
    """The best candidate by definition; None when there are too few rows or the best is no threshold at all."""
    k = CLASSES.index(label)
    best_here = [(t, p[k]) for t, p in rows if int(np.argmax(p)) == k]
    if len(best_here) < min_rows:
        return None
    points = np.quantile([p for _, p in best_here], np.arange(50, 100, 5) / 100)
    floor = ratio * sum(t == label for t, _ in best_here) / max(sum(t == label for t, _ in rows), 1)
    scored = [(measures(rows, label, c), -c) for c in {0.0, *(round(float(q), 4) for q in points)}]
    return -max(x for x in scored if x[0][2] >= floor)[1] or None


def random_rows(seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(300):
        w = [rnd.random() ** 2 for _ in CLASSES]
        probs = [round(x / sum(w), 3) for x in w]
        truth = CLASSES[int(np.argmax(probs))] if rnd.random() < max(probs) else rnd.choice(CLASSES)
        rows.append((truth, probs))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_matches_the_definition(spark, seed):
    rows, rare = random_rows(seed), ["c", "e"]
    table = tuning.tune_thresholds(frame(spark, rows), CLASSES, rare, min_recall_ratio=0.3, min_rows=25)
    got = {r.label: r.threshold for r in table.collect()}
    expected = {x: t for x in rare if (t := expected_threshold(rows, x, 0.3, 25)) is not None}
    assert got == pytest.approx(expected, abs=1e-4)


def test_labels_are_independent(spark):
    rows = frame(spark, random_rows(4))
    options = dict(min_recall_ratio=0.3, min_rows=25)
    alone = [tuple(r) for x in ("c", "e") for r in tuning.tune_thresholds(rows, CLASSES, [x], **options).collect()]
    both = [tuple(r) for r in tuning.tune_thresholds(rows, CLASSES, ["c", "e"], **options).collect()]
    assert sorted(alone) == sorted(both)


def test_few_top_rows_are_skipped(spark):
    rows = [("c", [0.9, 0.1, 0.0])] * 24
    assert tuning.tune_thresholds(frame(spark, rows), CLASSES, ["c"], min_recall_ratio=0.0).count() == 0


def test_hard_rows(spark):
    rows = [
        ("c", [0.0, 1.0, 0.0]),  # rare truth
        ("d", [0.9, 0.1, 0.0]),  # rare best
        ("d", [0.2, 0.8, 0.0]),  # rare second
        ("d", [0.0, 0.55, 0.45]),  # close
        ("d", [0.0, 0.9, 0.1]),
    ]
    df = frame(spark, rows)
    got = [r[0] for r in df.select(tuning.is_hard(F.col("probs"), CLASSES, F.col("label"), ["c"])).collect()]
    assert got == [True, True, True, True, False]


def test_experiment_without_thresholds_changes_nothing(spark):
    rows = [("VALIDATION", "c", [0.9, 0.1, 0.0]), ("OFFICIAL TEST", "d", [0.4, 0.35, 0.25])]
    df = spark.createDataFrame(rows, "split string, label string, probs array<double>")
    result = tuning_experiment(df, CLASSES, ["c"])
    assert result.thresholds == {} and result.config.enabled
    table = {(r.split, r.variant): r for r in result.metrics.collect()}
    assert len(table) == 4
    assert table["OFFICIAL TEST", "thresholded"].changed_fraction == 0.0
    assert table["OFFICIAL TEST", "baseline"].uncertain_rate == 1.0
