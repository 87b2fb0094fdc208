"""Early stopping: staged losses against the models' own probabilities, the patience rule, cut models."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowlab.plans import models, stopping, training
from flowlab.session import fresh_path


@pytest.fixture(scope="module")
def fitted(spark):
    """Two classes, a model each, over rows that hold a NaN."""
    rows = spark.range(400).selectExpr("IF(id % 41 = 0, DOUBLE('NaN'), id % 7) AS a", "CAST(id % 3 AS DOUBLE) AS b", "(id % 7 + id % 5) % 2 AS _y", "id")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="_features", handleInvalid="keep").transform(rows)

    def fit(target, rounds):
        booster = GBTClassifier(featuresCol="_features", labelCol="t", maxIter=rounds, maxDepth=3, stepSize=0.3, seed=5, featureSubsetStrategy="0.5")
        return booster.fit(rows.where("NOT isnan(a)").withColumn("t", (F.col("_y") == target).cast("double")))

    return rows, [fit(0, 6), fit(1, 6)], fit


def probabilities(model, rows):
    return np.array([r[0][1] for r in model.transform(rows).orderBy("id").select("probability").collect()])


def test_staged_loss(spark, fitted):
    rows, both, _ = fitted
    y = np.array([r[0] for r in rows.orderBy("id").select("_y").collect()])
    losses = stopping.staged_log_loss(rows, both)
    assert len(losses) == 6
    for k in (1, 4, 6):
        p = np.stack([probabilities(stopping.first_rounds(m, k), rows) for m in both], 1)
        assert losses[k - 1] == pytest.approx(-np.log(p[np.arange(len(y)), y] / p.sum(1)).mean())


def test_first_rounds_are_those_of_a_shorter_fit(spark, fitted):
    rows, both, fit = fitted
    cut = stopping.first_rounds(both[1], 3)
    assert cut.getNumTrees == 3
    assert (probabilities(cut, rows) == probabilities(fit(1, 3), rows)).all()
    path = fresh_path(spark, "cut")
    cut.write().save(path)
    assert (probabilities(GBTClassificationModel.load(path), rows) == probabilities(cut, rows)).all()


@pytest.mark.parametrize(
    "losses,patience,expected",
    [
        ([5, 4, 3, 3.5, 3.2, 3.1, 2], 3, (3, True)),  # the lower loss comes a round too late
        ([5, 4, 3, 3.5, 3.2, 2, 3, 3, 3], 3, (6, True)),
        ([5, 4, 3], 3, (3, False)),
        ([5, 5, 5, 5], 3, (1, True)),  # an equal loss is no lower one
        ([1], 50, (1, False)),
    ],
)
def test_best_round(losses, patience, expected):
    assert stopping.best_round(losses, patience) == expected


def test_fit_stops_and_doubles(spark):
    """Labels of the held-out rows are random, so closer margins cost there; without them all rounds are kept."""
    rows = spark.range(600).selectExpr("CAST(id % 6 AS DOUBLE) AS x", "concat('c', id % 6 % 2) AS label", "id")
    held = rows.withColumn("label", F.concat(F.lit("c"), F.col("id") % 5 % 2))
    preset = dict(maxIter=40, stepSize=0.3, maxDepth=3, minInstancesPerNode=1)
    model = training.fit_boosted(rows, held, features=["x"], preset=preset, patience=2)
    kept = {m.getNumTrees for m in model.per_class}
    assert kept == {stopping.best_round(model.losses, 2)[0]} and len(model.losses) in (4, 8, 16, 32, 40)
    assert max(kept) < len(model.losses)
    path = fresh_path(spark, "stopped")
    model.save(path)
    again = models.load(spark, path)
    assert [m.getNumTrees for m in again.per_class] == [m.getNumTrees for m in model.per_class]
    whole = training.fit_boosted(rows, None, features=["x"], preset=preset, max_iter=5)
    assert {m.getNumTrees for m in whole.per_class} == {5} and whole.losses == []
    empty = training.fit_boosted(rows, held.limit(0), features=["x"], preset=preset, max_iter=5)
    assert {m.getNumTrees for m in empty.per_class} == {5}


def test_copies_are_boosted_as_weight(spark, monkeypatch):
    """Rows that repeat are fitted once: the same trees and losses as from all rows, also where a leaf needs some rows."""
    sizes = []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, rows: (sizes.append(rows.count()), fit(self, rows))[1])
    rows = spark.range(900).selectExpr("CAST(pmod(xxhash64(id), 7) AS DOUBLE) AS x", "CAST(pmod(xxhash64(id, 1), 3) AS DOUBLE) AS y", "id")
    rows = rows.selectExpr("*", "concat('c', IF(id % 3 = 0, pmod(xxhash64(id, 2), 3), CAST((x * x + y) % 3 AS LONG))) AS label").coalesce(1)
    held = rows.where("id % 4 = 0")
    preset = dict(maxIter=2, stepSize=0.3, maxDepth=3, minInstancesPerNode=60)

    def fitted():
        return training.fit_boosted(rows, held, features=["x", "y"], preset=preset, patience=2)

    merged, few = fitted(), max(sizes)
    with monkeypatch.context() as whole:
        whole.setattr(training, "COPIES", 10**9)
        plain = fitted()
    assert few <= 7 * 3 * 3 and max(sizes) == 900
    assert merged.losses == pytest.approx(plain.losses)
    points = rows.select("x", "y").distinct().orderBy("x", "y")
    for a, b in zip(merged.score(points).orderBy("x", "y").collect(), plain.score(points).orderBy("x", "y").collect()):
        assert a["probs"] == pytest.approx(b["probs"])
    sizes.clear()
    weighted = training.fit_boosted(rows, features=["x", "y"], preset=dict(preset, maxIter=1), weights={"c0": 2.0, "c1": 1.0, "c2": 1.0})
    assert len(weighted.classes) == 3 and max(sizes) == 900  # a leaf's rows cannot be read off other weights


def test_one_row_many_times(spark):
    rows = spark.range(40).selectExpr("1.0D AS x", "'a' AS label")
    model = training.fit_boosted(rows, features=["x"], preset=dict(maxIter=2, stepSize=0.3, maxDepth=3, minInstancesPerNode=5))
    assert model.score(rows.limit(1)).first()["probs"] == [1.0]
