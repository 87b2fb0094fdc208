"""Spark ML models: quality, round trips and the two-level model."""

import threading

import pytest
from pyspark.sql import functions as F

from flowlab.functions.decisions import ThresholdConfig
from flowlab.operators.metrics import confusion, per_class, summary_metrics
from flowlab.plans import flows as flow_jobs
from flowlab.plans import hierarchical, models, training
from flowlab.plans.evaluation import evaluate_model
from flowlab.plans.scoring import predict, score_with
from flowlab.schema import FEATURES
from flowlab.session import fresh_path, materialize

LABELS = ["BenignTraffic", "DDoS-SYN_Flood", "DDoS-UDP_Flood", "Mirai-udpplain", "Mirai-greip_flood"]


@pytest.fixture(scope="module")
def flows(spark):
    """Five separable classes: the class shifts three features, the rest is noise from a hash."""
    k = F.col("id") % 5
    def noise(i):
        return (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000.0) - 0.5

    columns = [(noise(i) + (k * 2 if i < 2 else F.when(k % 2 == 0, 2.0).otherwise(0.0) if i == 2 else 0.0)).alias(c)
               for i, c in enumerate(FEATURES)]
    names = F.array(*[F.lit(x) for x in LABELS])
    df = spark.range(600).select("id", *columns, F.element_at(names, (k + 1).cast("int")).alias("label"))
    return materialize(df, "flows")


@pytest.fixture(scope="module")
def parts(flows):
    return materialize(flows.where("id < 450"), "train"), materialize(flows.where("id >= 450"), "val")


def accuracy(model, val):
    predicted = model.predict(val)
    return summary_metrics(per_class(confusion(predicted, "label", "y_pred"))).first().accuracy


@pytest.fixture(scope="module")
def logreg(parts):
    return training.fit_logreg(parts[0], max_iter=50)


def test_logreg(spark, parts, logreg):
    assert logreg.classes == sorted(LABELS)
    assert accuracy(logreg, parts[1]) > 0.9
    sums = logreg.score(parts[1]).select(F.aggregate("probs", F.lit(0.0), lambda a, p: a + p).alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").count() == 0


def test_forest_and_importance(spark, parts):
    model = training.fit_forest(parts[0], trees=10, max_depth=6, min_rows_per_leaf=2)
    assert accuracy(model, parts[1]) > 0.9
    table = model.feature_importance(spark)
    assert table.count() == 40
    top = [r.feature for r in table.orderBy(F.desc("importance")).limit(3).collect()]
    assert set(top) == set(FEATURES[:3])


def test_compared_models_are_fitted_side_by_side(spark, parts):
    met = threading.Barrier(2, timeout=60)

    def fit(train, val):
        met.wait()  # broken if the other fit only begins after this one
        return training.fit_logreg(train, max_iter=3)

    found = flow_jobs.compare_models(*parts, {"a": fit, "b": fit}, key_columns=["id"], rare_support_threshold=0)
    assert list(found.models) == ["a", "b"] and found.summary.count() == 2


def test_forest_keeps_the_node_of_a_row(spark, parts):
    model = training.fit_forest(parts[0], trees=3, max_depth=4)
    assert model.pipeline.stages[-1].getCacheNodeIds()


def test_boosted(spark, parts):
    preset = dict(maxIter=5, stepSize=0.3, maxDepth=3, minInstancesPerNode=2)
    model = training.fit_boosted(parts[0], parts[1], preset=preset)
    assert accuracy(model, parts[1]) > 0.9
    path = fresh_path(spark, "boosted")
    model.save(path)
    again = models.load(spark, path)
    a = [r.probs for r in model.score(parts[1]).orderBy("id").select("probs").collect()]
    b = [r.probs for r in again.score(parts[1]).orderBy("id").select("probs").collect()]
    assert a == b and all(abs(sum(p) - 1) < 1e-9 for p in a)


def test_presets_are_complete():
    assert len(training.FLAT_PRESETS) == 4 and len(training.FAMILY_PRESETS) == 3
    assert list(training.boosted_candidates()) == list(training.FLAT_PRESETS)


def test_shuffled_labels_fall_to_chance(spark, parts):
    rows = training.shuffled_label_check(
        lambda df: training.fit_logreg(df, max_iter=20), parts[0], {"VAL": parts[1]}, key_columns=["id"]
    )
    assert rows.first().accuracy < 0.5


def test_nulls_are_scored_not_dropped(spark, parts, logreg):
    hole = parts[1].withColumn("Rate", F.when(F.col("id") % 2 == 0, F.col("Rate")))
    scored = score_with(hole, logreg, carry=["id"])
    assert scored.count() == hole.count()
    assert scored.where("predicted_class IS NULL").count() == hole.where("Rate IS NULL").count()


def test_named_models_and_thresholds(spark, parts, logreg):
    root = fresh_path(spark, "models")
    logreg.save(models.model_path(root, "Logistic Regression"))
    out = predict(spark, parts[1], root, "Logistic Regression", carry=["id"])
    direct = score_with(parts[1], logreg, ThresholdConfig(), carry=["id"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, direct.collect()))
    assert len(out.columns) == 16
    with pytest.raises(ValueError, match="Unknown model"):
        models.load_model(spark, root, "Nope")
    assert len(models.available_models()) == 4


def test_hierarchical(spark, parts):
    train, val = parts
    model, chosen = hierarchical.train_hierarchical(
        train,
        val,
        key_columns=["id"],
        family_candidates=hierarchical.forest_family_candidates({}, trees=10, min_rows_per_leaf=(2, 4, 8)),
        subtype_fit=lambda rows, _: training.fit_forest(rows, trees=10, max_depth=5, min_rows_per_leaf=2),
    )
    assert set(model.subtypes) == {"DDoS", "Mirai"}
    assert model.passthrough["Benign"] == "BenignTraffic"
    assert chosen.best_name in dict.fromkeys(["family_balanced_baseline", "family_stable_medium", "family_stable_strong"])
    row = evaluate_model(model, val).first()
    assert row.accuracy > 0.9 and row.macro_auprc is None
    scored = score_with(val, model, carry=["id"])
    assert len(scored.columns) == 19 and scored.where("top_1_prob < confidence - 1e-12").count() == 0
    path = fresh_path(spark, "bundle")
    model.save(path)
    again = score_with(val, models.load(spark, path), carry=["id"])
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError, match="Mystery"):
        hierarchical.train_hierarchical(train.withColumn("label", F.lit("Mystery")), val, key_columns=["id"])
