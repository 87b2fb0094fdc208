"""Training and scoring on rows with nulls, NaN and infinities."""

import pytest
from pyspark.sql import functions as F

from flowlab.plans import hierarchical, models, training
from flowlab.plans.missing import find_gaps
from flowlab.session import fresh_path, materialize

NAMES = ["a", "b", "c d"]
LABELS = ["DDoS-SYN_Flood", "DDoS-UDP_Flood", "Mirai-udpplain", "Mirai-greip_flood"]


@pytest.fixture(scope="module")
def holed(spark):
    """Four separable classes; a has nulls and NaN, b both infinities, ``c d`` no finite value at all."""
    k, i = F.col("id") % 4, F.col("id")
    df = spark.range(400).select(
        "id",
        F.when(i % 9 == 0, None).when(i % 10 == 0, float("nan")).otherwise(k * 3.0 + (i % 7) / 10).alias("a"),
        F.when(i % 23 == 0, float("inf")).when(i % 29 == 0, float("-inf")).otherwise(k * 1.0).alias("b"),
        F.lit(None).cast("double").alias("c d"),
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), (k + 1).cast("int")).alias("label"),
    )
    return materialize(df, "holed")


def check(model, rows):
    scored = model.score(rows)
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    assert scored.columns == [*rows.columns, "probs"]
    assert scored.where(F.abs(total - 1) < 1e-9).count() == rows.count()
    return [r.probs for r in scored.orderBy("id").collect()]


def test_gaps(holed):
    gaps = {g.position: g for g in find_gaps(holed, NAMES)}
    assert gaps[0].marked and not gaps[1].marked and gaps[2].marked
    assert (gaps[1].low, gaps[1].high) == (0.0, 3.0) and gaps[2].fill == 0.0
    assert find_gaps(holed.select("id"), ["id"]) == []
    assert find_gaps(holed.limit(0), NAMES) == []


FITS = {
    "logreg": lambda df: training.fit_logreg(df, features=NAMES, max_iter=30),
    "forest": lambda df: training.fit_forest(df, features=NAMES, trees=5, max_depth=4, min_rows_per_leaf=2),
    "boosted": lambda df: training.fit_boosted(
        df, df, features=NAMES, preset=dict(maxIter=2, stepSize=0.3, maxDepth=3, minInstancesPerNode=2)
    ),
}


@pytest.mark.parametrize("name", list(FITS))
def test_every_trainer(spark, holed, name):
    model = FITS[name](holed)
    probs = check(model, holed)
    path = fresh_path(spark, "holed-model")
    model.save(path)
    assert check(models.load(spark, path), holed) == probs
    if name != "logreg":
        assert [r.feature for r in model.feature_importance(spark).collect()] == NAMES


def test_two_levels(holed):
    fit = dict(features=NAMES, trees=5, max_depth=4, min_rows_per_leaf=2)
    model, _ = hierarchical.train_hierarchical(
        holed,
        holed,
        key_columns=["id"],
        features=NAMES,
        family_candidates={"one": lambda train, val: training.fit_forest(train, label="family", **fit)},
        subtype_fit=lambda rows, _: training.fit_forest(rows, **fit),
    )
    scored = model.score(holed)
    assert scored.count() == holed.count() and scored.where("predicted_class IS NULL").count() == 0
    assert scored.where("predicted_class = label").count() > 0.8 * holed.count()
    assert not [c for c in scored.columns if c.startswith("_")]
