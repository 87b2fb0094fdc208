"""Early stopping of boosted class models on their joint log loss.

Each class has a binary model of its own, so no model can tell by itself when the classifier as a whole stops gaining.
One pass over the validation rows gives every row's margins after each round, for all classes, and one aggregation the
log loss by round; the models are then cut after the best one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.session import fresh_path

#: Rounds without a lower loss before boosting stops.
PATIENCE = 50
#: Probabilities below this count as this.
LEAST = 1e-15

#: Feature, threshold, left and right child (-1: a leaf) and value of the nodes of one tree.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def tree_tables(spark, model: GBTClassificationModel) -> list[Tree]:
    """The trees of a fitted model as arrays, values scaled by the trees' weights; read from its saved form."""
    path = fresh_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID",
        node["id"].alias("id"),
        node["split"]["featureIndex"].alias("feature"),
        F.coalesce(F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["prediction"].alias("value"),
    )
    table = rows.toPandas().sort_values(["treeID", "id"])  # rounds x nodes of a tree, bounded by the settings
    weights = model.treeWeights
    out = []
    for tree, part in table.groupby("treeID"):
        columns = [part[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value")]
        columns[4] = columns[4] * weights[tree]
        out.append(tuple(columns))
    return out


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    """A tree's value for every row of ``x``; a value at or below the threshold goes left, NaN right."""
    feature, threshold, left, right, value = tree
    node, row = np.zeros(len(x), np.int64), np.arange(len(x))
    while True:
        inner = left[node] >= 0
        if not inner.any():
            return value[node]
        goes_left = x[row, np.maximum(feature[node], 0)] <= threshold[node]
        node = np.where(inner, np.where(goes_left, left[node], right[node]), node)


def staged_log_loss(rows: DataFrame, models: Sequence[GBTClassificationModel], features: str = "_features", target: str = "_y", count: str | None = None) -> list[float]:
    """Mean log loss after 1, 2, .. rounds over ``rows``, whose ``target`` is the index of their class; a row stands for
    ``count`` rows if that column is given.

    The models say P(class against the rest); their shares of the sum are the joint probabilities.
    """
    spark = rows.sparkSession
    trees = [tree_tables(spark, m) for m in models]
    rounds = min(map(len, trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(rounds), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            y = batch.column(1).to_numpy().astype(np.int64)
            n = batch.column(2).to_numpy()
            margins, row = np.zeros((batch.num_rows, len(trees))), np.arange(batch.num_rows)
            for k in range(rounds):
                for c, stages in enumerate(trees):
                    margins[:, c] += tree_values(stages[k], x)
                p = 1 / (1 + np.exp(-2 * margins))
                total[k] -= (np.log(np.maximum(p[row, y] / p.sum(1), LEAST)) * n).sum()
            seen += n.sum()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), pa.array(total), pa.array(np.full(rounds, seen))], names=["k", "loss", "n"])

    number = (F.col(count).cast("double") if count else F.lit(1.0)).alias("n")
    staged = rows.select(vector_to_array(features), target, number).mapInArrow(run, "k long, loss double, n double")
    means = staged.groupBy("k").agg((F.sum("loss") / F.sum("n")).alias("loss")).orderBy("k").collect()  # one row a round
    return [r["loss"] for r in means]


def best_round(losses: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(rounds kept, whether boosting stops within ``losses``): the round of the lowest loss before ``patience`` rounds
    pass without a lower one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model as it was after that many rounds."""
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    held = model._java_obj.trees()
    for k in range(rounds):
        trees[k] = held[k]
        weights[k] = float(model.treeWeights[k])
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model._java_obj.uid(), trees, weights, model.numFeatures, 2)
    return model._copyValues(GBTClassificationModel(java))
