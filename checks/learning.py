"""Model training and scoring on flows derived from the embeddings: their dimensions as the features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import load
from flowlab.operators import reports, sampling
from flowlab.operators.metrics import confusion, per_class, summary_metrics
from flowlab.operators.taxonomy import family_correct
from flowlab.plans import flows as flow_jobs
from flowlab.plans import hierarchical, models, training
from flowlab.plans.evaluation import evaluate_model
from flowlab.plans.scoring import score_with
from flowlab.schema import FEATURES, TAXONOMY, conform
from flowlab.session import fresh_path, materialize

# The ten embedding labels, as labels of the taxonomy: five families, one of them with a single label.
FLOW_LABELS = [
    "BenignTraffic",
    "DDoS-SYN_Flood",
    "DDoS-UDP_Flood",
    "DDoS-TCP_Flood",
    "Mirai-greeth_flood",
    "Mirai-udpplain",
    "Recon-PortScan",
    "Recon-OSScan",
    "XSS",
    "SqlInjection",
]
KEY = ["flow_id"]


#: A column for each dimension of the embeddings: the features of the contract first, further ones after them.
DIMENSIONS = [*FEATURES, *[f"dimension_{i}" for i in range(len(FEATURES), 64)]]


def flows(spark, sf):
    features = [f"CAST(embedding[{i}] AS DOUBLE) AS `{c}`" for i, c in enumerate(DIMENSIONS)]
    return load(spark, sf, "embeddings").selectExpr("vec_id AS flow_id", *features, f"{SQL_LABEL} AS label")


def flow_conform(spark, sf):
    return conform(flows(spark, sf).withColumn("Telnet", F.lit(0)), label="label", carry=KEY)


def _split(spark, sf):
    train, val = sampling.split_train_val(flows(spark, sf), 0.30, seed=42, key_columns=KEY)
    return materialize(train, "train"), materialize(val, "val")


def _evaluated(model, val, name):
    row = evaluate_model(model, val, rare_support_threshold=20, name=name)
    return row.withColumn("rare_classes", F.concat_ws(",", "rare_classes"))


def train_logreg(spark, sf):
    train, val = _split(spark, sf)
    return _evaluated(training.fit_logreg(train, features=DIMENSIONS), val, "logreg")


def train_forest(spark, sf):
    train, val = _split(spark, sf)
    return _evaluated(training.fit_forest(train, features=DIMENSIONS), val, "forest")


def train_boosted(spark, sf):
    train, val = _split(spark, sf)
    small = dict(training.FLAT_PRESETS["stable_ultra"], minInstancesPerNode=5, stepSize=0.2)
    return _evaluated(training.fit_boosted(train, val, features=DIMENSIONS, preset=small, max_iter=5), val, "boosted")


def boosted_sweep(spark, sf):
    """Two presets with leaf sizes fit for small data; the tuning table, best first."""
    train, val = _split(spark, sf)
    small = {
        name: dict(training.FLAT_PRESETS[name], minInstancesPerNode=leaf, stepSize=0.2, maxDepth=3)
        for name, leaf in (("stable_medium", 5), ("stable_ultra", 10))
    }
    return training.sweep(training.boosted_candidates(small, features=DIMENSIONS, max_iter=3), train, val).table


def feature_importance(spark, sf):
    train, _ = _split(spark, sf)
    model = training.fit_forest(train, features=DIMENSIONS)
    return reports.top_features(model.feature_importance(spark))


def shuffled_label_check(spark, sf):
    train, val = _split(spark, sf)
    return training.shuffled_label_check(
        lambda rows: training.fit_logreg(rows, features=DIMENSIONS), train, {"TRAIN": train, "VAL": val}, key_columns=KEY
    )


def _hierarchical(spark, sf):
    train, val = _split(spark, sf)
    candidates = hierarchical.forest_family_candidates({}, features=DIMENSIONS)
    model, chosen = hierarchical.train_hierarchical(
        train,
        val,
        key_columns=KEY,
        features=DIMENSIONS,
        family_candidates=candidates,
    )
    return model, chosen, val


def train_hierarchical(spark, sf):
    model, _, val = _hierarchical(spark, sf)
    return _evaluated(model, val, "hierarchical")


def hierarchical_sweep(spark, sf):
    return _hierarchical(spark, sf)[1].table


def hierarchical_family_correct(spark, sf):
    """End-to-end metrics over the rows whose family was right, with mean confidences."""
    model, _, val = _hierarchical(spark, sf)
    scored = materialize(
        hierarchical.family_metrics_rows(model.score(val).select("label", "predicted_family", "predicted_class",
                                                                 "family_confidence", "subtype_confidence"), TAXONOMY),
        "scored",
    )
    right = family_correct(scored)
    summary = summary_metrics(per_class(confusion(right, "label", "predicted_class")))
    means = reports.mean_confidence(scored)
    return summary.withColumn("_one", F.lit(1)).join(means.withColumn("_one", F.lit(1)), "_one").drop("_one")


def saved_model_scores(spark, sf):
    """Train, save, load by name and score: the flat output table."""
    train, val = _split(spark, sf)
    root = fresh_path(spark, "models")
    training.fit_logreg(train, features=DIMENSIONS).save(models.model_path(root, "Logistic Regression"))
    model = models.load_model(spark, root, "Logistic Regression")
    return score_with(val, model, carry=KEY)


def _held_out(spark, sf):
    """A quarter of the flows as the untouched test set, the rest as the archive."""
    archive, test = sampling.split_train_val(flows(spark, sf), 0.25, seed=8, key_columns=KEY)
    return materialize(archive, "archive"), materialize(test, "test")


def compare_models(spark, sf):
    """Balanced sample, hygiene, two models, evaluation on three splits: the model summary."""
    archive, test = _held_out(spark, sf)
    fits = {
        "LogReg": lambda train, val: training.fit_logreg(train, features=DIMENSIONS),
        "RandomForest": lambda train, val: training.fit_forest(train, features=DIMENSIONS),
    }
    result = flow_jobs.compare_models(
        archive, test, fits, key_columns=KEY, features=DIMENSIONS, rare_support_threshold=12
    )
    return result.summary


def tune_model_thresholds(spark, sf):
    """Thresholds for a trained model, from its rebuilt validation split: metrics per split and variant."""
    archive, test = _held_out(spark, sf)
    model = training.fit_logreg(archive, features=DIMENSIONS)
    result = flow_jobs.tune_model(
        model, archive, test, key_columns=KEY, rare_support_threshold=12, val_frac=0.5, min_rows=3, min_recall_ratio=0.4
    )
    return result.metrics


def training_data_audit(spark, sf):
    """Overlap before, rows removed and overlap after, for the archive against the test rows plus some of its own."""
    archive, test = _held_out(spark, sf)
    leaked = test.unionByName(archive.where("label = 'XSS'"))
    data = flow_jobs.prepare_training_data(archive, leaked, key_columns=KEY, features=DIMENSIONS, max_per_label=None)
    return data.audit.select("unique_a", "overlap", "rows_before", "rows_removed", "rows_kept", "overlap_after")


def _sql_label() -> str:
    return "CASE label " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(FLOW_LABELS)) + " END"


SQL_LABEL = _sql_label()
_SQL_FEATURES = ", ".join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS "{c}"' for i, c in enumerate(FEATURES))

QUERIES = {
    "flow_conform": (
        flow_conform,
        f"SELECT vec_id AS flow_id, {_SQL_FEATURES}, {SQL_LABEL} AS label FROM embeddings",
    ),
    "training_data_audit": (
        training_data_audit,
        f"""WITH o AS (SELECT {SQL_LABEL} AS label, row_number() OVER (ORDER BY md5(concat_ws('|', '8', vec_id))) AS rn,
              count(*) OVER () AS n, embedding AS x FROM embeddings),
            a AS (SELECT label, x FROM o WHERE rn <= floor(n * (1.0 - 0.25))),
            t AS (SELECT DISTINCT x FROM (SELECT x FROM o WHERE rn > floor(n * (1.0 - 0.25))
                  UNION ALL SELECT x FROM a WHERE label = 'XSS'))
            SELECT count(DISTINCT x) AS unique_a, count(DISTINCT x) FILTER (x IN (SELECT x FROM t)) AS overlap,
              count(*) AS rows_before, count(*) FILTER (x IN (SELECT x FROM t)) AS rows_removed,
              count(*) FILTER (x NOT IN (SELECT x FROM t)) AS rows_kept, CAST(0 AS BIGINT) AS overlap_after FROM a""",
    ),
    "train_logreg": (train_logreg, None),
    "compare_models": (compare_models, None),
    "tune_model_thresholds": (tune_model_thresholds, None),
    "train_forest": (train_forest, None),
    "train_boosted": (train_boosted, None),
    "boosted_sweep": (boosted_sweep, None),
    "feature_importance": (feature_importance, None),
    "shuffled_label_check": (shuffled_label_check, None),
    "train_hierarchical": (train_hierarchical, None),
    "hierarchical_sweep": (hierarchical_sweep, None),
    "hierarchical_family_correct": (hierarchical_family_correct, None),
    "saved_model_scores": (saved_model_scores, None),
}
