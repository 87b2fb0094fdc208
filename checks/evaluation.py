"""Confusion-based metrics, average precision, candidate tables and model summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.decisions import _HIER_RIGHT, family_correct_metrics
from checks.tables import (
    DOC_CLASSES,
    DOC_RARE_SUPPORT,
    EVENT_CLASSES,
    SQL_DOCS,
    SQL_EVENTS,
    frequency_table,
    load,
    positioned,
    rounded,
    scored_documents,
    scored_events,
    sql_per_class,
    sql_values,
    sql_wide,
)
from flowlab.functions.ranking import argmax_class
from flowlab.operators import average_precision as ap
from flowlab.operators import metrics, reports, sampling
from flowlab.operators.quantiles import grouped_quantiles
from flowlab.operators.small import small_side
from flowlab.operators.support import class_support, rare_labels
from flowlab.plans.evaluation import evaluate_scored, evaluate_stacked
from flowlab.session import materialize


def _document_confusion(spark, sf):
    predicted = scored_documents(spark, sf).select(
        "label", argmax_class(F.col("probs"), DOC_CLASSES).alias("y_pred")
    )
    return metrics.confusion(predicted, "label", "y_pred")


def confusion(spark, sf):
    return _document_confusion(spark, sf)


def per_class_metrics(spark, sf):
    return rounded(metrics.per_class(_document_confusion(spark, sf)), "precision", "recall", "f1")


def fbeta_by_class(spark, sf):
    table = metrics.per_class(_document_confusion(spark, sf))
    return table.select("label", F.round(metrics.fbeta(F.col("precision"), F.col("recall")), 6).alias("f05"))


def summary_metrics(spark, sf):
    summary = metrics.summary_metrics(metrics.per_class(_document_confusion(spark, sf)))
    return rounded(summary, *summary.columns)


def rare_metrics(spark, sf):
    table = metrics.per_class(_document_confusion(spark, sf))
    rare = metrics.rare_metrics(table, metrics.is_rare(DOC_RARE_SUPPORT))
    named = rare.withColumn("rare_classes", F.concat_ws(",", "rare_classes"))
    return rounded(named, "rare_mean_precision", "rare_mean_recall", "rare_mean_f1")


def classification_report(spark, sf):
    report = metrics.classification_report(metrics.per_class(_document_confusion(spark, sf)))
    return rounded(report, "precision", "recall", "f1")


def evaluation_by_split(spark, sf):
    """Languages as splits, one of them the official test: rare metrics appear on that one only."""
    predicted = scored_documents(spark, sf).select(
        F.when(F.col("family") == "de", "official test").otherwise(F.upper("family")).alias("split"),
        "label",
        argmax_class(F.col("probs"), DOC_CLASSES).alias("y_pred"),
    )
    counts = metrics.confusion(predicted, "label", "y_pred", ["split"])
    summary = metrics.evaluation_summary(
        metrics.per_class(counts, ["split"]), rare_support_threshold=DOC_RARE_SUPPORT
    )
    named = summary.withColumn("rare_classes", F.concat_ws(",", "rare_classes"))
    return rounded(named, *[c for c, t in named.dtypes if t == "double"])


def one_vs_rest(spark, sf):
    return ap.one_vs_rest(scored_documents(spark, sf), DOC_CLASSES)


def average_precision(spark, sf):
    return rounded(ap.average_precision(scored_documents(spark, sf), DOC_CLASSES), "average_precision")


def event_average_precision(spark, sf):
    table = ap.average_precision(scored_events(spark, sf), EVENT_CLASSES, truth="event_type")
    return rounded(table, "average_precision")


def macro_auprc(spark, sf):
    return rounded(ap.macro_auprc(ap.average_precision(scored_documents(spark, sf), DOC_CLASSES)), "macro_auprc")


def rare_auprc(spark, sf):
    scored = scored_documents(spark, sf)
    rare = [r[0] for r in rare_labels(class_support(scored), DOC_RARE_SUPPORT).collect()]
    table = ap.average_precision(scored, DOC_CLASSES, only=rare)
    return rounded(ap.rare_auprc(table, rare), "rare_mean_auprc")


def evaluate_scored_documents(spark, sf):
    row = evaluate_scored(
        scored_documents(spark, sf), DOC_CLASSES, rare_support_threshold=DOC_RARE_SUPPORT, all_classes=True
    )
    named = row.withColumn("rare_classes", F.concat_ws(",", "rare_classes"))
    return rounded(named, *[c for c, t in named.dtypes if t == "double"])


def price_quantiles(spark, sf):
    """Exact quantiles of the tax-and-discount share per return flag."""
    lines = load(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_extendedprice") / 110_000).alias("share")
    )
    table = grouped_quantiles(lines, "l_returnflag", "share", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])
    return rounded(table, "quantile")


# Candidates: majority class per bucket learned on training rows, for three ways to bucket.
CANDIDATES = {
    "by_hour": "CAST(hour(ts) AS INT)",
    "by_value": "CAST(least(floor(value / 5), 20) AS INT)",
    "by_hour_and_value": "CAST(hour(ts) * 100 + least(floor(value / 5), 20) AS INT)",
}


def _splits(spark, sf):
    """TRAIN / VAL / OFFICIAL TEST: a fifth of the events held out, the rest split again."""
    events = load(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    pool, test = sampling.split_train_val(events, 0.20, seed=5, key_columns=["event_id"])
    parts = sampling.with_split(pool, 0.15, seed=42, key_columns=["event_id"])
    return parts.unionByName(test.withColumn("split", F.lit("OFFICIAL TEST")))


def _candidate_confusion(spark, sf):
    """Confusion counts of every candidate on every split. Counts per (candidate, bucket, split, class) come from one
    pass; all that follows works on those counts."""
    rows = _splits(spark, sf)
    entries = [
        F.struct(F.lit(name).alias("candidate"), F.lit(i).alias("candidate_idx"), F.expr(sql).alias("bucket"))
        for i, (name, sql) in enumerate(CANDIDATES.items())
    ]
    keys = ["candidate", "candidate_idx", "bucket"]
    counts = (
        rows.select("split", "event_type", F.explode(F.array(*entries)).alias("e"))
        .groupBy("split", "event_type", *[F.col(f"e.{k}").alias(k) for k in keys])
        .agg(F.count("*").alias("n"))
    )
    trained = counts.where("split = 'TRAIN'")
    first = Window.partitionBy(*keys).orderBy(F.desc("n"), "event_type")
    learned = trained.withColumn("rank", F.row_number().over(first)).where("rank = 1")
    learned = learned.select(*keys, F.col("event_type").alias("y_pred"))
    joined = counts.join(learned, keys, "left").withColumn("y_pred", F.coalesce("y_pred", F.lit(EVENT_CLASSES[0])))
    return joined.groupBy("candidate", "candidate_idx", "split", F.col("event_type").alias("y_true"), "y_pred").agg(
        F.sum("n").alias("n")
    )


def selection_score(spark, sf):
    keys = ["candidate", "candidate_idx", "split"]
    scores = metrics.summary_metrics(metrics.per_class(_candidate_confusion(spark, sf), keys), keys)
    table = positioned(reports.tuning_table(scores, order="candidate_idx"))
    return rounded(table, "train_macro_f1", "val_macro_f1", "gap", "score")


def best_candidate(spark, sf):
    return reports.best_candidate(selection_score(spark, sf), order="candidate_idx").select("candidate", "score")


def _stacked(spark, sf):
    """Every candidate's shares of the training rows' classes as its probabilities, side by side on all splits; a bucket
    that training rows do not have gets zeros. Rare: a test support below the mean."""
    names = [F.expr(sql).alias(name) for name, sql in CANDIDATES.items()]
    rows = materialize(_splits(spark, sf).select("split", F.col("event_type").alias("label"), *names), "splits")
    train, scored = rows.where("split = 'TRAIN'"), rows
    for name in CANDIDATES:
        table = frequency_table(train, name, "label", EVENT_CLASSES, out=f"p_{name}")
        scored = scored.join(small_side(table), name, "left")
    nothing = F.array(*[F.lit(0.0) for _ in EVENT_CLASSES])
    columns = {name: f"p_{name}" for name in CANDIDATES}
    scored = scored.withColumns({c: F.coalesce(c, nothing) for c in columns.values()})
    threshold = rows.where("split = 'OFFICIAL TEST'").count() // len(EVENT_CLASSES)
    return evaluate_stacked(
        scored, columns, dict.fromkeys(CANDIDATES, EVENT_CLASSES), rare_support_threshold=threshold, all_classes=True
    )


def stacked_evaluation(spark, sf):
    """Three candidates on three splits in one pass, with rare and macro average precision of each on the test split."""
    rows = _stacked(spark, sf).rows.withColumn("rare_classes", F.concat_ws(",", "rare_classes"))
    return rounded(rows, *[c for c, t in rows.dtypes if t == "double"])


def stacked_reports(spark, sf):
    """Per-class reports of every candidate on every split."""
    return rounded(_stacked(spark, sf).reports, "precision", "recall", "f1")


def model_summary(spark, sf):
    """Per model: macro F1 by split, gaps, and rare metrics and average precision on the test split."""
    summary = reports.model_summary(_stacked(spark, sf).rows)
    return rounded(positioned(summary), *[c for c, t in summary.dtypes if t == "double"])


_CM = f"""WITH {SQL_DOCS},{sql_wide(2)}, cm AS (SELECT truth AS y_true, ac AS y_pred, count(*) AS n FROM w GROUP BY 1, 2)"""
_PC = f"{_CM},{sql_per_class()}"
_RARE = f"support > 0 AND support <= {DOC_RARE_SUPPORT}"
_SUMMARY = """round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
    round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1"""


def sql_ap(where: str = "true") -> str:
    """CTE ``apc``: average precision per class from distinct scores, best first."""
    return f"""
    g AS (SELECT c AS class, p AS score, count(*) FILTER (truth = c) AS positives, count(*) AS rows FROM rk
          WHERE {where} GROUP BY 1, 2),
    run AS (SELECT *, sum(positives) OVER (PARTITION BY class ORDER BY score DESC) AS tp,
                   sum(rows) OVER (PARTITION BY class ORDER BY score DESC) AS seen,
                   sum(positives) OVER (PARTITION BY class) AS np FROM g),
    apc AS (SELECT class, CAST(max(np) AS BIGINT) AS positives,
                   coalesce(sum(positives / nullif(np, 0) * (tp / seen)), 0.0) AS ap FROM run GROUP BY 1)"""


_SPLIT_CM = """WITH s AS (SELECT CASE WHEN family = 'de' THEN 'official test' ELSE upper(family) END AS split, w.*
    FROM w JOIN dr ON dr.doc_id = w.id), cm AS (SELECT split, truth AS y_true, ac AS y_pred, count(*) AS n
    FROM s GROUP BY 1, 2, 3)"""

_KEY = "md5(concat_ws('|', '{seed}', event_id))"
_CAND_SQL = f"""
    WITH o AS (SELECT *, row_number() OVER (ORDER BY {_KEY.format(seed=5)}) AS rn, count(*) OVER () AS n FROM events),
    pool AS (SELECT * EXCLUDE (rn, n) FROM o WHERE rn <= floor(n * (1.0 - 0.20))),
    o2 AS (SELECT *, row_number() OVER (ORDER BY {_KEY.format(seed=42)}) AS rn, count(*) OVER () AS n FROM pool),
    sp AS (SELECT event_id, event_type, ts, value,
                  CASE WHEN rn <= floor(n * (1.0 - 0.15)) THEN 'TRAIN' ELSE 'VAL' END AS split FROM o2
           UNION ALL SELECT event_id, event_type, ts, value, 'OFFICIAL TEST' FROM o WHERE rn > floor(n * (1.0 - 0.20))),
    cd AS ({' UNION ALL '.join(
        f"SELECT split, event_type, '{name}' AS candidate, {i} AS candidate_idx, {sql} AS bucket FROM sp"
        for i, (name, sql) in enumerate(CANDIDATES.items()))}),
    learned AS (SELECT candidate, bucket, event_type AS y_pred FROM (
        SELECT candidate, bucket, event_type, count(*) AS n FROM cd WHERE split = 'TRAIN' GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY candidate, bucket ORDER BY n DESC, event_type) = 1),
    cm AS (SELECT candidate, candidate_idx, split, event_type AS y_true, coalesce(y_pred, 'click') AS y_pred, count(*) AS n
           FROM cd LEFT JOIN learned USING (candidate, bucket) GROUP BY ALL),
    {sql_per_class('cm', ['candidate', 'candidate_idx', 'split'])},
    sm AS (SELECT candidate, candidate_idx, split, avg(f1) AS f FROM pc GROUP BY ALL),
    wide AS (SELECT candidate, candidate_idx, max(CASE WHEN split = 'TRAIN' THEN f END) AS t,
                    max(CASE WHEN split = 'VAL' THEN f END) AS v, max(CASE WHEN split = 'OFFICIAL TEST' THEN f END) AS o
             FROM sm GROUP BY ALL),
    tab AS (SELECT candidate, candidate_idx, round(t, 6) AS train_macro_f1, round(v, 6) AS val_macro_f1,
                   round(t - v, 6) AS gap, round(v - 0.75 * greatest(0, t - v), 6) AS score FROM wide)"""

# Shares per (candidate, bucket) of the training rows, what each candidate says, and its scores of every class on the test.
_STACKED = f"""{_CAND_SQL.split("    learned AS")[0].rstrip().rstrip(",")},
    cls(idx, c) AS (SELECT * FROM {sql_values(EVENT_CLASSES)} v(idx, c)),
    cell AS (SELECT candidate, split, bucket, event_type, count(*) AS n FROM cd GROUP BY ALL),
    sw AS (SELECT candidate, bucket, idx, c, CAST(sum(CASE WHEN event_type = c THEN n ELSE 0 END) AS DOUBLE) AS n
           FROM cell CROSS JOIN cls WHERE split = 'TRAIN' GROUP BY ALL),
    pw AS (SELECT *, (n*n)*(n*n)*(n*n)*(n*n) AS x FROM sw),
    sh AS (SELECT candidate, bucket, idx, c, coalesce(round(x / nullif(sum(x) OVER (PARTITION BY candidate, bucket), 0), 6), 0.0) AS p FROM pw),
    sc AS (SELECT k.candidate, k.bucket, cls.idx, cls.c, coalesce(p, 0.0) AS p
           FROM (SELECT DISTINCT candidate, bucket FROM cell) k CROSS JOIN cls LEFT JOIN sh ON sh.candidate = k.candidate
           AND sh.bucket = k.bucket AND sh.idx = cls.idx),
    sd AS (SELECT candidate, bucket, c AS y_pred FROM sc
           QUALIFY row_number() OVER (PARTITION BY candidate, bucket ORDER BY p DESC, idx) = 1),
    cm AS (SELECT candidate AS model, split, event_type AS y_true, y_pred, sum(n) AS n FROM cell JOIN sd USING (candidate, bucket) GROUP BY ALL),
    {sql_per_class('cm', ['model', 'split'])},
    lim AS (SELECT count(*) // {len(EVENT_CLASSES)} AS t FROM sp WHERE split = 'OFFICIAL TEST'),
    g AS (SELECT cell.candidate AS model, c AS class, p AS score, sum(CASE WHEN event_type = c THEN n ELSE 0 END) AS positives, sum(n) AS rows
          FROM cell JOIN sc USING (candidate, bucket) WHERE split = 'OFFICIAL TEST' GROUP BY ALL),
    run AS (SELECT *, sum(positives) OVER (PARTITION BY model, class ORDER BY score DESC) AS tp,
                   sum(rows) OVER (PARTITION BY model, class ORDER BY score DESC) AS seen,
                   sum(positives) OVER (PARTITION BY model, class) AS np FROM g),
    apc AS (SELECT model, class, coalesce(sum(positives / nullif(np, 0) * (tp / seen)), 0.0) AS ap FROM run GROUP BY 1, 2),
    ra AS (SELECT pc.model, avg(precision) AS rp, avg(recall) AS rr, avg(f1) AS rf, avg(ap) AS ra, string_agg(label, ',' ORDER BY label) AS rc
           FROM pc JOIN apc ON apc.model = pc.model AND apc.class = pc.label, lim
           WHERE split = 'OFFICIAL TEST' AND support > 0 AND support <= t GROUP BY 1),
    ma AS (SELECT model, avg(ap) AS m FROM apc GROUP BY 1),
    ev AS (SELECT pc.model, split, sum(tp) / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(f1) AS macro_f1,
             sum(f1 * support) / sum(support) AS weighted_f1 FROM pc GROUP BY 1, 2)"""

QUERIES = {
    "stacked_evaluation": (
        stacked_evaluation,
        f"""{_STACKED} SELECT model, split, round(accuracy, 6) AS accuracy, round(macro_precision, 6) AS macro_precision,
            round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, round(rp, 6) AS rare_mean_precision,
            round(rr, 6) AS rare_mean_recall, round(rf, 6) AS rare_mean_f1, round(ra, 6) AS rare_mean_auprc,
            round(m, 6) AS macro_auprc, coalesce(rc, '') AS rare_classes
            FROM ev LEFT JOIN (SELECT *, 'OFFICIAL TEST' AS split FROM ra) USING (model, split)
            LEFT JOIN (SELECT *, 'OFFICIAL TEST' AS split FROM ma) USING (model, split)""",
    ),
    "stacked_reports": (
        stacked_reports,
        f"""{_STACKED}, a AS (SELECT model, split, sum(tp) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS n, avg(precision) AS mp,
              avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) / sum(support) AS wp,
              sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM pc GROUP BY 1, 2),
            lines AS (SELECT model, split, 0 AS section, label, precision, recall, f1, support FROM pc
              UNION ALL SELECT model, split, 1, 'accuracy', acc, acc, acc, n FROM a
              UNION ALL SELECT model, split, 2, 'macro avg', mp, mr, mf, n FROM a
              UNION ALL SELECT model, split, 3, 'weighted avg', wp, wr, wf, n FROM a)
            SELECT model, split, CAST(section AS INTEGER) AS section, label, round(precision, 6) AS precision,
              round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM lines""",
    ),
    "confusion": (confusion, f"{_CM} SELECT * FROM cm"),
    "per_class_metrics": (
        per_class_metrics,
        f"""{_PC} SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
            round(f1, 6) AS f1 FROM pc""",
    ),
    "fbeta_by_class": (
        fbeta_by_class,
        f"""{_PC} SELECT label, round(CASE WHEN precision = 0 AND recall = 0 THEN 0.0
            ELSE 1.25 * precision * recall / (0.25 * precision + recall) END, 6) AS f05 FROM pc""",
    ),
    "summary_metrics": (summary_metrics, f"{_PC} SELECT {_SUMMARY} FROM pc"),
    "rare_metrics": (
        rare_metrics,
        f"""{_PC} SELECT round(avg(precision) FILTER ({_RARE}), 6) AS rare_mean_precision,
            round(avg(recall) FILTER ({_RARE}), 6) AS rare_mean_recall, round(avg(f1) FILTER ({_RARE}), 6) AS rare_mean_f1,
            CAST(coalesce(sum(support) FILTER ({_RARE}), 0) AS BIGINT) AS rare_support_total,
            coalesce(string_agg(label, ',' ORDER BY label) FILTER ({_RARE}), '') AS rare_classes FROM pc""",
    ),
    "classification_report": (
        classification_report,
        f"""{_PC}, a AS (SELECT sum(tp) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS n, avg(precision) AS mp,
              avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) / sum(support) AS wp,
              sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM pc),
            lines AS (SELECT 0 AS section, label, precision, recall, f1, support FROM pc
              UNION ALL SELECT 1, 'accuracy', acc, acc, acc, n FROM a
              UNION ALL SELECT 2, 'macro avg', mp, mr, mf, n FROM a
              UNION ALL SELECT 3, 'weighted avg', wp, wr, wf, n FROM a)
            SELECT CAST(section AS INTEGER) AS section, label, round(precision, 6) AS precision,
              round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM lines""",
    ),
    "evaluation_by_split": (
        evaluation_by_split,
        f"""WITH {SQL_DOCS},{sql_wide(2)}, {_SPLIT_CM[5:]},{sql_per_class('cm', ['split'])},
            e AS (SELECT split, {_SUMMARY}, round(avg(precision) FILTER ({_RARE}), 6) AS rp,
              round(avg(recall) FILTER ({_RARE}), 6) AS rr, round(avg(f1) FILTER ({_RARE}), 6) AS rf,
              string_agg(label, ',' ORDER BY label) FILTER ({_RARE}) AS rc FROM pc GROUP BY split)
            SELECT split, accuracy, macro_precision, macro_f1, weighted_f1,
              CASE WHEN split = 'official test' THEN rp END AS rare_mean_precision,
              CASE WHEN split = 'official test' THEN rr END AS rare_mean_recall,
              CASE WHEN split = 'official test' THEN rf END AS rare_mean_f1,
              coalesce(CASE WHEN split = 'official test' THEN rc END, '') AS rare_classes FROM e""",
    ),
    "one_vs_rest": (
        one_vs_rest,
        f"""WITH {SQL_DOCS} SELECT c AS class, p AS score, count(*) FILTER (truth = c) AS positives, count(*) AS rows
            FROM rk GROUP BY 1, 2""",
    ),
    "average_precision": (
        average_precision,
        f"WITH {SQL_DOCS},{sql_ap()} SELECT class, positives, round(ap, 6) AS average_precision FROM apc",
    ),
    "event_average_precision": (
        event_average_precision,
        f"WITH {SQL_EVENTS},{sql_ap()} SELECT class, positives, round(ap, 6) AS average_precision FROM apc",
    ),
    "macro_auprc": (macro_auprc, f"WITH {SQL_DOCS},{sql_ap()} SELECT round(avg(ap), 6) AS macro_auprc FROM apc"),
    "rare_auprc": (
        rare_auprc,
        f"""WITH {SQL_DOCS},{sql_ap()}
            SELECT round(avg(ap), 6) AS rare_mean_auprc FROM apc WHERE positives BETWEEN 1 AND {DOC_RARE_SUPPORT}""",
    ),
    "evaluate_scored": (
        evaluate_scored_documents,
        f"""{_PC},{sql_ap()}, rare AS (SELECT label FROM pc WHERE {_RARE}),
            s AS (SELECT {_SUMMARY}, round(avg(precision) FILTER ({_RARE}), 6) AS rare_mean_precision,
              round(avg(recall) FILTER ({_RARE}), 6) AS rare_mean_recall, round(avg(f1) FILTER ({_RARE}), 6) AS rare_mean_f1,
              string_agg(label, ',' ORDER BY label) FILTER ({_RARE}) AS rare_classes FROM pc)
            SELECT 'model' AS model, 'OFFICIAL TEST' AS split, s.*,
              (SELECT round(avg(ap), 6) FROM apc WHERE class IN (SELECT label FROM rare)) AS rare_mean_auprc,
              (SELECT round(avg(ap), 6) FROM apc) AS macro_auprc FROM s""",
    ),
    "price_quantiles": (
        price_quantiles,
        f"""WITH v AS (SELECT l_returnflag, l_extendedprice / 110000 AS share FROM lineitem),
            q(i, q) AS (SELECT * FROM {sql_values(['0.0', '0.1', '0.5', '0.9', '0.99', '1.0'])} t(i, q)),
            a AS (SELECT l_returnflag, count(*) AS n, quantile_cont(share, [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]) AS l
                  FROM v GROUP BY 1)
            SELECT l_returnflag, n, CAST(q AS DOUBLE) AS q, round(l[i + 1], 6) AS quantile FROM a CROSS JOIN q""",
    ),
    "selection_score": (
        selection_score,
        f"""{_CAND_SQL} SELECT CAST(row_number() OVER (ORDER BY v - 0.75 * greatest(0, t - v) DESC, tab.candidate_idx) AS INTEGER) AS position,
            tab.* REPLACE (CAST(tab.candidate_idx AS INTEGER) AS candidate_idx) FROM tab JOIN wide USING (candidate)""",
    ),
    "best_candidate": (
        best_candidate,
        f"{_CAND_SQL} SELECT candidate, score FROM tab ORDER BY score DESC, candidate_idx LIMIT 1",
    ),
    "model_summary": (
        model_summary,
        f"""{_STACKED}, w AS (SELECT model, max(CASE WHEN split = 'TRAIN' THEN macro_f1 END) AS t,
              max(CASE WHEN split = 'VAL' THEN macro_f1 END) AS v, max(CASE WHEN split = 'OFFICIAL TEST' THEN macro_f1 END) AS o
              FROM ev GROUP BY 1)
            SELECT CAST(row_number() OVER (ORDER BY model) AS INTEGER) AS position, model, round(t, 6) AS train_macro_f1,
              round(v, 6) AS val_macro_f1, round(o, 6) AS test_macro_f1, round(t - v, 6) AS train_val_gap,
              round(v - o, 6) AS val_test_gap, round(rp, 6) AS rare_precision, round(rr, 6) AS rare_recall,
              round(ra, 6) AS rare_auprc FROM w LEFT JOIN ra USING (model)""",
    ),
    "family_correct_metrics": (
        family_correct_metrics,
        f"{_HIER_RIGHT},{sql_per_class()} SELECT {_SUMMARY} FROM pc",
    ),
}
