"""Threshold learning on scored events. Rare classes: support below the mean (the events are nearly balanced)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import (
    EVENT_BENIGN,
    EVENT_CLASSES,
    SQL_EVENTS,
    positioned,
    rounded,
    scored_events,
    sql_per_class,
    sql_wide,
)
from flowlab.operators import sampling, tuning
from flowlab.operators.small import small_side
from flowlab.operators.support import class_table
from flowlab.plans.experiment import tuning_experiment
from flowlab.plans.scoring import decide_flat
from flowlab.session import fresh_path, materialize
from flowlab.sources.config import load_threshold_config, save_threshold_config

RATIO = 0.40


def event_rare(scored):
    table = class_table(scored, "event_type")
    mean = sum(n for _, n in table) / len(table)
    return [c for c, n in table if n < mean]


def _tops(scored):
    return materialize(tuning.top1(scored, EVENT_CLASSES, truth="event_type"), "tops")


def threshold_candidates(spark, sf):
    scored = scored_events(spark, sf)
    return tuning.threshold_candidates(_tops(scored), event_rare(scored))


def candidate_scores(spark, sf):
    scored = scored_events(spark, sf)
    tops = _tops(scored)
    candidates = small_side(tuning.threshold_candidates(tops, event_rare(scored)))
    scores = tuning.candidate_scores(tops, candidates)
    return rounded(scores, "precision", "recall", "f05", "base_recall")


def rare_label_order(spark, sf):
    scored = scored_events(spark, sf)
    return rounded(positioned(tuning.rare_label_order(_tops(scored), event_rare(scored))), "precision", "recall")


def _tuned(scored, hard_only):
    table = tuning.tune_thresholds(
        scored, EVENT_CLASSES, event_rare(scored), truth="event_type", min_recall_ratio=RATIO, hard_only=hard_only
    )
    return table


def tune_thresholds(spark, sf):
    return rounded(positioned(_tuned(scored_events(spark, sf), False)), "precision", "recall", "f05")


def tune_thresholds_hard(spark, sf):
    return rounded(positioned(_tuned(scored_events(spark, sf), True)), "precision", "recall", "f05")


def _experiment(spark, sf, abstain):
    scored = materialize(scored_events(spark, sf), "scored")
    learn, test = sampling.split_train_val(scored, 0.5, seed=3, key_columns=["event_id"])
    parts = learn.withColumn("split", F.lit("VALIDATION")).unionByName(test.withColumn("split", F.lit("OFFICIAL TEST")))
    return tuning_experiment(
        parts,
        EVENT_CLASSES,
        event_rare(scored),
        label="event_type",
        min_recall_ratio=RATIO,
        abstain_on_rare=abstain,
        write_scored=False,
    )


def tuning_experiment_fallback(spark, sf):
    table = _experiment(spark, sf, False).metrics
    return rounded(table, *[c for c, t in table.dtypes if t == "double"])


def tuning_experiment_abstain(spark, sf):
    table = _experiment(spark, sf, True).metrics
    return rounded(table, *[c for c, t in table.dtypes if t == "double"])


def threshold_config_roundtrip(spark, sf):
    """Thresholds learned, written as JSON with their metrics, read back and served."""
    result = _experiment(spark, sf, False)
    path = fresh_path(spark, "thresholds")
    save_threshold_config(
        spark,
        path,
        result.config,
        result.metrics,
        model_name="frequency table",
        rare_support_threshold=500,
        min_recall_ratio=RATIO,
        tuning_scope="hard",
    )
    served = decide_flat(
        scored_events(spark, sf), EVENT_CLASSES, load_threshold_config(spark, path), benign=EVENT_BENIGN
    )
    return served.groupBy("predicted_class", "threshold_applied").agg(F.count("*").alias("rows"))


BLOCKS = ["validation", "official_test"]


def threshold_metric_blocks(spark, sf):
    """The eight metric blocks of a written threshold file, read back as one row per split."""
    result = _experiment(spark, sf, True)
    path = fresh_path(spark, "thresholds")
    about = dict(model_name="frequency table", rare_support_threshold=500, min_recall_ratio=RATIO, tuning_scope="hard")
    save_threshold_config(spark, path, result.config, result.metrics, **about)
    entry = spark.read.json(path).select("metrics.*")
    rows = [
        F.struct(
            F.lit(name).alias("block"),
            F.col(f"{name}_baseline.macro_f1").alias("baseline_macro_f1"),
            F.col(f"{name}_thresholded.macro_f1").alias("thresholded_macro_f1"),
            F.col(f"{name}_thresholded.rare_mean_recall").alias("thresholded_rare_recall"),
            F.col(f"{name}_changed_fraction").alias("changed_fraction"),
            F.col(f"{name}_abstention.abstain_rate").alias("abstain_rate"),
            F.col(f"{name}_abstention.abstain_on_rare_truth_rate").alias("abstain_on_rare_truth_rate"),
        )
        for name in BLOCKS
    ]
    table = entry.select(F.inline(F.array(*rows)))
    return rounded(table, *[c for c, t in table.dtypes if t == "double"])


_POINTS = "[0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]"


def sql_tuning(source: str) -> str:
    """CTEs ``cn`` (candidates), ``cs`` (their scores) and ``th`` (chosen thresholds) over wide rows ``source``."""
    return f"""
    sup AS (SELECT truth AS label, count(*) AS n FROM w GROUP BY 1),
    rare AS (SELECT label FROM sup WHERE n < (SELECT avg(n) FROM sup)),
    qs AS (SELECT ac AS label, quantile_cont(ap, {_POINTS}) AS l FROM {source} WHERE ac IN (SELECT label FROM rare)
           GROUP BY 1 HAVING count(*) >= 25),
    qv AS (SELECT DISTINCT label, round(v, 4) AS t FROM (SELECT label, unnest(l) AS v FROM qs)),
    qa AS (SELECT label, t FROM qv WHERE t > 0 UNION ALL SELECT label, 0.0 FROM qs),
    cn AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY t) - 1 AS candidate_idx, t AS threshold FROM qa),
    bs AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (ac = truth) AS hits FROM {source} GROUP BY 1),
    ks AS (SELECT cn.label, candidate_idx, threshold, count(s.id) AS kept, count(s.id) FILTER (s.truth = cn.label) AS tp
           FROM cn LEFT JOIN {source} s ON s.c1 = cn.label AND s.p1 >= threshold GROUP BY ALL),
    ps AS (SELECT ks.*, coalesce(tp / nullif(kept, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
                  coalesce(hits / nullif(support, 0), 0.0) AS base_recall FROM ks LEFT JOIN bs USING (label)),
    cs AS (SELECT *, CASE WHEN precision = 0 AND recall = 0 THEN 0.0
                     ELSE 1.25 * precision * recall / (0.25 * precision + recall) END AS f05 FROM ps),
    th AS (SELECT label, threshold, precision, recall, f05 FROM (
             SELECT * FROM cs WHERE recall >= base_recall * {RATIO}
             QUALIFY row_number() OVER (PARTITION BY label ORDER BY precision DESC, f05 DESC, recall DESC, threshold) = 1)
           WHERE threshold > 0)"""


_HARD = """(truth IN (SELECT label FROM hr) OR ac IN (SELECT label FROM hr) OR c2 IN (SELECT label FROM hr)
    OR ap - p2 < 0.20)"""
_HR = """hsup AS (SELECT truth AS label, count(*) AS n FROM w GROUP BY 1),
    hr AS (SELECT label FROM hsup WHERE n < (SELECT avg(n) FROM hsup))"""
_BASE = f"WITH {SQL_EVENTS},{sql_wide(5)},"
_TH = """SELECT CAST(row_number() OVER (ORDER BY threshold DESC, label) AS INTEGER) AS position, label, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05
    FROM th"""

_EXP_BASE = f"""{_BASE} {_HR},
    o AS (SELECT event_id, row_number() OVER (ORDER BY md5(concat_ws('|', '3', event_id))) AS rn, count(*) OVER () AS n
          FROM events),
    sp AS (SELECT event_id AS id, CASE WHEN rn <= floor(n * (1.0 - 0.5)) THEN 'VALIDATION' ELSE 'OFFICIAL TEST' END AS split
           FROM o),
    vw AS (SELECT w.* FROM w JOIN sp USING (id) WHERE split = 'VALIDATION' AND {_HARD}),{sql_tuning('vw')}"""


def _sql_experiment(abstain: bool) -> str:
    ab = "(NOT bool_or(ok) FILTER (rk = 1) AND max(c) FILTER (rk = 1) IN (SELECT label FROM rare))" if abstain else "false"
    return f"""{_EXP_BASE},
    m AS (SELECT rk.*, (th.threshold IS NULL OR rk.p >= th.threshold) AS ok FROM rk LEFT JOIN th ON th.label = rk.c),
    d AS (SELECT id, truth, max(c) FILTER (rk = 1) AS base, max(p) FILTER (rk = 1) AS basep, {ab} AS ab,
                 coalesce(min(rk) FILTER (ok), 1) AS pass FROM m GROUP BY id, truth),
    e AS (SELECT d.*, CASE WHEN ab THEN 1 ELSE pass END AS sel FROM d),
    f AS (SELECT e.*, CASE WHEN ab THEN 'UNCERTAIN_RARE' ELSE rk.c END AS pc, rk.p AS pp
          FROM e JOIN rk ON rk.id = e.id AND rk.rk = e.sel),
    rows2 AS (
      SELECT split, 'baseline' AS variant, truth, base AS pred, basep < 0.5 AS unc, false AS changed, false AS fb
      FROM f JOIN sp USING (id)
      UNION ALL SELECT split, 'thresholded', truth, pc, (pp < 0.5 OR ab OR sel > 1), pc <> base, sel > 1
      FROM f JOIN sp USING (id)),
    cm AS (SELECT split, variant, truth AS y_true, pred AS y_pred, count(*) AS n FROM rows2 GROUP BY ALL),
    {sql_per_class("cm", ["split", "variant"])},
    q AS (SELECT split, variant, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
            round(sum(f1 * support) / sum(support), 6) AS weighted_f1,
            round(avg(precision) FILTER (label IN (SELECT label FROM rare)), 6) AS rare_mean_precision,
            round(avg(recall) FILTER (label IN (SELECT label FROM rare)), 6) AS rare_mean_recall,
            CAST(sum(support) FILTER (label IN (SELECT label FROM rare)) AS BIGINT) AS rare_support_total FROM pc GROUP BY ALL),
    x AS (SELECT split, variant, round(avg(CAST(unc AS INTEGER)), 6) AS uncertain_rate,
            round(avg(CAST(changed AS INTEGER)), 6) AS changed_fraction, round(avg(CAST(fb AS INTEGER)), 6) AS fallback_rate,
            round(avg(CAST(pred = 'UNCERTAIN_RARE' AS INTEGER)), 6) AS abstain_rate,
            round(coalesce(avg(CAST(pred = 'UNCERTAIN_RARE' AS INTEGER))
              FILTER (truth IN (SELECT label FROM rare)), 0), 6) AS abstain_on_rare_truth_rate,
            round(coalesce(avg(CAST(pred = 'UNCERTAIN_RARE' AS INTEGER))
              FILTER (truth NOT IN (SELECT label FROM rare)), 0), 6) AS abstain_on_nonrare_truth_rate
          FROM rows2 GROUP BY ALL)
    SELECT * FROM q JOIN x USING (split, variant)"""

_SERVED = f"""{_EXP_BASE},
    m AS (SELECT rk.*, (th.threshold IS NULL OR rk.p >= th.threshold) AS ok FROM rk LEFT JOIN th ON th.label = rk.c
          WHERE rk <= 3),
    d AS (SELECT id, coalesce(min(rk) FILTER (ok), 1) AS sel, NOT bool_or(ok) FILTER (rk = 1) AS low FROM m GROUP BY id)
    SELECT rk.c AS predicted_class, low AS threshold_applied, count(*) AS rows
    FROM d JOIN rk ON rk.id = d.id AND rk.rk = d.sel GROUP BY 1, 2"""

def _sql_blocks() -> str:
    def of(variant: str, column: str) -> str:
        return f"max({column}) FILTER (variant = '{variant}')"

    return f"""SELECT lower(replace(split, ' ', '_')) AS block, {of('baseline', 'macro_f1')} AS baseline_macro_f1,
        {of('thresholded', 'macro_f1')} AS thresholded_macro_f1, {of('thresholded', 'rare_mean_recall')} AS thresholded_rare_recall,
        {of('thresholded', 'changed_fraction')} AS changed_fraction, {of('thresholded', 'abstain_rate')} AS abstain_rate,
        {of('thresholded', 'abstain_on_rare_truth_rate')} AS abstain_on_rare_truth_rate
        FROM ({_sql_experiment(True)}) GROUP BY 1"""


QUERIES = {
    "threshold_candidates": (
        threshold_candidates,
        f"{_BASE}{sql_tuning('w')} SELECT label, CAST(candidate_idx AS INTEGER) AS candidate_idx, threshold FROM cn",
    ),
    "candidate_scores": (
        candidate_scores,
        f"""{_BASE}{sql_tuning('w')} SELECT label, CAST(candidate_idx AS INTEGER) AS candidate_idx, threshold, kept, tp,
            round(precision, 6) AS precision, round(recall, 6) AS recall, round(f05, 6) AS f05,
            round(base_recall, 6) AS base_recall FROM cs""",
    ),
    "rare_label_order": (
        rare_label_order,
        f"""{_BASE} {_HR}, s AS (SELECT truth AS label, count(*) AS n, count(*) FILTER (ac = truth) AS tp FROM w GROUP BY 1),
            p AS (SELECT ac AS label, count(*) AS k FROM w GROUP BY 1)
            SELECT CAST(row_number() OVER (ORDER BY coalesce(tp / nullif(k, 0), 0), tp / n DESC, label) AS INTEGER) AS position, label,
              round(coalesce(tp / nullif(k, 0), 0), 6) AS precision, round(tp / n, 6) AS recall
            FROM s LEFT JOIN p USING (label) WHERE label IN (SELECT label FROM hr)""",
    ),
    "tune_thresholds": (tune_thresholds, f"{_BASE}{sql_tuning('w')} {_TH}"),
    "tune_thresholds_hard": (
        tune_thresholds_hard,
        f"{_BASE} {_HR}, hw AS (SELECT * FROM w WHERE {_HARD}),{sql_tuning('hw')} {_TH}",
    ),
    "tuning_experiment": (tuning_experiment_fallback, _sql_experiment(False)),
    "tuning_experiment_abstain": (tuning_experiment_abstain, _sql_experiment(True)),
    "threshold_metric_blocks": (threshold_metric_blocks, _sql_blocks()),
    "threshold_config_roundtrip": (threshold_config_roundtrip, _SERVED),
}
