"""Threshold, abstention and hierarchical decisions, and their effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.core import customer_families
from checks.tables import (
    EVENT_BENIGN,
    EVENT_CLASSES,
    EVENT_FAMILIES,
    EVENT_RARE,
    EVENT_THRESHOLDS,
    SQL_EVENT_ROWS,
    SQL_EVENTS,
    attach,
    event_rows,
    load,
    rounded,
    scored_events,
    shares,
    sql_alert,
    sql_in,
    sql_shares,
    sql_wide,
)
from flowlab.functions.decisions import ThresholdConfig, alert_level, hierarchical_decision, is_uncertain, tune_decision
from flowlab.functions.ranking import ranked_classes
from flowlab.operators import metrics, reports, taxonomy
from flowlab.plans.scoring import decide_flat

SERVE = ThresholdConfig(enabled=True, thresholds=EVENT_THRESHOLDS, rare_classes=EVENT_RARE)
ABSTAIN = ThresholdConfig(
    enabled=True, thresholds=EVENT_THRESHOLDS, rare_classes=EVENT_RARE, abstain_on_low_confidence_rare=True
)


def _served(spark, sf, config):
    return decide_flat(scored_events(spark, sf), EVENT_CLASSES, config, benign=EVENT_BENIGN)


def threshold_decision_serve(spark, sf):
    return _served(spark, sf, SERVE)


def abstain_decision(spark, sf):
    return _served(spark, sf, ABSTAIN)


def _tuned(spark, sf, abstain):
    ranked = scored_events(spark, sf).withColumn("r", ranked_classes(F.col("probs"), EVENT_CLASSES)).drop("probs")
    return tune_decision(
        tune_decision(ranked, "r", {}, prefix="base_"),
        "r",
        EVENT_THRESHOLDS,
        rare_labels=EVENT_RARE,
        abstain_on_rare=abstain,
    ).drop("r")


TUNED = ["event_id", "event_type", "predicted_class", "confidence", "selected_rank", "uncertain"]


def threshold_decision_tune(spark, sf):
    return _tuned(spark, sf, False).select(*TUNED)


def abstain_decision_tune(spark, sf):
    return _tuned(spark, sf, True).select(*TUNED)


def alert_level_by_value(spark, sf):
    """Alert level and uncertainty of every event, its type as the class and a scaled value as confidence."""
    confidence = F.least(F.col("value") / 100, F.lit(1.0))
    return load(spark, sf, "events").select(
        "event_id",
        alert_level(F.col("event_type"), confidence, EVENT_BENIGN).alias("alert_level"),
        is_uncertain(confidence).alias("uncertain"),
    )


def abstention_stats(spark, sf):
    stats = reports.abstention_stats(_tuned(spark, sf, True), EVENT_RARE, truth="event_type")
    return rounded(stats, *stats.columns)


def decision_effects(spark, sf):
    effects = reports.decision_effects(_tuned(spark, sf, False))
    return rounded(effects, *effects.columns)


def two_level_events(spark, sf):
    """Events scored for their family, and for their type inside each family."""
    rows = event_rows(spark, sf)
    families = list(EVENT_FAMILIES)
    counted = rows.groupBy("bucket").agg(
        *[F.count_if(F.col("event_type") == c).alias(f"_n_{c}") for c in EVENT_CLASSES]
    )
    sums = [sum([F.col(f"_n_{c}") for c in EVENT_FAMILIES[f][1:]], F.col(f"_n_{EVENT_FAMILIES[f][0]}")) for f in families]
    several = {f: names for f, names in EVENT_FAMILIES.items() if len(names) > 1}
    table = counted.select(
        "bucket",
        shares(sums).alias("family_probs"),
        *[shares([F.col(f"_n_{c}") for c in names]).alias(f"probs_{f}") for f, names in several.items()],
    )
    return attach(rows, table).drop("bucket"), families, several


def hierarchical_predictions(spark, sf, top_k=2):
    scored, families, several = two_level_events(spark, sf)
    return hierarchical_decision(
        scored,
        "family_probs",
        families,
        {f: (f"probs_{f}", names) for f, names in several.items()},
        {f: names[0] for f, names in EVENT_FAMILIES.items() if len(names) == 1},
        top_k=top_k,
        benign=EVENT_BENIGN,
    )


def hierarchical_decision_events(spark, sf):
    return hierarchical_predictions(spark, sf)


def hierarchical_top1(spark, sf):
    columns = ["event_id", "predicted_family", "predicted_class", "confidence"]
    return hierarchical_predictions(spark, sf, 1).select(*columns)


def mean_confidence(spark, sf):
    means = reports.mean_confidence(hierarchical_predictions(spark, sf))
    return rounded(means, *means.columns)


def _with_true_family(spark, sf):
    predicted = hierarchical_predictions(spark, sf)
    return taxonomy.with_family(
        predicted,
        taxonomy.taxonomy_table(spark, {c: f for f, names in EVENT_FAMILIES.items() for c in names}),
        label="event_type",
    )


def family_correct_metrics(spark, sf):
    """Metrics over the rows whose family was right."""
    right = taxonomy.family_correct(_with_true_family(spark, sf))
    counts = metrics.confusion(right, "event_type", "predicted_class")
    summary = metrics.summary_metrics(metrics.per_class(counts))
    return rounded(summary, *summary.columns)


def family_slice(spark, sf):
    rows = taxonomy.family_slice(customer_families(spark, sf), "ASIA")
    return rows.select("c_custkey", "label", "family")


def hierarchical_decision_customer(spark, sf):
    """25 nations in 5 regions, scored by market segment and balance step."""
    step = F.least(F.floor((F.col("c_acctbal") + 1000) / 1000), F.lit(11)).cast("int")
    rows = customer_families(spark, sf).withColumn("bucket", F.concat_ws("-", "c_mktsegment", step.cast("string")))
    pairs = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = {}
    for r in sorted((r["r_name"], r["n_name"]) for r in pairs.select("r_name", "n_name").collect()):  # 25 rows
        regions.setdefault(r[0], []).append(r[1])
    names = [n for members in regions.values() for n in members]
    counted = rows.groupBy("bucket").agg(*[F.count_if(F.col("label") == n).alias(f"_n_{n}") for n in names])
    total = {f: sum([F.col(f"`_n_{n}`") for n in m[1:]], F.col(f"`_n_{m[0]}`")) for f, m in regions.items()}
    columns = {f: f"probs_{i}" for i, f in enumerate(regions)}
    table = counted.select(
        "bucket",
        shares(list(total.values())).alias("family_probs"),
        *[shares([F.col(f"`_n_{n}`") for n in m]).alias(columns[f]) for f, m in regions.items()],
    )
    decided = hierarchical_decision(
        attach(rows.select("c_custkey", "bucket"), table).drop("bucket"),
        "family_probs",
        list(regions),
        {f: (columns[f], m) for f, m in regions.items()},
        {},
        top_k=2,
    )
    return decided.select(
        "c_custkey", "predicted_family", "predicted_class", "confidence", "top_2_class", "top_2_prob", "alert_level"
    )


def _thr(c):
    return "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in EVENT_THRESHOLDS.items()) + " END"


_RARE = sql_in(EVENT_RARE)
_OK = {i: f"(({_thr(f'c{i}')}) IS NULL OR p{i} >= ({_thr(f'c{i}')}))" for i in range(1, 6)}
_LOW = f"coalesce(p1 < ({_thr('c1')}), false)"


def sql_serve(abstain: bool) -> str:
    """CTE ``sv``: the serving rule over three ranks."""
    ab = f"(low AND c1 IN {_RARE})" if abstain else "false"
    return f"""
    l AS (SELECT *, {_LOW} AS low FROM w), a AS (SELECT *, {ab} AS ab FROM l),
    s AS (SELECT *, CASE WHEN low AND NOT ab THEN CASE WHEN {_OK[2]} THEN 2 WHEN {_OK[3]} THEN 3 ELSE 1 END
                    ELSE 1 END AS sel FROM a),
    t AS (SELECT *, CASE WHEN ab THEN 'UNCERTAIN_RARE' WHEN sel = 1 THEN c1 WHEN sel = 2 THEN c2 ELSE c3 END AS pc,
                 CASE sel WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS pp FROM s),
    sv AS (SELECT id AS event_id, truth AS event_type, pc AS predicted_class, pp AS confidence,
             CASE WHEN ab THEN 'REVIEW' ELSE {sql_alert('pc', 'pp', EVENT_BENIGN)} END AS alert_level,
             (pp < 0.5 OR low) AS uncertain, low AS threshold_applied,
             CASE WHEN low AND NOT ab THEN c1 END AS fallback_from_class, ab AS abstained,
             CASE WHEN ab THEN c1 END AS abstain_from_class, CAST(sel AS INTEGER) AS selected_rank,
             c1 AS top_1_class, p1 AS top_1_prob, c2 AS top_2_class, p2 AS top_2_prob, c3 AS top_3_class, p3 AS top_3_prob
           FROM t)"""


def sql_tune(abstain: bool, source: str = "w") -> str:
    """CTE ``tn``: the tuning rule over all five ranks, with the baseline decision beside it."""
    ab = f"(low AND c1 IN {_RARE})" if abstain else "false"
    search = " ".join(f"WHEN {_OK[i]} THEN {i}" for i in range(1, 6))
    pick_c = "CASE sel " + " ".join(f"WHEN {i} THEN c{i}" for i in range(1, 6)) + " END"
    pick_p = "CASE sel " + " ".join(f"WHEN {i} THEN p{i}" for i in range(1, 6)) + " END"
    return f"""
    tl AS (SELECT *, {_LOW} AS low FROM {source}), ta AS (SELECT *, {ab} AS ab FROM tl),
    ts AS (SELECT *, CASE WHEN ab THEN 1 ELSE CASE {search} ELSE 1 END END AS sel FROM ta),
    tn AS (SELECT *, CASE WHEN ab THEN 'UNCERTAIN_RARE' ELSE {pick_c} END AS pc, {pick_p} AS pp,
                  ({pick_p} < 0.5 OR ab OR sel > 1) AS unc, p1 < 0.5 AS base_unc FROM ts)"""


_W = f"WITH {SQL_EVENTS},{sql_wide(5)},"
_TUNED_COLS = """id AS event_id, truth AS event_type, pc AS predicted_class, pp AS confidence,
    CAST(sel AS INTEGER) AS selected_rank, unc AS uncertain"""

_FAM = "CASE WHEN event_type IN ('click', 'view') THEN 'Browse' WHEN event_type = 'error' THEN 'Fault' ELSE 'Convert' END"


def sql_hier(k: int) -> str:
    """CTE ``h``: events with the winning family, its subtype ranking and the product score."""
    return f"""WITH {SQL_EVENT_ROWS},
    ef AS (SELECT *, {_FAM} AS family FROM ev),
    eb AS (SELECT * FROM ef), {sql_shares('ef', 'bucket', 'family', list(EVENT_FAMILIES), 'f')},
    brow AS (SELECT bucket, CASE WHEN family = 'Browse' THEN event_type END AS event_type FROM ef),
    conv AS (SELECT bucket, CASE WHEN family = 'Convert' THEN event_type END AS event_type FROM ef),
    {sql_shares('brow', 'bucket', 'event_type', EVENT_FAMILIES['Browse'], 'b')},
    {sql_shares('conv', 'bucket', 'event_type', EVENT_FAMILIES['Convert'], 'c')},
    sub AS (SELECT 'Browse' AS family, bucket, idx, c, p FROM bshare
            UNION ALL SELECT 'Convert', bucket, idx, c, p FROM cshare
            UNION ALL SELECT 'Fault', bucket, 0, 'error', 1.0::DOUBLE FROM (SELECT DISTINCT bucket FROM ev)),
    sr AS (SELECT *, row_number() OVER (PARTITION BY family, bucket ORDER BY p DESC, idx DESC) AS rk FROM sub),
    sw AS (SELECT family, bucket, max(CASE WHEN rk = 1 THEN c END) AS c1, max(CASE WHEN rk = 1 THEN p END) AS p1,
                  max(CASE WHEN rk = 2 THEN c END) AS c2, max(CASE WHEN rk = 2 THEN p END) AS p2 FROM sr GROUP BY ALL),
    fr AS (SELECT bucket, c AS family, p AS fp, row_number() OVER (PARTITION BY bucket ORDER BY p DESC, idx DESC) AS fk
           FROM fshare),
    cand AS (SELECT fr.bucket, fr.family, fp, fk, c1, p1, coalesce(c2, c1) AS c2, coalesce(p2, 0.0) AS p2, fp * p1 AS score
             FROM fr JOIN sw USING (family, bucket) WHERE fk <= {k}),
    best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY score DESC, fk) = 1),
    h AS (SELECT ef.event_id, ef.event_type, ef.family AS true_family, best.* FROM ef JOIN best USING (bucket))"""


_HIER_RIGHT = f"""{sql_hier(2)}, cm AS (SELECT event_type AS y_true, c1 AS y_pred, count(*) AS n FROM h
    WHERE family = true_family GROUP BY 1, 2)"""


def _sql_customer() -> str:
    return f"""
    WITH cr AS (SELECT c_custkey, n_name AS label, r_name AS family,
            c_mktsegment || '-' || CAST(CAST(least(floor((c_acctbal + 1000) / 1000), 11) AS INTEGER) AS VARCHAR) AS bucket
          FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    dim AS (SELECT r_name AS family, n_name AS c, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS idx,
                   dense_rank() OVER (ORDER BY r_name) - 1 AS fidx
            FROM nation JOIN region ON n_regionkey = r_regionkey),
    bk AS (SELECT DISTINCT bucket FROM cr),
    fc AS (SELECT bk.bucket, d.family, d.fidx, CAST(count(cr.c_custkey) AS DOUBLE) AS n
           FROM bk CROSS JOIN (SELECT DISTINCT family, fidx FROM dim) d
           LEFT JOIN cr ON cr.bucket = bk.bucket AND cr.family = d.family GROUP BY ALL),
    fw AS (SELECT *, (n*n)*(n*n)*(n*n)*(n*n) AS v FROM fc),
    fs AS (SELECT bucket, family, fidx, round(v / sum(v) OVER (PARTITION BY bucket), 6) AS fp FROM fw),
    fr AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY fp DESC, fidx DESC) AS fk FROM fs),
    sc AS (SELECT bk.bucket, d.family, d.idx, d.c, CAST(count(cr.c_custkey) AS DOUBLE) AS n FROM bk CROSS JOIN dim d
           LEFT JOIN cr ON cr.bucket = bk.bucket AND cr.label = d.c GROUP BY ALL),
    sw AS (SELECT *, (n*n)*(n*n)*(n*n)*(n*n) AS v FROM sc),
    ss AS (SELECT *, coalesce(round(v / nullif(sum(v) OVER (PARTITION BY bucket, family), 0), 6), 0.0) AS p FROM sw),
    sr AS (SELECT *, row_number() OVER (PARTITION BY bucket, family ORDER BY p DESC, idx DESC) AS rk FROM ss),
    top AS (SELECT bucket, family, max(CASE WHEN rk = 1 THEN c END) AS c1, max(CASE WHEN rk = 1 THEN p END) AS p1,
                   max(CASE WHEN rk = 2 THEN c END) AS c2, max(CASE WHEN rk = 2 THEN p END) AS p2 FROM sr GROUP BY ALL),
    best AS (SELECT *, fp * p1 AS score FROM fr JOIN top USING (bucket, family) WHERE fk <= 2
             QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY fp * p1 DESC, fk) = 1)
    SELECT c_custkey, best.family AS predicted_family, c1 AS predicted_class, score AS confidence, c2 AS top_2_class,
           p2 AS top_2_prob, {sql_alert('c1', 'score', 'BenignTraffic')} AS alert_level
    FROM cr JOIN best USING (bucket)"""


QUERIES = {
    "threshold_decision_serve": (threshold_decision_serve, f"{_W}{sql_serve(False)} SELECT * FROM sv"),
    "abstain_decision": (abstain_decision, f"{_W}{sql_serve(True)} SELECT * FROM sv"),
    "threshold_decision_tune": (threshold_decision_tune, f"{_W}{sql_tune(False)} SELECT {_TUNED_COLS} FROM tn"),
    "abstain_decision_tune": (abstain_decision_tune, f"{_W}{sql_tune(True)} SELECT {_TUNED_COLS} FROM tn"),
    "alert_level_by_value": (
        alert_level_by_value,
        f"""WITH e AS (SELECT event_id, event_type, least(value / 100, 1.0) AS v FROM events)
            SELECT event_id, {sql_alert('event_type', 'v', EVENT_BENIGN)} AS alert_level, v < 0.5 AS uncertain FROM e""",
    ),
    "abstention_stats": (
        abstention_stats,
        f"""{_W}{sql_tune(True)} SELECT round(avg(CAST(ab AS INTEGER)), 6) AS abstain_rate,
            round(coalesce(avg(CAST(ab AS INTEGER)) FILTER (truth IN {_RARE}), 0), 6) AS abstain_on_rare_truth_rate,
            round(coalesce(avg(CAST(ab AS INTEGER)) FILTER (truth NOT IN {_RARE}), 0), 6)
              AS abstain_on_nonrare_truth_rate FROM tn""",
    ),
    "decision_effects": (
        decision_effects,
        f"""{_W}{sql_tune(False)} SELECT round(avg(CAST(pc <> c1 AS INTEGER)), 6) AS changed_fraction,
            round(avg(CAST(unc AS INTEGER)), 6) AS uncertain_rate,
            round(avg(CAST(sel > 1 AS INTEGER)), 6) AS fallback_rate FROM tn""",
    ),
    "hierarchical_decision": (
        hierarchical_decision_events,
        f"""{sql_hier(2)} SELECT event_id, event_type, family AS predicted_family, fp AS family_confidence,
            c1 AS predicted_class, p1 AS subtype_confidence, score AS confidence,
            {sql_alert('c1', 'score', EVENT_BENIGN)} AS alert_level, score < 0.5 AS uncertain, false AS threshold_applied,
            CAST(NULL AS VARCHAR) AS fallback_from_class, false AS abstained, CAST(NULL AS VARCHAR) AS abstain_from_class,
            CAST(1 AS INTEGER) AS selected_rank, c1 AS top_1_class, p1 AS top_1_prob, c2 AS top_2_class,
            CAST(p2 AS DOUBLE) AS top_2_prob, c1 AS top_3_class, CAST(0 AS DOUBLE) AS top_3_prob FROM h""",
    ),
    "hierarchical_top1": (
        hierarchical_top1,
        f"""{sql_hier(1)} SELECT event_id, family AS predicted_family, c1 AS predicted_class, score AS confidence FROM h""",
    ),
    "hierarchical_decision_customer": (hierarchical_decision_customer, _sql_customer()),
    "mean_confidence": (
        mean_confidence,
        f"""{sql_hier(2)} SELECT round(avg(fp), 6) AS family_confidence_mean,
            round(avg(p1), 6) AS subtype_confidence_mean FROM h""",
    ),
    "family_slice": (
        family_slice,
        """SELECT c_custkey, n_name AS label, r_name AS family FROM customer JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
    ),
}
