"""Projection, support, taxonomy, sampling, splitting, hygiene and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.tables import (
    DOC_RARE_SUPPORT,
    EVENT_BENIGN,
    EVENT_CLASSES,
    EVENT_RARE,
    SQL_DOC_ROWS,
    SQL_EVENTS,
    document_rows,
    load,
    rounded,
    scored_events,
    sql_alert,
    sql_in,
    sql_wide,
)
from flowlab.functions.ranking import (
    argmax_class,
    class_probability,
    margin,
    pad_ranks,
    ranked_classes,
    top_columns,
)
from flowlab.functions.decisions import ThresholdConfig
from flowlab.operators import hygiene, reports, sampling, support, taxonomy, tuning
from flowlab.operators.small import small_side
from flowlab.plans.scoring import decide_flat
from flowlab.schema import conform, labelled

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
OVERLAP = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def predictions(spark, sf):
    return decide_flat(scored_events(spark, sf), EVENT_CLASSES, ThresholdConfig(), benign=EVENT_BENIGN)


SQL_PRED = f"""WITH {SQL_EVENTS},{sql_wide(5)},
    pr AS (SELECT id AS event_id, truth AS event_type, c1 AS predicted_class, p1 AS confidence,
                  {sql_alert('c1', 'p1', EVENT_BENIGN)} AS alert_level, p1 < 0.5 AS uncertain,
                  c1, p1, c2, p2, c3, p3 FROM w)"""


def alert_distribution(spark, sf):
    return reports.alert_distribution(predictions(spark, sf))


def alert_tiles(spark, sf):
    return rounded(reports.alert_tiles(predictions(spark, sf)), "avg_confidence")


def top_attack_types(spark, sf):
    return reports.top_attack_types(predictions(spark, sf))


def first_rows(spark, sf):
    columns = ["event_id", "predicted_class", "confidence", "alert_level", "uncertain"]
    return reports.first_rows(predictions(spark, sf).select(*columns), "event_id")


def flat_predictions(spark, sf):
    return predictions(spark, sf)


def conform_project(spark, sf):
    table = labelled(load(spark, sf, "lineitem"), "l_returnflag")
    return conform(table, LINE_NUMBERS, label="l_returnflag", carry=LINE_KEY, dtype="float")


def class_support(spark, sf):
    return support.class_support(document_rows(spark, sf))


def rare_labels(spark, sf):
    return support.rare_labels(support.class_support(document_rows(spark, sf)), DOC_RARE_SUPPORT)


def class_weights(spark, sf):
    return rounded(support.class_weights(document_rows(spark, sf)), "weight")


def weighted_rows(spark, sf):
    rows = document_rows(spark, sf).select("doc_id", "label")
    weighted = support.attach_weights(rows, support.class_weights(rows))
    return rounded(weighted.select("doc_id", "label", "weight"), "weight")


def label_count(spark, sf):
    return support.label_count(load(spark, sf, "lineitem"), "l_returnflag")


def nation_taxonomy(spark, sf):
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(
        F.col("n_nationkey").cast("int").alias("position"), F.col("n_name").alias("label"), F.col("r_name").alias("family")
    )


def customers(spark, sf):
    """Customers with their nation as label."""
    nation = load(spark, sf, "nation").select("n_nationkey", "n_name")
    return load(spark, sf, "customer").join(small_side(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_name").alias("label"), "c_mktsegment", "c_acctbal"
    )


def customer_families(spark, sf):
    return taxonomy.with_family(customers(spark, sf), nation_taxonomy(spark, sf))


def label_to_family(spark, sf):
    return customer_families(spark, sf).select("c_custkey", "label", "family")


def families_in_order(spark, sf):
    table = taxonomy.families_in_order(nation_taxonomy(spark, sf))
    return table.withColumn("labels", F.concat_ws(",", "labels"))


def labels_for_family(spark, sf):
    return taxonomy.labels_for_family(nation_taxonomy(spark, sf), "ASIA")


def family_pool_counts(spark, sf):
    return support.family_pool_counts(customer_families(spark, sf))


def balanced_sample(spark, sf):
    rows = load(spark, sf, "lineitem").select(*LINE_KEY, *LINE_NUMBERS, "l_returnflag")
    return sampling.balanced_sample(rows, label="l_returnflag", max_per_label=5_000, seed=42, key_columns=LINE_KEY)


def family_capped_sample(spark, sf):
    rows = customer_families(spark, sf).select("c_custkey", "label", "family")
    return sampling.family_capped_sample(rows, max_per_family=200, seed=1, key_columns=["c_custkey"])


def train_val_split(spark, sf):
    rows = load(spark, sf, "events").select("event_id", "event_type")
    return sampling.with_split(rows, 0.15, seed=42, key_columns=["event_id"])


def three_way_split(spark, sf):
    """Three splits from one search for two ranks."""
    rows = load(spark, sf, "events").select("event_id", "event_type")
    return sampling.with_splits(rows, {"TRAIN": 0.7, "VAL": 0.1, "OFFICIAL TEST": 0.2}, seed=11, key_columns=["event_id"])


def label_permutation(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return sampling.permute_labels(
        rows, label="o_orderpriority", seed=7, key_columns=["o_orderkey"], column="shuffled_priority"
    )


def _line_sides(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", "l_discount", "l_tax", "l_linestatus")
    return lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'")


def overlap_report(spark, sf):
    report = hygiene.overlap_report(*_line_sides(spark, sf), OVERLAP)
    return rounded(report, "overlap_share_a", "overlap_share_b")


def exclude_overlap(spark, sf):
    return hygiene.exclude_overlap(*_line_sides(spark, sf), OVERLAP)


def overlap_audit(spark, sf):
    return hygiene.overlap_audit(*_line_sides(spark, sf), OVERLAP)


def shared_rows(spark, sf):
    rows = hygiene.shared_rows(*_line_sides(spark, sf), OVERLAP)
    return rows.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(OVERLAP)])


def _text_sides(spark, sf):
    """Documents with a label against those without."""
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    marked = load(spark, sf, "labels").select("doc_id").distinct()
    return docs.join(marked, "doc_id", "left_semi"), docs.join(marked, "doc_id", "left_anti")


def exclude_text_overlap(spark, sf):
    pool, reference = _text_sides(spark, sf)
    return hygiene.exclude_overlap(pool, reference, ["text"], numeric=False).select("doc_id", "lang")


def text_overlap_report(spark, sf):
    report = hygiene.overlap_report(*_text_sides(spark, sf), ["text"], numeric=False)
    return rounded(report, "overlap_share_a", "overlap_share_b")


def top3_classes(spark, sf):
    ranked = ranked_classes(F.col("probs"), EVENT_CLASSES, 3)
    return scored_events(spark, sf).select("event_id", ranked.alias("r")).select("event_id", *top_columns(F.col("r")))


def rank_details(spark, sf):
    scored = scored_events(spark, sf)
    ranked = scored.withColumn("r", ranked_classes(F.col("probs"), EVENT_CLASSES))
    padded = pad_ranks(F.slice("r", 1, 2))
    return rounded(
        ranked.select(
            "event_id",
            argmax_class(F.col("probs"), EVENT_CLASSES).alias("argmax_class"),
            F.col("r")[0]["class_name"].alias("rank1_class"),
            F.col("r")[1]["class_name"].alias("rank2_class"),
            padded[2]["class_name"].alias("padded_class"),
            padded[2]["probability"].alias("padded_prob"),
            margin(F.col("r")).alias("margin"),
            class_probability(F.col("probs"), EVENT_CLASSES, "error").alias("p_error"),
        ),
        "margin",
    )


def hard_cases(spark, sf):
    hard = tuning.is_hard(F.col("probs"), EVENT_CLASSES, F.col("event_type"), EVENT_RARE)
    return scored_events(spark, sf).select("event_id", hard.alias("is_hard"))


def hard_share(spark, sf):
    return rounded(reports.hard_share(hard_cases(spark, sf)), "hard_share")


_BY_KEY = "md5(concat_ws('|', '{seed}', {keys}))"
_LINES_KEY = _BY_KEY.format(seed=42, keys=", ".join(LINE_KEY))
_SIDES = """WITH a AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'),
    da AS (SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_tax FROM a),
    db AS (SELECT DISTINCT l_linenumber, l_quantity, l_discount, l_tax FROM b),
    inter AS (SELECT * FROM da INTERSECT SELECT * FROM db)"""
_TEXTS = """WITH m AS (SELECT DISTINCT doc_id FROM labels),
    a AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM m)),
    b AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m))"""
_CUSTOMERS = """WITH cf AS (SELECT c_custkey, n_name AS label, r_name AS family, c_mktsegment, c_acctbal
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_RARE = sql_in(EVENT_RARE)
_HARD = f"""(truth IN {_RARE} OR ac IN {_RARE} OR c2 IN {_RARE} OR ap - p2 < 0.20)"""

QUERIES = {
    "alert_distribution": (
        alert_distribution,
        f"{SQL_PRED} SELECT alert_level, count(*) AS rows FROM pr GROUP BY 1",
    ),
    "alert_tiles": (
        alert_tiles,
        f"""{SQL_PRED} SELECT count(*) AS total_rows, count(*) FILTER (alert_level = 'HIGH_ALERT') AS high_alerts,
            count(*) FILTER (uncertain) AS uncertain_rows, round(avg(confidence), 6) AS avg_confidence FROM pr""",
    ),
    "top_attack_types": (
        top_attack_types,
        f"""{SQL_PRED} SELECT predicted_class, count(*) AS rows FROM pr GROUP BY 1
            ORDER BY rows DESC, predicted_class LIMIT 10""",
    ),
    "first_rows": (
        first_rows,
        f"""{SQL_PRED} SELECT event_id, predicted_class, confidence, alert_level, uncertain FROM pr
            ORDER BY event_id LIMIT 20""",
    ),
    "flat_predictions": (
        flat_predictions,
        f"""{SQL_PRED} SELECT event_id, event_type, predicted_class, confidence, alert_level, uncertain,
            false AS threshold_applied, CAST(NULL AS VARCHAR) AS fallback_from_class, false AS abstained,
            CAST(NULL AS VARCHAR) AS abstain_from_class, CAST(1 AS INTEGER) AS selected_rank,
            c1 AS top_1_class, p1 AS top_1_prob, c2 AS top_2_class, p2 AS top_2_prob, c3 AS top_3_class, p3 AS top_3_prob
            FROM pr""",
    ),
    "conform_project": (
        conform_project,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS FLOAT) AS l_quantity,
           CAST(l_extendedprice AS FLOAT) AS l_extendedprice, CAST(l_discount AS FLOAT) AS l_discount,
           CAST(l_tax AS FLOAT) AS l_tax, l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL""",
    ),
    "class_support": (class_support, f"WITH {SQL_DOC_ROWS} SELECT label, count(*) AS support FROM dr GROUP BY 1"),
    "rare_labels": (
        rare_labels,
        f"WITH {SQL_DOC_ROWS} SELECT label, count(*) AS support FROM dr GROUP BY 1 HAVING count(*) <= {DOC_RARE_SUPPORT}",
    ),
    "class_weights": (
        class_weights,
        f"""WITH {SQL_DOC_ROWS}, s AS (SELECT label, count(*) AS support FROM dr GROUP BY 1)
            SELECT label, support, round((SELECT sum(support) FROM s) / ((SELECT count(*) FROM s) * support), 6) AS weight
            FROM s""",
    ),
    "weighted_rows": (
        weighted_rows,
        f"""WITH {SQL_DOC_ROWS}, s AS (SELECT label, count(*) AS support FROM dr GROUP BY 1)
            SELECT doc_id, label,
              round((SELECT sum(support) FROM s) / ((SELECT count(*) FROM s) * support), 6) AS weight
            FROM dr JOIN s USING (label)""",
    ),
    "label_count": (
        label_count,
        """SELECT count(DISTINCT l_returnflag) AS labels, count(*) AS rows FROM lineitem
           WHERE l_returnflag IS NOT NULL""",
    ),
    "label_to_family": (label_to_family, f"{_CUSTOMERS} SELECT c_custkey, label, family FROM cf"),
    "families_in_order": (
        families_in_order,
        """SELECT r_name AS family, CAST(min(n_nationkey) AS INTEGER) AS first_position, count(*) AS label_count,
           string_agg(n_name, ',' ORDER BY n_name) AS labels
           FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    ),
    "labels_for_family": (
        labels_for_family,
        """SELECT CAST(n_nationkey AS INTEGER) AS position, n_name AS label FROM nation JOIN region
           ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""",
    ),
    "family_pool_counts": (
        family_pool_counts, f"{_CUSTOMERS} SELECT family, count(*) AS rows FROM cf GROUP BY 1"
    ),
    "balanced_sample": (
        balanced_sample,
        f"""SELECT {', '.join(LINE_KEY)}, {', '.join(LINE_NUMBERS)}, l_returnflag FROM lineitem
            WHERE l_returnflag IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {_LINES_KEY}) <= 5000""",
    ),
    "family_capped_sample": (
        family_capped_sample,
        f"""{_CUSTOMERS} SELECT c_custkey, label, family FROM cf QUALIFY row_number() OVER (
            PARTITION BY family ORDER BY {_BY_KEY.format(seed=1, keys='c_custkey')}) <= 200""",
    ),
    "train_val_split": (
        train_val_split,
        f"""WITH r AS (SELECT event_id, event_type,
              row_number() OVER (ORDER BY {_BY_KEY.format(seed=42, keys='event_id')}) AS rn, count(*) OVER () AS n
              FROM events)
            SELECT event_id, event_type, CASE WHEN rn <= floor(n * (1.0 - 0.15)) THEN 'TRAIN' ELSE 'VAL' END AS split
            FROM r""",
    ),
    "three_way_split": (
        three_way_split,
        f"""WITH r AS (SELECT event_id, event_type,
              row_number() OVER (ORDER BY {_BY_KEY.format(seed=11, keys='event_id')}) AS rn, count(*) OVER () AS n
              FROM events)
            SELECT event_id, event_type, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'TRAIN'
              WHEN rn <= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'VAL' ELSE 'OFFICIAL TEST' END AS split FROM r""",
    ),
    "label_permutation": (
        label_permutation,
        f"""WITH r AS (SELECT o_orderkey, o_orderpriority,
              row_number() OVER (ORDER BY {_BY_KEY.format(seed=7, keys='o_orderkey')}) AS rn FROM orders),
            s AS (SELECT o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1),
            c AS (SELECT name, sum(n) OVER (ORDER BY name) AS upto, sum(n) OVER (ORDER BY name) - n AS frm FROM s)
            SELECT o_orderkey, o_orderpriority, name AS shuffled_priority FROM r JOIN c ON rn > frm AND rn <= upto""",
    ),
    "overlap_report": (
        overlap_report,
        f"""{_SIDES}, x AS (SELECT (SELECT count(*) FROM da) AS unique_a, (SELECT count(*) FROM db) AS unique_b,
              (SELECT count(*) FROM inter) AS overlap)
            SELECT *, round(overlap / unique_a, 6) AS overlap_share_a, round(overlap / unique_b, 6) AS overlap_share_b
            FROM x""",
    ),
    "exclude_overlap": (
        exclude_overlap,
        f"""{_SIDES} SELECT {', '.join(LINE_KEY)}, l_quantity, l_discount, l_tax, l_linestatus FROM a
            WHERE NOT EXISTS (SELECT 1 FROM db WHERE db.l_linenumber = a.l_linenumber AND db.l_quantity = a.l_quantity
              AND db.l_discount = a.l_discount AND db.l_tax = a.l_tax)""",
    ),
    "overlap_audit": (
        overlap_audit,
        f"""{_SIDES}, k AS (SELECT count(*) AS kept FROM a WHERE NOT EXISTS (
              SELECT 1 FROM db WHERE db.l_linenumber = a.l_linenumber AND db.l_quantity = a.l_quantity
              AND db.l_discount = a.l_discount AND db.l_tax = a.l_tax)), t AS (SELECT count(*) AS n FROM a)
            SELECT n AS rows_before, n - kept AS rows_removed, kept AS rows_kept FROM k CROSS JOIN t""",
    ),
    "shared_rows": (
        shared_rows,
        f"{_SIDES} SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity, l_discount, l_tax FROM inter",
    ),
    "exclude_text_overlap": (
        exclude_text_overlap,
        f"{_TEXTS} SELECT doc_id, lang FROM a WHERE text NOT IN (SELECT text FROM b WHERE text IS NOT NULL)",
    ),
    "text_overlap_report": (
        text_overlap_report,
        f"""{_TEXTS}, x AS (SELECT (SELECT count(DISTINCT text) FROM a) AS unique_a,
              (SELECT count(DISTINCT text) FROM b) AS unique_b,
              (SELECT count(*) FROM (SELECT text FROM a INTERSECT SELECT text FROM b)) AS overlap)
            SELECT *, round(overlap / unique_a, 6) AS overlap_share_a, round(overlap / unique_b, 6) AS overlap_share_b
            FROM x""",
    ),
    "top3_classes": (
        top3_classes,
        f"""{SQL_PRED} SELECT event_id, c1 AS top_1_class, p1 AS top_1_prob, c2 AS top_2_class, p2 AS top_2_prob,
            c3 AS top_3_class, p3 AS top_3_prob FROM pr""",
    ),
    "rank_details": (
        rank_details,
        f"""WITH {SQL_EVENTS},{sql_wide(5)}, e AS (SELECT id, p AS p_error FROM rk WHERE c = 'error')
            SELECT id AS event_id, ac AS argmax_class, c1 AS rank1_class, c2 AS rank2_class, c1 AS padded_class,
            CAST(0 AS DOUBLE) AS padded_prob, round(p1 - p2, 6) AS margin, p_error FROM w JOIN e USING (id)""",
    ),
    "hard_cases": (hard_cases, f"WITH {SQL_EVENTS},{sql_wide(5)} SELECT id AS event_id, {_HARD} AS is_hard FROM w"),
    "hard_share": (
        hard_share,
        f"""WITH {SQL_EVENTS},{sql_wide(5)}, h AS (SELECT {_HARD} AS is_hard FROM w)
            SELECT count(*) AS rows, count(*) FILTER (is_hard) AS hard_rows,
            round(avg(CAST(is_hard AS INTEGER)), 6) AS hard_share FROM h""",
    ),
}
