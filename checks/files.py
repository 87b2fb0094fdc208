"""CSV sources and sinks and file streams. Files are derived from the given tables below the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.core import SQL_PRED
from checks.learning import flows
from checks.tables import (
    EVENT_BENIGN,
    EVENT_CLASSES,
    attach,
    event_bucket,
    event_rows,
    frequency_table,
    load,
    rounded,
)
from flowlab.functions.decisions import ThresholdConfig
from flowlab.operators import hygiene, reports
from flowlab.plans.scoring import decide_flat
from flowlab.schema import FEATURES
from flowlab.session import fresh_path, materialize
from flowlab.sources.csv import read_archive, read_csv_by_name, read_feature_importance, read_labelled_test, write_predictions
from flowlab.streaming import scoring as streams

EVENT_SCHEMA = "event_id long, event_type string, value double, ts timestamp_ntz"


def csv_union_by_name(spark, sf):
    """Three kinds of file: two column orders, and one without the value column."""
    events = load(spark, sf, "events").select("event_id", "event_type", "value")
    folder = fresh_path(spark, "by-name")
    writer = {"header": True}
    events.where("event_type IN ('click', 'view')").write.options(**writer).csv(f"{folder}/a")
    events.where("event_type IN ('signup', 'purchase')").select("event_type", "value", "event_id").write.options(
        **writer
    ).csv(f"{folder}/b")
    events.where("event_type = 'error'").select("event_type", "event_id").write.options(**writer).csv(f"{folder}/c")
    table = read_csv_by_name(
        spark, f"{folder}/*/*.csv", features=["value"], label="event_type", carry=["event_id"]
    )
    return table.select(F.col("event_id").cast("long").alias("event_id"), "value", "event_type")


def csv_flow_archive(spark, sf):
    """All 40 features through CSV: an archive read by name, and a held-out file."""
    folder = fresh_path(spark, "flows")
    flows(spark, sf).drop("flow_id").write.option("header", True).csv(folder)
    archive = read_archive(spark, f"{folder}/*.csv", uniform=True)
    test = read_labelled_test(spark, f"{folder}/*.csv")
    both = archive.withColumn("source", F.lit("archive")).unionByName(test.withColumn("source", F.lit("test")))
    total = sum([F.col(f"`{c}`") for c in FEATURES[1:]], F.col(FEATURES[0]))
    summed = both.groupBy("source", "label").agg(F.count("*").alias("rows"), F.sum(total).alias("total"))
    return rounded(summed, "total", places=4)


def csv_mixed_layouts(spark, sf):
    """Held-out files in two column orders, read by name."""
    folder = fresh_path(spark, "mixed")
    rows = flows(spark, sf)
    names = [f"`{c}`" for c in FEATURES]
    rows.where("flow_id % 2 = 0").select(*names, "label").write.option("header", True).csv(f"{folder}/a")
    rows.where("flow_id % 2 = 1").select("label", *reversed(names)).write.option("header", True).csv(f"{folder}/b")
    table = read_labelled_test(spark, f"{folder}/*/*.csv")
    sums = [F.sum(n).alias(f"f{i}") for i, n in enumerate(names)]
    return rounded(table.groupBy("label").agg(F.count("*").alias("rows"), *sums), *[f"f{i}" for i in range(len(names))], places=4)


def csv_single_precision(spark, sf):
    """A third of each price and its tax, read back in single precision: bounds and sums per flag."""
    path = fresh_path(spark, "single")
    lines = load(spark, sf, "lineitem").selectExpr("l_returnflag AS label", "l_extendedprice / 3 AS price", "l_extendedprice * l_tax / 7 AS tax")
    lines.write.option("header", True).csv(path)
    table = read_labelled_test(spark, path, features=["tax", "price"], label="label", dtype="float")
    wide = table.select("label", *[F.col(c).cast("double").alias(c) for c in ("tax", "price")])
    out = wide.groupBy("label").agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in ("tax", "price") for n, f in (("least", F.min), ("most", F.max), ("sum", F.sum))]
    )
    return rounded(out, "sum_tax", "sum_price", places=2)


def _event_scorer(spark, sf):
    """Scores event rows against the frequency table of the batch table; row-local."""
    table = materialize(frequency_table(event_rows(spark, sf), "bucket", "event_type", EVENT_CLASSES), "frequencies")

    def scorer(rows):
        bucketed = rows.select("event_id", "event_type", event_bucket().alias("bucket"))
        return decide_flat(attach(bucketed, table).drop("bucket"), EVENT_CLASSES, ThresholdConfig(), benign=EVENT_BENIGN)

    return scorer


def results_csv_sink(spark, sf):
    """Predictions written as CSV and read back as text."""
    path = fresh_path(spark, "predictions")
    write_predictions(_event_scorer(spark, sf)(load(spark, sf, "events")), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(
        F.col("event_id").cast("long").alias("event_id"), "predicted_class", "alert_level", "uncertain", "abstained",
        F.col("confidence").cast("double").alias("confidence"),
    )


def _event_files(spark, sf):
    folder = fresh_path(spark, "arriving")
    events = load(spark, sf, "events").select("event_id", "event_type", "value", "ts")
    events.repartition(_arrivals(spark), "event_id").write.option("header", True).csv(folder)
    return folder


def _arrivals(spark):
    """Files that the events arrive in: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _event_stream(spark, sf):
    """The events as files that arrive in a few batches."""
    return streams.stream_csv(spark, _event_files(spark, sf), EVENT_SCHEMA, files_per_trigger=max(_arrivals(spark) // 3, 1))


def stream_score(spark, sf):
    stream = _event_stream(spark, sf)
    out = fresh_path(spark, "scored")
    streams.wait(streams.score_to_files(stream, _event_scorer(spark, sf), out, fresh_path(spark, "state")))
    return spark.read.parquet(out).select("event_id", "predicted_class", "confidence", "alert_level", "uncertain")


def _stream_totals(spark, sf):
    stream = _event_stream(spark, sf)
    path = fresh_path(spark, "totals")
    streams.wait(streams.running_alert_totals(stream, _event_scorer(spark, sf), path, fresh_path(spark, "state")))
    return streams.alert_totals(spark, path)


def stream_alert_counts(spark, sf):
    return streams.running_distribution(_stream_totals(spark, sf))


def stream_alert_tiles(spark, sf):
    return rounded(streams.running_tiles(_stream_totals(spark, sf)), "avg_confidence")


def stream_exclude(spark, sf):
    """Arriving events, values rounded, less those whose value occurs as a line quantity."""
    stream = _event_stream(spark, sf)
    reference = load(spark, sf, "lineitem").select(F.col("l_quantity").alias("value"))
    kept = hygiene.exclude_stream_overlap(stream.withColumn("value", F.round("value", 0)), reference, ["value"])
    out = fresh_path(spark, "kept")
    streams.wait(streams.score_to_files(kept, lambda rows: rows, out, fresh_path(spark, "state")))
    return spark.read.parquet(out).select("event_id", "event_type", "value")


def importance_table(spark, sf):
    """Share of variance per feature column of the flows, through the importance CSV and its top ten."""
    rows = flows(spark, sf)
    spread = rows.agg(*[F.var_pop(f"`{c}`").alias(c) for c in FEATURES])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("importance")) for c in FEATURES])
    table = spread.select(F.explode(entries).alias("e")).select("e.*")
    path = fresh_path(spark, "importance")
    table.write.option("header", True).csv(path)
    return rounded(reports.top_features(read_feature_importance(spark, path)), "importance")


_FLOW_SUM = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(len(FEATURES)))


def _sql_mixed() -> str:
    from checks.learning import SQL_LABEL

    sums = ", ".join(f"round(sum(CAST(embedding[{i + 1}] AS DOUBLE)), 4) AS f{i}" for i in range(len(FEATURES)))
    return f"SELECT {SQL_LABEL} AS label, count(*) AS rows, {sums} FROM embeddings GROUP BY 1"


def _sql_archive() -> str:
    from checks.learning import SQL_LABEL

    return f"""WITH f AS (SELECT {SQL_LABEL} AS label, {_FLOW_SUM} AS total FROM embeddings)
        SELECT s.source, label, count(*) AS rows, round(sum(total), 4) AS total
        FROM f CROSS JOIN (VALUES ('archive'), ('test')) s(source) GROUP BY 1, 2"""


_VARIANCES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_pop(CAST(embedding[{i + 1}] AS DOUBLE)) AS v FROM embeddings"
    for i, c in enumerate(FEATURES)
)

QUERIES = {
    "csv_union_by_name": (
        csv_union_by_name,
        "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, event_type FROM events",
    ),
    "csv_flow_archive": (csv_flow_archive, _sql_archive()),
    "csv_mixed_layouts": (csv_mixed_layouts, _sql_mixed()),
    "csv_single_precision": (
        csv_single_precision,
        """WITH t AS (SELECT l_returnflag AS label, CAST(CAST(l_extendedprice / 3 AS FLOAT) AS DOUBLE) AS price,
             CAST(CAST(l_extendedprice * l_tax / 7 AS FLOAT) AS DOUBLE) AS tax FROM lineitem)
           SELECT label, count(*) AS rows, min(tax) AS least_tax, max(tax) AS most_tax, round(sum(tax), 2) AS sum_tax,
             min(price) AS least_price, max(price) AS most_price, round(sum(price), 2) AS sum_price FROM t GROUP BY 1""",
    ),
    "results_csv_sink": (
        results_csv_sink,
        f"""{SQL_PRED} SELECT event_id, predicted_class, alert_level,
            CASE WHEN uncertain THEN 'True' ELSE 'False' END AS uncertain, 'False' AS abstained, confidence FROM pr""",
    ),
    "stream_score": (
        stream_score,
        f"{SQL_PRED} SELECT event_id, predicted_class, confidence, alert_level, uncertain FROM pr",
    ),
    "stream_alert_counts": (
        stream_alert_counts,
        f"{SQL_PRED} SELECT alert_level, count(*) AS rows FROM pr GROUP BY 1",
    ),
    "stream_alert_tiles": (
        stream_alert_tiles,
        f"""{SQL_PRED} SELECT count(*) AS total_rows, count(*) FILTER (alert_level = 'HIGH_ALERT') AS high_alerts,
            count(*) FILTER (uncertain) AS uncertain_rows, round(avg(confidence), 6) AS avg_confidence FROM pr""",
    ),
    "stream_exclude": (
        stream_exclude,
        """SELECT event_id, event_type, round(value, 0) AS value FROM events
           WHERE round(value, 0) NOT IN (SELECT DISTINCT l_quantity FROM lineitem WHERE l_quantity IS NOT NULL)""",
    ),
    "importance_table": (
        importance_table,
        f"""SELECT feature, round(v, 6) AS importance FROM ({_VARIANCES}) ORDER BY v DESC, feature LIMIT 10""",
    ),
}
