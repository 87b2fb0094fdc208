"""The given tables as stand-ins for flow data, and a frequency-table scorer over them.

The scorer is a deterministic stand-in for a classifier: rows fall into buckets of their own attributes, and
P(class | bucket) = round(n^8 / sum n^8, 6) from the row counts per class. The power sharpens nearly flat counts; the
rounding keeps last-bit differences between engines away from decisions. It is plain SQL in both engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from flowlab.operators.small import small_side

EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]
EVENT_FAMILIES = {"Browse": ["click", "view"], "Convert": ["purchase", "signup"], "Fault": ["error"]}
EVENT_BENIGN = "view"
EVENT_RARE = ["error", "purchase"]
EVENT_THRESHOLDS = {"click": 0.70, "error": 0.62, "purchase": 0.66}
DOC_CLASSES = ["de-0", "de-1", "en-0", "en-1", "es-0", "es-1", "fr-0", "fr-1"]
DOC_RARE_SUPPORT = 10


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def power8(n: Column) -> Column:
    return (n * n) * (n * n) * (n * n) * (n * n)


def shares(counts: Sequence[Column]) -> Column:
    """Array of sharpened shares; all zero when every count is zero."""
    weights = F.transform(F.array(*[n.cast("double") for n in counts]), power8)
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.transform(weights, lambda w: F.coalesce(F.round(F.try_divide(w, total), 6), F.lit(0.0)))


def frequency_table(rows: DataFrame, bucket: str, label: str, classes: Sequence[str], out: str = "probs") -> DataFrame:
    """(bucket, probs): one row per bucket from one map-side combined aggregation."""
    counts = rows.groupBy(bucket).agg(*[F.count_if(F.col(label) == c).alias(f"_n{i}") for i, c in enumerate(classes)])
    return counts.select(bucket, shares([F.col(f"_n{i}") for i in range(len(classes))]).alias(out))


def attach(rows: DataFrame, table: DataFrame, bucket: str = "bucket") -> DataFrame:
    """The table is broadcast when it is counted to be small."""
    return rows.join(small_side(table), bucket)


def event_bucket() -> Column:
    return (F.hour("ts") * 100 + F.least(F.floor(F.col("value") / 5), F.lit(20))).cast("int")


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", "event_type", event_bucket().alias("bucket"))


def scored_events(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, event_type, probs); at most 24 x 21 buckets."""
    rows = event_rows(spark, sf)
    return attach(rows, frequency_table(rows, "bucket", "event_type", EVENT_CLASSES)).drop("bucket")


def document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: label = language and toxicity; bucket = language, source and a length step."""
    labels = load(spark, sf, "labels").select("doc_id", "toxic")
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    step = F.least(F.floor(F.col("n_chars") / 400), F.lit(9)).cast("int")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.concat_ws("-", "lang", F.col("toxic").cast("string")).alias("label"),
        F.col("lang").alias("family"),
        F.concat_ws("-", "lang", "source", step.cast("string")).alias("bucket"),
    )


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = document_rows(spark, sf)
    return attach(rows, frequency_table(rows, "bucket", "label", DOC_CLASSES)).drop("bucket")


# ---- the same in SQL ----

def sql_values(names: Sequence[str]) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(names)) + ")"


def sql_shares(rows: str, bucket: str, label: str, classes: Sequence[str], prefix: str = "") -> str:
    """CTEs ending in ``{prefix}share(bucket, idx, c, p)``."""
    return f"""
    {prefix}cls(idx, c) AS (SELECT * FROM {sql_values(classes)} v(idx, c)),
    {prefix}cnt AS (
      SELECT k.{bucket} AS bucket, idx, c, CAST(count(r.{label}) AS DOUBLE) AS n
      FROM (SELECT DISTINCT {bucket} FROM {rows}) k CROSS JOIN {prefix}cls
      LEFT JOIN {rows} r ON r.{bucket} = k.{bucket} AND r.{label} = c GROUP BY ALL),
    {prefix}pw AS (SELECT *, (n*n)*(n*n)*(n*n)*(n*n) AS w FROM {prefix}cnt),
    {prefix}share AS (
      SELECT bucket, idx, c,
             coalesce(round(w / nullif(sum(w) OVER (PARTITION BY bucket), 0), 6), 0.0) AS p FROM {prefix}pw)"""


SQL_EVENT_ROWS = """
    ev AS (SELECT event_id, event_type,
                  CAST(hour(ts) * 100 + least(floor(value / 5), 20) AS INTEGER) AS bucket FROM events)"""

SQL_DOC_ROWS = """
    dr AS (SELECT d.doc_id, d.lang || '-' || CAST(l.toxic AS VARCHAR) AS label, d.lang AS family,
                  d.lang || '-' || d.source || '-' || CAST(CAST(least(floor(d.n_chars / 400), 9) AS INTEGER) AS VARCHAR)
                    AS bucket
           FROM documents d JOIN labels l USING (doc_id))"""


def sql_ranked(rows: str, row_id: str, label: str, share: str = "share") -> str:
    """CTE ``rk``: one line per row and class, with both tie rules."""
    return f"""
    rk AS (
      SELECT r.{row_id} AS id, r.{label} AS truth, s.idx, s.c, s.p,
             row_number() OVER (PARTITION BY r.{row_id} ORDER BY s.p DESC, s.idx DESC) AS rk,
             row_number() OVER (PARTITION BY r.{row_id} ORDER BY s.p DESC, s.idx) AS am
      FROM {rows} r JOIN {share} s USING (bucket))"""


SQL_EVENTS = f"{SQL_EVENT_ROWS},{sql_shares('ev', 'bucket', 'event_type', EVENT_CLASSES)}," + sql_ranked(
    "ev", "event_id", "event_type"
)
SQL_DOCS = f"{SQL_DOC_ROWS},{sql_shares('dr', 'bucket', 'label', DOC_CLASSES)}," + sql_ranked("dr", "doc_id", "label")


def sql_wide(k: int) -> str:
    """CTE ``w``: the first ``k`` ranks of each row side by side, and the arg-max class."""
    ranks = ", ".join(
        f"max(CASE WHEN rk = {i} THEN c END) AS c{i}, max(CASE WHEN rk = {i} THEN p END) AS p{i}"
        for i in range(1, k + 1)
    )
    return f"""
    w AS (SELECT id, truth, {ranks}, max(CASE WHEN am = 1 THEN c END) AS ac, max(CASE WHEN am = 1 THEN p END) AS ap
          FROM rk GROUP BY id, truth)"""


def sql_alert(predicted: str, confidence: str, benign: str) -> str:
    return f"""CASE WHEN {predicted} = '{benign}' THEN CASE WHEN {confidence} >= 0.9 THEN 'INFO' ELSE 'REVIEW' END
      WHEN {confidence} >= 0.9 THEN 'HIGH_ALERT' WHEN {confidence} >= 0.6 THEN 'MEDIUM_ALERT'
      ELSE 'LOW_ALERT_REVIEW' END"""


def sql_per_class(source: str = "cm", keys: Sequence[str] = ()) -> str:
    """CTE ``pc`` from confusion counts ``source(keys, y_true, y_pred, n)``."""
    k = "".join(f"{x}, " for x in keys)
    return f"""
    sides AS (
      SELECT {k}y_true AS label, n AS support, 0 AS predicted, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp
      FROM {source}
      UNION ALL SELECT {k}y_pred, 0, n, 0 FROM {source}),
    tot AS (SELECT {k}label, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted,
                   CAST(sum(tp) AS BIGINT) AS tp FROM sides GROUP BY ALL),
    pc AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
                  coalesce(2 * tp / nullif(support + predicted, 0), 0.0) AS f1 FROM tot)"""


def sql_in(names: Sequence[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in names) + ")"


def positioned(table: DataFrame) -> DataFrame:
    """A short ordered report with each row's place in it, from 1."""
    rows = table.collect()  # a row per label or candidate
    schema = StructType([StructField("position", IntegerType()), *table.schema.fields])
    return table.sparkSession.createDataFrame([(i, *row) for i, row in enumerate(rows, 1)], schema)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
