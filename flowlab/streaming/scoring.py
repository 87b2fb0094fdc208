"""Scoring of arriving files with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowlab.sources.csv import CSV_OPTIONS

#: Additive counts of one alert level.
TOTALS = T.StructType(
    [
        T.StructField("alert_level", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("uncertain_rows", T.LongType()),
        T.StructField("confidence_sum", T.DoubleType()),
        T.StructField("confidence_rows", T.LongType()),
    ]
)

Scorer = Callable[[DataFrame], DataFrame]


def stream_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, *, files_per_trigger: int | None = None
) -> DataFrame:
    """CSV files arriving in a folder. Headers are verified against the schema, which binds by position."""
    reader = spark.readStream.schema(schema).options(**CSV_OPTIONS).option("enforceSchema", "false")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.csv(path)


def score_to_files(
    stream: DataFrame, scorer: Scorer, path: str, checkpoint: str, *, fmt: str = "parquet"
) -> StreamingQuery:
    """Append predictions to files until all present input is read. Row-local: no state, exactly once per file."""
    writer = scorer(stream).writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if fmt == "csv":
        writer = writer.option("header", True)
    return writer.trigger(availableNow=True).start(path)


def _added(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the totals up to this batch: those up to the one before, plus its own counts. A batch that runs again after a
    failure writes the same folder with the same content, so nothing is counted twice."""
    spark = batch.sparkSession
    own = batch.groupBy("alert_level").agg(
        F.count("*").alias("rows"), F.count_if("uncertain").alias("uncertain_rows"),
        F.sum("confidence").alias("confidence_sum"), F.count("confidence").alias("confidence_rows"),
    )
    if batch_id:
        own = own.unionByName(spark.read.schema(TOTALS).parquet(f"{path}/batch={batch_id - 1}"))
    names = [f.name for f in TOTALS.fields[1:]]
    totals = own.groupBy("alert_level").agg(*[F.sum(c).alias(c) for c in names])
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a row per alert level


def running_alert_totals(stream: DataFrame, scorer: Scorer, path: str, checkpoint: str) -> StreamingQuery:
    """Running totals per alert level of everything seen, below the shared folder ``path``, one folder a batch.

    Each batch is one map-side combined count and one row per level; the driver holds nothing. The checkpoint lets a
    restarted query go on, and a batch that is run twice is counted once.
    """
    writer = scorer(stream).select("alert_level", "uncertain", "confidence").writeStream
    writer = writer.foreachBatch(lambda batch, batch_id: _added(batch, batch_id, path))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alert_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals up to the last batch."""
    batches = spark.read.schema(T.StructType([*TOTALS.fields, T.StructField("batch", T.LongType())])).parquet(path)
    last = batches.agg(F.max("batch").alias("batch"))
    return batches.join(F.broadcast(last), "batch").drop("batch")  # one row


def running_distribution(totals: DataFrame) -> DataFrame:
    """Rows per alert level, as ``reports.alert_distribution``."""
    return totals.select("alert_level", "rows").orderBy(F.desc("rows"), "alert_level")


def running_tiles(totals: DataFrame) -> DataFrame:
    """Total rows, high alerts, uncertain rows and mean confidence, as ``reports.alert_tiles``."""
    return totals.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("alert_level") == "HIGH_ALERT", F.col("rows"))), F.lit(0)).alias("high_alerts"),
        F.coalesce(F.sum("uncertain_rows"), F.lit(0)).alias("uncertain_rows"),
        F.try_divide(F.sum("confidence_sum"), F.sum("confidence_rows")).alias("avg_confidence"),
    )


def wait(query: StreamingQuery, timeout: float | None = None) -> None:
    """Block until an ``availableNow`` query ends; raises what it raised."""
    finished = query.awaitTermination(timeout) if timeout else query.awaitTermination()
    if timeout and not finished:
        query.stop()
        raise TimeoutError(f"Streaming query still running after {timeout} s")

