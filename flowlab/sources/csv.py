"""CSV archives matched by column name, and CSV sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlab.operators.small import small_side
from flowlab.operators.support import mapped
from flowlab.schema import FEATURES, LABEL, conform, labelled, quoted, require_columns, require_label
from flowlab.session import materialize

CSV_OPTIONS = {"header": "true", "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "NaN"}
#: Larger than any file: a file is then one task of the header lookup.
_WHOLE_FILE = str(1 << 50)


def _typed(header: Sequence[str], features: Sequence[str]) -> T.StructType:
    numbers = set(features)
    return T.StructType([T.StructField(c, T.DoubleType() if c in numbers else T.StringType()) for c in header])


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    return tuple(spark.read.options(**CSV_OPTIONS).csv(path).columns)


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, header, file): the first line with content of each file, looked up in one job; ``file`` is the path as
    ``_metadata`` spells it. A task opens one file and stops after that line; files without content have no row.

    Split sizes are settings of a session, so the lookup has a session of its own.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", _WHOLE_FILE)
    own.conf.set("spark.sql.files.openCostInBytes", _WHOLE_FILE)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and batch.column(1)[0].as_py().strip():
                name = batch.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([unquote(name)]), batch.column(1), pa.array([name])], names=["path", "header", "file"])
                return

    lines = own.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.mapInArrow(first, "path string, header string, file string")


def read_csv_by_name(
    spark: SparkSession,
    path: str,
    *,
    features: Sequence[str] = FEATURES,
    label: str | None = LABEL,
    carry: Sequence[str] = (),
    uniform: bool = False,
) -> DataFrame:
    """Many CSV files, columns matched by header name; a column missing from some files is null there.

    Spark binds CSV columns by position. Files that all have one header are read with its schema. Of files with several
    headers the lines are read once and each is split by the places of its own file's header; the driver sees one file
    name per layout. A record is one line, so a line break inside quotes ends it; empty lines and lines like the file's
    header are no records; a number that cannot be read is null. With ``uniform`` only one header is looked up and Spark
    verifies it against every file while reading.
    """
    wanted = [*carry, *features, *([label] if label else [])]
    reader = spark.read.options(**CSV_OPTIONS)
    if uniform:
        header = _header(spark, path)
        table = reader.option("enforceSchema", "false").schema(_typed(header, features)).csv(path)
        require_columns(table, wanted)
        return table.select(*[quoted(c) for c in wanted])

    lines = materialize(header_lines(spark, path), "headers")
    samples = lines.groupBy("header").agg(F.min("path").alias("path")).orderBy("path").collect()  # one row a layout
    layouts = [(r["header"], _header(spark, r["path"])) for r in samples]
    known = {c for _, header in layouts for c in header}
    missing = [c for c in wanted if c not in known]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    if len(layouts) == 1:
        table = reader.schema(_typed(layouts[0][1], features)).csv(path)
        return table.select(*[quoted(c) for c in wanted])
    return _by_layout(spark, path, lines, layouts, wanted, features)


def _by_layout(
    spark: SparkSession, path: str, lines: DataFrame, layouts: Sequence[tuple[str, Sequence[str]]], wanted: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """One scan of files with several layouts: each line meets its file's layout number, is split once, and every column is
    taken from its place in that layout."""
    place = {header: k for k, (header, _) in enumerate(layouts)}
    files = lines.select("file", "header", mapped(F.col("header"), place).alias("layout"))
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = text.join(small_side(files), "file").where((F.col("value") != F.col("header")) & (F.trim("value") != ""))
    width = max(len(header) for _, header in layouts)
    cells = F.from_csv("value", F.lit(", ".join(f"c{i} STRING" for i in range(width))), {k: v for k, v in CSV_OPTIONS.items() if k != "header"})
    parts = rows.select("layout", cells.alias("_cells")).select("layout", F.array(*[F.col(f"_cells.c{i}") for i in range(width)]).alias("_parts"))
    numbers = set(features)

    def column(name: str) -> Column:
        at = {k: header.index(name) for k, (_, header) in enumerate(layouts) if name in header}
        raw = F.get("_parts", mapped(F.col("layout"), at))
        return (raw.try_cast("double") if name in numbers else raw).alias(name)

    return parts.select(*[column(c) for c in wanted])


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    """The training archive: features and label by name, rows without a label left out."""
    label = options.get("label", LABEL)
    return labelled(read_csv_by_name(spark, path, **options), label)


def read_labelled_test(
    spark: SparkSession, path: str, *, features: Sequence[str] = FEATURES, label: str = LABEL, dtype: str = "double"
) -> DataFrame:
    """Held-out CSV files, columns matched by name in each file. Label and features are checked, then projected in
    order, as ``dtype`` ("float" takes half the room and rounds to single precision). Null labels are kept."""
    header = {c for c in _header(spark, path)}
    table = read_csv_by_name(spark, path, features=features, label=label if label in header else None)
    require_label(table, label)
    return conform(table, features, label=label, dtype=dtype)


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Predictions as a folder of CSV files with a header each, written by every task in parallel."""
    flat = [quoted(n) if t != "boolean" else F.initcap(quoted(n).cast("string")).alias(n) for n, t in predictions.dtypes]
    predictions.select(*flat).write.mode(mode).option("header", True).csv(path)


def read_feature_importance(spark: SparkSession, path: str) -> DataFrame:
    """Importance tables (feature, importance), columns matched by name in each file."""
    return read_csv_by_name(spark, path, features=["importance"], label=None, carry=["feature"])
