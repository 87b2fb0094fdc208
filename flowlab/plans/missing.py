"""Missing and infinite feature values: learnt from the training rows, applied alike when fitting and when scoring.

A column with nulls or NaN in training gets its median there and an indicator column beside it; infinities become the
largest or smallest finite training value. Columns without such values in training stay as they are, so a value that is
missing only when scoring is left to the model: trees score it, linear models give no prediction. No row is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.operators.quantiles import grouped_quantiles
from flowlab.schema import quoted, ticked

FILLED, MISSING = "_filled_", "_missing_"
_INFINITY = float("inf")


@dataclass(frozen=True)
class Gap:
    """What stands for missing and infinite values of the feature at ``position``; ``marked``: with an indicator."""

    position: int
    fill: float
    low: float
    high: float
    marked: bool


def find_gaps(df: DataFrame, features: Sequence[str]) -> list[Gap]:
    """Features that hold a null, NaN or infinity; further passes, over these alone, find their bounds and exact medians
    (the lower one of two).

    A feature without a finite value is filled with 0.
    """
    columns = [quoted(c).cast("double") for c in features]
    counts = df.agg(
        *[F.count_if(c.isNull() | F.isnan(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.abs(c) == _INFINITY).alias(f"i{i}") for i, c in enumerate(columns)],
    ).first()
    holed = [i for i in range(len(columns)) if counts[f"n{i}"] or counts[f"i{i}"]]
    if not holed:
        return []
    finite = {i: F.when(F.abs(columns[i]) < _INFINITY, columns[i]) for i in holed}  # NaN is above infinity
    found = df.agg(
        *[F.min(c).alias(f"l{i}") for i, c in finite.items()],
        *[F.max(c).alias(f"h{i}") for i, c in finite.items()],
    ).first()
    listed = F.array(*[F.struct(F.lit(i).alias("feature"), c.alias("value")) for i, c in finite.items()])
    unfolded = df.select(F.explode(listed).alias("e")).select("e.*")
    medians = {r["feature"]: r["quantile"] for r in grouped_quantiles(unfolded, "feature", "value", [0.5], lower=True).collect()}
    return [Gap(i, medians.get(i) or 0.0, *(found[f"{k}{i}"] or 0.0 for k in "lh"), counts[f"n{i}"] > 0) for i in holed]


def fill_statement(gaps: Sequence[Gap], features: Sequence[str]) -> str:
    """SQL that adds a filled column per gap, and an indicator where it is marked."""
    added = []
    for gap in gaps:
        c = ticked(features[gap.position])
        fill, low, high = (f"CAST('{x!r}' AS DOUBLE)" for x in (gap.fill, gap.low, gap.high))
        missing = f"({c} IS NULL OR isnan({c}))"
        added.append(
            f"CASE WHEN {missing} THEN {fill} WHEN {c} = CAST('Infinity' AS DOUBLE) THEN {high} "
            f"WHEN {c} = CAST('-Infinity' AS DOUBLE) THEN {low} ELSE {c} END AS {FILLED}{gap.position}"
        )
        if gap.marked:
            added.append(f"CAST({missing} AS DOUBLE) AS {MISSING}{gap.position}")
    return f"SELECT *, {', '.join(added)} FROM __THIS__"


def assembling_stages(df: DataFrame, features: Sequence[str]) -> list[Transformer]:
    """The stages that make the feature vector, learnt from the training rows ``df``: filling where it is needed, then
    the features in order, then the indicators."""
    gaps = find_gaps(df, features)
    filled = {gap.position for gap in gaps}
    inputs = [f"{FILLED}{i}" if i in filled else c for i, c in enumerate(features)]
    inputs += [f"{MISSING}{gap.position}" for gap in gaps if gap.marked]
    # Values that are missing only when scoring become NaN and rows are kept: dropping would change every denominator.
    assembler = VectorAssembler(inputCols=inputs, outputCol="_features", handleInvalid="keep")
    return [SQLTransformer(statement=fill_statement(gaps, features)), assembler] if gaps else [assembler]
