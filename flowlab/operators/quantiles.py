"""Exact linear-interpolation quantiles per group, by a radix search for the wanted ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.digits import FIRST_SHIFT, OPENED, WIDTH, prefix, with_ordered_bits
from flowlab.operators.small import small_side
from flowlab.session import materialize


def grouped_quantiles(
    df: DataFrame, group: str, value: str, points: Sequence[float], min_rows: int = 1, *, opened: int = OPENED, lower: bool = False
) -> DataFrame:
    """(group, n, q, quantile) of a numeric column of any range; groups under ``min_rows`` rows are left out.

    Rows are counted by the leading digit of the value's order; the prefixes that hold a wanted rank are counted by the
    next digit until they hold one value or at most ``opened`` rows, which alone are collapsed to distinct values and
    ranked. Null values are passed over, NaN is the largest; a null group is a group. With ``lower`` the quantile is the
    value at the rank below, not a mean of two.
    """
    valued = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    valued = with_ordered_bits(valued, "_v")

    def counted(rows: DataFrame, within: Sequence[str], shift: int) -> DataFrame:
        counts = rows.groupBy(*within, prefix(F.col("_bits"), shift).alias("_prefix")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        running = Window.partitionBy(*within).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.withColumn("_next", F.sum("_n").over(running)).withColumn("_first", F.col("_next") - F.col("_n"))

    def holding(rows: DataFrame, ranks: DataFrame, shift: int) -> DataFrame:
        """``rows`` below the prefixes of ``ranks``."""
        wanted = ranks.select(F.col("_g").alias("_wg"), F.col("_prefix").alias("_in")).distinct()
        return rows.join(small_side(wanted), F.col("_g").eqNullSafe(F.col("_wg")) & (prefix(F.col("_bits"), shift) == F.col("_in"))).drop("_wg")

    shift = FIRST_SHIFT
    first = counted(valued, ["_g"], shift).withColumn("n", F.sum("_n").over(Window.partitionBy("_g"))).where(F.col("n") >= min_rows)
    asked = first.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in points])))
    asked = asked.withColumn("_position", F.lit(0.0) + (F.col("n") - 1) * F.col("q"))
    asked = asked.withColumn("_rank", F.explode(F.array(F.floor("_position"), F.ceil("_position"))))
    kept = ["_g", "n", "q", "_position", "_rank", "_prefix", "_n", "_lo", "_hi", "_local"]
    found = asked.where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_next")))
    ranks = materialize(found.withColumn("_local", F.col("_rank") - F.col("_first")).select(kept), "ranks")  # two a point and group
    asks = ["_g", "n", "q", "_position", "_rank"]
    done = []
    while True:
        single = (F.col("_lo") == F.col("_hi")) | F.isnan("_lo")
        done.append(ranks.where(single).select(*asks, F.col("_lo").alias("_found")))
        several = ranks.where(~single)
        light = several.where(F.col("_n") <= opened)
        inside = holding(valued, light, shift).groupBy("_g", "_in", "_v").agg(F.count("*").alias("_n"))
        running = Window.partitionBy("_g", "_in").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = inside.withColumn("_next", F.sum("_n").over(running)).withColumn("_first", F.col("_next") - F.col("_n"))
        inside = inside.withColumnsRenamed({"_g": "_ig", "_n": "_in_n"})
        there = F.col("_g").eqNullSafe(F.col("_ig")) & (F.col("_prefix") == F.col("_in")) & (F.col("_local") >= F.col("_first")) & (F.col("_local") < F.col("_next"))
        done.append(light.join(inside, there).select(*asks, F.col("_v").alias("_found")))
        crowded = several.where(F.col("_n") > opened)
        if crowded.isEmpty():
            break
        parts = holding(valued, crowded, shift)
        shift = max(shift - WIDTH, 0)
        parts = counted(parts, ["_g", "_in"], shift).withColumnsRenamed({"_g": "_pg", "_prefix": "_p", "_n": "_pn", "_lo": "_plo", "_hi": "_phi"})
        there = F.col("_g").eqNullSafe(F.col("_pg")) & (F.col("_prefix") == F.col("_in")) & (F.col("_local") >= F.col("_first")) & (F.col("_local") < F.col("_next"))
        deeper = crowded.join(parts, there).select(
            *asks, F.col("_p").alias("_prefix"), F.col("_pn").alias("_n"), F.col("_plo").alias("_lo"), F.col("_phi").alias("_hi"), (F.col("_local") - F.col("_first")).alias("_local")
        )
        ranks = materialize(deeper, "ranks")
    values = done[0]
    for more in done[1:]:
        values = values.unionByName(more)
    share = F.col("_position") - F.floor("_position")
    ends = values.groupBy("_g", "n", "q", "_position").agg(F.min("_found").alias("_low"), F.max("_found").alias("_high"))
    quantile = F.when(F.lit(lower) | (F.col("_low") == F.col("_high")), F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * share)
    return ends.select(F.col("_g").alias(group), "n", "q", quantile.alias("quantile"))
