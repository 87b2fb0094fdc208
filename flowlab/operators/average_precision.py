"""One-vs-rest average precision, exact, without sorting a class in one task.

AP = sum over distinct scores, best first, of (recall step x precision). A first pass counts rows and positives per
class and leading digit of the score, combined map-side. Only buckets that hold a positive raise recall, so a second pass
opens those alone and leaves all other rows where they are; a bucket of too many rows is counted by further digits
until its parts are small or hold a single score.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.digits import FIRST_SHIFT, OPENED, WIDTH, prefix, with_ordered_bits
from flowlab.operators.small import small_side
from flowlab.schema import quoted
from flowlab.session import materialize


def _unfolded(
    df: DataFrame,
    classes: Sequence[str],
    probs: str,
    truth: str,
    only: Sequence[str] | None,
    keys: Sequence[str],
    least: Mapping[str, float] | None = None,
) -> DataFrame:
    """(keys, class, score, hit) for each row and wanted class; with ``least`` only where the class's score reaches it.

    A wanted class the model does not know has no score and is left out; a null score is below all others.
    """
    names = [str(c) for c in classes]
    wanted = [c for c in (names if only is None else map(str, only)) if c in names and (least is None or c in least)]

    def entry(name: str) -> Column:
        score = F.coalesce(F.get(F.col(probs), F.lit(names.index(name))), F.lit(float("-inf")))
        hit = F.coalesce(quoted(truth) == name, F.lit(False)).cast("int")
        listed = F.struct(F.lit(name).alias("class"), score.alias("score"), hit.alias("hit"))
        return listed if least is None else F.when(score >= least[name], listed)

    if not wanted:
        empty = df.select(*keys, F.lit("").alias("class"), F.lit(0.0).alias("score"), F.lit(0).alias("hit"))
        return empty.where(F.lit(False))
    entries = F.array(*[entry(c) for c in wanted])
    if least is not None:
        entries = F.array_compact(entries)
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def one_vs_rest(
    df: DataFrame,
    classes: Sequence[str],
    *,
    probs: str = "probs",
    truth: str = "label",
    only: Sequence[str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, class, score, positives, rows): the binarised truth counted per distinct score."""
    unfolded = _unfolded(df, classes, probs, truth, only, keys)
    return unfolded.groupBy(*keys, "class", "score").agg(F.sum("hit").alias("positives"), F.count("*").alias("rows"))


def _counted(rows: DataFrame, group: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Buckets of ``rows`` (group, within, _prefix, score, hit) with what stands above each, inside ``within``."""
    buckets = rows.groupBy(*group, *within, "_prefix").agg(
        F.sum("hit").alias("positives"), F.count("*").alias("rows"), F.min("score").alias("_lo"), F.max("score").alias("_hi")
    )
    above = Window.partitionBy(*group, *within).orderBy(F.desc("_prefix")).rowsBetween(Window.unboundedPreceding, -1)
    return buckets.withColumns(
        {f"_{c}_above": F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("positives", "rows")}
    )


def _met(rows: DataFrame, buckets: DataFrame, group: Sequence[str], shift: int) -> DataFrame:
    """``rows`` that fall into ``buckets`` at that shift, with the buckets' columns."""
    wanted = buckets.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], F.col("_prefix").alias("_in"), "_positives_above", "_rows_above")
    same = prefix(F.col("_bits"), shift) == F.col("_in")
    for k, c in enumerate(group):
        same = same & quoted(c).eqNullSafe(F.col(f"_g{k}"))
    return rows.join(small_side(wanted), same).drop(*[f"_g{k}" for k in range(len(group))])


def _area(positives: Column, rows: Column) -> Column:
    return F.col("positives") * (positives + F.col("_positives_above")) / (rows + F.col("_rows_above"))


def average_precision(
    df: DataFrame,
    classes: Sequence[str],
    *,
    probs: str = "probs",
    truth: str = "label",
    only: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    opened: int = OPENED,
    write_rows: bool = True,
) -> DataFrame:
    """(keys, class, positives, average_precision); 0 for a class without a positive row.

    ``df`` has one row per scored case, with the probabilities in the order of ``classes``. It is read twice or more and
    usually comes from a model, so its needed columns are written first; ``write_rows=False`` leaves that out for rows
    that are already stored. No more than ``opened`` rows of a bucket are ranked together.
    """
    group = [*keys, "class"]
    df = df.select(*keys, quoted(truth).alias("_truth"), F.col(probs).alias("_probs"))
    if write_rows:
        df = materialize(df, "scored")

    def unfolded(least: Mapping[str, float] | None = None) -> DataFrame:
        return with_ordered_bits(_unfolded(df, classes, "_probs", "_truth", only, keys, least), "score")

    shift = FIRST_SHIFT
    first = materialize(_counted(unfolded().withColumn("_prefix", prefix(F.col("_bits"), shift)), group, []), "buckets")
    totals = first.groupBy(*group).agg(F.sum("positives").alias("_all"))
    buckets, areas = first, []
    while True:
        buckets = buckets.where("positives > 0")
        single = F.col("_lo") == F.col("_hi")
        areas.append(buckets.where(single).select(*group, _area(F.col("positives"), F.col("rows")).alias("_area")))
        several = buckets.where(~single)
        least = {r["class"]: r["_least"] for r in several.groupBy("class").agg(F.min("_lo").alias("_least")).collect()}
        if not least:
            break
        rows = unfolded(least)
        inside = _met(rows, several.where(F.col("rows") <= opened), group, shift)
        counts = inside.groupBy(*group, "_in", "score", "_positives_above", "_rows_above").agg(F.sum("hit").alias("positives"), F.count("*").alias("rows"))
        running = Window.partitionBy(*group, "_in").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumns({"_tp": F.sum("positives").over(running), "_seen": F.sum("rows").over(running)})
        areas.append(counts.where("positives > 0").select(*group, _area(F.col("_tp"), F.col("_seen")).alias("_area")))
        crowded = several.where(F.col("rows") > opened)
        if crowded.isEmpty():
            break
        parts = _met(rows, crowded, group, shift).withColumnsRenamed({"_positives_above": "_p", "_rows_above": "_r"})
        shift = max(shift - WIDTH, 0)
        parts = _counted(parts.withColumn("_prefix", prefix(F.col("_bits"), shift)), group, ["_in", "_p", "_r"])
        parts = parts.withColumns({"_positives_above": F.col("_positives_above") + F.col("_p"), "_rows_above": F.col("_rows_above") + F.col("_r")})
        buckets = materialize(parts.drop("_in", "_p", "_r"), "buckets")
    parts = totals.withColumn("_area", F.lit(0.0))
    for area in areas:
        parts = parts.unionByName(area, allowMissingColumns=True)
    summed = parts.groupBy(*group).agg(F.max("_all").alias("positives"), F.sum("_area").alias("_area"))
    share = F.coalesce(F.try_divide(F.col("_area"), F.col("positives")), F.lit(0.0))
    return summed.select(*map(quoted, group), "positives", share.alias("average_precision"))


def macro_auprc(ap: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ap.groupBy(*keys).agg(F.avg("average_precision").alias("macro_auprc"))


def rare_auprc(ap: DataFrame, rare: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean AP over the rare classes; one the model does not know counts as 0; null when there is no rare class."""
    wanted = [str(x) for x in rare]
    hits = F.when(F.col("class").isin(wanted), F.col("average_precision")) if wanted else F.lit(None).cast("double")
    total = F.coalesce(F.sum(hits), F.lit(0.0))
    mean = total / F.lit(float(len(wanted))) if wanted else F.lit(None).cast("double")
    return ap.groupBy(*keys).agg(mean.alias("rare_mean_auprc"))
