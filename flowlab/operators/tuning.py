"""Learning per-class thresholds on scored rows.

While tuning, only rare classes have thresholds and a rare top class below its own abstains. Raising the threshold of one
class therefore changes predictions of that class only: labels are independent, and a whole search is one aggregation
over (class, number of candidates passed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.functions.ranking import argmax_class, argmax_index, best_class, ranked_classes, usable
from flowlab.operators.metrics import fbeta
from flowlab.operators.quantiles import grouped_quantiles
from flowlab.operators.small import small_side
from flowlab.schema import quoted
from flowlab.session import materialize

QUANTILE_POINTS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
MIN_TOP1_ROWS = 25


def is_hard(
    probs: Column, classes: Sequence[str], truth: Column, rare: Sequence[str], max_margin: float = 0.20
) -> Column:
    """Rare truth, rare best or second class, or a margin below ``max_margin``."""
    names = [str(x) for x in rare]
    two = ranked_classes(probs, classes, 2)
    best = F.element_at(probs, argmax_index(probs) + 1)
    second = F.get(two, F.lit(1))
    listed = [argmax_class(probs, classes).isin(names), second["class_name"].isin(names), truth.isin(names)]
    flags = [*(listed if names else []), (best - second["probability"]) < max_margin]
    hard = F.lit(False)
    for flag in flags:
        hard = hard | F.coalesce(flag, F.lit(False))
    return hard


def top1(df: DataFrame, classes: Sequence[str], probs: str = "probs", truth: str = "label") -> DataFrame:
    """(truth, argmax_class, argmax_p, rank1_class, rank1_p): both tie rules side by side."""
    return df.select(
        quoted(truth).alias("truth"),
        argmax_class(F.col(probs), classes).alias("argmax_class"),
        F.element_at(F.col(probs), argmax_index(F.col(probs)) + 1).alias("argmax_p"),
        best_class(F.col(probs), classes).alias("rank1_class"),
        F.when(usable(F.col(probs)), F.array_max(probs)).alias("rank1_p"),
    )


def threshold_candidates(
    tops: DataFrame, rare: Sequence[str], *, min_rows: int = MIN_TOP1_ROWS, places: int = 4
) -> DataFrame:
    """(label, candidate_idx, threshold): 0 and the rounded quantiles of each rare label's best probabilities."""
    mine = tops.where(F.col("argmax_class").isin([str(x) for x in rare]))
    quantiles = grouped_quantiles(mine, "argmax_class", "argmax_p", QUANTILE_POINTS, min_rows)
    rounded = F.collect_set(F.round("quantile", places))  # at most ten values
    positive = F.filter(F.array_sort(rounded), lambda t: t > 0)
    lists = quantiles.groupBy(F.col("argmax_class").alias("label")).agg(
        F.concat(F.array(F.lit(0.0)), positive).alias("_list")
    )
    return lists.select("label", F.posexplode("_list").alias("candidate_idx", "threshold"))


def candidate_scores(tops: DataFrame, candidates: DataFrame) -> DataFrame:
    """Precision, recall and F0.5 of every candidate, with the baseline recall of its label.

    Rows are counted per (label, candidates passed, truth hit), and the counts accumulated from the highest candidate down:
    each row is touched once, however many candidates there are.
    """
    lists = candidates.groupBy("label").agg(F.array_sort(F.collect_list("threshold")).alias("_list"))
    side = small_side(lists)
    counted = F.filter(F.col("_list"), lambda t: t <= F.col("rank1_p"))
    passed = (
        tops.join(side, F.col("rank1_class") == F.col("label"))
        .groupBy("label", F.size(counted).alias("_passed"))
        .agg(F.count("*").alias("_rows"), F.count_if(F.col("truth") == F.col("label")).alias("_hits"))
    )
    # Baseline recall uses the arg-max rule; supports come from the truth.
    truth = tops.groupBy(F.col("truth").alias("label")).agg(
        F.count("*").alias("support"), F.count_if(F.col("argmax_class") == F.col("truth")).alias("base_hits")
    )
    kept = (
        candidates.join(passed, "label", "left")
        .groupBy("label", "candidate_idx", "threshold")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_passed") > F.col("candidate_idx"), F.col("_rows"))), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(F.col("_passed") > F.col("candidate_idx"), F.col("_hits"))), F.lit(0)).alias("tp"),
        )
    )
    joined = kept.join(truth, "label", "left")
    precision = F.coalesce(F.try_divide("tp", "kept"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    base = F.coalesce(F.try_divide("base_hits", "support"), F.lit(0.0))
    return joined.select(
        "label",
        "candidate_idx",
        "threshold",
        "kept",
        "tp",
        precision.alias("precision"),
        recall.alias("recall"),
        fbeta(precision, recall, 0.5).alias("f05"),
        base.alias("base_recall"),
    )


def best_thresholds(scores: DataFrame, min_recall_ratio: float = 0.85) -> DataFrame:
    """The best candidate per label by (precision, F0.5, recall), the lowest threshold on ties.

    Candidates whose recall falls under the floor are out; a label whose best candidate is 0 gets no threshold.
    """
    allowed = scores.where(F.col("recall") >= F.col("base_recall") * min_recall_ratio)
    best = allowed.groupBy("label").agg(
        F.max(F.struct("precision", "f05", "recall", (-F.col("threshold")).alias("_low"), "threshold")).alias("_best")
    )
    chosen = best.select("label", "_best.threshold", "_best.precision", "_best.recall", "_best.f05")
    return chosen.where("threshold > 0").orderBy(F.desc("threshold"), "label")


def rare_label_order(tops: DataFrame, rare: Sequence[str]) -> DataFrame:
    """Rare labels by baseline precision, then falling recall: the order a greedy search would visit them."""
    names = [str(x) for x in rare]
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.lit(1).alias("s"), F.lit(0).alias("p")),
        F.struct(F.col("argmax_class").alias("label"), F.lit(0).alias("s"), F.lit(1).alias("p")),
    )
    hit = (F.col("truth") == F.col("argmax_class")).cast("int")
    pairs = tops.groupBy("truth", "argmax_class").agg(F.count("*").alias("n"))
    unfolded = pairs.select("n", hit.alias("hit"), F.explode(sides).alias("e"))
    totals = (
        unfolded.where(F.col("e.label").isin(names))
        .groupBy(F.col("e.label").alias("label"))
        .agg(
            F.sum(F.col("n") * F.col("e.s")).alias("support"),
            F.sum(F.col("n") * F.col("e.p")).alias("predicted"),
            F.coalesce(F.sum(F.col("n") * F.col("hit") * F.col("e.s")), F.lit(0)).alias("tp"),
        )
    )
    measured = totals.select(
        "label",
        F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)).alias("recall"),
    )
    return measured.orderBy("precision", F.desc("recall"), "label")


def tune_thresholds(
    scored: DataFrame,
    classes: Sequence[str],
    rare: Sequence[str],
    *,
    probs: str = "probs",
    truth: str = "label",
    min_recall_ratio: float = 0.85,
    min_rows: int = MIN_TOP1_ROWS,
    hard_only: bool = False,
) -> DataFrame:
    """(label, threshold, precision, recall, f05) for every rare label that gains from a threshold."""
    rows = scored
    if hard_only:
        rows = scored.where(is_hard(F.col(probs), classes, quoted(truth), rare))
    # Five narrow columns, written once: scoring is not repeated for every count below.
    tops = materialize(top1(rows, classes, probs, truth), "tops")
    candidates = small_side(threshold_candidates(tops, rare, min_rows=min_rows))
    return best_thresholds(candidate_scores(tops, candidates), min_recall_ratio)
