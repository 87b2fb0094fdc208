"""Ranking of class probabilities inside a row.

A scored row holds ``probs: array<double>``; the class names are one list on the driver, in the order of the
array. Two tie rules exist and both are kept: ranked lists put the *higher* class index first among equal
probabilities, the arg-max takes the *lowest* index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_array(classes: Sequence[str]) -> Column:
    names = ", ".join("'" + str(c).replace("\\", "\\\\").replace("'", "\\'") + "'" for c in classes)
    return F.expr(f"array({names})")


def usable(probs: Column) -> Column:
    """False for a missing vector or one with a missing or NaN entry."""
    return F.coalesce(~F.array_contains(probs, F.lit(float("nan"))), F.lit(False))


def _best_first(probs: Column, columns: Sequence[Column], k: int | None, when: Column | None = None) -> Column:
    """The probabilities zipped with per-class columns, best first. All steps run in generated code: a lambda per
    element costs several times as much. Rows not wanted turn null before the sort, which then costs nothing."""
    guarded = F.when(usable(probs) if when is None else when & usable(probs), probs)
    ordered = F.sort_array(F.arrays_zip(guarded.alias("p"), *columns), asc=False)
    return ordered if k is None else F.slice(ordered, 1, k)


def class_indices(count: int) -> Column:
    return F.expr(f"sequence(0, {count - 1})")


def ranked_indices(probs: Column, count: int, k: int | None = None) -> Column:
    """``array<struct<p, i>>`` over ``count`` classes, best first; ties: higher index first. Null when the vector is
    unusable."""
    return _best_first(probs, [class_indices(count).alias("i")], k)


def ranked_classes(
    probs: Column, classes: Sequence[str], k: int | None = None, when: Column | None = None
) -> Column:
    """The best ``k`` classes (all when None) as ``array<struct<rank, class_name, probability>>``; null where ``when``
    is given and does not hold."""
    count = len(classes)
    names = class_array(classes).alias("c")
    best = _best_first(probs, [class_indices(count).alias("i"), names], k, when)
    ranks = F.expr(f"sequence(1, {count if k is None else min(k, count)})")
    zipped = F.arrays_zip(ranks.alias("rank"), best["c"].alias("class_name"), best["p"].alias("probability"))
    return zipped


def best_class(probs: Column, classes: Sequence[str]) -> Column:
    """The first entry of the ranked list alone, without sorting: ties take the higher index."""
    top = F.array_max(probs)
    last = F.size(probs) - F.array_position(F.reverse(probs), top).cast("int") + 1
    return F.when(usable(probs), F.element_at(class_array(classes), last))


def pad_ranks(ranked: Column, k: int = 3) -> Column:
    """Fill a short ranked list up to ``k`` with its first class at probability 0."""
    def filled(values: Column, filler: Column) -> Column:
        return F.slice(F.concat(values, F.array_repeat(filler, k)), 1, k)

    first = F.get(ranked, F.lit(0))["class_name"]
    return F.when(
        ranked.isNotNull(),
        F.arrays_zip(
            F.expr(f"sequence(1, {k})").alias("rank"),
            filled(ranked["class_name"], first).alias("class_name"),
            filled(ranked["probability"], F.lit(0.0)).alias("probability"),
        ),
    )


def argmax_index(probs: Column) -> Column:
    """Zero-based index of the largest probability; ties: lowest index."""
    return F.when(usable(probs), (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))


def argmax_class(probs: Column, classes: Sequence[str]) -> Column:
    return F.element_at(class_array(classes), argmax_index(probs) + 1)


def margin(ranked: Column) -> Column:
    """Difference between the two best probabilities of a ranked list."""
    return F.get(ranked, F.lit(0))["probability"] - F.get(ranked, F.lit(1))["probability"]


def class_probability(probs: Column, classes: Sequence[str], name: str) -> Column:
    """The probability of one class; null for a class the model does not know."""
    names = [str(c) for c in classes]
    return F.get(probs, F.lit(names.index(name))) if name in names else F.lit(None).cast("double")


def top_columns(ranked: Column, k: int = 3) -> list[Column]:
    """``top_1_class, top_1_prob, ...`` from a ranked list; null where the list is shorter."""
    columns = []
    for r in range(k):
        entry = F.get(ranked, F.lit(r))
        columns.append(entry["class_name"].alias(f"top_{r + 1}_class"))
        columns.append(entry["probability"].alias(f"top_{r + 1}_prob"))
    return columns
