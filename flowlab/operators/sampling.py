"""Exact, reproducible sampling, splitting and label permutation without a global sort.

Rows are ordered by a uniform hexadecimal key (``functions.keys.order_key``). An exact rank is found by digits:
count rows per leading four digits (at most 65,536 counts per group, combined map-side), locate the bucket that
holds the rank, and look only inside that bucket with four more digits. The result is a key to compare with, so
the rows themselves are filtered in place and never sorted or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.functions.keys import content_key, order_key
from flowlab.operators.small import pin
from flowlab.operators.support import class_table
from flowlab.schema import LABEL, labelled, quoted, ticked

# Leading digits counted by successive rounds. Eight digits split any table into buckets of a few distinct keys, so
# whole keys come next. The second half is the row content, used only where different rows share one key.
LEVELS = (4, 8, 32, 36, 40, 64)
KEY_DIGITS, CONTENT_DIGITS = 32, 64
EDGE_ROWS = 1_000_000
#: Cuts kept as a local table and sent to every executor; more are joined by shuffle, with the same rows.
PINNED_CUTS = 100_000
COPIES_PER_CHUNK = 100_000


def _histogram(keyed: DataFrame, groups: Sequence[str], length: int) -> DataFrame:
    """Rows per group and leading ``length`` digits, with the count before and through each bucket."""
    counts = keyed.groupBy(*groups, F.substring("_key", 1, length).alias("_bucket")).agg(F.count("*").alias("_n"))
    running = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_bucket"))
    return counts.withColumn("_through", running).withColumn("_before", running - F.col("_n"))


def capped_sample(
    df: DataFrame,
    group: str,
    cap: int,
    *,
    seed: int,
    key_columns: Sequence[str],
    edge_rows: int | None = None,
) -> DataFrame:
    """At most ``cap`` rows of every group: those with the smallest order keys; smaller groups stay whole.

    First pass: counts per (group, four key digits) give each group's last needed bucket. Second pass: rows up to
    that bucket, about ``cap`` per group, are kept behind a filter, and only those are ranked, per bucket; a last bucket of
    more than ``edge_rows`` (EDGE_ROWS) rows is counted by further digits first. A sample of more than ``edge_rows`` rows ranks
    only buckets that are partly needed; its other rows stay where they are. Exact
    copies are counted, not ranked, so a bucket filled by one repeated row stays one entry.
    """
    keyed = df.where(quoted(group).isNotNull()).withColumn("_key", order_key(seed, key_columns))
    edge_rows = EDGE_ROWS if edge_rows is None else edge_rows

    def edges(prefix: DataFrame, length: int) -> DataFrame:
        last = F.max_by(F.struct("_bucket", "_before", "_n"), "_before").alias("_edge")
        return (
            prefix.where(F.col("_before") < cap)
            .groupBy(group)
            .agg(last)
            .select(group, "_edge._bucket", "_edge._before", "_edge._n")
        )

    length = LEVELS[0]
    cuts, small = pin(edges(_histogram(keyed, [group], length), length), PINNED_CUTS)
    too_large = (F.col("_n") > edge_rows) & (F.col("_before") + F.col("_n") > cap)  # and only partly needed
    while length < CONTENT_DIGITS and not cuts.where(too_large).isEmpty():
        # A bucket too large to rank in one task: look inside it with more digits. The cuts stay a table, whatever the
        # number of groups.
        if length == KEY_DIGITS:
            keyed = keyed.withColumn("_key", F.concat("_key", content_key(df)))
        outer = cuts.select(group, F.col("_bucket").alias("_in"), F.col("_before").alias("_base"))
        inside = keyed.join(F.broadcast(outer) if small else outer, group).where(F.col("_key").startswith(F.col("_in")))
        length = _next_level(length)
        finer = _histogram(inside, [group, "_base"], length).withColumn("_before", F.col("_before") + F.col("_base"))
        cuts, small = pin(edges(finer, length), PINNED_CUTS)

    columns = [ticked(c) for c in df.columns]
    room = F.lit(cap) - F.col("_before")
    cut = cuts.select(group, F.col("_bucket").alias("_last"), room.alias("_room"), (room < F.col("_n")).alias("_partly"))
    prefix = F.substring("_key", 1, length)
    near = keyed.join(F.broadcast(cut) if small else cut, group).where(prefix <= F.col("_last"))
    ranked, sure = near, (prefix < F.col("_last")) | ~F.col("_partly")
    large = (cuts.agg(F.sum(F.least(F.col("_before") + F.col("_n"), F.lit(cap)))).first()[0] or 0) > edge_rows
    if large:
        whole, ranked = near.where(sure).select(*columns), near.where(~sure)
        if cut.where("_partly").isEmpty():
            return whole
    copies = ranked.groupBy(*columns, "_key", "_last", "_room").agg(F.count("*").alias("_n"))
    bucket = Window.partitionBy(group, F.substring("_key", 1, length)).orderBy("_key", content_key(df))
    rows_before = F.sum("_n").over(bucket.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    room = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_room") - F.col("_before_here")))
    keep = F.when(prefix < F.col("_last"), F.col("_n")).otherwise(room)
    kept = copies.withColumn("_before_here", rows_before).withColumn("_keep", keep.cast("int")).where("_keep > 0")
    kept = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_keep")))).select(*columns)
    return whole.union(kept) if large else kept


def _next_level(length: int) -> int:
    return next(level for level in LEVELS if level > length)


def balanced_sample(
    df: DataFrame,
    *,
    label: str = LABEL,
    max_per_label: int = 20_000,
    seed: int = 42,
    key_columns: Sequence[str],
) -> DataFrame:
    """Label-balanced sample of the rows with a known label."""
    return capped_sample(labelled(df, label), label, max_per_label, seed=seed, key_columns=key_columns)


def family_capped_sample(
    df: DataFrame,
    *,
    family: str = "family",
    max_per_family: int = 80_000,
    seed: int = 1,
    key_columns: Sequence[str],
) -> DataFrame:
    return capped_sample(df, family, max_per_family, seed=seed, key_columns=key_columns)


@dataclass(frozen=True)
class KeyCut:
    """The first ``rank`` rows are those with key below ``key``, plus ``room`` of the rows equal to it.

    ``room`` is 0 unless several rows share one whole key.
    """

    rank: int
    key: str
    room: int


def _first_level(keyed: DataFrame) -> tuple[list[str], np.ndarray]:
    """Sorted leading digits and the row count through each: at most 65,536 entries, whatever the table size."""
    counts = keyed.groupBy(F.substring("_key", 1, LEVELS[0]).alias("_bucket")).agg(F.count("*").alias("_n"))
    table = counts.orderBy("_bucket").toArrow()
    return table["_bucket"].to_pylist(), np.cumsum(table["_n"].to_numpy())


def key_cuts(
    keyed: DataFrame, ranks: Callable[[int], Sequence[int]], digits: int = KEY_DIGITS
) -> tuple[list[KeyCut], int]:
    """Locate exact ranks in the order of ``_key``; ``ranks`` derives them from the row count, returned as well.

    The first round counts rows per leading digits, which also gives the row count. Each further round counts inside the
    buckets that hold a wanted rank and returns one row per rank: two rounds as a rule, three at most for unique keys.
    """
    buckets, through = _first_level(keyed)
    total = int(through[-1]) if len(through) else 0
    wanted = [int(r) for r in ranks(total)]
    found: dict[int, KeyCut] = {}
    open_ranks: dict[int, tuple[str, int]] = {}

    def settle(rank: int, bucket: str, left: int, size: int, length: int) -> None:
        if left == size:  # the cut falls right behind this bucket
            found[rank] = KeyCut(rank, bucket + "~", 0)
        elif length >= digits:
            found[rank] = KeyCut(rank, bucket, left)
        else:
            open_ranks[rank] = (bucket, left)

    for rank in set(wanted):
        if rank <= 0:
            found[rank] = KeyCut(rank, "", 0)
        elif rank >= total:
            found[rank] = KeyCut(rank, "~", 0)
        else:
            at = int(np.searchsorted(through, rank))
            before = int(through[at - 1]) if at else 0
            settle(rank, buckets[at], rank - before, int(through[at]) - before, LEVELS[0])

    length = LEVELS[0]
    while open_ranks:
        targets = keyed.sparkSession.createDataFrame(
            [(rank, prefix, left) for rank, (prefix, left) in open_ranks.items()],
            "_rank long, _head string, _left long",
        )
        heads = sorted({prefix for prefix, _ in open_ranks.values()})
        head = F.substring("_key", 1, length)
        length = _next_level(length)
        inside = keyed.select("_key", head.alias("_head")).where(F.col("_head").isin(heads))
        located = (
            _histogram(inside, ["_head"], length)
            .join(F.broadcast(targets), "_head")  # one row per open rank
            .where((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_through")))
            .select("_rank", "_bucket", (F.col("_left") - F.col("_before")).alias("_left"), "_n")
            .collect()
        )
        open_ranks.clear()
        for hit in located:
            settle(hit["_rank"], hit["_bucket"], hit["_left"], hit["_n"], length)
    return [found[rank] for rank in wanted], total


def _cuts_with_content(df: DataFrame, seed: int, key_columns: Sequence[str], ranks: Callable[[int], Sequence[int]]):
    """Key cuts; when a cut falls among rows sharing a whole key, the row content extends the key."""
    key = order_key(seed, key_columns)
    cuts, total = key_cuts(df.select(key.alias("_key")), ranks)
    if any(c.room for c in cuts):
        key = F.concat(key, content_key(df))
        cuts, total = key_cuts(df.select(key.alias("_key")), ranks, digits=CONTENT_DIGITS)
    return key, cuts, total


def _some_copies(exact: DataFrame, first: int, last: int) -> DataFrame:
    """Copies ``first`` (exclusive) to ``last`` of rows that are all alike, made anew in parallel chunks."""
    columns = [ticked(c) for c in exact.columns]
    one = exact.groupBy(*columns).agg(F.count("*").alias("_n"))
    upto = F.least(F.lit(last), F.col("_n"))
    starts = F.sequence(F.lit(first), upto - 1, F.lit(COPIES_PER_CHUNK))
    chunks = (
        one.where(upto > first)
        .withColumn("_upto", upto)
        .withColumn("_from", F.explode(starts))
        .repartition("_from")
    )
    size = F.least(F.lit(COPIES_PER_CHUNK), F.col("_upto") - F.col("_from"))
    return chunks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size))).select(*columns)


def split_train_val(
    df: DataFrame,
    val_frac: float = 0.15,
    *,
    seed: int = 42,
    key_columns: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """Shuffled split: the first ``int(n * (1 - val_frac))`` rows by order key train, the rest validate.

    Both sides are plain filters on the order key. ``key_columns`` should identify a row; copies that share the key at
    the cut are divided exactly by count.
    """
    key, (cut,), total = _cuts_with_content(df, seed, key_columns, lambda n: [int(n * (1.0 - val_frac))])
    keyed = df.withColumn("_key", key)
    train, val = keyed.where(F.col("_key") < cut.key), keyed.where(F.col("_key") >= cut.key)
    if not cut.room:
        return train.drop("_key"), val.drop("_key")
    same = keyed.where(F.col("_key") == cut.key).drop("_key")
    after = keyed.where(F.col("_key") > cut.key).drop("_key")
    train = train.drop("_key").unionByName(_some_copies(same, 0, cut.room))
    val = after.unionByName(_some_copies(same, cut.room, total))
    return train, val


def with_split(
    df: DataFrame,
    val_frac: float = 0.15,
    *,
    seed: int = 42,
    key_columns: Sequence[str],
    column: str = "split",
) -> DataFrame:
    """The same split as one table with a ``TRAIN`` / ``VAL`` column: one pass after the counts."""
    key, cuts, _ = _cuts_with_content(df, seed, key_columns, lambda n: [int(n * (1.0 - val_frac))])
    return _dealt_out(df.withColumn("_key", key), ["TRAIN", "VAL"], cuts, column)


def with_splits(
    df: DataFrame, shares: Mapping[str, float], *, seed: int = 42, key_columns: Sequence[str], column: str = "split"
) -> DataFrame:
    """Any number of splits by order key, in the order of ``shares``, as one table with a column of their names.

    Split k ends behind row ``int(n * (sum of the first k shares))``, the last one takes the rest. All boundaries come from
    one search for ranks, and the table is read once after it.
    """
    names, ends, total = list(shares), [], 0.0
    for name in names[:-1]:
        total += shares[name]
        ends.append(total)
    key, cuts, _ = _cuts_with_content(df, seed, key_columns, lambda n: [int(n * end) for end in ends])
    return _dealt_out(df.withColumn("_key", key), names, cuts, column)


def permute_labels(
    df: DataFrame,
    *,
    label: str = LABEL,
    seed: int = 42,
    key_columns: Sequence[str],
    column: str | None = None,
) -> DataFrame:
    """Replace the label by a uniformly random permutation of all labels; features stay in place.

    Ranks follow a random order key, so dealing the sorted labels out along the ranks is a random permutation.
    Only one boundary key per label is needed and no row moves. Every label keeps its exact count; a boundary that falls
    among rows with one shared key is resolved by content, and exact copies there are divided by count.
    """
    table = class_table(df, label)
    ranks, total = [], 0
    for _, support in table[:-1]:
        total += support
        ranks.append(total)
    known = labelled(df, label)
    key, cuts, _ = _cuts_with_content(known, seed, key_columns, lambda _: ranks)
    return _dealt_out(known.withColumn("_key", key), [name for name, _ in table], cuts, column or label)


def _dealt_out(keyed: DataFrame, names: Sequence[str], cuts: Sequence[KeyCut], target: str) -> DataFrame:
    """``keyed`` without its ``_key``, and in ``target`` the name of the stretch between cuts that each row falls into: one
    expression over the key. Only rows that share a whole key at a cut are divided by count, in parts of their own."""
    shared = sorted({c.key for c in cuts if c.room})
    apart = keyed.where(~F.col("_key").isin(shared)) if shared else keyed
    dealt = apart.withColumn(target, _dealt(names, cuts)).drop("_key")
    for value in shared:
        same = keyed.where(F.col("_key") == value).drop("_key")
        rooms = [c.room for c in cuts if c.key == value]
        first = sum(1 for c in cuts if c.key < value)
        bounds = [0, *rooms, 2**62]
        for offset, (lower, upper) in enumerate(zip(bounds, bounds[1:])):
            part = _some_copies(same, lower, upper)
            dealt = dealt.unionByName(part.withColumn(target, F.lit(names[first + offset])))
    return dealt


def _dealt(names: Sequence[str], cuts: Sequence[KeyCut]) -> Column:
    if not cuts:
        return F.lit(names[0])
    chosen = F.when(F.col("_key") < cuts[0].key, names[0])
    for name, cut in zip(names[1:], cuts[1:]):
        chosen = chosen.when(F.col("_key") < cut.key, name)
    return chosen.otherwise(names[-1])
