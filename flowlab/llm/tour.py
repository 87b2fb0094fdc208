"""Ranking of linked lists: sums of weights from every element to the end of its list, block by block.

Elements have numbers; those of one block of consecutive numbers are ranked together in one task, so every run of links
inside a block shrinks to one link. The runs' heads are numbered anew, without gaps, and form a shorter list, which is
ranked in the same way; the results are then added back level by level. Where numbers say so little about the order that a
level shrinks to less than half, every fourth element or so is drawn as a ruler and the others jump, doubling, to the
next ruler. No task holds more than a block, whatever the lists look like.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.operators.small import small_side
from flowlab.session import materialize

#: Elements of one block.
BLOCK = 16_384
#: One element in so many is a ruler.
RULERS = 4


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with its rows' places, from 0 without gaps, in ``number``: by the columns of ``order``, whose rows are dealt by
    range and sorted there, or any order if none is given."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(df.withColumn("position", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("part", F.shiftright("position", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row per partition
    offsets = small_side(sizes.select("part", before.alias("before")))
    local = F.col("position").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(offsets, "part").withColumn("number", F.col("before") + local).drop("position", "part", "before")


def _walked(weights: Sequence[str]):
    """Ranks one block: (element, next, weights) gives (element, target, sums up to the target, head)."""

    def run(part: pa.Table) -> pa.Table:
        element = part.column("element").to_numpy()
        order = np.argsort(element)
        element = element[order]
        after = part.column("next").fill_null(-1).to_numpy()[order]
        at = np.minimum(np.searchsorted(element, after), len(element) - 1)
        jump = np.where(element[at] == after, at, -1)
        head = np.ones(len(element), bool)
        head[jump[jump >= 0]] = False
        sums = [part.column(w).to_numpy()[order].copy() for w in weights]
        last = np.arange(len(element))
        while True:
            live = np.flatnonzero(jump >= 0)
            if not len(live):
                break
            to = jump[live]
            for s in sums:
                s[live] += s[to]
            last[live] = last[to]
            jump[live] = jump[to]
        target = after[last]
        columns = [pa.array(element), pa.array(target, mask=target < 0), *map(pa.array, sums), pa.array(head), pa.array(np.cumsum(head) - 1)]
        return pa.table(columns, names=["element", "target", *weights, "head", "place"])

    return run


def _by_blocks(links: DataFrame, weights: Sequence[str], block: int) -> DataFrame:
    """(element, target, sums, head, number): number counts the heads from 0 over all blocks."""
    schema = f"element long, target long, {', '.join(f'{w} long' for w in weights)}, head boolean, place long"
    numbered = links.withColumn("block", F.floor(F.col("element") / block))
    walked = numbered.groupBy("block").applyInArrow(_walked(weights), schema)
    walked = materialize(walked.withColumn("block", F.floor(F.col("element") / block)), "walked")
    heads = walked.groupBy("block").agg(F.count_if("head").alias("heads"))
    before = F.sum("heads").over(Window.orderBy("block")) - F.col("heads")  # one row per block
    offsets = heads.select("block", before.alias("before"))
    return walked.join(offsets, "block").withColumn("number", F.when(F.col("head"), F.col("before") + F.col("place"))).drop("block", "before", "place")


def _by_rulers(links: DataFrame, weights: Sequence[str], level: int) -> DataFrame:
    """As ``_by_blocks``, with rulers for heads; numbers are those of the rulers' order, from 0."""
    ruler = F.pmod(F.xxhash64("element", F.lit(level)), F.lit(RULERS)) == 0
    state = materialize(links.select("element", F.col("next").alias("target"), *weights, ruler.alias("head")), "rulers")
    while True:
        ruled = F.pmod(F.xxhash64("target", F.lit(level)), F.lit(RULERS)) == 0
        going = F.col("target").isNotNull() & ~ruled
        if state.filter(going).isEmpty():
            break
        to = state.select(F.col("element").alias("target"), F.col("target").alias("further"), *[F.col(w).alias(f"more_{w}") for w in weights])
        moved = state.filter(going).join(to, "target").select(
            "element", F.col("further").alias("target"), *[(F.col(w) + F.col(f"more_{w}")).alias(w) for w in weights], "head"
        )
        state = materialize(state.filter(~going).union(moved), "rulers")
    numbers = numbered(state.filter("head").select("element")).select("element", "number")
    return state.join(numbers, "element", "left")


def ranked(links: DataFrame, weights: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(element, weights): each weight summed from the element, included, to the end of its list.

    ``links`` (element, next, weights) has the elements 0 .. n - 1, each followed by at most one and following at most
    one; ``next`` is null at the end of a list. Weights are longs.
    """
    levels = []
    links = materialize(links.select("element", "next", *weights), "links")
    size = links.count()
    by_rulers = False
    while True:
        done = _by_rulers(links, weights, len(levels)) if by_rulers else _by_blocks(links, weights, block)
        done = materialize(done, "level")
        levels.append(done)
        heads = done.filter("number IS NOT NULL").count()
        if done.filter("target IS NOT NULL").isEmpty():
            break
        by_rulers = not by_rulers and 2 * heads > size
        size = heads
        shorter = done.filter("number IS NOT NULL")
        numbers = shorter.select(F.col("element").alias("target"), F.col("number").alias("next"))
        links = materialize(shorter.select(F.col("number").alias("element"), "target", *weights).join(numbers, "target", "left").select("element", "next", *weights), "links")
    solved = levels.pop().select("element", *weights)
    while levels:
        done = levels.pop()
        rest = solved.select(F.col("element").alias("up"), *[F.col(w).alias(f"more_{w}") for w in weights])
        heads = done.filter("number IS NOT NULL").select(F.col("element").alias("target"), F.col("number").alias("up")).join(rest, "up").drop("up")
        summed = [(F.col(w) + F.coalesce(f"more_{w}", F.lit(0))).alias(w) for w in weights]
        solved = materialize(done.join(heads, "target", "left").select("element", *summed), "ranked")
    return solved
