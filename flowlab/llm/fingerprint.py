"""Document fingerprints by consistent weighted sampling, in DataFrame operations alone.

The terms of a text are its words, lower case, weighted by how often they occur. For each of SLOTS samples and each term
two gamma variates and a uniform one are read off hashes of the term; the weight is quantised to a level t on a grid that
they set, and the term with the least sampling value is chosen with its level (Ioffe's method). Two texts choose alike in
a slot with a probability equal to their generalised Jaccard similarity, sum of least weights over sum of largest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import keyed_texts
from flowlab.session import materialize

SLOTS = 64
#: Slots worked out side by side.
BLOCK = 4
_UNIT = 1 << 26


#: Steps to which the gamma variates are rounded.
_STEPS = 4096


def gamma_quantile(p: float) -> float:
    """Quantile of the gamma distribution of shape 2: solves 1 - exp(-x)(1 + x) = p by bisection."""
    lo, hi = 0.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if -math.expm1(-mid) - mid * math.exp(-mid) < p else (lo, mid)
    return (lo + hi) / 2


def _constant(values: list[float]) -> Column:
    """An array that the optimiser folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _bits(u: str, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(u, shift).bitwiseAND((1 << bits) - 1)


def _least(k: int) -> Column:
    """Least sampling value of a slot with the code of its term and level: value in the high bits, code in 16 low ones."""
    r, t = F.col(f"r{k}"), F.col(f"t{k}")
    value = ((F.col(f"c{k}") - r * (t + 1 - F.col(f"beta{k}")) + 64.0) * _UNIT).cast("long")
    code = F.pmod(F.shiftright("h", 9) + t * 40503, F.lit(65535)) + 1
    return F.min(F.shiftleft(value, 16).bitwiseOR(code)).alias(f"s{k}")


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys.., fingerprint): 4 hexadecimal digits per slot; a text without words has zeros, which no term gives.

    No exchange happens here if ``texts`` is already partitioned by some of ``keys``.
    """
    words = texts.select(*keys, F.explode_outer(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word"))
    terms = words.select(*keys, F.xxhash64(F.nullif(F.col("word"), F.lit(""))).alias("h"), (F.length("word") > 0).alias("real"))
    weighted = terms.groupBy(*keys, "h", "real").agg(F.log(F.count("*")).alias("lw"))
    # a row per term and block of slots keeps the generated code small; each step below is computed once per row
    row = [*keys, "h", F.when(F.col("real"), F.col("lw")).alias("lw")]
    rows = weighted.select(*row, F.explode(F.sequence(F.lit(0), F.lit(SLOTS // BLOCK - 1))).alias("b"))
    slots = range(BLOCK)
    rows = rows.select(*keys, "b", "h", "lw", *[F.xxhash64("h", F.col("b") * BLOCK + k).alias(f"u{k}") for k in slots])
    # the variates are quantiles; those of the sampling value are finest where it is least, by the root of their rank
    grid_of = _constant([gamma_quantile((k + 0.5) / _STEPS) for k in range(_STEPS)])
    cost_of = _constant([math.log(gamma_quantile(((k + 0.5) / _STEPS) ** 2)) for k in range(_STEPS)])
    grid = [F.get(grid_of, _bits(f"u{k}", 0, 12).cast("int")).alias(f"r{k}") for k in slots]
    cost = [F.get(cost_of, (F.sqrt(_bits(f"u{k}", 12, 24) / float(1 << 24)) * _STEPS).cast("int")).alias(f"c{k}") for k in slots]
    beta = [(_bits(f"u{k}", 36, 20) / float(1 << 20)).alias(f"beta{k}") for k in slots]
    rows = rows.select(*keys, "b", "h", "lw", *grid, *cost, *beta)
    level = [F.floor(F.col("lw") / F.col(f"r{k}") + F.col(f"beta{k}")).alias(f"t{k}") for k in slots]
    rows = rows.select(*keys, "b", "h", *[x for k in slots for x in (f"r{k}", f"c{k}", f"beta{k}")], *level)
    picked = rows.groupBy(*keys, "b").agg(*[_least(k) for k in slots])
    digits = [F.lpad(F.lower(F.hex(F.coalesce(F.col(f"s{k}"), F.lit(0)).bitwiseAND(65535))), 4, "0") for k in slots]
    blocks = picked.select(*keys, "b", F.concat(*digits).alias("d"))
    every = blocks.groupBy(*keys).agg(*[F.max(F.when(F.col("b") == b, F.col("d"))).alias(f"d{b}") for b in range(SLOTS // BLOCK)])
    return every.select(*keys, F.concat(*[f"d{b}" for b in range(SLOTS // BLOCK)]).alias("fingerprint"))


def likeness(a: str, b: str) -> Column:
    """Share of slots in which two fingerprints agree."""
    same = F.aggregate(
        F.sequence(F.lit(1), F.lit(4 * SLOTS), F.lit(4)), F.lit(0), lambda n, k: n + F.when(F.substring(a, k, F.lit(4)) == F.substring(b, k, F.lit(4)), 1).otherwise(0)
    )
    return same / float(SLOTS)


def with_neighbours(keys: DataFrame) -> DataFrame:
    """``keys`` (id, th, ..) with ``next`` and ``prev``, structs of the neighbour's columns in descending (id, th); the
    ends meet. Rows are dealt into ranges, neighbours across a border come from one row per range."""
    columns = [F.col(c) for c in keys.columns]
    dealt = keys.repartitionByRange(F.desc("id"), F.desc("th")).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    order = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("th"))
    row = F.struct(*columns)
    inside = dealt.withColumns({"next": F.lead(row).over(order), "prev": F.lag(row).over(order)})
    rank = F.struct("id", "th")
    edges = dealt.groupBy("part").agg(F.max_by(row, rank).alias("first"), F.min_by(row, rank).alias("last"))
    line = Window.orderBy("part")  # one row a range
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = edges.select(
        "part",
        F.coalesce(F.lead("first").over(line), F.first("first").over(every)).alias("after"),
        F.coalesce(F.lag("last").over(line), F.last("last").over(every)).alias("before"),
    )
    joined = inside.join(F.broadcast(borders), "part")
    return joined.select(*columns, F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev"))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last third replaced by as much of the next document's beginning, next in descending id; the
    last document's next is the first. Rows that repeat an id with another text are ordered by text hash; whole repeated
    rows are one document whose result each of them gets. Null text counts as empty. Two texts without words are alike
    (1), one without and one with words are not (0).
    """
    texts = keyed_texts(df, doc_id, text)
    keys = texts.groupBy("id", "th").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("copies"))
    related = materialize(with_neighbours(keys), "neighbours")
    one = Window.partitionBy("id", "th").orderBy("th")
    own = texts.join(related, ["id", "th"]).withColumn("line", F.row_number().over(one)).filter("line = 1")
    third = F.floor(F.col("prev.n") / 3).cast("int")
    heads = own.select(F.col("prev.id").alias("id"), F.col("prev.th").alias("th"), F.substring("text", F.lit(1), third).alias("head"))
    kept = (F.col("n") - F.floor(F.col("n") / 3)).cast("int")
    both = own.join(heads, ["id", "th"]).withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), "head"))
    facts = both.select("id", "th", "n", "copies", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"), F.sha2("edited", 256).alias("edited_sha256"))
    sides = both.select("id", "th", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x"))
    printed = fingerprints(sides.select("id", "th", "x.side", "x.t"), ["id", "th", "side"], "t")
    pair = printed.groupBy("id", "th").agg(
        F.max(F.when(F.col("side") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("side") == 1, F.col("fingerprint"))).alias("edited_fingerprint")
    )
    done = materialize(facts.join(pair, ["id", "th"]), "fingerprints")
    following = done.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("fingerprint").alias("following"))
    near = done.join(following, ["next_id", "next_th"])
    return near.select(
        "id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "following").alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
