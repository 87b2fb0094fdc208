"""The trie of conversation prefixes, its subtrees summed along an Euler tour.

Every conversation is rebuilt: the first turns of its hundred's first conversation, then its own. A prefix is named by
two running sums (exclusive or) of hashes of place and turn, so prefixes are found without following the turns one after
another, and nodes are groups of equal names. Each node gives two arcs, one into it and one out of it; an arc into a
node leads into its first child, else out again, an arc out leads into the next sibling, else out of the parent. The
tour is ranked as a linked list (``tour``), and what a subtree holds is the difference of the sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.tour import BLOCK, numbered, ranked
from flowlab.session import materialize

#: Conversations of one hundred share their first one's turns, fewer than this many.
HUNDRED, SHARED = 100, 6
#: Turns whose names are summed in one piece.
PIECE = 4096
#: Conversation numbers written in one piece.
IDS = 8192


def _turns(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, rank, digest, chars): the turns in order, counted from 0 in their conversation."""
    who, said = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)
    turns = df.select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(digest).alias("digest"), F.length(said).cast("long").alias("chars"))
    placed = numbered(turns.filter("conv IS NOT NULL"), F.asc("conv"), F.asc_nulls_first("turn"), F.asc("digest"))
    starts = placed.groupBy("conv").agg(F.min("number").alias("start"))
    return materialize(placed.join(starts, "conv").select("conv", (F.col("number") - F.col("start")).alias("rank"), "digest", "chars"), "turns")


def _conversations(turns: DataFrame) -> DataFrame:
    """(conv, base, shared, taken, turns): shared turns asked of the base conversation, those it has, and all after rebuilding."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    own = sizes.select(
        "conv", "n", (F.col("conv") - F.col("conv") % HUNDRED).alias("base"), (F.crc32(F.col("conv").cast("string")) % SHARED).alias("shared")
    )
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("shared", F.coalesce("base_n", F.lit(0)))
    joined = own.join(base, "base", "left").withColumn("taken", taken)
    return materialize(joined.select("conv", "base", "shared", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).alias("turns")), "conversations")


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, at, digest, chars): the rebuilt conversations' turns, counted from 0."""
    own = turns.join(convs, "conv").filter("rank >= shared").select("conv", (F.col("taken") + F.col("rank") - F.col("shared")).alias("at"), "digest", "chars")
    first = turns.filter(F.col("rank") < SHARED - 1).withColumnRenamed("conv", "base")
    lent = first.join(convs, "base").filter("rank < shared").select("conv", F.col("rank").alias("at"), "digest", "chars")
    return own.unionByName(lent)


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars): the name of every prefix and of the one before it."""
    hashed = rebuilt.withColumns({"x1": F.xxhash64(F.lit(1), "at", "digest"), "x2": F.xxhash64("digest", "at", F.lit(2)), "piece": F.floor(F.col("at") / PIECE)})
    hashed = materialize(hashed.drop("digest"), "rebuilt")
    along = Window.partitionBy("conv", "piece").orderBy("at")
    inner = hashed.withColumns({"k1": F.bit_xor("x1").over(along), "k2": F.bit_xor("x2").over(along)})
    long = hashed.filter("piece > 0").select("conv").distinct()
    pieces = hashed.join(long, "conv", "left_semi").groupBy("conv", "piece").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    earlier = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row per PIECE turns
    carried = pieces.select("conv", "piece", F.bit_xor("t1").over(earlier).alias("c1"), F.bit_xor("t2").over(earlier).alias("c2"))
    joined = inner.join(carried, ["conv", "piece"], "left")
    for k in ("1", "2"):
        joined = joined.withColumn(f"k{k}", F.col(f"k{k}").bitwiseXOR(F.coalesce(f"c{k}", F.lit(0))))
    return joined.select(
        "conv", (F.col("at") + 1).alias("depth"), "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "chars"
    )


def _hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; only the running state is held."""
    node, state, out = None, None, []
    for batch in batches:
        for v, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
            if v != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = v, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.string())], names=["v", "ends_sha256"])
            out = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["v", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(v, ends_sha256) of (v, conv): the numbers in order, comma-joined piece by piece."""
    placed = numbered(ends, "v", "conv").withColumn("piece", F.floor(F.col("number") / IDS))
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))  # at most IDS of them
    pieces = placed.groupBy("v", "piece").agg(F.array_join(ids, ",").alias("ids"))
    return pieces.repartition("v").sortWithinPartitions("v", "piece").select("v", "ids").mapInArrow(_hashed_runs, "v long, ends_sha256 string")


def _arcs(nodes: DataFrame, kids: DataFrame, siblings: DataFrame) -> DataFrame:
    """(element, next, steps, leaves, saved): arc 2v leads into node v, arc 2v + 1 out of it."""
    v, into, out = F.col("v"), (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    known = nodes.join(kids, "v", "left").join(siblings, "v", "left")

    def arc(element: Column, after: Column, leaves: Column, saved: Column) -> Column:
        return F.struct(element.alias("element"), after.alias("next"), F.lit(1).cast("long").alias("steps"), leaves.cast("long").alias("leaves"), saved.cast("long").alias("saved"))

    enter = arc(v * 2, F.coalesce(into("first_child"), out("v")), F.col("first_child").isNull(), (F.col("n_convs") - 1) * F.col("chars"))
    leave = arc(v * 2 + 1, F.coalesce(into("sibling"), out("pv")), F.lit(0), F.lit(0))
    return known.select(F.explode(F.array(enter, leave)).alias("a")).select("a.*")


def prefix_trie(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, block: int = BLOCK
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, n_nodes
    (nodes of the subtree).

    Turns are taken by number, null first, those of one number by digest of role and text. Null roles and texts are
    empty; rows without conv_id belong to no conversation and are left out; repeated rows are turns of their own; an
    empty table gives no rows. Only the four named columns are read. Conversations of any length: turns are placed by
    range, named in pieces and ranked in blocks, so none is held whole.
    """
    turns = _turns(df, conv_id, turn, role, text)
    convs = _conversations(turns)
    members = materialize(_prefixes(_rebuilt(turns, convs)), "members")
    name = ["depth", "k1", "k2"]
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("chars"))
    nodes = members.unionByName(root).groupBy(*name).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    nodes = numbered(nodes, "conv_id", "depth").withColumnRenamed("number", "v")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("v").alias("pv"), F.col("conv_id").alias("parent_conv_id"))
    nodes = materialize(nodes.join(above, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "nodes")
    children = nodes.filter("pv IS NOT NULL").select("pv", "v")
    kids = materialize(children.groupBy("pv").agg(F.count("*").alias("n_children"), F.min("v").alias("first_child")).withColumnRenamed("pv", "v"), "kids")
    row = numbered(children, "pv", "v")
    after = row.select((F.col("number") - 1).alias("number"), F.col("pv").alias("same"), F.col("v").alias("sibling"))
    siblings = row.join(after, "number").filter("pv = same").select("v", "sibling")
    weights = ["steps", "leaves", "saved"]
    sums = ranked(_arcs(nodes, kids.select("v", "first_child"), siblings), weights, block)
    sign = F.when(F.col("element") % 2 == 0, 1).otherwise(-1)
    subtree = sums.groupBy(F.floor(F.col("element") / 2).alias("v")).agg(*[F.sum(F.col(w) * sign).alias(w) for w in weights])
    last = convs.select("conv", F.col("turns").alias("depth"))
    stops = members.select("conv", *name).unionByName(root.select("conv", *name)).join(last, ["conv", "depth"])
    ends = _ends(stops.join(nodes.select(*name, "v"), name).select("v", "conv"))
    out = nodes.join(kids.select("v", "n_children"), "v", "left").join(subtree, "v").join(ends, "v", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        F.floor((F.col("steps") + 1) / 2).alias("n_nodes"),
    )


#: The same in DuckDB SQL, over the view ``conversations``: prefixes as lists, subtrees by joining every node to the
#: prefixes of its smallest member.
SQL_TRIE = rf"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b FROM range(0, 256) AS r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS rank,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, encode(conv_id::VARCHAR) AS s FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, n, conv_id - conv_id % {HUNDRED} AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(s)) // 2), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {SHARED} AS h
  FROM sizes, crc),
rebuilt AS (
  SELECT c.conv_id, coalesce(least(h, b.n), 0) + t.rank - h AS spot, said
  FROM hashed AS c LEFT JOIN sizes AS b ON b.conv_id = c.base JOIN turns AS t ON t.conv_id = c.conv_id AND t.rank >= h
  UNION ALL
  SELECT c.conv_id, t.rank, said FROM hashed AS c JOIN turns AS t ON t.conv_id = c.base AND t.rank < h),
listed AS (SELECT conv_id, list(said ORDER BY spot) AS l FROM rebuilt GROUP BY conv_id),
conv AS (SELECT conv_id, coalesce(l, []) AS l FROM hashed LEFT JOIN listed USING (conv_id)),
prefix AS (SELECT conv_id, d, l[1:d] AS p, len(l) AS n FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM conv)),
node AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[d].text) END AS own
  FROM prefix GROUP BY d, p),
place AS (SELECT x.conv_id AS member, node.d, node.conv_id FROM prefix AS x JOIN node USING (d, p)),
tree AS (
  SELECT node.conv_id, node.d, n_convs, own, ends_sha256, place.conv_id AS parent
  FROM node LEFT JOIN place ON place.member = node.conv_id AND place.d = node.d - 1),
kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM tree WHERE parent IS NOT NULL GROUP BY ALL),
below AS (
  SELECT place.conv_id, place.d, sum(own) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves, count(*) AS nodes
  FROM tree LEFT JOIN kids USING (conv_id, d) JOIN place ON place.member = tree.conv_id AND place.d <= tree.d GROUP BY ALL)
SELECT tree.conv_id, tree.d::BIGINT AS depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends_sha256, nodes AS n_nodes
FROM tree LEFT JOIN kids USING (conv_id, d) JOIN below USING (conv_id, d)"""
