"""Near-duplicate detection with Order MinHash.

Words are runs of letters and digits, lower case; k-mers are five words, labelled by their occurrence in the text. A
sketch takes the few k-mers that a random order puts first and keeps them in text order, so it agrees for texts that
are close in edit distance, not merely in content. Equal texts share one node; nodes that share a sketch are
candidates; a candidate pair is verified by aligning the two word sequences inside the band that the threshold allows:
similarity is 1 - (word edits) / (words of the longer text). A class is a connected component of verified pairs.

A sketch shared by many nodes never gives all pairs as rows: its components are first compared by one node each, with one
centre or pair by pair, in rounds with changing centres. Then the members that lie outside a sketch's largest component
meet all members of fitting length, however many they are: blocks of members are rows, and two blocks are compared in one
task on the signatures of their texts, a few bits a word. An edit changes two words of the bag at most, so signatures that
differ in more bits than the threshold allows rule a pair out; only what is left goes on as pairs, to be aligned. Word
hashes of a node are looked up once and sent to the tasks that need them.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import NO_ID, WORD_BYTE, hashed_words, join_keys, keep_rows, keyed_texts, mix
from flowlab.llm.components import joined_components
from flowlab.session import fresh_path, materialize

WORDS = 5
SIMILARITY = 0.8
#: k-mers kept in order by one sketch.
ORDERED = 2
#: Sketches of a text. Edits scattered over a fifth of the words leave a fifth of the k-mers in common; such a pair shares
#: one of 64 sketches with probability 0.92, a pair that shares half of its k-mers with 0.99999999.
SKETCHES = 64
#: Components of one sketch that are compared pair by pair in the centre rounds.
PAIRWISE = 12
#: Rounds of comparisons with changing centres before the members of a crowded sketch are compared.
CENTRE_ROUNDS = 3
#: Edits that are tried one by one before a pair is aligned column by column.
FEW_EDITS = 24
#: Nodes of one block, and their words, about; a task compares two blocks.
BLOCK, BLOCK_WORDS = 2048, 4_000_000
#: Bits of a signature for each word, about, and of the shortest one; lengths are powers of two.
WORD_BITS, LEAST_BITS = 4, 512
#: Numbers compared at once in a task.
COMPARED = 1 << 20
#: Candidates of one node that are aligned in the first round, and how many times as many in each further one.
FIRST, MORE = 16, 8
#: Pairs of one centre that are aligned in one place; the words of the centre are sent once for so many.
TOGETHER = 256
_odd = np.random.default_rng(11).integers(1, 2**32, SKETCHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SLICE = 1 << 15


def kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of the runs of k words; a shorter text has one k-mer of all its words, an empty one none."""
    n = len(words)
    k = min(k, n)
    if not n:
        return words
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
    return mix(total + np.uint64(k))


def occurrence_labels(x: np.ndarray) -> np.ndarray:
    """How often each value occurred before."""
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    out = np.empty(len(x), np.uint64)
    out[order] = (np.arange(len(x)) - first).astype(np.uint64)
    return out


def order_sketches(words: np.ndarray) -> np.ndarray:
    """SKETCHES values: each hashes, in text order, the ORDERED k-mers least in one random order."""
    grams = kmers(words)
    if not len(grams):
        return np.zeros(0, np.int64)
    grams = mix(grams + occurrence_labels(grams) * np.uint64(0xC2B2AE3D27D4EB4F))
    small = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.zeros((SKETCHES, 0), np.int64)
    for lo in range(0, len(grams), _SLICE):
        h = small[None, lo : lo + _SLICE] * _odd[:, None]
        row = np.arange(SKETCHES)
        found = []
        for _ in range(min(ORDERED, h.shape[1])):
            at = h.argmin(1)
            found.append(at + lo)
            h[row, at] = 0xFFFFFFFF
        best = np.concatenate([best, np.stack(found, 1)], 1)
    if len(grams) > _SLICE:
        h = small[best] * _odd[:, None]
        best = np.take_along_axis(best, np.argsort(h, 1, kind="stable")[:, :ORDERED], 1)
    placed = np.sort(best, 1)
    value = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(ORDERED)
    for j in range(placed.shape[1]):
        value = mix(value * np.uint64(0x27D4EB2F165667C5) + grams[placed[:, j]])
    return value.astype(np.int64)


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        same = a[at : min(at + step, n)] == b[at : min(at + step, n)]
        if not same.all():
            return at + int(same.argmin())
        at += len(same)
        step *= 4
    return n


def within(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the word edit distance of ``a`` and ``b`` is at most (1 - similarity) x the longer length.

    Aligns inside the band of that many diagonals: for 0, 1, 2, ... edits it keeps the furthest word reached on each. A pair
    that is not through after FEW_EDITS is aligned column by column, whose differences are the bits of two numbers.
    """
    longest = max(len(a), len(b))
    limit = int(np.floor((1 - similarity) * longest + 1e-9))
    if abs(len(a) - len(b)) > limit:
        return False
    k = _run(a, b)
    a, b = a[k:], b[k:]
    k = _run(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    n, m = len(a), len(b)
    if min(n, m) == 0:
        return max(n, m) <= limit
    names, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    bag = np.minimum(np.bincount(counts[:n], minlength=len(names)), np.bincount(counts[n:], minlength=len(names))).sum()
    if max(n, m) - bag > limit:
        return False
    band = min(limit, n + m)
    reach = np.full(2 * band + 3, -2, np.int64)  # furthest index into a on diagonal d = index - band - 1
    middle, goal = band + 1, band + 1 + n - m
    reach[middle] = 0
    diagonals = np.arange(-band - 1, band + 2)
    for edits in range(min(limit, FEW_EDITS) + 1):
        if edits:
            lo, hi = middle - edits, middle + edits + 1
            before = reach
            reach = before.copy()
            reach[lo:hi] = np.maximum(np.maximum(before[lo - 1 : hi - 1] + 1, before[lo:hi] + 1), before[lo + 1 : hi + 1])
            np.minimum(reach[lo:hi], np.minimum(n, m + diagonals[lo:hi]), out=reach[lo:hi])
        else:
            lo, hi = middle, middle + 1
        x = reach[lo:hi]
        y = x - diagonals[lo:hi]
        open_ = (x >= 0) & (y >= 0) & (x < n) & (y < m)
        hit = np.flatnonzero(open_)
        for d in hit[a[x[hit]] == b[y[hit]]].tolist():
            reach[lo + d] += _run(a[x[d] :], b[y[d] :])
        if reach[goal] >= n:
            return True
    return limit > FEW_EDITS and _distance_within(counts[:n].tolist(), counts[n:].tolist(), limit)


def _distance_within(a: list[int], b: list[int], limit: int) -> bool:
    """Whether at most ``limit`` edits make ``a`` of ``b``.

    A column of the edit table is kept as the bits where its values rise and where they fall; the last value is followed,
    and the end is near once it can no longer come down to the limit.
    """
    places: dict[int, int] = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, value, left = full, 0, len(a), len(b)
    for word in b:
        equal = places.get(word, 0)
        down = equal | falls
        across = (((equal & rises) + rises) ^ rises) | equal
        up = falls | (full ^ ((across | rises) & full))
        back = rises & across
        left -= 1
        if up & last:
            value += 1
            if value - left > limit:
                return False
        elif back & last:
            value -= 1
        up = (up << 1 | 1) & full
        rises = (back << 1 & full) | (full ^ ((down | up) & full))
        falls = up & down
    return value <= limit


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, hashes, *_ in hashed_words(pc.utf8_lower(texts), WORD_BYTE):
        yield row, hashes


def _sketched(texts: DataFrame) -> DataFrame:
    """(id, th, words, digest, sketches): digest names the word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sketches, counts = [], [], []
            for _, words in word_hashes(batch.column(2)):
                digests.append(xxhash.xxh3_128_digest(words.tobytes()))
                counts.append(len(words))
                sketches.append(order_sketches(words))
            lengths = np.cumsum([0, *map(len, sketches)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(lengths, np.concatenate(sketches) if sketches else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists],
                names=["id", "th", "words", "digest", "sketches"],
            )

    return texts.mapInArrow(run, "id long, th long, words long, digest binary, sketches array<long>")


def _shared(held: DataFrame) -> DataFrame:
    """The rows (value, node) whose value at least two nodes have. Rows are shuffled once: the search for such values
    and the join with them read the same shuffle, as both need both columns."""
    held = held.repartition("value")
    values = held.groupBy("value").agg(F.min("node").alias("least"), F.max("node").alias("largest")).filter("least < largest")
    return held.join(values.select("value"), "value")


def _bodies(texts: DataFrame) -> DataFrame:
    """(node, body): the word hashes of each text, cut to 32 bits: two different words of a pair of texts of 1,000 words
    look alike with a chance of 0.0002. Repeated rows of a node have one body; texts stay where they are. Bucketed by node:
    bodies are shuffled once, and each round's work joins them where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [words.astype(np.uint32).tobytes() for _, words in word_hashes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary())], names=["node", "body"])

    spark = texts.sparkSession
    name, parts = f"bodies_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    bodies = texts.select("node", "text").mapInArrow(run, "node long, body binary").dropDuplicates(["node"])  # deals nodes as the buckets do
    bodies.write.bucketBy(parts, "node").sortBy("node").option("path", fresh_path(spark, "bodies")).format("parquet").saveAsTable(name)
    return spark.table(name)


def _sent(work: DataFrame, bodies: DataFrame) -> DataFrame:
    """``work`` (node, ..) with each node's body: looked up once a node, then sent with each of its rows."""
    columns = [c for c in work.columns if c != "node"]
    jobs = work.groupBy("node").agg(F.collect_list(F.struct(*columns)).alias("jobs"))  # the tasks of one node
    return jobs.join(bodies, "node").select("node", "body", F.explode("jobs").alias("job")).select("node", "body", "job.*")


def _words(body: pa.Scalar) -> np.ndarray:
    return np.frombuffer(body.as_buffer(), np.uint32).astype(np.uint64)


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the pairs whose texts are similar. The rows of one centre ``a`` come one after another, its own first, so
    its words are sent once for TOGETHER pairs of it, about: rows and bytes sent grow with the pairs."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    others = pairs.join(parts, "a").select(F.col("b").alias("node"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), "parts").alias("part"), F.lit(False).alias("own"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    centres = parts.select(F.col("a").alias("node"), F.col("a").alias("centre"), each.alias("part"), F.lit(True).alias("own"))
    rows = _sent(centres.unionByName(others), bodies).repartition("centre", "part")
    rows = rows.sortWithinPartitions("centre", "part", F.desc("own")).select("node", "centre", "own", "body")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for k, (node, centre, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                body = _words(batch.column(3)[k])
                if own:
                    words = body.copy()
                elif within(words, body, similarity):
                    found.append((centre, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def _long_enough(x: Column, y: Column, similarity: float) -> Column:
    """Whether two texts of these lengths can be similar: the difference alone costs as many edits."""
    return F.abs(x - y) <= F.floor((1 - similarity) * F.greatest(x, y) + 1e-9)


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def signature(words: np.ndarray) -> np.ndarray:
    """Bits, as 64-bit numbers: for each place, whether an odd number of words, labelled by occurrence, falls on it."""
    size = max(LEAST_BITS, 1 << (WORD_BITS * len(words) - 1).bit_length()) if len(words) else LEAST_BITS
    at = mix(words + mix(occurrence_labels(words) + np.uint64(1))) & np.uint64(size - 1)
    odd = np.bincount(at.astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows) as shorter ones of ``width`` numbers would be."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _signatures(bodies: DataFrame) -> DataFrame:
    """(node, bits) of (node, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [signature(_words(b)).tobytes() for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["node", "bits"])

    return bodies.select("node", "body").mapInArrow(run, "node long, bits binary")


def _allowed(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """How many words of two similar texts of these lengths are in one of them only, at most; negative if too different."""
    longest = np.maximum(x, y)
    edits = np.floor((1 - similarity) * longest + 1e-9).astype(np.int64)
    return np.where(np.abs(x - y) > edits, -1, x + y - 2 * (longest - edits))


def _compared(similarity: float):
    """(a, b): pairs of different components between two blocks, or inside one, that their signatures do not rule out and
    that share no smaller bucket, where they meet as well."""

    def run(task: pa.Table) -> pa.Table:
        blocks, key, earlier = [], task.column("key")[0].as_py(), {}
        for members in task.column("members").to_pylist():
            by_width: dict[int, list] = {}
            for m in members:
                by_width.setdefault(len(m["bits"]) // 8, []).append(m)
                earlier[m["node"]] = frozenset(x for x in m["buckets"] if x < key)
            block = {}
            for width, some in by_width.items():
                columns = [np.array([m[c] for m in some], np.int64) for c in ("node", "comp", "words")]
                block[width] = (*columns, np.frombuffer(b"".join(m["bits"] for m in some), np.uint64).reshape(len(some), width))
            blocks.append(block)
        found = []
        for left_width, (nodes, comps, sizes, bits) in blocks[0].items():
            for right_width, (others, other_comps, other_sizes, other_bits) in blocks[-1].items():
                width = min(left_width, right_width)
                left, right = _folded(bits, width), _folded(other_bits, width)
                step = max(1, COMPARED // (width * len(others)))
                for lo in range(0, len(nodes), step):
                    part = slice(lo, lo + step)
                    allowed = _allowed(sizes[part, None], other_sizes[None], similarity)
                    maybe = (allowed >= 0) & (comps[part, None] != other_comps[None])
                    if len(blocks) == 1:
                        maybe &= nodes[part, None] < others[None]
                    x, y = np.nonzero(maybe)
                    for k in range(0, len(x), chunk := max(1, COMPARED // width)):
                        u, v = x[k : k + chunk], y[k : k + chunk]
                        differ = np.bitwise_count(left[lo + u] ^ right[v]).sum(1, dtype=np.int64)
                        near = differ <= allowed[u, v]
                        met = zip(nodes[lo + u[near]].tolist(), others[v[near]].tolist())
                        found += [pair for pair in met if earlier[pair[0]].isdisjoint(earlier[pair[1]])]
        pairs = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pairs.min(0), "b": pairs.max(0)})

    return run


def _met(members: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of different components within a bucket (key, node, comp, words) that may be similar.

    The members of a small bucket are one block. A large one is divided by length and by whether a member lies in the
    largest component, and further into blocks of about BLOCK nodes. Texts that are alike differ in length by one step at
    most, a step being a factor of 1 / similarity, so blocks of two neighbouring steps meet; two blocks of the largest
    component do not.
    """
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    tops = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    small = (F.col("n") <= BLOCK) & (F.col("w") <= BLOCK_WORDS)
    tops = tops.filter("comps > 1").select("key", F.col("top.comp").alias("top"), small.alias("small"))
    step = F.floor(F.log(F.greatest("words", F.lit(1))) / math.log(1 / similarity)).cast("int")
    rows = members.join(tops, "key").select(
        "key", "node", "comp", "words", F.when(F.col("small"), 0).otherwise(step).alias("step"), (~F.col("small") & (F.col("comp") == F.col("top"))).alias("in_top")
    )
    rows = materialize(rows, "crowded")  # read three times
    place = ["key", "step", "in_top"]
    sizes = rows.groupBy(*place).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    sizes = materialize(sizes.select(*place, F.ceil(F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_WORDS, F.lit(1))).cast("int").alias("pieces")), "sizes")
    nodes = rows.groupBy("node").agg(F.collect_list("key").alias("buckets"))  # SKETCHES at most
    signed = _signatures(bodies.join(nodes, "node", "left_semi")).join(nodes, "node")
    held = rows.join(sizes, place).withColumn("piece", F.pmod(F.xxhash64("node", "key"), F.col("pieces")).cast("int")).join(signed, "node")
    block = F.struct("in_top", "step", "piece").alias("block")
    blocks = held.groupBy("key", block).agg(F.collect_list(F.struct("node", "comp", "words", "bits", "buckets")).alias("members"))  # about BLOCK of them
    every = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("key", block)
    left, right = every.alias("x"), every.alias("y")
    fitting = (F.col("x.block") <= F.col("y.block")) & (F.abs(F.col("x.block.step") - F.col("y.block.step")) <= 1) & ~(F.col("x.block.in_top") & F.col("y.block.in_top"))
    tasks = left.join(right, "key").filter(fitting).select("key", F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    wanted = tasks.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return wanted.join(blocks, ["key", "block"]).select("key", "i", "j", "members").groupBy("key", "i", "j").applyInArrow(_compared(similarity), "a long, b long")


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``nodes`` (one row each) with their component."""
    if labels is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _links(members: DataFrame, nodes: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame | None:
    """Component label (node, comp) of every node that has a verified link; None if there is none.

    ``members`` (value, node, words) holds the sketches that at least two nodes share, ``nodes`` (node, words) the lengths
    of these nodes.
    """
    tested = labels = crowds = None
    for rounds in range(CENTRE_ROUNDS):
        if rounds:
            known = _labelled(crowds, labels).select("node", "comp", "words", F.explode("held").alias("value"))
        else:
            known = members.withColumn("comp", F.col("node"))
        # one node stands for its component in a sketch: at first the same one wherever it is met, so that a large group
        # gathers around few centres, later one that changes with the sketch
        order = F.struct(F.xxhash64(F.col("value") if rounds else F.lit(0), "node", F.lit(rounds)).alias("o"), "node", "words")
        reps = known.groupBy("value", "comp").agg(F.min(order).alias("rep"))
        reps = materialize(reps.select("value", "rep.*"), "representatives")
        sizes = reps.groupBy("value").agg(F.count("*").alias("comps"), F.min(F.struct("o", "node", "words")).alias("centre")).filter("comps > 1")
        sizes = sizes.select("value", "comps", F.col("centre.node").alias("centre"), F.col("centre.words").alias("centre_words"))
        open_ = materialize(reps.join(sizes, "value").drop("o"), "open")
        few = open_.filter(F.col("comps") <= PAIRWISE)
        paired = few.alias("x").join(few.alias("y"), "value").filter("x.node < y.node").filter(_long_enough(F.col("x.words"), F.col("y.words"), similarity))
        pairs = paired.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        starred = open_.filter((F.col("comps") > PAIRWISE) & (F.col("node") != F.col("centre"))).filter(_long_enough(F.col("words"), F.col("centre_words"), similarity))
        pairs = pairs.union(starred.select(*_ordered(F.col("node"), F.col("centre")))).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        new = materialize(_verified(pairs, bodies, similarity), "links")
        tested = pairs if tested is None else tested.union(pairs)
        linked = not new.isEmpty()
        if linked:
            labels = joined_components(labels, new)
        if not rounds:  # of a sketch of few nodes all pairs are compared by now; all members of the others go on
            crowded = members.groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") > PAIRWISE).select("value")
            held = members.join(crowded, "value").groupBy("node").agg(F.collect_list("value").alias("held"))  # SKETCHES at most
            crowds = materialize(held.join(nodes, "node"), "crowds")
            if crowds.isEmpty():
                return labels
        if not linked:
            break
    rows = materialize(_labelled(crowds, labels).select("node", "comp", "words", F.explode("held").alias("key")), "members")
    return _closed(_met(rows, bodies, similarity), labels, bodies, similarity)


def _closed(candidates: DataFrame, labels: DataFrame | None, bodies: DataFrame, similarity: float) -> DataFrame | None:
    """``labels`` (node, comp) after all similar pairs of ``candidates`` (a, b) are joined. Some of each node are aligned
    first, then more, but for those that were joined meanwhile."""
    left, most = materialize(candidates.distinct(), "candidates"), FIRST
    while not left.isEmpty():
        ranked = left.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b")))
        ranked = materialize(ranked.select("a", "b", (F.col("place") <= most).alias("now")), "ranked")
        new = materialize(_verified(ranked.filter("now").select("a", "b"), bodies, similarity), "links")
        left = ranked.filter("NOT now").select("a", "b")
        if not new.isEmpty():
            labels = joined_components(labels, new)
        if labels is not None:
            for end in ("a", "b"):
                left = left.join(labels.select(F.col("node").alias(end), F.col("comp").alias(f"comp_{end}")), end, "left")
            left = left.filter("comp_a IS NULL OR comp_b IS NULL OR comp_a <> comp_b").select("a", "b")
        left, most = materialize(left, "candidates"), most * MORE
    return labels


def near_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: (id, th, class_id, class_size, kept).

    class_id is the smallest id of the class (null last) and belongs to the row that is kept. Equal word sequences are
    one class, so all texts without words (null, empty, signs only) are one; a text of fewer than five words is near
    only its copies. Repeated rows belong to one class, one of them is kept. An empty table gives no rows.
    """
    texts = keyed_texts(df, doc_id, text)
    base = materialize(_sketched(texts).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    rank = F.struct(F.col("id") == NO_ID, "id", "uid")
    nodes = materialize(base.groupBy("digest").agg(F.min("uid").alias("node"), F.min(rank).alias("first"), F.count("*").alias("copies")), "nodes")
    own = base.join(nodes.select(F.col("node").alias("uid")), "uid", "left_semi")
    held = _shared(own.select(F.explode("sketches").alias("value"), F.col("uid").alias("node")))
    members = materialize(held.join(own.select(F.col("uid").alias("node"), "words"), "node").select("value", "node", "words"), "members")
    some = own.join(members.select(F.col("node").alias("uid")).distinct(), "uid", "left_semi").select("id", "th", F.col("uid").alias("node"))
    lengths = own.join(members.select(F.col("node").alias("uid")).distinct(), "uid", "left_semi").select(F.col("uid").alias("node"), "words")
    labels = _links(members, lengths, _bodies(join_keys(texts, some)), similarity)
    classed = nodes.withColumn("comp", F.col("node")) if labels is None else nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classed = materialize(classed.select("digest", "comp", "first", "copies"), "classes")
    heads = classed.groupBy("comp").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    out = base.select("id", "th", "uid", "digest").join(classed.select("digest", "comp"), "digest").join(heads, "comp")
    return out.select("id", "th", F.col("head.id").alias("class_id"), "class_size", (F.col("head.uid") == F.col("uid")).alias("kept"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each class of near copies; columns unchanged."""
    return keep_rows(df, near_classes(df, doc_id, text).filter("kept"), doc_id, text, once=True)
