"""Substring deduplication: words of passages that already stand in a document with a smaller id are removed.

A window is WINDOW consecutive words. Its anchor is the least hash of the GRAM-word runs in it, so equal windows have
equal anchors, and neighbouring windows mostly share one: a segment is a run of windows with one anchor. Steps:

1. Anchors that occur in several documents are found from packed number arrays. An anchor that a batch already sees in
   two documents is settled there and sent on once, so a frequent passage costs one entry a batch.
2. Segments with such anchors go to the shard of their anchor; equal segments collapse to one with the smallest id.
   A crowded anchor's segments are dealt out window by window instead.
3. A shard builds a compressed FM-index over its segments and streams them through it: backward search gives each
   window's matching statistics, and where a match reaches WINDOW words, the smallest document id of its occurrences.
4. These go back to the documents of the segment, which drop the words of windows first seen in a smaller id.

Hashes only choose where to look: words are compared as they are in step 3.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import NOT_SPACE, free_name, hashed_words, join_keys, mix
from flowlab.llm.fmindex import FmIndex
from flowlab.session import fresh_path, materialize

WINDOW = 13
GRAM = 5
#: Anchors handled by one task of step 1, and segments by one shard of step 3, about.
ANCHORS_A_TASK = 1_000_000
SEGMENTS_A_SHARD = 40_000
#: Least number of tasks of step 1.
LEAST_TASKS = 64
#: Different segments of one anchor from which on windows are dealt out instead.
CROWDED = 5_000
#: Stands for a null id: it comes after every other.
LAST_ID = 2**63 - 1


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def segments(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of each segment of a document's word hashes, in order."""
    n = len(words) - WINDOW + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none
    grams = np.zeros(len(words) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[j : len(words) - GRAM + 1 + j]
    grams = mix(grams)
    wide = WINDOW - GRAM + 1
    least = np.empty(n, np.int64)
    for lo in range(0, n, 1 << 16):
        part = grams[lo : min(lo + (1 << 16), n) + wide - 1]
        least[lo : lo + len(part) - wide + 1] = np.lib.stride_tricks.sliding_window_view(part, wide).argmin(1)
    least += np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, np.diff(np.append(first, n)), grams[least[first]].astype(np.int64)


def short(anchors: np.ndarray) -> np.ndarray:
    """The upper half of anchors. With the task number that is enough to find shared ones: an anchor taken for shared by
    chance only has its segments looked at in vain."""
    return (anchors >> 32).astype(np.int32)


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _document_anchors(texts: DataFrame, tasks: int) -> DataFrame:
    """(key, anchors, owners, ids, ths): packed arrays. A key below ``tasks`` holds anchors to compare (owner 0: already
    seen in two documents, else a place in ids from 1), a key above it holds settled (anchor, document) pairs that only pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for row, words, *_ in hashed_words(batch.column(2), NOT_SPACE):
                anchors = np.unique(segments(words)[2])
                found.append(anchors)
                owner.append(np.full(len(anchors), row, np.int32))
            if not found:
                continue
            anchors, owners = np.concatenate(found), np.concatenate(owner)
            order = np.argsort(anchors, kind="stable")
            anchors, owners = anchors[order], owners[order]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ths = batch.column(1).to_numpy(zero_copy_only=False)
            same = np.zeros(len(anchors), bool)
            same[1:] = anchors[1:] == anchors[:-1]
            local = same.copy()
            local[:-1] |= same[1:]
            send = ~local | (local & ~same)  # of those seen twice here, one goes on
            sent_owner = np.where(local, -1, owners)[send]
            sent = anchors[send]
            key = (sent.astype(np.uint64) % np.uint64(tasks)).astype(np.int64)
            keys, cols = [], ([], [], [], [])

            def put(k: int, a: np.ndarray, o: np.ndarray) -> None:
                used, position = np.unique(o, return_inverse=True)
                used = used.astype(np.int64)
                keys.append(k)
                for col, value in zip(cols, (short(a), np.where(used[position] < 0, 0, position + 1).astype(np.uint16 if len(used) < 65535 else np.uint32), np.where(used < 0, 0, ids[used]), np.where(used < 0, 0, ths[used]))):
                    col.append(value)

            by_key = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[by_key], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(by_key)]):
                at = by_key[lo:hi]
                put(int(key[at[0]]), sent[at], sent_owner[at])
            if local.any():
                at = np.flatnonzero(local)
                spread = owners[at] % 8
                for s in range(8):
                    part = at[spread == s]
                    if len(part):
                        put(tasks + int(anchors[part[0]] % tasks), anchors[part], owners[part])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *map(_packed, cols)], names=["key", "anchors", "owners", "ids", "ths"])

    return texts.mapInArrow(run, "key int, anchors binary, owners binary, ids binary, ths binary")


def _shared_anchors(packed: DataFrame, tasks: int) -> DataFrame:
    """(id, th, anchors): for each document its anchors that some other document has too; several rows a document."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        anchors, owners, ids, ths, base = [], [], [], [], 0
        for a, o, i, t in zip(*(table.column(c) for c in ("anchors", "owners", "ids", "ths"))):
            anchors.append(np.frombuffer(a.as_py(), np.int32))
            o = o.as_py()
            o = np.frombuffer(o, np.uint16 if len(o) == 2 * len(anchors[-1]) else np.uint32).astype(np.int64)
            owners.append(np.where(o == 0, -1, o - 1 + base))
            ids.append(np.frombuffer(i.as_py(), np.int64))
            ths.append(np.frombuffer(t.as_py(), np.int64))
            base += len(ids[-1])
        anchors, owners, ids, ths = map(np.concatenate, (anchors, owners, ids, ths))
        if key[0].as_py() < tasks:
            order = np.argsort(anchors, kind="stable")
            anchors, owners = anchors[order], owners[order]
            start = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
            size = np.diff(np.append(start, len(anchors)))
            shared = np.repeat((size > 1) | (np.minimum.reduceat(owners, start) < 0), size)
            keep = shared & (owners >= 0)
            anchors, owners = anchors[keep], owners[keep]
        order = np.argsort(owners, kind="stable")
        anchors, owners = anchors[order], owners[order]
        start = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])) if len(owners) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(anchors)).astype(np.int32)), pa.array(anchors))
        at = owners[start]
        return pa.table({"id": pa.array(ids[at]), "th": pa.array(ths[at]), "anchors": lists})

    return packed.groupBy("key").applyInArrow(run, "id long, th long, anchors array<int>")


def _marked(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, th, text, anchors) of the documents that have shared anchors, bucketed by (id, th): texts are shuffled once,
    and what is found about a document later joins its text where it lies."""
    spark = texts.sparkSession
    lists = shared.groupBy("id", "th").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))  # a document's own only
    keys = shared.select("id", "th").distinct()
    name, parts = f"marked_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = join_keys(texts, keys).repartition(parts, "id", "th").join(lists, ["id", "th"]).select("id", "th", "text", "anchors")
    joined.write.bucketBy(parts, "id", "th").sortBy("id", "th").option("path", fresh_path(spark, "marked")).format("parquet").saveAsTable(name)
    return spark.table(name)


def _row_segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(row, first window, windows, anchor, words joined by a space) of the shared segments of (id, th, text, anchors)."""
    lists = batch.column(3)
    for row, words, starts, ends, data in hashed_words(batch.column(2), NOT_SPACE):
        first, size, anchor = segments(words)
        mine = np.isin(short(anchor), lists[row].values.to_numpy(zero_copy_only=False))
        if not mine.any():
            continue
        joined = b" ".join(data.tobytes().split())
        ends = np.cumsum(ends - starts + 1) - 1
        begins = np.append(0, ends[:-1] + 1)
        first, size, anchor = first[mine], size[mine], anchor[mine]
        spans = zip(first.tolist(), size.tolist(), anchor.tolist(), begins[first].tolist(), ends[first + size + WINDOW - 2].tolist())
        for f, s, a, lo, hi in spans:
            yield row, f, s, a, joined[lo:hi]


def _distinct_segments(marked: DataFrame) -> DataFrame:
    """(anchor, segment, first): different segments with their smallest document id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            seen: dict[bytes, tuple[int, int]] = {}
            for row, _, _, anchor, segment in _row_segments(batch):
                have = seen.get(segment)
                if have is None or ids[row] < have[1]:
                    seen[segment] = (anchor, ids[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in seen.values()], pa.int64()), pa.array(list(seen), pa.binary()), pa.array([i for _, i in seen.values()], pa.int64())],
                names=["anchor", "segment", "first"],
            )

    return marked.mapInArrow(run, "anchor long, segment binary, first long").groupBy("anchor", "segment").agg(F.min("first").alias("first"))


def _first_ids(shards: DataFrame) -> DataFrame:
    """(digest, firsts) per segment of (shard, segment, first): the smallest id in which each of its windows starts."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.column("segment").to_pylist()
        owner = table.column("first").to_numpy()
        lists = [p.split(b" ") for p in parts]
        sizes = np.array([len(x) for x in lists])
        coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        total = int(sizes.sum()) + len(sizes)
        x = np.zeros(total, np.int64)  # 0 ends a segment
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        inside = np.ones(total, bool)
        inside[begin + sizes] = False
        x[inside] = coded.indices.to_numpy().astype(np.int64) + 1
        index = FmIndex(x, WINDOW)
        who = np.repeat(owner, sizes + 1)
        windows = sizes - WINDOW + 1
        offsets = np.concatenate([[0], np.cumsum(windows)])
        starts = np.repeat(begin - offsets[:-1], windows) + np.arange(offsets[-1])
        lo, hi, length = index.search(x, starts + WINDOW, WINDOW)
        firsts = who[starts]
        met = np.flatnonzero((length >= WINDOW) & (hi - lo > 1))
        if len(met):
            by_suffix = np.append(who[index.suffixes], LAST_ID)
            firsts[met] = np.minimum.reduceat(by_suffix, np.stack([lo[met], hi[met]], 1).ravel())[::2]
        digests = pa.array([xxhash.xxh3_128_digest(p) for p in parts], pa.binary())
        return pa.table({"digest": digests, "firsts": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(firsts))})

    return shards.groupBy("shard").applyInArrow(run, "digest binary, firsts array<long>")


def _windows(crowded: DataFrame) -> DataFrame:
    """(segment, at, window, first): each window of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, at, window, first = [], [], [], []
            for segment, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = segment.split(b" ")
                name = xxhash.xxh3_128_digest(segment)
                for k in range(len(words) - WINDOW + 1):
                    digests.append(name)
                    at.append(k)
                    window.append(b" ".join(words[k : k + WINDOW]))
                    first.append(f)
            wnames = pa.array([xxhash.xxh3_128_digest(w) for w in window], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(at, pa.int32()), pa.array(window, pa.binary()), wnames, pa.array(first, pa.int64())],
                names=["digest", "at", "segment", "window", "first"],
            )

    return crowded.select("segment", "first").mapInArrow(run, "digest binary, at int, segment binary, window binary, first long")


def first_occurrences(distinct: DataFrame, n_segments: int) -> DataFrame:
    """(digest, firsts) of every different segment, whatever its anchor's share."""
    shards = max(1, -(-n_segments // SEGMENTS_A_SHARD))
    busy = distinct.groupBy("anchor").count().filter(F.col("count") > CROWDED).select("anchor")
    busy = materialize(busy, "busy")
    plain = distinct if busy.isEmpty() else distinct.join(busy, "anchor", "left_anti")
    out = _first_ids(plain.select(F.expr(f"pmod(anchor, {shards})").cast("int").alias("shard"), "segment", "first"))
    if busy.isEmpty():
        return out
    windows = materialize(_windows(distinct.join(busy, "anchor", "left_semi")), "windows")
    single = windows.groupBy("segment").agg(F.min("first").alias("first")).select(F.expr(f"pmod(xxhash64(segment), {shards})").cast("int").alias("shard"), "segment", "first")
    known = _first_ids(single).select(F.col("digest").alias("window"), F.col("firsts")[0].alias("of"))
    back = windows.select("digest", "at", "window").join(known, "window")
    lists = back.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("at", "of"))).alias("l"))  # at most WINDOW - GRAM + 1 each
    return out.unionByName(lists.select("digest", F.col("l.of").alias("firsts")))


def _uses(marked: DataFrame) -> DataFrame:
    """(digest, id, th, at): where each shared segment stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, at, names = [], [], []
            for row, first, _, _, segment in _row_segments(batch):
                rows.append(row)
                at.append(first)
                names.append(xxhash.xxh3_128_digest(segment))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([ids[r] for r in rows], pa.int64()), pa.array([ths[r] for r in rows], pa.int64()), pa.array(at, pa.int64())],
                names=["digest", "id", "th", "at"],
            )

    return marked.mapInArrow(run, "digest binary, id long, th long, at long")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(id, th, text, windows): ascending first words of the windows that also start in a document with a smaller id,
    for the documents that have any."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(LEAST_TASKS, -(-size // (32 * ANCHORS_A_TASK)))  # about one anchor in 32 bytes
    shared = materialize(_shared_anchors(_document_anchors(texts, tasks), tasks), "anchors")
    marked = _marked(texts, shared)
    distinct = materialize(_distinct_segments(marked), "segments")
    firsts = first_occurrences(distinct, distinct.count())
    hit = _uses(marked).join(firsts, "digest").filter(F.array_min("firsts") < F.col("id"))
    late = F.filter(F.transform("firsts", lambda f, k: F.when(f < F.col("id"), F.col("at") + k)), lambda w: w.isNotNull())
    rows = hit.select("id", "th", late.alias("w"))
    lists = rows.groupBy("id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("windows"))
    once = Window.partitionBy("id", "th").orderBy("id", "th")  # repeated rows have one result
    return marked.select("id", "th", "text").join(lists, ["id", "th"]).withColumn("line", F.row_number().over(once)).filter("line = 1").drop("line")


def _kept(tokens: list[bytes], windows: np.ndarray) -> np.ndarray:
    cover = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(cover, windows, 1)
    np.add.at(cover, windows + WINDOW, -1)
    return np.cumsum(cover)[:-1] == 0


def removals(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document that loses words: (id, th, n_removed, kept_text), kept words joined by one space.

    Words are runs of anything but code points 9 to 13 and 32. A null text has no words; a null id comes after all
    others; rows that repeat an id are one document, so neither makes the other lose words.
    """
    texts = _texts(df, doc_id, text)
    wide = repeated_windows(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, kept = [], []
            for k in range(batch.num_rows):
                tokens = batch.column(2)[k].as_py().encode().split()
                stay = _kept(tokens, batch.column(3)[k].values.to_numpy(zero_copy_only=False))
                lost.append(len(tokens) - int(stay.sum()))
                kept.append(b" ".join([t for t, s in zip(tokens, stay.tolist()) if s]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["id", "th", "n_removed", "kept_text"])

    return wide.select("id", "th", "text", "windows").mapInArrow(run, "id long, th long, n_removed long, kept_text string")


def word_digests(texts: DataFrame) -> DataFrame:
    """(id, th, n_words, sha256) of whole texts: words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column(2):
                tokens = text.as_py().encode().split()
                n.append(len(tokens))
                sha.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["id", "th", "n_words", "sha256"])

    return texts.mapInArrow(run, "id long, th long, n_words long, sha256 string")


def drop_repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated passages cut from the text; columns unchanged. A text that loses nothing stays as it is, a
    document that loses every word keeps its row with an empty text."""
    names = {c: free_name("_" + c, df.columns) for c in ("id", "th")}
    new = free_name("_kept_text", df.columns)
    cut = removals(df, doc_id, text).select(F.col("id").alias(names["id"]), F.col("th").alias(names["th"]), F.col("kept_text").alias(new))
    keyed = df.withColumns({names["id"]: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), names["th"]: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    joined = keyed.join(cut, list(names.values()), "left")
    return joined.withColumn(text, F.coalesce(new, text)).select(df.columns)
