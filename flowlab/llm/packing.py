"""Best-fit packing by a linear grouping scheme.

Documents become token ids and a closing id; only those longer than a sequence are cut. The plan is made from the counts
of lengths alone (at most CAPACITY numbers): large lengths are dealt into groups of equal cardinality and rounded up to
the largest of their group, configurations of these few sizes are chosen, actual lengths take the places of the rounded
ones, and small lengths go by best fit into the room that is left. A plan is a short list of runs of equal sequences;
each piece finds its place from its length and its rank among the pieces of that length, which needs no large group in
one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import keyed_texts
from flowlab.llm.lexicon import shared_encoder
from flowlab.session import materialize

CAPACITY = 4096
CLOSING_ID = 1
#: Lengths above this share of a sequence are large.
LARGE = 1 / 8
#: Group numbers that are tried; the plan with fewest sequences is taken.
GROUPS = (24, 64, 160)
#: Pieces of one length that are ranked in one task, about.
RANKED = 50_000


@dataclass
class _Plan:
    capacity: int
    slots: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, first rank, last, per sequence, sequence, offset
    used: dict[int, int] = field(default_factory=dict)
    room: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # room left -> runs (sequence, number)
    rooms: list[int] = field(default_factory=list)
    sequences: int = 0

    def take(self, length: int, sequence: int, number: int, each: int, offset: int) -> None:
        first = self.used.get(length, 0)
        self.used[length] = first + number * each
        self.slots.append((length, first, first + number * each, each, sequence, offset))

    def put(self, room: int, sequence: int, number: int) -> None:
        if not number:
            return
        if room not in self.room:
            self.room[room] = []
            bisect.insort(self.rooms, room)
        self.room[room].append((sequence, number))

    def pop(self, length: int) -> tuple[int, int, int] | None:
        at = bisect.bisect_left(self.rooms, length)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        sequence, number = self.room[room].pop()
        if not self.room[room]:
            del self.room[room], self.rooms[at]
        return room, sequence, number

    def best_fit(self, length: int, n: int) -> None:
        while n:
            run = self.pop(length)
            if run is None:
                number = -(-n // (self.capacity // length))
                run = self.capacity, self.sequences, number
                self.sequences += number
            room, sequence, number = run
            each = room // length
            full = min(number, n // each)
            offset = self.capacity - room
            if full:
                self.take(length, sequence, full, each, offset)
                self.put(room - each * length, sequence, full)
                n -= full * each
            if n and full < number and n < each:
                self.take(length, sequence + full, 1, n, offset)
                self.put(room - n * length, sequence + full, 1)
                n, full = 0, full + 1
            self.put(room, sequence + full, number - full)



def _groups(lengths: list[tuple[int, int]], k: int) -> list[list[list[int]]]:
    """Large lengths, longest first, dealt into at most k groups of equal cardinality: [length, number] lists."""
    total = sum(n for _, n in lengths)
    size = max(1, -(-total // k))
    out, now, free = [], [], size
    for length, n in sorted(lengths, reverse=True):
        while n:
            m = min(n, free)
            now.append([length, m])
            n -= m
            free -= m
            if not free:
                out.append(now)
                now, free = [], size
    return out + ([now] if now else [])


def _complement(sizes: list[int], left: list[int], room: int) -> list[tuple[int, int]]:
    """(group, number) choices that fill ``room`` best, from groups with ``left`` documents each."""
    by_group = np.full(room + 1, -1, np.int32)
    number = np.zeros(room + 1, np.int32)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for g, (size, have) in enumerate(zip(sizes, left)):
        if not have or size > room:
            continue
        before = reached.copy()
        for t in range(1, min(have, room // size) + 1):
            new = np.zeros(room + 1, bool)
            new[t * size :] = before[: room + 1 - t * size]
            new &= ~reached
            by_group[new], number[new] = g, t
            reached |= new
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    out = []
    while at:
        g, t = int(by_group[at]), int(number[at])
        out.append((g, t))
        at -= t * sizes[g]
    return out


def _plan(counts: dict[int, int], capacity: int, k: int) -> _Plan:
    plan = _Plan(capacity)
    large = [(length, n) for length, n in counts.items() if length > capacity * LARGE]
    groups = _groups(large, k)
    sizes = [max(length for length, _ in g) for g in groups]
    left = [sum(n for _, n in g) for g in groups]
    for g in range(len(groups)):
        while left[g]:
            left[g] -= 1
            others = _complement(sizes, left, capacity - sizes[g])
            left[g] += 1
            need = {g: 1}
            for h, t in others:
                need[h] = need.get(h, 0) + t
            times = min(left[h] // t for h, t in need.items())
            for h, t in need.items():
                left[h] -= times * t
            _substitute(plan, groups, [h for h, t in need.items() for _ in range(t)], times)
    for length in sorted((x for x in counts if x <= capacity * LARGE), reverse=True):
        plan.best_fit(length, counts[length])
    return plan


def _substitute(plan: _Plan, groups: list[list[list[int]]], slots: list[int], times: int) -> None:
    """``times`` sequences with one document of each slot's group: actual lengths, as runs that change together."""
    queues = []
    for g in slots:
        runs, need = [], times
        while need:
            length, n = groups[g][0]
            m = min(n, need)
            runs.append([length, m])
            need -= m
            if m == n:
                groups[g].pop(0)
            else:
                groups[g][0][1] -= m
        queues.append(runs)
    done = 0
    while done < times:
        step = min(q[0][1] for q in queues)
        offset, sequence = 0, plan.sequences + done
        for q in queues:
            length = q[0][0]
            plan.take(length, sequence, step, 1, offset)
            offset += length
            q[0][1] -= step
            if not q[0][1]:
                q.pop(0)
        plan.put(plan.capacity - offset, sequence, step)
        done += step
    plan.sequences += times


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(slots, sequences) for numbers of pieces by length from 1 to ``capacity``.

    A slot is (length, first rank, end rank, pieces per sequence, first sequence, offset of the first piece).
    """
    plans = [_plan(counts, capacity, k) for k in GROUPS]
    best = min(plans, key=lambda p: p.sequences)
    slots = np.array(sorted(best.slots), np.int64).reshape(-1, 6)
    return slots, best.sequences


def token_pieces(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, th, piece, start, length, ids_crc32): whole documents as ids with a closing id, cut only where too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for a, b, ids, offsets in encoder.encode(batch.column(2)):
                for k in range(b - a):
                    whole = np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(CLOSING_ID)).astype("<u4")
                    for p, lo in enumerate(range(0, len(whole), capacity)):
                        part = whole[lo : lo + capacity]
                        row.append(a + k)
                        piece.append(p)
                        start.append(lo)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "th", "piece", "start", "length", "ids_crc32"],
            )

    return keyed_texts(df, doc_id, text).mapInArrow(run, "id long, th long, piece int, start long, length long, ids_crc32 long")


def ranked_in_class(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``rank`` from 0 among the rows of their length; a frequent length is ranked in many tasks."""
    parts = max(1, -(-n // RANKED))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("id", "th", "piece"), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "th", "piece"))
    return dealt.withColumn("inside", inside).join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("inside") - 1).drop("first", "inside", "part")


def pack(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their place: (id, th, piece, start, length, ids_crc32, sequence_id, offset).

    Null and empty texts are the closing id alone. Repeated rows are packed each by itself; an empty table gives no rows.
    """
    pieces = materialize(token_pieces(df, path, doc_id, text, capacity), "pieces")
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan_sequences(counts, capacity)
    table = df.sparkSession.sparkContext.broadcast(slots)
    ranked = ranked_in_class(pieces, sum(counts.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = table.value
        keys = s[:, 0] << 44 | s[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            within = rank - s[at, 1]
            sequence = s[at, 4] + within // s[at, 3]
            offset = s[at, 5] + within % s[at, 3] * length
            names = ["id", "th", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, th long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
