"""Chat formatting: a hidden Markov model over the lines of a transcript recovers who speaks.

States are a role and whether a line begins a turn or goes on with it. A line shows the kind of speaker marker it begins
with, its length and how it ends; the model's numbers are counts over labelled transcripts. Scores are whole numbers, so
the best path through a long transcript can be put together from blocks exactly: each block gives the best score between
any two states, these tables are chained over runs of blocks and then over the runs of a conversation, and each block is
decoded between the states it has to start from and end in. No conversation needs to be in one task as lines. A
conversation of one block needs no tables. Blocks are rows; a batch of them is decoded line by line side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlab.llm.common import BROADCAST_KEYS
from flowlab.session import materialize

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Turns of a conversation that make one block.
BLOCK_TURNS = 32
#: Blocks of a conversation that make one run.
RUN_BLOCKS = 4096
#: Turns without a number are dealt to so many blocks of their conversation, by text.
UNNUMBERED_BLOCKS = 1 << 20
#: Scores are logarithms times this, rounded.
SCALE = 1000
#: Speaker markers by kind.
MARKERS = {
    "user": ["user", "human", "q", "question", "customer"],
    "assistant": ["assistant", "bot", "a", "answer", "agent"],
    "system": ["system", "instructions"],
}
_KINDS = ["none", "user", "assistant", "system", "name"]
FEATURE_SIZES = (len(_KINDS), 4, 3)


@dataclass(frozen=True)
class ChatModel:
    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: tuple[np.ndarray, ...]  # one table states x values per feature


def marker_kind(line: Column) -> Column:
    """0 none, 1 user, 2 assistant, 3 system, 4 some other name before a colon."""
    out = F.when(line.rlike(r"^[\[<(#*\s]*\p{L}[\p{L}\d_]{0,15}[\]>)*]*\s?:"), 4).otherwise(0)
    for k, kind in enumerate(_KINDS[1:4], 1):
        out = F.when(line.rlike(rf"(?i)^[\[<(#*\s]*({'|'.join(MARKERS[kind])})[\]>)*]*\s?(:|$)"), k).otherwise(out)
    return out


def marker_length(line: Column) -> Column:
    """Code points of the marker that a line begins with."""
    bare = F.regexp_replace(line, r"^[\[<(#*\s]*\p{L}[\p{L}\d_]{0,15}[\]>)*]*\s?(:[ \t]*|$)", "")
    return F.char_length(line) - F.char_length(bare)


def line_code(line: Column) -> Column:
    """Marker kind, length class and ending of a line as one number."""
    n = F.char_length(line)
    length = F.when(n == 0, 0).when(n < 40, 1).when(n < 200, 2).otherwise(3)
    ending = F.when(line.rlike(r"\?\s*$"), 0).when(line.rlike(r"[.!]\s*$"), 1).otherwise(2)
    return (marker_kind(line) * FEATURE_SIZES[1] + length) * FEATURE_SIZES[2] + ending


def features_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rest, ending = np.divmod(codes, FEATURE_SIZES[2])
    kind, length = np.divmod(rest, FEATURE_SIZES[1])
    return kind, length, ending


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv, block, turn, tie, first_state, raw): stored turns as raw transcript text, with the state that is to be
    found for the turn's first line.

    Each conversation writes its speakers in one of five styles; one turn in eight has lost its marker. Null ids become
    -1, null turns -1, null texts empty lines, unknown roles user. Turns with one number are ordered by text, turns
    without a number come first, ordered by text.
    """
    style = F.pmod(F.xxhash64("conv"), F.lit(5))
    lost = F.pmod(F.xxhash64("conv", "turn", "text"), F.lit(8)) == 0
    names = {r: MARKERS[r] for r in ROLES}

    def spoken(role: str) -> Column:
        a, b, c = names[role][0].capitalize(), names[role][1].capitalize(), names[role][-1]
        return F.when(style == 0, a + ": ").when(style == 1, b + ": ").when(style == 2, f"[{names[role][0]}]: ").when(style == 3, f"### {b}:\n").otherwise(f"<{c}>: ")

    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-1)).alias("conv"),
        F.col("turn").isNull().alias("unnumbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        role.alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("tie", F.xxhash64("text", "role"))
    marker = F.when(F.col("role") == ROLES[0], spoken(ROLES[0])).when(F.col("role") == ROLES[1], spoken(ROLES[1])).otherwise(spoken(ROLES[2]))
    numbered = F.floor(F.col("turn") / BLOCK_TURNS)
    first = sum((F.when(F.col("role") == r, 2 * k).otherwise(0) for k, r in enumerate(ROLES)), F.lit(0))
    return rows.select(
        "conv",
        F.when(F.col("unnumbered"), F.pmod("tie", F.lit(UNNUMBERED_BLOCKS)) - 2 * UNNUMBERED_BLOCKS).otherwise(numbered).alias("block"),
        "turn",
        "tie",
        first.alias("first_state"),
        F.when(lost, F.col("text")).otherwise(F.concat(marker, "text")).alias("raw"),
    )


def line_blocks(turns: DataFrame) -> DataFrame:
    """(conv, block, lines, codes, cuts, states): the lines of a block's turns in order, with their codes, the lengths of
    their markers and the states that are to be found. A block holds BLOCK_TURNS turn numbers."""
    lines = turns.withColumn("lines", F.split("raw", "\n", -1)).select(
        "conv",
        "block",
        F.struct(
            "turn",
            "tie",
            "lines",
            F.transform("lines", line_code).alias("codes"),
            F.transform("lines", lambda line: F.when(marker_kind(line) > 0, marker_length(line)).otherwise(0)).alias("cuts"),
            F.transform("lines", lambda _, at: F.col("first_state") + F.when(at > 0, 1).otherwise(0)).alias("states"),
        ).alias("t"),
    )
    whole = lines.groupBy("conv", "block").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv", "block", *(F.flatten(F.col(f"t.{c}")).alias(c) for c in ("lines", "codes", "cuts", "states")))


def fit_chat_model(blocks: DataFrame) -> ChatModel:
    """Counts over every line of labelled blocks (.., codes, states), taken in one pass; a few thousand reach the driver."""
    n = len(STATES)
    # inside a block the line before is the one in order; a block's first line has none
    line = "transform(states, (s, i) -> struct(if(i > 0, states[i - 1], -1) AS before, s AS state, codes[i] AS code))"
    counts = blocks.select(F.inline(F.expr(line))).groupBy("before", "state", "code").count().toPandas()
    before, state, count = (counts[c].to_numpy(np.int64) for c in ("before", "state", "count"))
    emit = []
    for size, value in zip(FEATURE_SIZES, features_of(counts["code"].to_numpy(np.int64))):
        table = np.ones((n, size))
        np.add.at(table, (state, value), count)
        emit.append(np.round(np.log(table / table.sum(1, keepdims=True)) * SCALE).astype(np.int64))
    step, start = np.full((n, n), 0.1), np.full(n, 0.1)
    follows = before >= 0
    np.add.at(step, (before[follows], state[follows]), count[follows])
    np.add.at(start, state[~follows], count[~follows])
    for a in range(n):  # a turn goes on only with its own role
        for b in range(n):
            if not STATES[b][1] and STATES[a][0] != STATES[b][0]:
                step[a, b] = 1e-9
    start[[k for k, s in enumerate(STATES) if not s[1]]] = 1e-9
    logs = [np.round(np.log(x / x.sum(-1, keepdims=True)) * SCALE).astype(np.int64) for x in (start, step)]
    return ChatModel(logs[0], logs[1], tuple(emit))


def line_scores(model: ChatModel, codes: np.ndarray) -> np.ndarray:
    """lines x states from line codes."""
    return sum(table[:, value].T for table, value in zip(model.emit, features_of(codes)))


def _columns(offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows, longest first, and for each step the places of its lines; the rows still going are the first ones."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    going = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")
    return order, [offsets[order[:k]] + t for t, k in enumerate(going)]


def block_tables(model: ChatModel, scores: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of lines the best score from each state before it to each state at its last line, and the best score
    at its last line if it starts the conversation."""
    order, steps = _columns(offsets)
    n = len(model.start)
    # row n of a table stands for the start of the conversation
    best = np.concatenate([model.step, model.start[None]])[None] + scores[steps[0]][:, None, :]
    for at in steps[1:]:
        best[: len(at)] = (best[: len(at), :, :, None] + model.step).max(2) + scores[at][:, None, :]
    out = np.empty_like(best)
    out[order] = best
    return out[:, :n], out[:, n]


def decode_rows(model: ChatModel, scores: np.ndarray, offsets: np.ndarray, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best states of all lines; each row goes from state ``before`` (-1: the beginning) to ``last`` (-1: any)."""
    order, steps = _columns(offsets)
    path = np.empty(len(scores), np.int64)
    if not steps:
        return path
    best = np.concatenate([model.step, model.start[None]])[before[order]] + scores[steps[0]]
    back = np.zeros(scores.shape, np.int8)
    for at in steps[1:]:
        reach = best[: len(at), :, None] + model.step
        back[at] = reach.argmax(1)
        best[: len(at)] = reach.max(1) + scores[at]
    state = np.where(last[order] >= 0, last[order], best.argmax(1))
    for at in reversed(steps):
        path[at] = state[: len(at)]
        state[: len(at)] = back[at, state[: len(at)]]
    return path


def chain(tables: np.ndarray, first: np.ndarray, last: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state before, last state) of each table on the best path, and the scores at the end; ``first`` scores the ends of
    the first table, ``last`` is the state to end in (-1: any). The first state before is not known here: -1."""
    best, back = first, np.zeros((len(tables), len(first)), np.int64)
    for k in range(1, len(tables)):
        reach = best[:, None] + tables[k]
        back[k] = reach.argmax(0)
        best = reach.max(0)
    ends = np.empty(len(tables), np.int64)
    ends[-1] = int(best.argmax()) if last < 0 else last
    for k in range(len(tables) - 1, 0, -1):
        ends[k - 1] = back[k, ends[k]]
    return np.concatenate([[-1], ends[:-1]]), ends, best


def _lists(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat numbers, offsets) of a list array."""
    offsets = array.offsets.to_numpy()
    return array.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64), (offsets - offsets[0]).astype(np.int64)


def _tables(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["table"].tolist()).reshape(len(pdf), len(STATES), len(STATES))


def block_ends(blocks: DataFrame, model: ChatModel) -> DataFrame:
    """(conv, block, before, last): the states between which each block of a conversation of several is decoded."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, offsets = _lists(batch.column(2))
            tables, first = block_tables(model, line_scores(model, codes), offsets)
            flat = [pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.int64())) for x in (tables, first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *flat], names=["conv", "block", "table", "first"])

    schema = "conv long, block long, table array<long>, first array<long>"
    tables = blocks.select("conv", "block", "codes").mapInArrow(table, schema)
    tables = materialize(tables.withColumn("run", F.floor(F.col("block") / RUN_BLOCKS)), "tables")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        """One table for a run of blocks."""
        pdf = pdf.sort_values("block")
        steps, first = _tables(pdf), np.array(pdf["first"].iloc[0])
        product = np.concatenate([steps[0], first[None]])
        for k in range(1, len(steps)):
            product = (product[:, :, None] + steps[k]).max(1)
        return pd.DataFrame({"conv": pdf["conv"].iloc[:1], "run": pdf["run"].iloc[:1], "table": [product[:-1].ravel().tolist()], "first": [product[-1].tolist()]})

    def outer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        before, last, _ = chain(_tables(pdf), np.array(pdf["first"].iloc[0]))
        return pd.DataFrame({"conv": pdf["conv"], "run": pdf["run"], "run_before": before, "run_last": last})

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        start, steps = int(pdf["run_before"].iloc[0]), _tables(pdf)
        before, last, _ = chain(steps, np.array(pdf["first"].iloc[0]) if start < 0 else steps[0][start], int(pdf["run_last"].iloc[0]))
        before[0] = start
        return pd.DataFrame({"conv": pdf["conv"], "block": pdf["block"], "before": before, "last": last})

    runs = tables.groupBy("conv", "run").applyInPandas(whole, "conv long, run long, table array<long>, first array<long>")
    runs = runs.groupBy("conv").applyInPandas(outer, "conv long, run long, run_before long, run_last long")
    return tables.join(runs, ["conv", "run"]).groupBy("conv", "run").applyInPandas(inner, "conv long, block long, before long, last long")


def decode_blocks(blocks: DataFrame, model: ChatModel) -> DataFrame:
    """(conv, block, number, opens, role, text, n_lines, n_right): the turns of each block (.., before, last), numbered
    from 1; number 0 goes on with a turn of an earlier block."""
    begins_of = np.array([begins for _, begins in STATES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, offsets = _lists(batch.column("codes"))
            cuts, states = _lists(batch.column("cuts"))[0], _lists(batch.column("states"))[0]
            before, last = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("before", "last"))
            path = decode_rows(model, line_scores(model, codes), offsets, before, last)
            begins = begins_of[path]
            opening = begins.copy()
            opening[offsets[:-1]] = True
            starts = np.flatnonzero(opening)
            row = np.searchsorted(offsets, starts, side="right") - 1
            counted = np.concatenate([[0], np.cumsum(begins)])
            lines = batch.column("lines").flatten().to_pylist()
            for k in np.flatnonzero(begins & (cuts > 0)).tolist():
                lines[k] = lines[k][cuts[k] :]
            marked = begins & (features_of(codes)[0] > 0)
            ends = np.append(starts[1:], len(path))
            # a marker on a line of its own leaves no empty line behind
            text = ["\n".join(lines[a + (b - a > 1 and m and not lines[a]) : b]) for a, b, m in zip(starts.tolist(), ends.tolist(), marked[starts].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv").take(pa.array(row)),
                    batch.column("block").take(pa.array(row)),
                    pa.array(counted[starts + 1] - counted[offsets[row]]),
                    pa.array(begins[starts]),
                    pa.array([STATES[s][0] for s in path[starts].tolist()]),
                    pa.array(text, pa.string()),
                    pa.array(ends - starts),
                    pa.array(np.add.reduceat((path == states).astype(np.int64), starts)),
                ],
                names=["conv", "block", "number", "opens", "role", "text", "n_lines", "n_right"],
            )

    return blocks.mapInArrow(run, "conv long, block long, number long, opens boolean, role string, text string, n_lines long, n_right long")


def recover_turns(blocks: DataFrame, model: ChatModel) -> DataFrame:
    """(conv, turn, piece, role, text, rendered, n_lines, n_right) from blocks (conv, block, lines, codes, cuts, states).

    A turn within one block is one piece; one that reaches into further blocks has a piece in each. The rendered pieces of
    a conversation in order are its canonical form. An empty table gives no rows; an empty line belongs to its turn.
    """
    several = materialize(blocks.groupBy("conv").count().filter("count > 1").select("conv"), "several")
    if several.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        several = F.broadcast(several)
    free = F.lit(-1).cast("long")
    alone = decode_blocks(blocks.join(several, "conv", "left_anti").withColumns({"before": free, "last": free}), model)
    parts = blocks.join(several, "conv", "left_semi")
    ends = materialize(block_ends(parts, model), "ends")
    pieces = materialize(decode_blocks(parts.join(ends, ["conv", "block"]), model), "pieces")
    # turns opened in earlier blocks: first within a run of blocks, then over the runs
    opened = pieces.groupBy("conv", "block").agg(F.count_if("opens").alias("n")).withColumn("run", F.floor(F.col("block") / RUN_BLOCKS))
    earlier = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier_runs = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = opened.groupBy("conv", "run").agg(F.sum("n").alias("n")).select("conv", "run", F.coalesce(F.sum("n").over(earlier_runs), F.lit(0)).alias("base"))
    within = opened.select("conv", "run", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("so_far"))
    offset = within.join(runs, ["conv", "run"]).select("conv", "block", (F.col("base") + F.col("so_far")).alias("offset"))
    head = F.when(F.col("opens"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise("")
    numbered = alone.withColumn("offset", F.lit(0).cast("long")).unionByName(pieces.join(offset, ["conv", "block"]))
    return numbered.select(
        "conv",
        (F.col("offset") + F.col("number") - 1).alias("turn"),
        F.col("block").alias("piece"),
        "role",
        "text",
        F.concat(head, "text", F.lit("\n")).alias("rendered"),
        "n_lines",
        "n_right",
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Write the stored turns as raw transcripts, fit the model on three conversations in four, recover all turns."""
    blocks = materialize(line_blocks(transcripts(conversations)), "blocks")
    model = fit_chat_model(blocks.filter(F.pmod(F.xxhash64("conv"), F.lit(4)) != 2))
    return recover_turns(blocks, model)
