"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

Words that are frequent in the corpus are compiled into an automaton in which equal endings share states; the numbers
on its edges add up to the place of a word, where its token ids stand. The automaton is one flat file that executors
fetch once and map into memory. Words it does not hold are merged exactly, pair by pair in rank order.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import keyed_texts
from flowlab.llm.pretoken import SPECIAL, Splitter
from flowlab.session import fresh_path

#: Words compiled into the automaton, the most frequent ones.
LEXICON_WORDS = 1 << 16
#: A task reports words that it met so often; a word met less often in every task is merged when it is met.
REPORT_COUNT = 8
#: Longer words are merged by a heap, one at a time; shorter ones many at a time.
LONG_WORD = 64
#: Merged words that a worker remembers.
MEMO_WORDS = 300_000
BLOCK = 1 << 22
_NONE = np.int32(2**31 - 1)


class Merges:
    """Byte-pair merging by the ranks of a tokenizer file."""

    def __init__(self, splitter: Splitter, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.size = max([*vocab.values(), *splitter.special.values()]) + 1
        self.inner = np.full(256, -1, np.int64)
        self.final = np.full(256, -1, np.int64)
        for b, c in splitter.letter_of.items():
            self.inner[b], self.final[b] = vocab[c], vocab[c + end]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *splitter.special.items()]:
            self.tokens[i] = token

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, new id) of pairs; rank _NONE where they do not merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    def merge(self, words: Sequence[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for length, at in by_length.items():
            if length > LONG_WORD:
                for k in at:
                    out[k] = self.merge_long(words[k])
                continue
            for lo in range(0, len(at), 20_000):
                part = at[lo : lo + 20_000]
                for k, ids in zip(part, self._merge_equal([words[k] for k in part], length)):
                    out[k] = ids
        return out

    def _merge_equal(self, words: list[bytes], length: int) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)
        ids = self.inner[data]
        ids[:, -1] = self.final[data[:, -1]]
        if length == 1:
            return list(ids)
        rank, made = self.find(ids[:, :-1], ids[:, 1:])
        done = np.full(len(words), length)
        rows = np.arange(len(words))
        active, a_ids, a_rank, a_made = rows, ids, rank, made
        size = length
        while True:
            best = a_rank.argmin(1)
            line = np.arange(len(active))
            go = a_rank[line, best] != _NONE
            stop = ~go
            if stop.any():
                ids[active[stop], :size] = a_ids[stop]
                done[active[stop]] = size
                active, a_ids, a_rank, a_made, best = active[go], a_ids[go], a_rank[go], a_made[go], best[go]
                line = line[: len(active)]
            if not len(active):
                break
            new = a_made[line, best]
            size -= 1
            later = np.arange(size)[None, :] > best[:, None]
            a_ids = np.where(later, a_ids[:, 1:], a_ids[:, :-1])
            a_ids[line, best] = new
            if size == 1:
                ids[active, :1] = a_ids
                done[active] = 1
                break
            later = later[:, :-1]
            a_rank = np.where(later, a_rank[:, 1:], a_rank[:, :-1])
            a_made = np.where(later, a_made[:, 1:], a_made[:, :-1])
            for shift in (-1, 0):
                p = best + shift
                ok = np.flatnonzero((p >= 0) & (p < size - 1))
                q = p[ok]
                a_rank[ok, q], a_made[ok, q] = self.find(a_ids[ok, q], a_ids[ok, q + 1])
        return [ids[k, : done[k]] for k in range(len(words))]

    def merge_long(self, word: bytes) -> np.ndarray:
        data = np.frombuffer(word, np.uint8)
        ids = self.inner[data]
        ids[-1] = self.final[data[-1]]
        n = len(ids)
        rank, made = self.find(ids[:-1], ids[1:])
        heap = [(r, k, m) for k, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if r != _NONE]
        heapq.heapify(heap)
        symbol = ids.tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        version = rank.tolist()  # the rank of the pair that starts here now
        while heap:
            r, k, m = heapq.heappop(heap)
            if symbol[k] < 0 or version[k] != r or after[k] < 0:
                continue
            gone = after[k]
            symbol[k], symbol[gone] = m, -1
            after[k] = after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for p in (before[k], k):
                if p < 0 or p >= n:
                    continue
                if after[p] < 0:
                    if p < n - 1:
                        version[p] = -1
                    continue
                pr, pm = self.find(np.array([symbol[p]]), np.array([symbol[after[p]]]))
                version[p] = int(pr[0])
                if pr[0] != _NONE:
                    heapq.heappush(heap, (int(pr[0]), p, int(pm[0])))
        return np.array([s for s in symbol if s >= 0], np.int64)


def compile_lexicon(words: Sequence[bytes], ids: Sequence[np.ndarray]) -> bytes:
    """The automaton of different words as one file: int64 arrays, their lengths first.

    Words go in in order; once a branch can no longer grow, its states are replaced by equal ones met before.
    """
    order = sorted(range(len(words)), key=lambda k: words[k])
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    previous = b""

    def settle(down_to: int) -> None:
        while len(path) - 1 > down_to:
            child = path.pop()
            shape = (final[child], tuple(sorted(edges[child].items())))
            same = register.setdefault(shape, child)
            if same != child:
                edges[path[-1]][previous[len(path) - 1]] = same

    for k in order:
        word = words[k]
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        settle(common)
        for c in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][c] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        previous = word
    settle(0)

    number, queue = {0: 0}, [0]
    for state in queue:
        for child in edges[state].values():
            if child not in number:
                number[child] = len(queue)
                queue.append(child)
    below: dict[int, int] = {}
    stack = [(0, False)]
    while stack:  # words that end below each state
        state, ready = stack.pop()
        if state in below:
            continue
        if ready:
            below[state] = final[state] + sum(below[c] for c in edges[state].values())
        else:
            stack.append((state, True))
            stack += [(c, False) for c in edges[state].values()]
    key, target, output = [], [], []
    for state in queue:
        count = int(final[state])
        for c, child in sorted(edges[state].items()):
            key.append(number[state] * 256 + c)
            target.append(number[child])
            output.append(count)
            count += below[child]
    flat = np.concatenate([ids[k] for k in order]) if order else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(ids[k]) for k in order])])
    arrays = [np.array(x, np.int64) for x in (key, target, output, [final[s] for s in queue], offsets, flat)]
    return b"".join(x.tobytes() for x in [np.array([len(x) for x in arrays], np.int64), *arrays])


class Lexicon:
    """A compiled automaton, mapped into memory."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.int64, "r")
        parts, at = [], 6
        for n in whole[:6].tolist():
            parts.append(whole[at : at + n])
            at += n
        self.key, self.target, self.output, self.final, self.offsets, self.ids = parts

    def places(self, words: pa.Array) -> np.ndarray:
        """Place of each word among the compiled ones in order, -1 if it is not one; walks all words side by side."""
        n = len(words)
        place = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return place
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        length = np.diff(offsets)
        state, total, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
        depth = 0
        while len(alive):
            over = length[alive] == depth
            ended = alive[over]
            place[ended] = np.where(self.final[state[ended]] == 1, total[ended], -1)
            alive = alive[~over]
            if not len(alive):
                break
            key = state[alive] * 256 + data[offsets[alive] + depth]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            alive, at = alive[hit], at[hit]
            state[alive] = self.target[at]
            total[alive] += self.output[at]
            depth += 1
        return place


class Encoder:
    """Token ids of whole texts, exactly those of the tokenizer file."""

    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.splitter = Splitter(path)
        self.merges = Merges(self.splitter, path)
        self.lexicon = lexicon
        self.memo: dict[bytes, np.ndarray] = {}
        self.token_text = pa.array(self.merges.tokens, pa.string())

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, length) for each of different words."""
        n = len(words)
        start, length = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat, base = [], 0
        rest = np.arange(n)
        if self.lexicon is not None:
            place = self.lexicon.places(words)
            hit = np.flatnonzero(place >= 0)
            start[hit] = self.lexicon.offsets[place[hit]]
            length[hit] = self.lexicon.offsets[place[hit] + 1] - start[hit]
            flat.append(np.asarray(self.lexicon.ids))
            base = len(self.lexicon.ids)
            rest = np.flatnonzero(place < 0)
        other = words.take(pa.array(rest)).to_pylist()
        new = []
        for w in other:
            if w not in self.memo:
                if w.startswith(SPECIAL):
                    self.memo[w] = np.array([self.splitter.special[w[len(SPECIAL) :].decode()]])
                else:
                    new.append(w)
        for w, ids in zip(new, self.merges.merge(new)):
            self.memo[w] = ids
        found = [self.memo[w] for w in other]
        sizes = np.array([len(x) for x in found], np.int64)
        flat += found
        start[rest] = base + np.cumsum(sizes) - sizes
        length[rest] = sizes
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), start, length

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from row, to row, ids, offsets) for blocks of whole rows, in order."""
        for a, b, words, number, at in self.splitter.words(texts, BLOCK):
            flat, start, length = self._word_ids(words)
            sizes = length[number]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            source = np.repeat(start[number] - (ends - sizes), sizes) + np.arange(total)
            yield a, b, flat[source].astype(np.uint32), np.concatenate([[0], ends])[at]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id lists: their tokens joined by a space, as a file without a decoder asks for."""
        if len(ids) > 1 << 25:  # one huge text: 32-bit offsets of joined text would not reach
            names = self.merges.tokens
            rows = [" ".join([names[i] for i in ids[a:b].tolist()]) for a, b in zip(offsets[:-1], offsets[1:])]
            return pa.array(rows, pa.large_string())
        tokens = self.token_text.take(pa.array(ids))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


def frequent_words(texts: DataFrame, path: str, n: int = LEXICON_WORDS, text: str = "text") -> list[bytes]:
    """The ``n`` most frequent words of all texts, ties by bytes. Counts add up in each task before the shuffle, and a
    task leaves out words it met fewer than REPORT_COUNT times; this bears on speed only, never on results."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, total = Splitter(path), Counter()
        for batch in batches:
            for _, _, words, number, _ in splitter.words(batch.column(0), BLOCK):
                seen = np.bincount(number, minlength=len(words))
                total.update(dict(zip(words.to_pylist(), seen.tolist())))
                if len(total) > 2_000_000:  # a long task forgets what is rare in it
                    total = Counter({w: c for w, c in total.items() if c >= REPORT_COUNT})
        picked = [(w, c) for w, c in total.items() if c >= REPORT_COUNT and not w.startswith(SPECIAL)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in picked], pa.binary()), pa.array([c for _, c in picked], pa.int64())], names=["word", "n"])

    counts = texts.select(F.col(text).alias("t")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(n).collect()]


def publish_lexicon(df: DataFrame, path: str, n: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compile the frequent words of ``df``, store the file in the shared folder and hand it to every executor.

    Returns its name for ``SparkFiles.get``; an executor that joins later fetches it too.
    """
    spark = df.sparkSession
    words = frequent_words(df, path, n, text)
    merges = Merges(Splitter(path), path)
    blob = compile_lexicon(words, merges.merge(words))
    target = fresh_path(spark, "lexicon") + ".bin"
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    place = jvm.org.apache.hadoop.fs.Path(target)
    stream = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place)
    try:
        stream.write(blob)
    finally:
        stream.close()
    context.addFile(target)
    return target.rsplit("/", 1)[1]


_encoders: dict[tuple[str, str | None], Encoder] = {}


def shared_encoder(path: str, lexicon: str | None = None) -> Encoder:
    """The encoder of this Python worker; its memo lives as long as the worker."""
    key = (path, lexicon)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[key]


def encoded_digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, words: int = LEXICON_WORDS) -> DataFrame:
    """(id, th, n_tokens, ids_sha256, decoded_sha256) per row: whole texts encoded, and decoded from their ids.

    Null and empty texts have no ids and decode to the empty text; repeated rows repeat their result.
    """
    texts = keyed_texts(df, doc_id, text)
    name = publish_lexicon(texts, path, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, name)
        for batch in batches:
            counts, shas, decoded = [], [], []
            for a, b, ids, offsets in encoder.encode(batch.column(2)):
                counts += np.diff(offsets).tolist()
                for k in range(b - a):
                    shas.append(hashlib.sha256(ids[offsets[k] : offsets[k + 1]]).hexdigest())
                for back in encoder.decode(ids, offsets):
                    decoded.append(hashlib.sha256(back.as_buffer()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "th", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts.mapInArrow(run, "id long, th long, n_tokens long, ids_sha256 string, decoded_sha256 string")
