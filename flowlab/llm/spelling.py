"""Spelling variant grouping: words one error apart, found by search schemes over bidirectional FM-indexes.

An error lies in the first or in the second half of a word, so a near word shares the other half exactly. Vocabulary
words are dealt to shards by the halves they could share, queries by their own halves; a shard indexes its words between
marks and answers its queries by matching one half exactly and reading on across the other with one error allowed. A
half that more than SHARD_WORDS words share is dealt over several shards, and its queries go to all of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlab.llm.bidirectional import Vocabulary, flat
from flowlab.operators.small import small_side
from flowlab.session import materialize

#: Code points of the shortest word and occurrences of the rarest.
MIN_LENGTH = 6
MIN_COUNT = 5
#: A form is this many times as frequent as the word, at least.
RATIO = 5
#: One run in so many, chosen by its document, is read with one code point less.
MISREAD = 199
#: Words of one shard, about; a half shared by more is divided.
SHARD_WORDS = 8192
#: Different words, and their code points, counted in a task before they are given out.
HELD_WORDS, HELD_POINTS = 200_000, 8_000_000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{MIN_LENGTH},}}")


def document_words(doc_id: int | None, text: str) -> Counter:
    """Occurrences of the words of at least MIN_LENGTH code points that one document is read as."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: only A-Z change
    words = Counter(_RUN.findall(lowered))
    if doc_id is None:
        return words
    start = zlib.crc32(f"{doc_id}:".encode())
    misread = Counter()  # kept apart: a run read as another one that is misread itself changes only once
    for run in [w for w in words if zlib.crc32(w.encode(), start) % MISREAD == 0]:
        n = words.pop(run)
        cut = zlib.crc32(run.encode(), start) % len(run)
        word = run[:cut] + run[cut + 1 :]
        if len(word) >= MIN_LENGTH:
            misread[word] += n
    words.update(misread)
    return words


def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}
    points = 0

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for word, n in document_words(doc_id, text.as_py() or "").items():
                if word in held:
                    held[word] += n
                else:
                    held[word] = n
                    points += len(word)
            if len(held) > HELD_WORDS or points > HELD_POINTS:
                yield given()
                held.clear()
                points = 0
    if held:
        yield given()


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of at least MIN_LENGTH code points and MIN_COUNT occurrences."""
    counted = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_spoken, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _halves(words: DataFrame) -> DataFrame:
    """(word, n, side, part, half, asks): the halves under which a word is indexed; with ``asks`` it is a query there too.

    ``word`` is turned round on the second side, so that the shared half comes first on both. A word of length l asks with
    half l // 2 (second side: the rest) and can be met by words one shorter or longer, which ask with up to one more or less.
    """
    length = F.length("word")

    def taken(side: int, word: Column, half: Column) -> list[Column]:
        own = F.floor(half(length)).cast("int")
        other = F.when(F.floor(half(length - 1)) < own, own - 1).otherwise(own + 1)
        return [
            F.struct(F.lit(side).alias("side"), word.alias("word"), part.alias("part"), F.substring(word, F.lit(1), part).alias("half"), asks.alias("asks"))
            for part, asks in ((own, F.lit(True)), (other.cast("int"), F.lit(False)))
        ]

    both = taken(0, F.col("word"), lambda x: x / 2) + taken(1, F.reverse("word"), lambda x: (x + 1) / 2)
    return words.select("n", F.explode(F.array(*both)).alias("h")).select("n", "h.*").filter(F.col("part") >= MIN_LENGTH // 2)


def _dealt(words: DataFrame) -> DataFrame:
    """(shard, side, word, n, part, asks, indexed): where each half is indexed, and asked for in all pieces of a divided one."""
    halves = _halves(words)
    shards = max(1, -(-halves.count() // SHARD_WORDS))
    place = ["side", "part", "half"]
    crowded = halves.groupBy(*place).agg(F.count("*").alias("members")).filter(F.col("members") > SHARD_WORDS)
    crowded = crowded.select(*place, F.ceil(F.col("members") / SHARD_WORDS).cast("int").alias("pieces"))
    known = halves.join(small_side(crowded), place, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    known = known.withColumn("own", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    goes = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array("own"))
    spread = known.withColumn("piece", F.explode(goes))
    shard = F.pmod(F.xxhash64("side", "part", "half", "piece"), F.lit(shards)) * 2 + F.col("side")
    return spread.select(shard.alias("shard"), "side", "word", "n", "part", "asks", (F.col("piece") == F.col("own")).alias("indexed"))


def _points(words: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in words.to_pylist()]


def _answered(shard: pa.Table) -> pa.Table:
    """(word, near, n_near, form_n, form): for each query of a shard with near words, their number and the most frequent."""
    side = shard.column("side")[0].as_py()
    indexed = shard.filter(shard.column("indexed"))
    # pieces of one divided half may lie in one shard: a word asks there once
    asks = shard.filter(shard.column("asks")).group_by("word", use_threads=False).aggregate([("part", "min")]).rename_columns(["word", "part"])
    none = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "form_n": pa.array([], pa.int64()), "form": pa.array([], pa.string())})
    if not len(indexed) or not len(asks):
        return none
    # a word may stand under two of its halves here; it is indexed once and answers each query under the half asked for
    grouped = indexed.group_by("word", use_threads=False).aggregate([("n", "min"), ("part", "min"), ("part", "max")]).sort_by("word")
    least, most = (grouped.column(c).to_numpy() for c in ("part_min", "part_max"))
    n = grouped.column("n_min").to_numpy()
    raw, queries = _points(grouped.column("word")), _points(asks.column("word"))
    names = np.unique(np.concatenate([*raw, *queries]))
    words = [np.searchsorted(names, w) + 1 for w in raw]
    symbols, starts = flat([np.searchsorted(names, w) + 1 for w in queries])
    split = asks.column("part").to_numpy().astype(np.int64)
    query, near = Vocabulary(words, len(names) + 1).near(symbols, starts, split)
    met = (least[near] == split[query]) | (most[near] == split[query])
    query, near = query[met], near[met]
    flat_words, word_starts = flat(words)
    if side:  # pairs whose first halves agree are the first side's
        length = np.diff(starts)[query]
        first = length // 2
        ends, near_ends = starts[query] + length, word_starts[near + 1]
        alike = near_ends - word_starts[near] >= first
        for k in range(1, int(first.max(initial=0)) + 1):
            live = np.flatnonzero(alike & (k <= first))
            alike[live] = symbols[ends[live] - k] == flat_words[near_ends[live] - k]
        query, near = query[~alike], near[~alike]
    if not len(query):
        return none
    turned = -1 if side else 1
    order_word = np.argsort(np.argsort(np.array([w[::turned] for w in grouped.column("word").to_pylist()], object), kind="stable"), kind="stable")
    order = np.lexsort((order_word[near], -n[near], query))
    query, near = query[order], near[order]
    firsts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    best = near[firsts]
    asked, answer = asks.column("word").to_pylist(), grouped.column("word").to_pylist()
    return pa.table(
        {
            "word": pa.array([asked[q][::turned] for q in query[firsts].tolist()], pa.string()),
            "n_near": pa.array(np.diff(np.r_[firsts, len(query)]), pa.int64()),
            "form_n": pa.array(n[best], pa.int64()),
            "form": pa.array([answer[k][::turned] for k in best.tolist()], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) of the words of ``words`` (word, n) that have near words: how many, and the most
    frequent one (ties: the smallest in code-point order)."""
    found = _dealt(words).groupBy("shard").applyInArrow(_answered, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Each form is RATIO times as frequent, so paths are short; a step doubles
    how far every word looks."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = materialize(reached.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return reached


def spelling_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root), one row per word of the vocabulary.

    Null and empty texts have no words; a null id leaves its document's words as they are; repeated rows count as often
    as they stand there; an empty table gives no rows. Only the two named columns are read. A text or word of any length
    is counted whole; a long word makes its shard's tables sparser.
    """
    words = materialize(vocabulary(df, doc_id, text), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    chosen = F.col("form_n") >= RATIO * F.col("n")
    near = materialize(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("form")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n")),
        "near",
    )
    return near.join(_roots(near.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


#: The same in DuckDB SQL, over the view ``documents``: checksums from the table of the polynomial, near words from the
#: words with one code point left out.
SQL_SPELLING = rf"""
WITH RECURSIVE bits(b, k, v) AS (
  SELECT b, 0, b FROM range(0, 256) AS r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
    FROM documents)
  WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL),
bytes AS (
  SELECT doc_id, run, c, list_transform(range(0, length(hex(s)) // 2), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::BIGINT) AS bs
  FROM (SELECT *, encode(concat(doc_id, ':', run)) AS s FROM runs)),
summed AS (
  SELECT doc_id, run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, crc),
heard AS (
  SELECT CASE WHEN doc_id IS NOT NULL AND h % {MISREAD} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c
  FROM summed),
vocabulary AS (SELECT word, sum(c)::BIGINT AS n FROM heard WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter AS a JOIN shorter AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, v.word, v.n FROM shorter AS s JOIN vocabulary AS v ON s.rest = v.word
  UNION SELECT v.word, s.word, s.n FROM shorter AS s JOIN vocabulary AS v ON s.rest = v.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM pairs GROUP BY word),
formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * v.n THEN form END AS form,
         CASE WHEN form_n >= {RATIO} * v.n THEN form_n END AS form_n
  FROM vocabulary AS v LEFT JOIN best USING (word)),
path(word, spot) AS (
  SELECT word, word FROM formed
  UNION ALL
  SELECT p.word, f.form FROM path AS p JOIN formed AS f ON p.spot = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT p.word, p.spot AS root FROM path AS p JOIN formed AS f ON p.spot = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, root, n, n_near::BIGINT AS n_near, form_n FROM formed AS f JOIN ends USING (word)"""
