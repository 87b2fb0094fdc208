"""Language ID with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary naive-Bayes classifier over hashed byte n-grams predicts
the bit; decoding adds up each codeword's logistic loss, weighted by how well the bit's classifier separates its two
sides, and the codeword with the least loss wins. Two codewords with nearly the same loss make the result ambiguous.

Training counts n-grams over every labelled row given, map-side per task, so what reaches the driver is bounded by
languages x FEATURES. Prediction is map-only and reads nothing but the text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from flowlab.llm.common import blocks, free_name, utf8

#: Hashed features: the first half for pairs of bytes, the second for triples.
FEATURES = 1 << 15
SMOOTHING = 0.5
#: Below this difference of losses between the two nearest codewords a result is ambiguous.
AMBIGUOUS = 0.1
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if 97 <= c <= 122 else 32 for c in range(128)]


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, entries -1 and 1
    weights: np.ndarray  # FEATURES x bits
    bit_weight: np.ndarray  # one per bit, mean 1


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature at each byte for pairs and for triples; -1 where the n-gram would leave its document or is blank."""
    b = _FOLD[data].astype(np.int64)
    half = FEATURES // 2
    n = len(b)
    pair = np.full(n, -1, np.int64)
    triple = np.full(n, -1, np.int64)
    if n > 1:
        key = b[:-1] * 257 + b[1:]
        pair[:-1] = np.where(key == 32 * 257 + 32, -1, (key * 40503 >> 4) % half)
    if n > 2:
        key = (b[:-2] * 257 + b[1:-1]) * 257 + b[2:]
        blank = (b[1:-1] == 32) & ((b[:-2] == 32) | (b[2:] == 32))
        triple[:-2] = np.where(blank, -1, half + (key * 2654435761 >> 12) % half)
    ends = offsets[1:][np.diff(offsets) > 0]
    pair[ends - 1] = -1
    triple[ends - 1] = -1
    triple[ends[ends > 1] - 2] = -1
    return pair, triple


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(texts.fill_null("")))


def ngram_counts(rows: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """(lang, feature, n) over all rows with a label; each task adds up its rows before anything is shuffled."""
    picked = rows.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = _folded(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, b in blocks(np.diff(offsets)):
                local = offsets[a : b + 1] - offsets[a]
                pair, triple = _features(data[offsets[a] : offsets[b]], local)
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                owner = np.repeat(code, np.diff(local))
                both = np.concatenate([(owner * FEATURES + f)[f >= 0] for f in (pair, triple)])
                seen = np.bincount(both, minlength=len(names) * FEATURES).reshape(len(names), FEATURES)
                for name, row in zip(names.tolist(), seen):
                    totals[name] = totals[name] + row if name in totals else row
        for name, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))],
                names=["lang", "feature", "n"],
            )

    counts = picked.mapInArrow(count, "lang string, feature int, n bigint")
    return counts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def codewords(n: int, *, seed: int = 7) -> np.ndarray:
    """Codewords of -1 and 1. Up to five classes: every different split once; above: random splits, far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in columns], float).T
    random = np.random.default_rng(seed)
    bits = 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (n, bits))
        distance = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if (np.abs(code.sum(0)) < n).all() and distance.min() > apart:
            best, apart = code, distance.min()
    return best


def fit_language_model(rows: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """Fit on every row of ``rows`` whose label is not null. No labelled row at all gives a model without languages."""
    table = ngram_counts(rows, text, label).toPandas()
    languages = sorted(table["lang"].unique().tolist())
    share = np.zeros((len(languages), FEATURES))
    for k, name in enumerate(languages):
        part = table[table["lang"] == name]
        share[k, part["feature"].to_numpy()] = part["n"].to_numpy()
    share = (share + SMOOTHING) / (share.sum(1, keepdims=True) + SMOOTHING * FEATURES)
    code = codewords(len(languages))
    weights = np.zeros((FEATURES, code.shape[1]))
    gain = np.ones(code.shape[1])
    if len(languages) > 1:
        for b in range(code.shape[1]):
            one, zero = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
            weights[:, b] = np.log(one) - np.log(zero)
            gain[b] = ((one - zero) * weights[:, b]).sum()
    return LanguageModel(languages, code, weights.astype(np.float32), gain / max(gain.mean(), 1e-12))


def decode(margins: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest language, score, ambiguous) for rows of bit margins; ties go to the first language by name."""
    z = margins[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -z) * model.bit_weight).sum(2)
    best = loss.argmin(1)
    ordered = np.sort(loss, 1)
    likely = np.exp(-(loss - ordered[:, :1]))
    score = 1 / likely.sum(1)
    close = ordered[:, 1] - ordered[:, 0] < AMBIGUOUS if loss.shape[1] > 1 else np.zeros(len(loss), bool)
    return best, score, close


def _predict(texts: pa.Array, model: LanguageModel) -> tuple[list, np.ndarray, np.ndarray]:
    n = len(texts)
    lang, score, close = [UNDETERMINED] * n, np.zeros(n), np.ones(n, bool)
    if not model.languages or not n:
        return lang, score, close
    lettered = pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
    data, offsets = _folded(texts)
    bits = model.weights.shape[1]
    margins = np.zeros((n, bits))
    for a, b in blocks(np.diff(offsets), 1 << 18):
        for lo in range(int(offsets[a]), max(int(offsets[b]), int(offsets[a]) + 1), 1 << 22):  # one text may exceed a block
            hi = min(int(offsets[b]), lo + (1 << 22) + 2)
            local = np.clip(offsets[a : b + 1], lo, hi) - lo
            pair, triple = _features(data[lo:hi], local)
            owner = np.repeat(np.arange(a, b), np.diff(local))
            if hi - lo > 1 << 22:  # the overlap of two bytes starts no n-gram here
                pair[1 << 22 :] = -1
                triple[1 << 22 :] = -1
            for f in (pair, triple):
                at = f >= 0
                rows, picked = owner[at], f[at]
                for k in range(bits):
                    margins[a:b, k] += np.bincount(rows - a, model.weights[picked, k], b - a)
                score[a:b] += np.bincount(rows - a, minlength=b - a)
    margins /= np.sqrt(np.maximum(score, 1))[:, None]
    best, score, close = decode(margins, model)
    names = np.array(model.languages, object)[best]
    names[~lettered] = UNDETERMINED
    score[~lettered] = 0.0
    close[~lettered] = True
    return names.tolist(), score, close


def predict_language(rows: DataFrame, model: LanguageModel, text: str = "text", *, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``rows`` with the predicted language, its score from 0 to 1 and an ambiguity flag; map-only.

    Null text and text without a letter give ``und``, score 0, ambiguous. Added columns whose names are taken get
    leading underscores. Very long texts are read in slices, whole.
    """
    added = []
    for name in names:
        added.append(free_name(name, [*rows.columns, *added]))
    plain = rows.select([F.col(f"`{c.replace('`', '``')}`") for c in rows.columns])
    schema = StructType([*plain.schema.fields, StructField(added[0], StringType()), StructField(added[1], DoubleType()), StructField(added[2], BooleanType())])
    at = rows.columns.index(text)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, close = _predict(batch.column(at), shared.value)
            more = [pa.array(lang, pa.string()), pa.array(score), pa.array(close)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *added])

    return plain.mapInArrow(predict, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
