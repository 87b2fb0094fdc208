"""Registered queries of the text operators, over whole tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm import chat, exact, fingerprint, language, lexicon, licenses, near, packing, sharding, spelling, substring, trie, urls
from flowlab.llm.common import load, public_id


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    out = chat.format_chats(load(spark, sf, "conversations"))
    return out.withColumnRenamed("conv", "conv_id")


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf, "documents")).select(
        public_id().alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    out = lexicon.encoded_digests(load(spark, sf, "documents"), tokenizer_path())
    return out.select(public_id().alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op4_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = exact.exact_groups(load(spark, sf, "documents"))
    return out.select(public_id().alias("doc_id"), public_id("keep_id").alias("keep_id"), "group_size", "kept", "text_sha256")


SQL_EXACT = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS kept, sha AS text_sha256
FROM t"""


def op5_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    out = fingerprint.edited_fingerprints(load(spark, sf, "documents"))
    return out.select(public_id().alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(load(spark, sf, "documents"))


def packed(documents: DataFrame) -> DataFrame:
    out = packing.pack(documents, tokenizer_path())
    return out.select(public_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(load(spark, sf, "pages"), load(spark, sf, "labels"))


def op8_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = near.near_classes(load(spark, sf, "documents"))
    return out.select(public_id().alias("doc_id"), public_id("class_id").alias("class_id"), "class_size", "kept")


def op9_language(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents")
    model = language.fit_language_model(documents.filter(~language.held_out()))
    out = language.predict_language(documents.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    documents = load(spark, sf, "documents")
    texts = substring._texts(documents, "doc_id", "text")
    digests = substring.word_digests(texts)
    cut = substring.removals(documents).select("id", "th", "n_removed", F.sha2("kept_text", 256).alias("cut_sha256"))
    out = digests.join(cut, ["id", "th"], "left")
    return out.select(
        F.when(F.col("id") != substring.LAST_ID, F.col("id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )


SQL_SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g FROM k WHERE i + 12 <= len(ws)),
fst AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, win.i FROM win JOIN fst USING (g) WHERE f < win.doc_id),
cov AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(0, 13) AS r(j)),
one AS (
  SELECT k.doc_id, k.i, k.ws[k.i] AS word, cov.i IS NOT NULL AS gone
  FROM k LEFT JOIN cov ON cov.doc_id = k.doc_id AND cov.i = k.i),
agg AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM one GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN agg USING (doc_id)"""


def op11_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = licenses.scan_licenses(load(spark, sf, "documents"))
    return out.select(public_id().alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(load(spark, sf, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    out = spelling.spelling_variants(load(spark, sf, "documents"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_chat_formatting": (op1_chat_formatting, None),
    "op2_sharding": (op2_sharding, None),
    "op3_bpe": (op3_bpe, None),
    "op4_exact_dedup": (op4_exact_dedup, SQL_EXACT),
    "op5_fingerprints": (op5_fingerprints, None),
    "op6_packing": (op6_packing, None),
    "op7_url_filter": (op7_url_filter, None),
    "op8_near_dedup": (op8_near_dedup, None),
    "op9_language": (op9_language, None),
    "op10_substring_dedup": (op10_substring_dedup, SQL_SUBSTRING),
    "op11_license_scan": (op11_license_scan, licenses.SQL_LICENSES),
    "op12_prefix_trie": (op12_prefix_trie, trie.SQL_TRIE),
    "op13_spelling_variants": (op13_spelling_variants, spelling.SQL_SPELLING),
}
