"""The operators as queries over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (cross_tokens, decontamination, hard_negatives, line_dedup, near_dedup, order_minhash, packing,
                          quality, secrets, sharding, token_counts, token_files, vector_search)
from millrace.session import scratch_path


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = token_files.write(documents(spark, folder), scratch_path(spark, "token_files"),
                             public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(spark, path)


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    # Size and digest are those of the text that arrived. A null text has no bytes; its size is the one byte that every
    # row adds.
    text = F.coalesce("value.text", F.lit("")).cast("binary")
    return sharding.shuffle(documents(spark, folder), shards=8).select(
        "value.doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.search(spark.read.parquet(f"{folder}/embeddings.parquet"), F.expr("vec_id % 50 = 0"), k=5)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")
                                        ).select("doc_id", "item_id", "n_words", "n_equal", "first_word", "last_word")


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(documents(spark, folder))


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder), size=2, percent=80).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    net = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    doc_id = F.col("value.doc_id")
    return quality.score(docs, net).select(
        doc_id, quality.held_out(doc_id).alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, folder).select("doc_id", "text")).select(
        "value.doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("label", label)
    return hard_negatives.mine(vectors, F.expr("vec_id % 50 = 0"))


def op12_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.with_next(documents(spark, folder))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return cross_tokens.align(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("piece_bpe_32k.model"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_sharding": op2_sharding,
    "op3_vector_search": op3_vector_search,
    "op4_decontamination": op4_decontamination,
    "op5_secrets": op5_secrets,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_fingerprints": op12_fingerprints,
    "op13_token_alignment": op13_token_alignment,
}

#: Every other row against each query, whole; few enough at the sizes that the comparison uses.
VECTOR_SEARCH = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

LINE_DEDUP = """
WITH docs AS (
    SELECT coalesce(doc_id, 9223372036854775807) AS doc, doc_id, coalesce(text, '') AS text,
           row_number() OVER () AS r
    FROM documents
), lines AS (
    SELECT r, doc, doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM docs
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, min(doc) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc) < max(doc)
), marked AS (
    SELECT k.*, p.first IS NOT NULL AND k.doc > p.first AS dropped FROM keyed k LEFT JOIN repeated p USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count_if(dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r
"""

NEAR_DEDUP = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
           ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM words
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
         AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept
FROM sets s JOIN reached r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""

HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
           CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLES: dict[str, str] = {"op3_vector_search": VECTOR_SEARCH, "op6_near_dedup": NEAR_DEDUP,
                           "op8_line_dedup": LINE_DEDUP, "op11_hard_negatives": HARD_NEGATIVES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
