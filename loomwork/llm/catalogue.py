"""Queries that apply the operators, with production parameters, to whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, exact_dedup, kneser_ney, langid, line_dedup, mixing, simhash, substring_dedup, token_counts, topk
from loomwork.llm.shared import shared_folder, table

#: Neighbours that the search query asks for.
K = 10


def default_tokenizer() -> bpe.Tokenizer:
    import public_tokenizers

    return bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), K)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept", 256).alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = default_tokenizer()
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, then byte-level BPE tokens, of all documents.

    All documents are loaded with their words, those without a word are withdrawn
    and come back, every count is revised to a second version, the counts by tokens
    are added, what is committed is folded, and the load is repeated, which does nothing.
    """
    docs = table(spark, sf_dir, "documents")
    words, pieces = token_counts.count_tokens(docs, "words", None), token_counts.count_tokens(docs, "byte_bpe_50k", default_tokenizer())
    second = words.withColumn("tokenizer", F.lit("words-2"))
    store = token_counts.Rollups(spark, f"{shared_folder(spark).rstrip('/')}/loomwork-{spark.sparkContext.applicationId}/rollups-{uuid.uuid4().hex}")
    store.commit("load", token_counts.inserts(words))
    store.commit("withdraw-empty", token_counts.deletes(words.where("n_tokens = 0")))
    store.commit("revise", token_counts.revisions(words.where("n_tokens > 0"), second))
    store.compact()
    store.commit("tokens", token_counts.inserts(pieces))
    store.commit("load", token_counts.inserts(words))
    return store.totals()


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out("doc_id"))
    found = langid.predict(docs, langid.train(known), "text", "doc_id")
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    return kneser_ney.classify(table(spark, sf_dir, "documents"), trusted)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_line_dedup, op3_substring_dedup, op4_bpe, op5_mixing, op6_simhash, op7_token_counts, op8_language_id, op9_quality, op10_exact_dedup)}

ORACLES = {
    "op1_topk_search": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op3_substring_dedup": """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT r, unnest(range(1, len(words) - 33)) AS p, words FROM w WHERE len(words) >= 35
), windows AS (
  SELECT r, p, md5(array_to_string(words[p:p + 34], ' ')) AS h FROM starts
), repeated AS (
  SELECT r, p FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM repeated
), gone AS (
  SELECT r, list(i) AS places FROM covered GROUP BY r
), kept AS (
  SELECT w.doc_id, len(w.words) AS n_words, coalesce(len(g.places), 0) AS n_removed,
    CASE WHEN g.places IS NULL THEN w.words
      ELSE list_transform(list_filter(list_zip(w.words, range(1, len(w.words) + 1)), lambda x: NOT list_contains(g.places, x[2])), lambda x: x[1]) END AS left_words
  FROM w LEFT JOIN gone g ON g.r = w.r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(left_words, ' ')) AS kept_sha256
FROM kept
""",
    "op10_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id,
  max(doc_id) OVER (PARTITION BY t) AS keep_id,
  count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(t) AS text_sha256
FROM n
""",
}
