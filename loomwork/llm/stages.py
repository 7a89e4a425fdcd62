"""Stages of the corpus pipeline: each calls one operator on all its predecessor kept.

All but the last return the columns of ``documents`` (doc_id, text, lang,
source, n_chars); further columns of the input are left behind, so their names
cannot clash. A null doc_id, lang, source or n_chars is kept like any other value.
What a stage does with the rest:

| stage | null and empty texts | very long texts | ties | repeated rows | empty table |
|-|-|-|-|-|-|
| language_id | go: no language can be told | read whole | the earlier name | judged each, alike | empty |
| line_dedup | kept, null as empty | compared whole, line by line | the smaller id, then content | alike, so all stay or go | empty |
| near_dedup | one of all of them stays | read whole | the smaller id, then content, then any | one stays | empty |
| mix_sources | weigh nothing, taken once | counted whole | by id, then content | rounded alike | empty |
| bpe_encode | no ids | dealt over tasks in chunks | none can arise | encoded each | empty |

Results do not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, catalogue, langid, line_dedup as lines, mixing, shingles, simhash
from loomwork.llm.shared import components, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, ``lang`` being the predicted one; those without a letter go."""
    known = docs.where(F.col("doc_id").isNotNull() & ~langid.held_out("doc_id"))
    found = langid.predict(docs.select(*COLUMNS), langid.train(known), "text", *COLUMNS)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; one that loses its last line with content goes."""
    left = lines.line_dedup(docs.select(*COLUMNS), also=("lang", "source"))
    kept = left.where((F.col("n_removed") == 0) | (F.length(F.trim(F.regexp_replace("kept", r"\s+", " "))) > 0))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def _simhash_firsts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents, each with a number ``_row``, and of each SimHash component the one that stays."""
    # Rows are told apart by a number they are written with, as ids may be null or repeat.
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "stage-simhash")
    # In order of id: the smallest number of a component is then that of its smallest id.
    order = rows.select("_row", "doc_id", F.xxhash64("text").alias("h"))
    found = simhash.simhash_dedup(rows, "_row").select(F.col("doc_id").alias("_row"), "component_id")
    best = found.join(order, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "_row")).alias("best"))
    return rows, best.select("best.*")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of the smallest id, or of the smaller content among equal ids."""
    rows, best = _simhash_firsts(docs)
    return rows.join(best.select("_row"), "_row", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What ``simhash_dedup`` keeps, less near copies: one document of each component of five-word similarity 0.8 or more."""
    rows, best = _simhash_firsts(docs)
    best = stored(best, "stage-firsts")
    left = rows.join(best.select("_row"), "_row", "left_semi")
    roots = components(shingles.near_links(left), "stage-near").withColumnRenamed("vertex", "_row")
    # Of each component all go but the one that comes first, as in ``simhash_dedup``.
    placed = stored(best.join(roots, "_row"), "stage-placed")
    stay = placed.groupBy("root").agg(F.min(F.struct("no_id", "doc_id", "h", "_row")).alias("best")).select(F.col("best._row").alias("_row"))
    kept = best.join(placed.join(stay, "_row", "left_anti"), "_row", "left_anti")
    return rows.join(kept.select("_row"), "_row", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it takes no copy of go."""
    rows = stored(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "stage-mix")
    # Rounding goes by id and content; the number only leads back to the row.
    key = F.struct("doc_id", F.xxhash64("text").alias("h"), "_row").alias("key")
    mixed = mixing.mix(rows.select(key, "source", "text"), "key", rounding=("doc_id.doc_id", "doc_id.h")).select(F.col("doc_id._row").alias("_row"), "copies").where("copies > 0")
    taken = rows.join(mixed, "_row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return taken.select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left: their number and the digests of the ids and of the decoded bytes."""
    tokenizer = catalogue.default_tokenizer()
    return bpe.digests(bpe.encode(docs, tokenizer), tokenizer)
