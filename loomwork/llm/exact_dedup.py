"""Exact dedup by skew-safe combining: local, salted and global, always on full content.

Only DataFrame functions are used. Three aggregations follow one another, and
each has the normalised text itself among its keys, so equality is decided by
content and never by a digest:

1. every map task combines the equal rows it has read (partial aggregation);
2. the rows of a (salt, digest, text) meet; the salt splits a group of copies
   that holds a large part of all rows over ``salts`` tasks;
3. the winners of the salts meet, at most ``salts`` rows for each text.

Documents then look their group up by digest. Step 3 has counted the contents of
each digest: where there is one, the digest is the content; where SHA-256 had
collided, the contents are told apart by a second hash and the length. So whole
texts are shuffled twice at most.

Defined cases: a null text counts as empty. A null doc_id never wins against a
doc_id; in a group of nulls only, ``keep_id`` is null. Rows that share doc_id
and text are one another's copies and exactly one of them has ``kept``; of other
ties the largest id decides. A very long text is compared whole and takes memory in
proportion to itself in the tasks that it passes. Columns
other than the id and the text are ignored, so their names cannot clash. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import lower_ascii, stored

#: Tasks over which the copies of one text are dealt before they are combined.
SALTS = 32


def _normalised(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = lower_ascii(F.coalesce(F.col(text_column), F.lit("")))
    return docs.select(F.col(id_column).alias("doc_id"), text.alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct normalised text: ``digest, t, keep_id, group_size``."""
    rows = _normalised(docs, id_column, text_column)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    winners = salted.groupBy("salt", "digest", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return winners.groupBy("digest", "t").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    # Contents of one digest: nearly always one. Texts go no further than this step.
    entry = F.struct("keep_id", "group_size", F.xxhash64("t").alias("h"), F.length("t").alias("n"))
    by_digest = groups(docs, id_column, text_column, salts).groupBy("digest").agg(F.collect_list(entry).alias("contents"))
    by_digest = stored(by_digest, "exact-groups")  # read from a table, the join can be split where a digest is frequent
    rows = _normalised(docs, id_column, text_column).withColumn("h", F.xxhash64("t")).withColumn("n", F.length("t"))
    # Repeated rows travel as one with their number, and are dealt out again below.
    rows = rows.groupBy("doc_id", "digest", "h", "n").agg(F.count(F.lit(1)).alias("copies"))
    own = F.filter("contents", lambda x: (F.size("contents") == 1) | ((x["h"] == F.col("h")) & (x["n"] == F.col("n"))))[0]
    joined = rows.join(by_digest, "digest").select("doc_id", "digest", "copies", own.alias("own"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    dealt = joined.select("doc_id", "digest", "own.keep_id", "own.group_size", copy)
    return dealt.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
