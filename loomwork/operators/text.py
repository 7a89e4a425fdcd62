"""Counting words and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.strings import bigrams, grams, tokens


def token_rows(lines: DataFrame, *kept: str, line: str = "line") -> DataFrame:
    """A row ``token`` for every token, with the columns ``kept``; nothing is shuffled."""
    return lines.select(*kept, F.explode(tokens(F.col(line))).alias("token"))


def word_count(lines: DataFrame, line: str = "line") -> DataFrame:
    """``token, n``."""
    return token_rows(lines, line=line).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def bigram_count(lines: DataFrame, line: str = "line") -> DataFrame:
    """``x, y, n`` of neighbours inside a line."""
    words = lines.select(tokens(F.col(line)).alias("t"))
    return words.select(F.inline(bigrams(F.col("t")))).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def ngram_rows(lines: DataFrame, n: int, names: str, kept: str | None = None, line: str = "line") -> DataFrame:
    """A row of the slots ``kept`` (all, if not given) and ``n``, 1, for every run of ``n`` tokens inside a line; nothing is shuffled.

    Weights add up, so these rows serve wherever counted n-grams do.
    """
    words = lines.select(tokens(F.col(line)).alias("t"))
    return words.select(F.inline(grams(F.col("t"), n, list(names), kept))).withColumn("n", F.lit(1).cast("long"))


def ngram_count(lines: DataFrame, n: int, names: str, line: str = "line") -> DataFrame:
    """Slots and ``n`` of runs of ``n`` tokens inside a line.

    A run is dealt and counted as one text, a third as long as a row of its words; tokens have no space.
    """
    runs = ngram_rows(lines, n, names, line=line).select(F.concat_ws(" ", *names).alias("_run"))
    counted = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("n"))
    words = F.split("_run", " ")
    return counted.select(*[F.get(words, F.lit(k)).alias(c) for k, c in enumerate(names)], "n")


def two_corpora(lines: DataFrame, foreground: Column, pairs: bool = False, line: str = "line") -> DataFrame:
    """Counts ``f`` and ``b`` of words ``token``, or of pairs ``x, y``, in foreground lines and in the others, by one pass and one shuffle."""
    words = lines.select(foreground.alias("_f"), tokens(F.col(line)).alias("t"))
    rows = words.select("_f", F.inline(bigrams(F.col("t")))) if pairs else words.select("_f", F.explode("t").alias("token"))
    return rows.groupBy(*(["x", "y"] if pairs else ["token"])).agg(F.count_if("_f").alias("f"), F.count_if(~F.col("_f")).alias("b"))


def most_common(counts: DataFrame, k: int, *keys: str, n: str = "n") -> DataFrame:
    """The ``k`` largest counts; ties go to the smaller key."""
    return counts.orderBy(F.desc(n), *keys).limit(k)
