"""Two corpora compared: log-odds, phraseness, good phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomwork.operators.lineage import written


def totals(counts: DataFrame, vocabulary: str = "vocabulary", total: str = "total") -> DataFrame:
    """One row: the number of distinct keys and the sum of their counts."""
    return counts.agg(F.count(F.lit(1)).alias(vocabulary), F.coalesce(F.sum("n"), F.lit(0)).alias(total))


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of ``df`` beside the single row of an aggregate, whose size is fixed."""
    return df.crossJoin(F.broadcast(one_row))


def held(counts: DataFrame, name: str, kept: str = "f > 0 AND b > 0") -> tuple[DataFrame, DataFrame]:
    """Counts ``f`` and ``b``, worked out once: the rows ``kept``, written, and one row of what all rows add up to.

    ``n1`` and ``n2`` are the keys in the foreground and in the background, ``total`` is the foreground's sum.
    """
    sums = Observation()
    whole = counts.observe(sums, F.count_if(F.col("f") > 0).alias("n1"), F.count_if(F.col("b") > 0).alias("n2"), F.coalesce(F.sum("f"), F.lit(0)).alias("total"))
    rows = written(whole.where(kept), name)
    found = sums.get
    return rows, counts.sparkSession.range(1).select(*[F.lit(found[c]).cast("long").alias(c) for c in ("n1", "n2", "total")])


def add_field(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column unless there is one of that name: an existing field wins."""
    return df if name in df.columns else df.withColumn(name, value)


def lookup(df: DataFrame, slot: str, table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Inner join on ``df[slot] = table[key]`` that attaches ``table[value]`` as ``name`` unless it is there."""
    found = table.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    joined = df.join(found, F.col(slot) == F.col("_key"))
    return add_field(joined, name, F.col("_value")).drop("_key", "_value")


def smoothed(count: Column, vocabulary: Column, total: Column) -> Column:
    """(count + 1 / vocabulary) / (total + 1)."""
    return (count + F.lit(1.0) / vocabulary) / (total + F.lit(1.0))


def log_odds(foreground: DataFrame, background: DataFrame, keys: list[str], background_vocabulary: str = "background") -> DataFrame:
    """Keys that are in both count tables, ``f``, ``b`` and ``score``.

    The score is the logarithm of the ratio of the smoothed frequencies, in
    which the vocabulary size stands for the total, too. With
    ``background_vocabulary="foreground"`` the size of the foreground's
    vocabulary serves on both sides.
    """
    both = foreground.withColumnRenamed("n", "f").join(background.withColumnRenamed("n", "b"), keys, "full")
    return counted_odds(both.select(*keys, F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("b", F.lit(0)).alias("b")), keys, background_vocabulary)


def counted_odds(counts: DataFrame, keys: list[str], background_vocabulary: str = "background", sizes: DataFrame | None = None) -> DataFrame:
    """``log_odds`` of keys whose counts ``f`` and ``b`` in both corpora stand in one row; ``sizes`` as of ``held``, if these aren't all."""
    if background_vocabulary not in ("background", "foreground"):
        raise ValueError(background_vocabulary)
    if sizes is None:
        sizes = counts.agg(F.count_if(F.col("f") > 0).alias("n1"), F.count_if(F.col("b") > 0).alias("n2"))
    sized = beside(counts.where("f > 0 AND b > 0"), sizes.select("n1", F.col("n2" if background_vocabulary == "background" else "n1").alias("n2")))
    score = F.log(smoothed(F.col("f"), F.col("n1"), F.col("n1")) / smoothed(F.col("b"), F.col("n2"), F.col("n2")))
    return sized.select(*keys, "f", "b", score.alias("score"))


def top_bottom(scored: DataFrame, k: int, keys: list[str], score: str = "score") -> DataFrame:
    """The ``k`` highest and the ``k`` lowest rows, ``side`` and ``rank``; ties go to the smaller key."""
    import pyspark.sql.window as w

    def end(side: str, order: Column) -> DataFrame:
        few = scored.orderBy(order, *keys).limit(k)
        rank = F.row_number().over(w.Window.orderBy(order, *keys))  # over k rows
        return few.select(F.lit(side).alias("side"), rank.alias("rank"), *keys, score)

    return end("top", F.desc(score)).unionByName(end("bottom", F.asc(score)))


def phraseness(phrases: DataFrame, words: DataFrame, pairs: DataFrame, pair_totals: DataFrame | None = None) -> DataFrame:
    """``phrases(x, y, ...)`` with ``phrase_count`` (unless they have it), ``x_count, y_count, phraseness``.

    ``words`` are the counts of words, ``pairs`` those of word pairs in the same
    corpus; the score is the logarithm of the pair's smoothed frequency over the
    product of its words'. ``pair_totals`` (``vp, np``) are those of all pairs, if ``pairs`` aren't all.
    """
    joined = phrases if "phrase_count" in phrases.columns else phrases.join(pairs.select("x", "y", F.col("n").alias("phrase_count")), ["x", "y"])
    joined = lookup(joined, "x", words, "token", "n", "x_count")
    joined = lookup(joined, "y", words, "token", "n", "y_count")
    sized = beside(beside(joined, totals(words, "vw", "nw")), totals(pairs, "vp", "np") if pair_totals is None else pair_totals)
    px, py = (smoothed(F.col(c), F.col("vw"), F.col("nw")) for c in ("x_count", "y_count"))
    pxy = smoothed(F.col("phrase_count"), F.col("vp"), F.col("np"))
    return add_field(sized, "phraseness", F.log(pxy / (px * py))).drop("vw", "nw", "vp", "np")


def good_phrases(scored: DataFrame, least: float = 2.5) -> DataFrame:
    """Phrases whose phraseness is above ``least``; their log-odds come along in the same rows, so nothing is joined again."""
    return scored.where(F.col("phraseness") > F.lit(least))
