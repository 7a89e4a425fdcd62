"""Pattern queries over weighted n-grams with slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "_"


def matches(query: dict[str, str]) -> Column:
    """The n-grams that a query admits: a slot's word must equal its constant; ``_`` and slots not named admit any."""
    fixed = [F.col(slot) == word for slot, word in sorted(query.items()) if word != ANY]
    return reduce(lambda a, b: a & b, fixed, F.lit(True))


def binding(query: dict[str, str]) -> Column:
    """``A=word,B=word`` over the slots that a query names, in order."""
    return F.concat_ws(",", *[F.concat(F.lit(f"{slot.upper()}="), F.col(slot)) for slot in sorted(query)])


def count_bindings(ngrams: DataFrame, query: dict[str, str]) -> DataFrame:
    """``binding, n``: weights of the n-grams that match, by what the named slots are bound to."""
    if unknown := set(query) - set(ngrams.columns):
        raise ValueError(f"no such slots: {sorted(unknown)}")
    slots = sorted(query)
    found = ngrams.where(matches(query)).groupBy(*slots).agg(F.sum("n").alias("n"))
    return found.select(binding(query).alias("binding"), "n")


def distribution(counted: DataFrame, top: int) -> DataFrame:
    """``binding, n, probability`` of the ``top`` bindings; ties go to the smaller binding."""
    whole = counted.agg(F.sum("n").alias("total"))
    shares = counted.crossJoin(F.broadcast(whole)).select("binding", "n", (F.col("n") / F.col("total")).alias("probability"))
    return shares.orderBy(F.desc("n"), "binding").limit(top)


def match_share(ngrams: DataFrame, query: dict[str, str]) -> DataFrame:
    """One row: ``matched``, ``total`` and ``percent`` of all weights (null if there are none), in one pass."""
    sums = ngrams.agg(F.coalesce(F.sum(F.when(matches(query), F.col("n"))), F.lit(0)).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return sums.select("matched", "total", F.try_divide(F.lit(100.0) * F.col("matched"), F.col("total")).alias("percent"))
