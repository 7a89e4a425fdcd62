"""Readers: lines, edges, weighted n-grams, matrices and line sets; sharded text files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions.strings import stripped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of an input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line string`` for every line of text files, without its line feed."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def rows(spark: SparkSession, items: Iterable, schema: str | T.StructType) -> DataFrame:
    """A DataFrame from a local list, with a fixed schema."""
    return spark.createDataFrame(list(items), schema)


def document_lines(docs: DataFrame, *kept: str, text: str = "text") -> DataFrame:
    """Lines of a text column, with the columns ``kept``."""
    return docs.select(*kept, F.explode(F.split(F.col(text), "\n", -1)).alias("line"))


def _checked(df: DataFrame, good: Column, line: str, strict: bool) -> DataFrame:
    """The rows that are good; with ``strict``, the others are an error."""
    if not strict:
        return df.where(good)
    fault = F.raise_error(F.concat(F.lit("malformed line: "), F.col(line))).cast("boolean")
    return df.where(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(fault))


def edges(lines_: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """``src, dst`` from lines of two fields between white space; other lines are left out, or an error if ``strict``."""
    parts = F.split(stripped(F.col(line)), r"\s+")
    return _checked(lines_.select(line, parts.alias("p")), F.size("p") == 2, line, strict).select(F.col("p")[0].alias("src"), F.col("p")[1].alias("dst"))


def weighted_ngrams(lines_: DataFrame, slots: Sequence[str] = "abcde", line: str = "line", strict: bool = False) -> DataFrame:
    """Slots and ``n`` from lines ``word word ...<TAB>count``; lines of another shape are left out, or an error if ``strict``."""
    fields = lines_.select(line, F.split(stripped(F.col(line), left=False), "\t").alias("f"))
    split = fields.select(line, F.size("f").alias("k"), F.split(F.get("f", F.lit(0)), " ").alias("w"), F.get("f", F.lit(1)).try_cast("long").alias("n"))
    return _checked(split, (F.col("k") == 2) & (F.size("w") == len(slots)) & F.col("n").isNotNull(), line, strict).select(*[F.col("w")[i].alias(s) for i, s in enumerate(slots)], "n")


_ENTRIES = "array<array<double>>"


def matrices(spark: SparkSession, path: str, names: Sequence[str] = ("a", "b", "r")) -> dict[str, DataFrame]:
    """Sparse matrices ``row, col, w`` from one JSON document whose keys hold lists of [row, col, w]."""
    document = spark.read.schema(", ".join(f"`{n}` {_ENTRIES}" for n in names)).json(path, multiLine=True)

    def entries(name: str) -> DataFrame:
        one = document.select(F.explode(F.col(name)).alias("e"))
        return one.select(F.col("e")[0].cast("long").alias("row"), F.col("e")[1].cast("long").alias("col"), F.col("e")[2].alias("w"))

    return {n: entries(n) for n in names}


def line_set(lines_: DataFrame, line: str = "line") -> DataFrame:
    """``item``: stripped lines that are not blank."""
    return lines_.select(stripped(F.col(line)).alias("item")).where(F.col("item") != "")
