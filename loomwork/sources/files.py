"""Text sinks, and text kept as one file for each shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.strings import shard


def write_text(df: DataFrame, path: str, column: str = "value", compression: str = "none") -> None:
    """One line of text for every row, in a file for each partition; readers know a compressed file by its name."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path, compression=compression)


class ShardedText:
    """Lines in ``n`` shards; a line's shard depends on its content alone."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n

    def put(self, lines: DataFrame, path: str, line: str = "line") -> DataFrame:
        """Write lines to their shards; returns ``shard, lines``."""
        rows = lines.select(F.col(line).alias("value"), shard(F.col(line), self.n).cast("int").alias("shard"))
        rows.repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)
        return self.stats(path)

    def read(self, path: str) -> DataFrame:
        return self.spark.read.schema("value string, shard int").text(path).select("shard", F.col("value").alias("line"))

    def stats(self, path: str) -> DataFrame:
        """``shard, lines`` of every shard, empty ones too."""
        every = self.spark.range(self.n).select(F.col("id").cast("int").alias("shard"))
        found = self.read(path).groupBy("shard").agg(F.count(F.lit(1)).alias("lines"))
        return every.join(found, "shard", "left").select("shard", F.coalesce("lines", F.lit(0)).alias("lines"))

    def merged(self, path: str) -> DataFrame:
        """``shard, line`` of all lines, shard by shard, in the order in which a shard's files hold them."""
        at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        return self.spark.read.schema("value string, shard int").text(path).select("shard", F.col("value").alias("line"), at.alias("at")).orderBy("shard", "at").drop("at")

    def get_merge(self, path: str, out: str) -> DataFrame:
        """Write all lines, shard by shard, as text files whose names are in order; returns ``shard, lines``."""
        write_text(self.merged(path), out, "line")
        return self.stats(path)

    def head(self, path: str, k: int = 10) -> list[str]:
        """Up to ``k`` lines from the start of the first shard."""
        return [r["line"] for r in self.read(path).where("shard = 0").take(k)]

    def tail(self, path: str, k: int = 10) -> list[str]:
        """Up to ``k`` lines from the end of the last shard."""
        return [r["line"] for r in self.read(path).where(F.col("shard") == self.n - 1).tail(k)]


def head_tail(lines: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """The first and the last ``k`` rows in a total order, with ``place``."""
    first = lines.orderBy(*order).limit(k).withColumn("place", F.lit("head"))
    return first.unionByName(lines.orderBy(*[F.desc(c) for c in order]).limit(k).withColumn("place", F.lit("tail")))
