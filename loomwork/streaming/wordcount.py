"""Word counts that grow as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.operators.text import token_rows


def token_stream(spark: SparkSession, folder: str, schema, text: str = "text") -> DataFrame:
    """Tokens of the Parquet files in a folder, as they come in."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return token_rows(rows.select(F.col(text).alias("line")))


def running_counts(tokens: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """``token, n`` so far, in the in-memory table ``name``; ends when all files that are there have been counted."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
