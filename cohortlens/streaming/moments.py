"""The gene moments under Structured Streaming. Sums are additive, so each batch of a stream of (sample_id, state, gene_id, count, value) rows is
aggregated by itself and written beside the others; reading merges them. State and driver hold nothing, however many genes there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.cells import gene_moments, merge_moments

SCHEMA = T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("state", T.StringType()), T.StructField("gene_id", T.StringType()), T.StructField("count", T.LongType()), T.StructField("value", T.DoubleType())])


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Write the partitions of df in place of those of the same values; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def stream_moments(rows: DataFrame, output: str, checkpoint: str, thresholds=(), **trigger) -> StreamingQuery:
    """A started query that writes the moments of each batch of a stream as partition ``batch`` of the table at output. A batch that is
    repeated after a failure replaces what it had written. Table and checkpoint belong together."""

    def add(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(gene_moments(batch, thresholds).withColumn("batch", F.lit(batch_id).cast("long")), output, "batch")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def moments(spark: SparkSession, output: str) -> DataFrame:
    """The moments of all batches at output so far."""
    return merge_moments(spark.read.parquet(output).drop("batch"))
