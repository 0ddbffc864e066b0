"""Keep sums of ratings current from a stream of rating files; the batch fit starts from the sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orizuru.sources.store import RATINGS_SCHEMA


def rating_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RATINGS_SCHEMA).option("header", True).csv(folder)


def write_sums(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the sums of each micro-batch by (user, item); the state is the sum over all written batches, so a batch
    that is replayed overwrites its own folder and never counts twice."""

    def batch(rows: DataFrame, number: int) -> None:
        valid = rows.where(F.col("score").isNotNull() & ~F.isnan("score"))
        sums = valid.groupBy("user_id", "item_id").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_sums(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    return rows.groupBy("user_id", "item_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
