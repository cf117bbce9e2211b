"""Incremental ingest of run results: a file stream that keeps each run once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_runs(spark: SparkSession, folder: str, schema: str, key: str, seen_at: str, late: str = "30 days") -> DataFrame:
    """Rows of arriving parquet files, each key once; state older than the lateness bound is dropped."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.withWatermark(seen_at, late).dropDuplicatesWithinWatermark([key])


def append_unseen(stream: DataFrame, target: str, key: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Writes each micro-batch's rows whose key the target table does not hold yet.

    The target is partitioned by a hash of the key, so a micro-batch reads only the keys of the
    buckets that its own keys fall into, never the whole table.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).select("*", bucket).persist()
        try:
            touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]  # at most `buckets` rows
            rows = fresh
            try:
                have = spark.read.parquet(target).where(F.col("_bucket").isin(touched)).select(key)
                rows = fresh.join(have, key, "left_anti")
            except AnalysisException as e:  # the target does not exist before the first batch
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
            rows.write.mode("append").partitionBy("_bucket").parquet(target)
        finally:
            fresh.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loss_windows(stream: DataFrame, at: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean and least value per tumbling window of event time."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.count("*").alias("n"))
