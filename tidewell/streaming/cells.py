"""Rates and first copies over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.text import dedupe_key


def rate_stream(stream: DataFrame, ts: str = "date", window: str = "7 days", late: str = "2 days", start: str = "4 days") -> DataFrame:
    """Counts by tumbling window, source and community; windows close when the watermark passes. The offset of four days makes weeks start on Monday."""
    w = F.window(ts, window, window, start) if window == "7 days" else F.window(ts, window)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), "source", "community").agg(F.count("*").alias("n_total"), F.sum(F.col("stress_flag").cast("long")).alias("n_stress"), F.sum("stress_prob").alias("prob_sum")).select(F.col("w.start").cast("date").alias("period"), "source", "community", "n_total", "n_stress", "prob_sum")


def first_copies(stream: DataFrame, ts: str = "created_at", text: str = "text_clean", late: str = "2 days") -> DataFrame:
    """Rows whose text has not been seen within the watermark."""
    return stream.withColumn("dedupe_key", dedupe_key(F.col(text))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["dedupe_key"])


def run_to_table(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a query over what is there and returns what it wrote, as a table in the shared folder: all batches, or in complete mode the last one. Nothing is held by the driver; a batch that is tried again replaces what it had written."""
    from uuid import uuid4

    from tidewell.sources.scratch import shared_dir

    spark: SparkSession = out.sparkSession
    at = f"{shared_dir(spark)}/stream-{name}-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else number}")

    q = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows").select(*out.columns)


def run_once(out: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a query over what is there and returns its result from a table in memory; for backfills and tests."""
    spark: SparkSession = out.sparkSession
    q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
