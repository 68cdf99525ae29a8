"""The same results from streams over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.stats import rounded
from tidewell.plans.registry import query
from tidewell.plans.set_queries import KEY
from tidewell.sources.scratch import is_folder
from tidewell.streaming import cells


def _stream(spark, sf_dir, name):
    """A table as a stream of its files; one that is a single file is a stream of its folder's files of that name."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("rate_stream", "SELECT CAST(date_trunc('week', ts) AS DATE) AS period, event_type AS source, 'c' || (user_id % 5) AS community, count(*) AS n_total, CAST(sum(CAST(value >= 50 AS INTEGER)) AS BIGINT) AS n_stress, round(sum(value / (value + 50)), 6) AS prob_sum FROM events GROUP BY ALL")
def rate_stream(spark, sf_dir):
    e = _stream(spark, sf_dir, "events")
    t = e.select(F.col("ts").cast("timestamp").alias("date"), F.col("event_type").alias("source"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("community"), (F.col("value") >= 50).alias("stress_flag"), (F.col("value") / (F.col("value") + 50)).alias("stress_prob"))
    return rounded(cells.run_to_table(cells.rate_stream(t), "rates", "complete"), 6)


@query("first_copies_stream", f"SELECT {KEY} AS dedupe_key, count(DISTINCT 1) AS n FROM documents GROUP BY 1")
def first_copies_stream(spark, sf_dir):
    d = _stream(spark, sf_dir, "documents").select(F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.col("text").alias("text_clean"))
    return cells.run_to_table(cells.first_copies(d).select("dedupe_key"), "copies").groupBy("dedupe_key").agg(F.count("*").alias("n"))
