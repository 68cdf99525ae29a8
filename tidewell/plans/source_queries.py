"""Raw posts through the adapters, made from documents as JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import quality
from tidewell.plans.registry import query, table
from tidewell.sources import adapters, lake


def _lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fields = F.struct(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("subreddit"), (F.lit(1704067200) + F.col("doc_id")).alias("created_utc"), F.lit("").alias("title"), F.when(F.col("doc_id") % 13 == 0, "[removed]").otherwise(F.col("text")).alias("selftext"), F.when(F.col("doc_id") % 17 == 0, "AutoModerator").otherwise("x").alias("author"))
    return d.select(F.when(F.col("doc_id") % 29 == 0, F.lit("{broken")).otherwise(F.to_json(fields)).alias("value"))


@query("submission_reasons", "SELECT CASE WHEN doc_id % 29 = 0 THEN 'malformed_json' WHEN source NOT IN ('src1', 'src2', 'src3') THEN 'not_in_communities' WHEN doc_id >= 500 THEN 'outside_date_range' WHEN doc_id % 17 = 0 THEN 'bot_account' WHEN doc_id % 13 = 0 THEN 'removed_or_deleted' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY ALL")
def submission_reasons(spark, sf_dir):
    posts = adapters.submissions(_lines(spark, sf_dir), ["src1", "src2", "src3"], 1704067200, 1704067200 + 500, ["automoderator"])
    return quality.drop_accounting(posts)


@query("rows_per_day", "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1")
def rows_per_day(spark, sf_dir):
    return lake.rows_per_day(table(spark, sf_dir, "events").withColumnRenamed("ts", "created_at"))


@query("read_day", "SELECT event_id AS record_id, value FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-05'")
def read_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("ts").alias("created_at"), "value")
    return lake.read_day(e, "2024-01-05").select("record_id", "value")
