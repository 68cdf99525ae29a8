"""The standard tables seen as what the operators work on: scored records, topic counts, labelled predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.stats import short_hash
from tidewell.operators.sampling import two_stage
from tidewell.plans.registry import hash_sql, table

K_MIN, RATE, SEED = 50, 0.15, 42


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as scored records with two-stage weights and score families."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    t = e.select("event_id", F.col("ts").alias("date"), F.col("event_type").alias("source"), F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("community"), "user_id", "value", k.alias("k"))
    t = t.withColumns({"stress_prob": F.col("value") / (F.col("value") + 50), "stress_flag": F.col("value") >= 50})
    scored = F.col("stress_flag") | (short_hash(F.col("event_id"), str(SEED)) < RATE)
    t = t.withColumns({"second_stage_scored": scored, "sample_weight": F.when(F.col("stress_flag"), 1.0).when(scored, 1 / RATE)})
    p = {"joy": F.col("k") % 10 / 10.0, "sadness": F.col("k") % 7 / 7.0, "anger": F.col("k") % 4 / 4.0}
    t = t.withColumns({f"emotion_p__{n}": c for n, c in p.items()})
    t = t.withColumns({"emotion_group__positive": F.col("emotion_p__joy"), "emotion_group__negative": F.greatest("emotion_p__sadness", "emotion_p__anger")})
    flags = {"work": F.col("k") % 2 == 0, "money": F.col("k") % 3 == 0, "health": F.col("k") > 50}
    t = t.withColumns({f"stressor_flag__{n}": c for n, c in flags.items()})
    return t.withColumn("stressor_top", F.when(F.col("stressor_flag__work"), "work").when(F.col("stressor_flag__money"), "money").when(F.col("stressor_flag__health"), "health"))


RECORDS_SQL = f"""r0 AS (
    SELECT event_id, ts AS date, event_type AS source, 'c' || (user_id % 5) AS community, user_id, value,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k, value / (value + 50) AS stress_prob, value >= 50 AS stress_flag,
           {hash_sql("event_id", str(SEED))} AS u
    FROM events),
r AS (
    SELECT *, stress_flag OR u < {RATE}e0 AS second_stage_scored,
           CASE WHEN stress_flag THEN 1.0e0 WHEN u < {RATE}e0 THEN 1.0e0 / {RATE}e0 END AS sample_weight,
           k % 10 / 10.0e0 AS joy, k % 7 / 7.0e0 AS sadness, k % 4 / 4.0e0 AS anger,
           k % 2 = 0 AS work, k % 3 = 0 AS money, k > 50 AS health,
           CASE WHEN k % 2 = 0 THEN 'work' WHEN k % 3 = 0 THEN 'money' WHEN k > 50 THEN 'health' END AS stressor_top
    FROM r0),
emo AS (
    SELECT event_id, community, stress_flag, sample_weight, work, money, health, 'label' AS level, unnest(['joy', 'sadness', 'anger']) AS label, unnest([joy, sadness, anger]) AS p FROM r WHERE second_stage_scored
    UNION ALL
    SELECT event_id, community, stress_flag, sample_weight, work, money, health, 'group', unnest(['positive', 'negative']), unnest([joy, greatest(sadness, anger)]) FROM r WHERE second_stage_scored)"""


def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as topic assignments: one residue of the part is unassigned."""
    t = table(spark, sf_dir, "lineitem")
    topic = F.when(F.col("l_partkey") % 12 == 11, -1).otherwise(F.col("l_partkey") % 12).cast("int")
    return t.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("community"), topic.alias("topic_id")).agg(F.count("*").alias("n"))


TOPICS_SQL = """tc AS (
    SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS community, CAST(CASE WHEN l_partkey % 12 = 11 THEN -1 ELSE l_partkey % 12 END AS INTEGER) AS topic_id, CAST(count(*) AS BIGINT) AS n
    FROM lineitem GROUP BY ALL)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with a score from the length of the document: doc_id, y, p, source, lang."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    p = F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 3)
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), "toxic", p.alias("p"), "source", "lang", "n_chars")


PREDICTIONS_SQL = "pr AS (SELECT l.doc_id, quality AS y, toxic, round(n_chars / (n_chars + 2000.0e0), 3) AS p, source, lang, n_chars FROM labels l JOIN documents d USING (doc_id))"


def two_stage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return two_stage(e.withColumn("stress_flag", F.col("value") >= 50), "event_id", "stress_flag", RATE, SEED)
