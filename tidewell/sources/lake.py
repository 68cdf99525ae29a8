"""The lake of cleaned records, enriched tables by date, and published aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, StructField, StructType, TimestampType

from tidewell.operators.quality import check_publishable

LAKE = StructType([StructField("record_id", StringType()), StructField("source", StringType()), StructField("community", StringType()), StructField("created_at", TimestampType()), StructField("text_clean", StringType()), StructField("n_chars", IntegerType()), StructField("n_tokens_est", IntegerType()), StructField("lang", StringType())])
SCORED = ("ok", "ok_truncated")
ROWS_PER_FILE = 500_000


def to_lake_schema(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LAKE))


def write_lake(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by source, year and month. Rows are dealt by month and a few salts of the id, so that a hot month is written by several tasks."""
    t = to_lake_schema(df).withColumns({"year": F.year("created_at"), "month": F.month("created_at")})
    t = t.repartition("source", "year", "month", F.pmod(F.xxhash64("record_id"), F.lit(8)))
    t.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("source", "year", "month").parquet(path)


def read_lake(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType([*(f for f in LAKE if f.name != "source"), LAKE["source"], StructField("year", IntegerType()), StructField("month", IntegerType())])
    return spark.read.schema(schema).parquet(path)


def compact_lake(spark: SparkSession, path: str, to: str) -> None:
    """Rewrites a lake in few sorted files; a range of time in each, so that no partition goes through one task."""
    t = read_lake(spark, path)
    t.repartitionByRange("source", "year", "month", "created_at", "record_id").sortWithinPartitions("source", "year", "month", "created_at", "record_id").write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("source", "year", "month").parquet(to)


def read_day(lake: DataFrame, day: str) -> DataFrame:
    """One UTC day by id. Year and month prune partitions, which a test of created_at alone would not."""
    d = F.lit(day).cast("date")
    t = lake.where((F.col("created_at") >= d.cast("timestamp")) & (F.col("created_at") < F.date_add(d, 1).cast("timestamp")))
    if {"year", "month"} <= set(lake.columns):
        t = t.where((F.col("year") == int(day[:4])) & (F.col("month") == int(day[5:7])))
    return t.orderBy("record_id")


def rows_per_day(lake: DataFrame) -> DataFrame:
    return lake.groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("n"))


def write_enriched(df: DataFrame, path: str) -> None:
    """By source and date; a date that comes again replaces what it had."""
    if any(c in df.columns for c in ("text", "text_clean", "text_raw")):
        raise ValueError("enriched tables hold no text")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source", "date").parquet(path)


def write_restricted(lake: DataFrame, path: str) -> None:
    """Texts of scored records in a place of their own, by source and date; it must not be within the enriched table's."""
    t = lake.select("record_id", "text_clean", "source", F.to_date("created_at").alias("date"))
    t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source", "date").parquet(path)


def write_date(enriched: DataFrame, path: str, date: str, markers: str, settings: dict, texts: DataFrame | None = None, restricted: str | None = None) -> dict:
    """Writes one date of an enriched table (and its texts where they are kept), and last of all its marker: where that is, the date is done. Returns the marker."""
    from tidewell.sources.ledger import settings_hash, write_json
    from tidewell.sources.scratch import written

    if restricted is not None and (restricted.rstrip("/") + "/").startswith(path.rstrip("/") + "/"):
        raise ValueError("restricted texts must not be kept within the enriched table")
    day = written(enriched.where(F.col("date") == F.lit(date).cast("date")), "enriched")  # models run once
    write_enriched(day, path)
    if restricted is not None and texts is not None:
        write_restricted(texts.where(F.to_date("created_at") == F.lit(date).cast("date")), restricted)
    n = day.agg(F.count("*"), F.count_if(F.col("input_status").isin(*SCORED)), F.count_if("second_stage_scored")).first()
    marker = {"date": date, "rows_in": n[0], "rows_scored": n[1], "rows_second_stage": n[2], "settings": settings_hash(settings), "text_written_to_restricted": restricted is not None and texts is not None}
    write_json(f"{markers}/{date}.json", marker)
    return marker


def read_markers(markers: str) -> dict[str, dict]:
    """Markers of finished dates by date."""
    import json
    from pathlib import Path

    return {p.stem: json.loads(p.read_text()) for p in sorted(Path(markers).glob("*.json"))}


def load_enriched(spark: SparkSession, path: str, columns: list[str] | None = None, prefixes: list[str] = ()) -> DataFrame:
    """Scored records with chosen columns and families. The columns of folders are a string and a date, whatever their values look like."""
    kinds = {"source": StringType(), "date": DateType()}
    seen = spark.read.parquet(path).schema
    t = spark.read.schema(StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in seen])).parquet(path)
    want = [c for c in t.columns if columns is None or c in columns or c.startswith(tuple(prefixes) or ("\0",))]
    return t.where(F.col("input_status").isin(*SCORED)).select(*want)


def write_gold(df: DataFrame, path: str, k_min: int, counts: list[str] = ()) -> None:
    """Publishes an aggregate, or refuses to."""
    check_publishable(df, k_min, list(counts))
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def manifest(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """(file, rows, bytes) of a Parquet folder, and if asked for sha256, read where the files are."""
    t = spark.read.parquet(path)
    out = t.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    if not digests:
        return out
    name = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return out.join(files.select(name("path").alias("k"), F.sha2("content", 256).alias("sha256")), name("file") == F.col("k")).drop("k")
