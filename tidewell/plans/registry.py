"""Registration of named queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is; one of texts with fewer partitions than cores, such as a single small file, is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages", "conversations") and df.rdd.getNumPartitions() < cores else df


Z = "1.959963984540054e0"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    """The same bounds in SQL."""
    k, n = f"CAST({k} AS DOUBLE)", f"nullif(CAST({n} AS DOUBLE), 0)"
    p = f"({k} / {n})"
    centre = f"({p} + {Z} * {Z} / (2.0e0 * {n}))"
    half = f"({Z} * sqrt(greatest({p} * (1.0e0 - {p}) / {n} + {Z} * {Z} / (4.0e0 * {n} * {n}), 0.0e0)))"
    scale = f"(1.0e0 + {Z} * {Z} / {n})"
    clip = lambda e: f"CASE WHEN {n} IS NOT NULL THEN least(greatest({e}, 0.0e0), 1.0e0) END"
    return clip(f"({centre} - {half}) / {scale}"), clip(f"({centre} + {half}) / {scale}")


def hash_sql(key: str, salt: str) -> str:
    """short_hash in SQL."""
    return f"(CAST(('0x' || substr(sha256('{salt}:' || {key}), 1, 12)) AS BIGINT) / 281474976710656.0e0)"


def rnd(e: str, alias: str, digits: int = 8) -> str:
    return f"round({e}, {digits}) AS {alias}"
