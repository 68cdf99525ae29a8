"""Vectors of texts: pooled from their tokens' vectors, and kept so that no text is encoded twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.operators.scoring import normalised
from tidewell.sources.scratch import exists, written


def pooled(tokens: Column, how: str = "mean", unit: bool = True) -> Column:
    """One vector for an array of token vectors: their mean, or the first of them (cls); of unit length if asked for, null for none."""
    if how not in ("mean", "cls"):
        raise ValueError(f"no way {how!r} to pool")
    first = F.get(tokens, F.lit(0)).cast("array<double>")
    if how == "mean":
        total = F.aggregate(tokens, F.transform(first, lambda _: F.lit(0.0)), lambda a, v: F.zip_with(a, v.cast("array<double>"), lambda x, y: x + y))
        first = F.transform(total, lambda x: x / F.size(tokens))
    return F.when(F.size(tokens) > 0, normalised(first) if unit else first)


def cached_vectors(df: DataFrame, key: str, text: str, model: str, encode: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """(key, vector) of all rows with a text. Vectors lie under path by a digest of model and text; only texts that are not there are encoded, each once, and added. encode takes (digest, text) and adds a column vector."""
    spark = df.sparkSession
    keyed = df.where(F.col(text).isNotNull()).select(key, text, F.sha2(F.concat_ws("\n", F.lit(model), text), 256).alias("digest"))
    wanted = keyed.groupBy("digest").agg(F.min(text).alias("text"))
    if exists(spark, path):
        wanted = wanted.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    new = written(encode(wanted).select("digest", F.col("vector").cast("array<float>").alias("vector")), "vectors")
    if new.limit(1).count() or not exists(spark, path):
        new.write.mode("append").parquet(path)
    return keyed.select(key, "digest").join(spark.read.parquet(path).dropDuplicates(["digest"]), "digest").select(key, "vector")
