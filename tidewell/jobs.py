"""Whole jobs: from sources to the lake, from the lake to enriched tables, and from these to published aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators import ingest, quality, rates, topics
from tidewell.operators.labelled import with_meta
from tidewell.operators.predict import enriched
from tidewell.sources import lake, ledger


def ingest_job(raw: DataFrame, source: str, path: str, order: list[str], lo: str | None = None, hi: str | None = None) -> DataFrame:
    """Cleans and filters raw posts, appends what stays to the lake, and returns rows by reason; raises if any row is unaccounted for."""
    from tidewell.sources.scratch import written

    done = written(ingest.clean_and_filter(raw, source, order, lo, hi), "ingested")
    reasons = quality.drop_accounting(done)
    quality.check_accounting(reasons, raw.count())
    lake.write_lake(done.where("drop_reason is null"), path)
    return reasons


def enrich_job(spark: SparkSession, lake_path: str, out: str, markers: str, settings: dict, predict: Callable[[DataFrame], DataFrame], restricted: str | None = None, force: bool = False) -> list[str]:
    """Scores the dates of a lake that have no marker of these settings, each written whole before its marker, and returns them."""
    records = lake.read_lake(spark, lake_path)
    dates = [str(r["date"]) for r in lake.rows_per_day(records).orderBy("date").collect()]  # a row for each day
    todo = dates if force else ledger.pending(dates, lake.read_markers(markers), ledger.settings_hash(settings))
    for date in todo:
        day = lake.read_day(records, date)
        lake.write_date(enriched(day, predict(day)), out, date, markers, settings, day, restricted)
    return todo


def core_job(scored: DataFrame, out: str, k_min: int, granularities: tuple[str, ...] = ("day", "week", "month")) -> list[str]:
    """Rates, adjusted rates and lifts of enriched records, published if they may be; returns the names of the tables."""
    done = []

    def publish(name: str, df: DataFrame, counts: list[str]) -> None:
        lake.write_gold(df, f"{out}/{name}", k_min, counts)
        done.append(name)

    for g in granularities:
        publish(f"stress_rate_{g}", rates.rate_table(rates.rate_cells(scored, g), k_min), ["n_total"])
    weights = rates.reference_weights(scored, k_min, first_n_weeks=8)
    publish("adjusted_rate_week", rates.adjusted_series(rates.rate_cells(scored, "week"), weights, k_min), ["n_total"])
    publish("lift", rates.lift(scored, k_min), ["n_flagged", "n_unflagged_sampled"])
    return done


def topic_job(assigned: DataFrame, records: DataFrame, out: str, k_min: int, granularity: str = "week") -> None:
    """Topic shares from assignments, published if they may be."""
    lake.write_gold(topics.share_series(with_meta(assigned, records), granularity, k_min), f"{out}/topic_share_{granularity}", k_min, ["n_topic", "n_total"])


def audit_job(tables: dict[str, DataFrame], text: str, path: str) -> None:
    """One Markdown report with the columns, missing texts and duplicates of each table."""
    from tidewell.operators.dedupe import duplicate_stats

    parts: dict[str, DataFrame] = {}
    for name, df in tables.items():
        parts[f"{name}-columns"] = quality.tabular_audit(df)
        if text in df.columns:
            parts[f"{name}-missing"] = quality.missing_text(df, text)
            parts[f"{name}-duplicates"] = duplicate_stats(df, text)
            parts[f"{name}-lengths"] = quality.describe_numeric(df.select(F.char_length(text).alias("n")), "n")
    quality.write_report(path, "Audit", parts)
