"""From raw posts to lake rows: cleaning, filters with a reason for every dropped row, first copy kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions import text as T
from tidewell.sources.scratch import written

MAX_CHARS, MIN_LETTERS, MIN_TOKENS = 20_000, 3, 5


def clean_input(raw: Column) -> Column:
    """What is scored of a text: at most MAX_CHARS characters of it, cleaned."""
    return T.clean_text(F.substring(raw, 1, MAX_CHARS))


def input_status(raw: Column, clean: Column | None = None, lang: Column | None = None, english_only: bool = True) -> Column:
    """Why a text is not scored, or ok; clean is what clean_input made of raw. Without it the whole text is judged as it stands, and what cleaning would take away counts."""
    status = F.when(raw.isNull(), "none").when(raw.rlike(r"\A\p{Zs}*\z"), "empty")
    if clean is None:
        status = status.when(F.regexp_count(raw, F.lit(r"\p{L}")) < MIN_LETTERS, "no_text")
    else:
        status = status.when(F.trim(clean) == "", "empty_after_cleaning").when(T.letters(clean) < MIN_LETTERS, "no_text")
    if lang is not None and english_only:
        status = status.when(lang != "en", "non_english")
    return status.otherwise(F.when(F.char_length(raw) > MAX_CHARS, "ok_truncated").otherwise("ok"))


def mark_duplicates(df: DataFrame, key: Column, order: list[Column], reason: str = "drop_reason") -> DataFrame:
    """Marks later copies among the rows that nothing else drops. The first place of each key is found by partial sums and joined back, so that a hot key is no single task's. df is read twice: write it first if it is dear."""
    keyed = df.withColumns({"__key": F.when(F.col(reason).isNull(), key), "__at": F.struct(*order)})
    first = keyed.where("__key is not null").groupBy("__key").agg(F.min("__at").alias("__first"))
    copy = F.col("__first").isNotNull() & (F.col("__at") != F.col("__first"))
    # rows that are dropped anyway would all share the null key: they get keys of their own
    spread = keyed.withColumn("__key", F.coalesce("__key", F.concat(F.lit("-"), F.xxhash64("__at").cast("string"))))
    return spread.join(first, "__key", "left").withColumn(reason, F.when(copy, "duplicate").otherwise(F.col(reason))).drop("__key", "__at", "__first")


def clean_and_filter(raw: DataFrame, source: str, order: list[str], lo: str | None = None, hi: str | None = None, min_tokens: int = MIN_TOKENS, decode: bool = True) -> DataFrame:
    """raw (record_id, community, created_at, text_raw[, lang]) with lake columns and drop_reason: the first that applies, in a fixed order, or null for rows that stay."""
    df = raw.withColumn("text_clean", T.clean_text(F.col("text_raw"), decode=decode))
    df = df.withColumns({"n_chars": F.char_length("text_clean"), "n_tokens_est": T.token_estimate(F.col("text_clean")), "source": F.lit(source)})
    at = F.col("created_at")
    reason = F.when(at.isNull(), "no_timestamp")
    if lo or hi:
        reason = reason.when((at < F.lit(lo or "0001-01-01").cast("timestamp")) | (at >= F.lit(hi or "9999-12-31").cast("timestamp")), "out_of_range")
    reason = reason.when(F.col("text_clean") == "", "empty").when(T.is_bot_text(F.col("text_clean")), "bot").when(F.col("n_tokens_est") < min_tokens, "too_short")
    if "lang" in raw.columns:
        reason = reason.when(F.col("lang") != "en", "non_english")
    return mark_duplicates(written(df.withColumn("drop_reason", reason), "cleaned"), T.dedupe_key(F.col("text_clean")), [F.col(c) for c in order])
