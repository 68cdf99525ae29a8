"""Topics over time: shares, emergence, persistence; all over a gap-free grid of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewell.functions.stats import period_start, ratio, suppress, wilson

UNASSIGNED, ALL = -1, "ALL"
STEP = {"day": "1 day", "week": "7 days", "month": "1 month"}


def scope_counts(counts: DataFrame, granularity: str) -> DataFrame:
    """(period, community, topic_id, n) with all communities together as ALL."""
    base = counts.groupBy(period_start(F.col("date"), granularity).alias("period"), F.col("community").cast("string").alias("community"), "topic_id").agg(F.sum("n").alias("n"))
    return base.select("period", F.explode(F.array(F.col("community"), F.lit(ALL))).alias("community"), "topic_id", "n").groupBy("period", "community", "topic_id").agg(F.sum("n").alias("n"))


def share_series(counts: DataFrame, granularity: str, k_min: int) -> DataFrame:
    """Share of each topic of its period and scope; unassigned records count below the line only."""
    t = scope_counts(counts, granularity).withColumn("n_total", F.sum("n").over(Window.partitionBy("period", "community"))).where(F.col("topic_id") != UNASSIGNED).withColumnRenamed("n", "n_topic")
    lo, hi = wilson(F.col("n_topic"), F.col("n_total"))
    t = t.withColumns({"share": ratio(F.col("n_topic"), F.col("n_total")), "ci_low": lo, "ci_high": hi})
    return suppress(t, "n_topic", k_min, ["share", "ci_low", "ci_high", "n_total"], F.col("n_total") < k_min)


def period_grid(scoped: DataFrame, granularity: str) -> DataFrame:
    """(community, period, n_period): every period between the first and the last of each scope, with its total."""
    ends = scoped.groupBy("community").agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    grid = ends.select("community", F.explode(F.sequence("lo", "hi", F.expr(f"interval {STEP[granularity]}"))).alias("period"))
    totals = scoped.groupBy("community", "period").agg(F.sum("n").alias("n_period"))
    return grid.join(totals, ["community", "period"], "left").fillna(0, ["n_period"])


def topic_grid(scoped: DataFrame, grid: DataFrame) -> DataFrame:
    """(community, topic_id, period, n_period, n): every topic of a scope in every period of its grid."""
    topics = scoped.where(F.col("topic_id") != UNASSIGNED).select("community", "topic_id").distinct()
    return grid.join(topics, "community").join(scoped, ["community", "topic_id", "period"], "left").fillna(0, ["n"])


def emerging(counts: DataFrame, granularity: str, k_min: int, recent: int = 4, baseline: int = 8, min_count: int = 50, ratio_at_least: float = 1.5, persistence: int = 2, ci_above: bool = True, as_of: str | None = None) -> DataFrame:
    """Topics whose share in the last `recent` periods outgrew that of the `baseline` periods before them.

    The baseline count is floored at k_min. A period is hot when its own share is at least ratio_at_least times the baseline's;
    the longest run of hot periods must reach `persistence`. Scopes without enough periods or records are left out.
    """
    scoped = scope_counts(counts, granularity)
    grid = period_grid(scoped, granularity)
    if as_of:
        grid = grid.where(F.col("period") <= F.lit(as_of).cast("date"))
    back = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("period")))
    grid = grid.withColumn("back", back).where(F.col("back") <= recent + baseline)
    in_w = F.col("back") <= recent
    scope = grid.groupBy("community").agg(F.count("*").alias("periods"), F.max("period").alias("as_of_period"), F.sum(F.when(in_w, F.col("n_period")).otherwise(0)).alias("n_recent_total"), F.sum(F.when(~in_w, F.col("n_period")).otherwise(0)).alias("n_baseline_total"))
    scope = scope.where((F.col("periods") == recent + baseline) & (F.col("n_recent_total") >= k_min) & (F.col("n_baseline_total") >= k_min)).drop("periods")
    cells = topic_grid(scoped, grid)
    sums = cells.groupBy("community", "topic_id").agg(F.sum(F.when(in_w, F.col("n")).otherwise(0)).alias("n_recent"), F.sum(F.when(~in_w, F.col("n")).otherwise(0)).alias("n_baseline")).join(scope, "community")
    sums = sums.withColumns({"share_recent": ratio(F.col("n_recent"), F.col("n_recent_total")), "share_baseline_floored": ratio(F.greatest("n_baseline", F.lit(k_min)), F.col("n_baseline_total"))})
    sums = sums.withColumns({"growth_ratio": ratio(F.col("share_recent"), F.col("share_baseline_floored")), "ci_low_recent": wilson(F.col("n_recent"), F.col("n_recent_total"))[0]})
    # runs of hot periods: the number of cold ones so far names the run
    hot = F.coalesce(ratio(ratio(F.col("n"), F.col("n_period")), F.col("share_baseline_floored")) >= ratio_at_least, F.lit(False))
    in_time = Window.partitionBy("community", "topic_id").orderBy("period")
    runs = cells.where(in_w).join(sums.select("community", "topic_id", "share_baseline_floored"), ["community", "topic_id"]).withColumn("hot", hot).withColumn("run", F.count_if(~F.col("hot")).over(in_time))
    longest = runs.groupBy("community", "topic_id", "run").agg(F.count_if("hot").alias("n")).groupBy("community", "topic_id").agg(F.max("n").alias("max_consecutive_hot"))
    t = sums.join(longest, ["community", "topic_id"])
    ok = (F.col("n_recent") >= max(min_count, k_min)) & (F.col("growth_ratio") >= ratio_at_least) & (F.col("max_consecutive_hot") >= persistence)
    if ci_above:
        ok = ok & (F.col("ci_low_recent") > F.col("share_baseline_floored"))
    t = t.withColumns({"is_emerging": ok, "baseline_below_k": F.col("n_baseline") < k_min}).withColumn("n_baseline", F.when(~F.col("baseline_below_k"), F.col("n_baseline")))
    return suppress(t, "n_recent", k_min, ["share_recent", "share_baseline_floored", "growth_ratio", "max_consecutive_hot", "ci_low_recent", "n_baseline", "is_emerging"]).withColumn("is_emerging", F.coalesce("is_emerging", F.lit(False)))


def persistent(counts: DataFrame, granularity: str, k_min: int, share_at_least: float = 0.05, fraction: float = 0.6, min_periods: int = 8) -> DataFrame:
    """Topics whose share reaches share_at_least in at least `fraction` of the periods with k_min records."""
    scoped = scope_counts(counts, granularity)
    grid = period_grid(scoped, granularity).where(F.col("n_period") >= k_min)
    share = F.col("n") / F.col("n_period").cast("double")
    t = topic_grid(scoped, grid).groupBy("community", "topic_id").agg(F.count("*").alias("n_valid_periods"), F.count_if(share >= share_at_least).alias("n_periods_above"), F.avg(share).alias("mean_share"), F.sum("n").alias("n_topic_valid_periods"))
    t = t.withColumn("fraction_above", ratio(F.col("n_periods_above"), F.col("n_valid_periods"))).withColumn("is_persistent", (F.col("n_valid_periods") >= min_periods) & (F.col("fraction_above") >= fraction))
    return suppress(t, "n_topic_valid_periods", k_min, ["n_periods_above", "fraction_above", "mean_share", "is_persistent"]).withColumn("is_persistent", F.coalesce("is_persistent", F.lit(False)))


def status(emerging_topics: DataFrame, persistent_topics: DataFrame) -> DataFrame:
    m = persistent_topics.select("community", "topic_id", "is_persistent").join(emerging_topics.select("community", "topic_id", "is_emerging"), ["community", "topic_id"], "full_outer").fillna(False, ["is_persistent", "is_emerging"])
    p, e = F.col("is_persistent"), F.col("is_emerging")
    return m.withColumn("status", F.when(p & e, "both").when(e, "emerging").when(p, "persistent").otherwise("neither"))


def ewma(series: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponentially weighted mean of each series, and CUSUM sums around its mean; a fold over each key's own (short) series."""
    rows = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("s"), F.avg(value).alias("m"))
    start = F.struct(F.lit(None).cast("double").alias("e"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast(f"array<struct<{order}:date,ewma:double,cusum_up:double,cusum_down:double>>").alias("out"))

    def step(acc, x):
        e = F.when(acc["e"].isNull(), x[value]).otherwise(F.lit(alpha) * x[value] + F.lit(1 - alpha) * acc["e"])
        up, down = F.greatest(F.lit(0.0), acc["up"] + x[value] - F.col("m")), F.greatest(F.lit(0.0), acc["down"] - x[value] + F.col("m"))
        return F.struct(e.alias("e"), up.alias("up"), down.alias("down"), F.array_append(acc["out"], F.struct(x[order].alias(order), e.alias("ewma"), up.alias("cusum_up"), down.alias("cusum_down"))).alias("out"))

    return rows.select(key, F.inline(F.aggregate("s", start, step)["out"]))
