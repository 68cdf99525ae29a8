"""Counts, rates and standardised series over period x source x community, with groups below k_min blanked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.stats import Z95, period_start, ratio, suppress, wilson

ALL = "ALL"


def rate_cells(df: DataFrame, granularity: str, date: str = "date", flag: str = "stress_flag", prob: str = "stress_prob") -> DataFrame:
    """Unsuppressed counts by period, source and community, by period and source, and by period.

    Rows are aggregated once; the roll-ups come from that small table. `level` (0 cell, 1 source, 2 all) keeps a real community named ALL apart.
    """
    base = df.groupBy(period_start(F.col(date), granularity).alias("period"), F.col("source").cast("string").alias("source"), F.col("community").cast("string").alias("community")).agg(
        F.count("*").alias("n_total"), F.sum(F.col(flag).cast("long")).alias("n_stress"), F.sum(F.col(prob).cast("double")).alias("prob_sum")
    )
    scope = lambda level, s, c: F.struct(F.lit(level).alias("level"), s.alias("source"), c.alias("community"))
    s, c, every = F.col("source"), F.col("community"), F.lit(ALL)
    rolled = base.select("period", "n_total", "n_stress", "prob_sum", F.explode(F.array(scope(0, s, c), scope(1, s, every), scope(2, every, every))).alias("scope"))
    return rolled.groupBy("period", "scope.level", "scope.source", "scope.community").agg(*(F.sum(x).alias(x) for x in ("n_total", "n_stress", "prob_sum")))


def rate_table(cells: DataFrame, k_min: int) -> DataFrame:
    """Mean probability and rate with its Wilson interval."""
    lo, hi = wilson(F.col("n_stress"), F.col("n_total"))
    t = cells.withColumns({"mean_stress_prob": ratio(F.col("prob_sum"), F.col("n_total")), "stress_rate": ratio(F.col("n_stress"), F.col("n_total")), "ci_low": lo, "ci_high": hi}).drop("prob_sum", "level")
    return suppress(t, "n_total", k_min, ["n_stress", "mean_stress_prob", "stress_rate", "ci_low", "ci_high"])


def reference_weights(df: DataFrame, k_min: int, start: str | None = None, end: str | None = None, first_n_weeks: int = 8, date: str = "date") -> DataFrame:
    """Share of each (source, community) stratum of the records in [start, end], over all and within its source; strata below k_min have weight 0."""
    day = F.col(date).cast("date")
    lo = F.lit(start).cast("date") if start else F.lit(df.agg(F.min(day)).first()[0])
    hi = F.lit(end).cast("date") if end else F.date_add(lo, 7 * first_n_weeks - 1)
    w = df.where(day.between(lo, hi)).groupBy(F.col("source").cast("string").alias("source"), F.col("community").cast("string").alias("community")).agg(F.count("*").alias("n_ref"))
    from pyspark.sql import Window

    w = w.withColumn("usable", F.col("n_ref") >= k_min)
    own = F.when(F.col("usable"), F.col("n_ref")).otherwise(0)
    total = w.agg(F.coalesce(F.sum(own), F.lit(0)).alias("total"))
    in_source = F.sum(own).over(Window.partitionBy("source"))
    w = w.withColumn("weight_in_source", F.coalesce(ratio(own, in_source), F.lit(0.0)))
    return w.join(F.broadcast(total)).withColumn("weight_all", own / F.greatest(F.col("total"), F.lit(1)).cast("double")).drop("total")  # a table of one row


def adjusted_series(cells: DataFrame, weights: DataFrame, k_min: int, min_coverage: float = 0.8) -> DataFrame:
    """Directly standardised rate by scope (ALL and each source) and period: weights of the strata present, renormalised; null below min_coverage of the weight."""
    base = cells.where("level = 0")
    joined = base.join(weights.select("source", "community", "weight_all", "weight_in_source"), ["source", "community"], "left")
    scope = lambda name, w: F.struct(name.alias("scope"), F.coalesce(F.col(w), F.lit(0.0)).alias("w"))
    t = joined.select("period", "n_total", "n_stress", F.explode(F.array(scope(F.lit(ALL), "weight_all"), scope(F.col("source"), "weight_in_source"))).alias("s")).select("period", "n_total", "n_stress", "s.*")
    used = (F.col("n_total") >= k_min) & (F.col("w") > 0)
    p = F.col("n_stress") / F.col("n_total").cast("double")
    sums = t.groupBy("scope", "period").agg(
        F.sum("n_total").alias("n_total"),
        F.sum("n_stress").alias("n_stress"),
        F.coalesce(F.sum(F.when(used, F.col("w"))), F.lit(0.0)).alias("coverage"),
        F.sum(F.when(used, F.col("w") * p)).alias("wp"),
        F.sum(F.when(used, F.col("w") * F.col("w") * p * (1 - p) / F.col("n_total"))).alias("v"),
        F.count_if(used).alias("n_strata"),
    )
    enough = F.col("coverage") >= min_coverage
    est, se = F.when(enough, ratio(F.col("wp"), F.col("coverage"))), F.when(enough, ratio(F.sqrt("v"), F.col("coverage")))
    lo, hi = wilson(F.col("n_stress"), F.col("n_total"))
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    out = sums.withColumns({"adjusted_rate": est, "adj_ci_low": clip(est - Z95 * se), "adj_ci_high": clip(est + Z95 * se), "raw_rate": ratio(F.col("n_stress"), F.col("n_total")), "raw_ci_low": lo, "raw_ci_high": hi}).drop("wp", "v")
    return suppress(out, "n_total", k_min, ["n_stress", "raw_rate", "raw_ci_low", "raw_ci_high", "adjusted_rate", "adj_ci_low", "adj_ci_high", "coverage"])


def unpivot(df: DataFrame, keys: list[str], families: dict[str, str], value: str) -> DataFrame:
    """Long form of column families: families maps level to prefix; gives keys, level, label, value."""
    items = [F.struct(F.lit(level).alias("level"), F.lit(c.removeprefix(prefix)).alias("label"), F.col(c).alias(value)) for level, prefix in families.items() for c in df.columns if c.startswith(prefix)]
    return df.select(*keys, F.explode(F.array(*items)).alias("x")).select(*keys, "x.*")


FAMILIES = {"label": "emotion_p__", "group": "emotion_group__"}


def _present(threshold: float) -> Column:
    return F.coalesce(~F.isnan("p") & (F.col("p") >= threshold), F.lit(False))


def lift_patterns(df: DataFrame, threshold: float) -> DataFrame:
    """Second-stage rows by scope, level, label, flag and weight: counts of rows and of rows with the label. All that lifts and their resampling need, and small."""
    rows = df.where(F.col("second_stage_scored") & F.col("sample_weight").isNotNull())
    long = unpivot(rows, ["community", "stress_flag", "sample_weight"], FAMILIES, "p").withColumn("present", _present(threshold))
    scoped = long.groupBy("community", "level", "label", "stress_flag", "sample_weight").agg(F.count("*").alias("n"), F.count_if("present").alias("k"))
    # overall and by community
    each = scoped.select(F.explode(F.array(F.lit(ALL), F.col("community").cast("string"))).alias("scope"), "level", "label", "stress_flag", "sample_weight", "n", "k")
    return each.groupBy("scope", "level", "label", "stress_flag", "sample_weight").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def lift(df: DataFrame, k_min: int, threshold: float = 0.5) -> DataFrame:
    """Weighted prevalence among flagged and unflagged records and their ratio; blank unless both groups have k_min records."""
    f, w = F.col("stress_flag"), F.col("sample_weight")
    t = lift_patterns(df, threshold).groupBy("scope", "level", "label").agg(
        F.coalesce(F.sum(F.when(f, F.col("n"))), F.lit(0)).alias("n_flagged"),
        F.coalesce(F.sum(F.when(~f, F.col("n"))), F.lit(0)).alias("n_unflagged_sampled"),
        F.sum(F.when(~f, w * F.col("n"))).alias("n_unflagged_weighted"),
        ratio(F.sum(F.when(f, w * F.col("k"))), F.sum(F.when(f, w * F.col("n")))).alias("prev_flagged"),
        ratio(F.sum(F.when(~f, w * F.col("k"))), F.sum(F.when(~f, w * F.col("n")))).alias("prev_unflagged"),
    ).withColumn("lift", ratio(F.col("prev_flagged"), F.col("prev_unflagged")))
    return suppress(t, "n_flagged", k_min, ["n_unflagged_sampled", "n_unflagged_weighted", "prev_flagged", "prev_unflagged", "lift"], F.col("n_unflagged_sampled") < k_min)


def lift_bootstrap(df: DataFrame, k_min: int, key: str, replicates: int = 100, seed: int = 42, threshold: float = 0.5, alpha: float = 0.05, per_community: bool = False) -> DataFrame:
    """Percentile interval of the overall lift, and if asked for of each community's (scope): each record counts Poisson(1) times in a replicate, drawn by a hash of seed, replicate and record."""
    from tidewell.functions.stats import poisson1, short_hash

    rows = df.where(F.col("second_stage_scored") & F.col("sample_weight").isNotNull())
    labels = [c for p in FAMILIES.values() for c in df.columns if c.startswith(p)]
    drawn = rows.select(key, "community", "stress_flag", "sample_weight", *labels, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    w = poisson1(short_hash(F.concat_ws(":", F.col("b").cast("string"), F.col(key).cast("string")), str(seed))) * F.col("sample_weight")
    # one sum for each label while the rows pass, so that replicates are never unpivoted
    scope, by = ([F.explode(F.array(F.lit(ALL), F.col("community").cast("string"))).alias("scope")], ["scope"]) if per_community else ([], [])
    own = drawn.withColumn("w", w).groupBy("b", "stress_flag", *(["community"] if per_community else [])).agg(F.sum("w").alias("all"), *(F.sum(F.when(F.coalesce(F.col(c) >= threshold, F.lit(False)), F.col("w")).otherwise(0.0)).alias(c) for c in labels))
    sums = own.select("b", "stress_flag", "all", *labels, *scope).groupBy("b", "stress_flag", *by).agg(*(F.sum(c).alias(c) for c in ("all", *labels)))
    long = unpivot(sums, ["b", "stress_flag", "all", *by], FAMILIES, "s").withColumn("prev", ratio(F.col("s"), F.col("all")))
    by_b = long.groupBy(*by, "level", "label", "b").agg(ratio(F.max(F.when(F.col("stress_flag"), F.col("prev"))), F.max(F.when(~F.col("stress_flag"), F.col("prev")))).alias("lift"))
    return by_b.groupBy(*by, "level", "label").agg(F.percentile("lift", F.lit(alpha / 2)).alias("lift_ci_low"), F.percentile("lift", F.lit(1 - alpha / 2)).alias("lift_ci_high"), F.count("lift").alias("n_replicates"))


def community_agreement(lifts: DataFrame) -> DataFrame:
    """Share of communities whose lift is on the same side of 1 as the overall one."""
    shown = lifts.where(~F.col("suppressed") & F.col("lift").isNotNull())
    overall = shown.where(F.col("scope") == ALL).select("level", "label", F.col("lift").alias("overall"))
    return shown.where(F.col("scope") != ALL).join(overall, ["level", "label"]).groupBy("level", "label").agg(F.avg(((F.col("lift") > 1) == (F.col("overall") > 1)).cast("double")).alias("community_agreement"), F.count("*").alias("n_communities"))


def cooccurrence(df: DataFrame, k_min: int, threshold: float = 0.5) -> DataFrame:
    """P(emotion | stressor) among flagged second-stage records, with the base rate over all of them."""
    rows = df.where(F.col("second_stage_scored") & F.col("stress_flag"))
    stressors = [c for c in df.columns if c.startswith("stressor_flag__")]
    marks = F.filter(F.array(F.lit(ALL), *(F.when(F.col(c), F.lit(c.removeprefix("stressor_flag__"))) for c in stressors)), F.isnotnull)
    long = unpivot(rows.withColumn("stressors", marks), ["stressors"], FAMILIES, "p").withColumn("present", _present(threshold).cast("long"))
    # counts by pattern of stressors first: exploding them then touches few rows
    packed = long.groupBy("stressors", "level", "label").agg(F.count("*").alias("n"), F.sum("present").alias("k"))
    by = packed.select(F.explode("stressors").alias("stressor"), "level", "label", "n", "k").groupBy("stressor", "level", "label").agg(F.sum("n").alias("n_stressor"), F.sum("k").alias("k"))
    base = by.where(F.col("stressor") == ALL).select("level", "label", ratio(F.col("k"), F.col("n_stressor")).alias("prev_all_flagged"))
    lo, hi = wilson(F.col("k"), F.col("n_stressor"))
    t = by.where(F.col("stressor") != ALL).join(base, ["level", "label"]).withColumns({"prev_given_stressor": ratio(F.col("k"), F.col("n_stressor")), "ci_low": lo, "ci_high": hi})
    t = t.withColumn("lift", F.when(F.col("prev_all_flagged") > 0, F.col("prev_given_stressor") / F.col("prev_all_flagged"))).drop("k")
    return suppress(t, "n_stressor", k_min, ["prev_given_stressor", "ci_low", "ci_high", "prev_all_flagged", "lift"])


def stressor_share(df: DataFrame, granularity: str, k_min: int, date: str = "date") -> DataFrame:
    """Share of flagged second-stage records with each stressor, as a flag and as the top one, by period and community and over all communities."""
    rows = df.where(F.col("second_stage_scored") & F.col("stress_flag")).withColumn("period", period_start(F.col(date), granularity))
    names = [c.removeprefix("stressor_flag__") for c in df.columns if c.startswith("stressor_flag__")]
    base = rows.groupBy("period", F.col("community").cast("string").alias("community"), F.coalesce("stressor_top", F.lit("none_unclear")).alias("top")).agg(F.count("*").alias("n"), *(F.count_if(f"stressor_flag__{s}").alias(f"f_{s}") for s in names))
    scoped = base.withColumn("community", F.explode(F.array(F.col("community"), F.lit(ALL)))).groupBy("period", "community", "top").agg(F.sum("n").alias("n"), *(F.sum(f"f_{s}").alias(f"f_{s}") for s in names))
    total = scoped.groupBy("period", "community").agg(F.sum("n").alias("n_stress_scored"), *(F.sum(f"f_{s}").alias(f"f_{s}") for s in names))
    flags = total.select("period", "community", F.explode(F.array(*(F.struct(F.lit(s).alias("stressor"), F.col(f"f_{s}").alias("n_flag")) for s in names))).alias("x")).select("period", "community", "x.*")
    tops = scoped.select("period", "community", F.col("top").alias("stressor"), F.col("n").alias("n_top"))
    t = flags.join(tops, ["period", "community", "stressor"], "full_outer").join(total.select("period", "community", "n_stress_scored"), ["period", "community"], "left").fillna(0, ["n_flag", "n_top"])
    n = F.col("n_stress_scored")
    (fl, fh), (tl, th) = wilson(F.col("n_flag"), n), wilson(F.col("n_top"), n)
    t = t.withColumns({"share_flag": ratio(F.col("n_flag"), n), "share_top": ratio(F.col("n_top"), n), "flag_ci_low": fl, "flag_ci_high": fh, "top_ci_low": tl, "top_ci_high": th})
    return suppress(t, "n_stress_scored", k_min, ["n_flag", "n_top", "share_flag", "share_top", "flag_ci_low", "flag_ci_high", "top_ci_low", "top_ci_high"])
