"""Reports on classifiers: resampled intervals and gains, thresholds by kind of score, splits, groups, agreement, noise.

Resampling draws a Poisson(1) weight for each unit (a row, or a cluster such as a post) and replicate from a hash. Units are
summed before they are drawn, so that replicates touch units, not rows, and every replicate is one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.stats import poisson1, ratio, short_hash, wilson
from tidewell.operators import metrics as M

COUNTS = ("tp", "fp", "fn", "tn")


def _draws(units: DataFrame, unit: str, replicates: int, seed: int) -> DataFrame:
    """units with b and w for each replicate; b = -1 has weight 1 and gives the point."""
    u = short_hash(F.concat_ws(":", F.col("b").cast("string"), F.col(unit).cast("string")), str(seed))
    drawn = units.withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    return drawn.withColumn("w", F.when(F.col("b") < 0, 1.0).otherwise(poisson1(u)))


def _interval(col: str, by: list[str], t: DataFrame, alpha: float) -> DataFrame:
    """point (b = -1) and percentiles of a column over replicates where it is defined."""
    own = F.when(F.col("b") >= 0, F.col(col))
    return t.groupBy(*by).agg(F.max(F.when(F.col("b") < 0, F.col(col))).alias("point"), F.percentile(own, F.lit(alpha / 2)).alias("lo"), F.percentile(own, F.lit(1 - alpha / 2)).alias("hi"), F.count(own).alias("n_valid"))


def bootstrap_confusion(df: DataFrame, thresholds: dict[str, float], unit: str, y: str = "y", p: str = "p", replicates: int = 200, seed: int = 42) -> DataFrame:
    """(b, name, tp, fp, fn, tn and what follows of them) for each replicate and named threshold. The same draws serve all thresholds."""
    cells = [c.alias(f"{k}_{name}") for name, t in thresholds.items() for k, c in M.confusion(F.coalesce(F.col(p) >= t, F.lit(False)), F.col(y)).items()]
    units = df.groupBy(F.col(unit).alias("unit")).agg(*cells)
    sums = _draws(units, "unit", replicates, seed).groupBy("b").agg(*(F.sum(F.col("w") * F.col(f"{k}_{n}")).alias(f"{k}_{n}") for n in thresholds for k in COUNTS))
    long = sums.select("b", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), *(F.col(f"{k}_{n}").alias(k) for k in COUNTS)) for n in thresholds))).alias("x")).select("b", "x.*")
    return M.from_confusion(long)


def metric_intervals(draws: DataFrame, names: tuple[str, ...] = ("accuracy", "precision", "recall", "f1", "f1_macro"), alpha: float = 0.05) -> DataFrame:
    """(name, metric, point, lo, hi, n_valid)."""
    long = draws.select("b", "name", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))).alias("x")).select("b", "name", "x.*")
    return _interval("value", ["name", "metric"], long, alpha)


def paired_gain(draws: DataFrame, metric: str, new: str, reference: str, alpha: float = 0.05) -> DataFrame:
    """How much better a metric is at one threshold than at another on the same draws: gain, lo, hi, share of replicates above 0."""
    value = lambda n: F.max(F.when(F.col("name") == n, F.col(metric)))
    t = draws.groupBy("b").agg((value(new) - value(reference)).alias("gain"))
    own = F.when(F.col("b") >= 0, F.col("gain"))
    return t.agg(F.max(F.when(F.col("b") < 0, F.col("gain"))).alias("gain"), F.percentile(own, F.lit(alpha / 2)).alias("lo"), F.percentile(own, F.lit(1 - alpha / 2)).alias("hi"), F.avg((own > 0).cast("double")).alias("share_above_0"))


def independent_delta(a: DataFrame, b: DataFrame, metric: str, alpha: float = 0.05) -> DataFrame:
    """The difference of a metric between two samples that were drawn apart (with different seeds)."""
    t = a.select("b", F.col(metric).alias("x")).join(b.select("b", F.col(metric).alias("y")), "b").withColumn("delta", F.col("x") - F.col("y"))
    return _interval("delta", [], t, alpha)


def decide_threshold(gain: DataFrame, tuned: float, least: float, above_zero: bool = True, reference: float = 0.5) -> DataFrame:
    """The tuned threshold if its gain is clear, else the reference: at least `least`, and if asked for an interval above 0."""
    clear = (F.col("gain") >= least) & ((F.col("lo") > 0) if above_zero else F.lit(True)) & F.lit(abs(tuned - reference) >= 1e-9)
    clear = F.coalesce(clear, F.lit(False))
    return gain.select(F.lit(tuned).alias("tuned"), F.when(clear, F.lit(tuned)).otherwise(F.lit(reference)).alias("applied"), clear.alias("is_clear"), "gain", "lo", "hi")


def cluster_difference(df: DataFrame, values: list[str], flag: str, unit: str, replicates: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(name, with_flag, without, diff, lo, hi): difference of the means of flagged and other rows, with whole clusters drawn."""
    on = F.coalesce(F.col(flag), F.lit(False))
    sums = [F.sum(F.when(on == f, F.col(v).cast("double"))).alias(f"{v}_{int(f)}") for v in values for f in (True, False)]
    units = df.groupBy(F.col(unit).alias("unit")).agg(*sums, F.count_if(on).alias("n_1"), F.count_if(~on).alias("n_0"))
    total = lambda c: F.coalesce(F.sum(F.col("w") * F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))
    t = _draws(units, "unit", replicates, seed).groupBy("b").agg(*(total(f"{v}_{f}").alias(f"{v}_{f}") for v in values for f in (0, 1)), total("n_0").alias("n_0"), total("n_1").alias("n_1"))
    item = lambda v: F.struct(F.lit(v).alias("name"), ratio(F.col(f"{v}_1"), F.col("n_1")).alias("x"), ratio(F.col(f"{v}_0"), F.col("n_0")).alias("y"))
    long = t.select("b", F.explode(F.array(*map(item, values))).alias("i")).select("b", "i.*").withColumn("d", F.col("x") - F.col("y"))
    point = lambda c: F.max(F.when(F.col("b") < 0, F.col(c)))
    own = F.when(F.col("b") >= 0, F.col("d"))
    return long.groupBy("name").agg(point("x").alias("with_flag"), point("y").alias("without"), point("d").alias("diff"), F.percentile(own, F.lit(alpha / 2)).alias("lo"), F.percentile(own, F.lit(1 - alpha / 2)).alias("hi"))


def bootstrap_multilabel(long: DataFrame, threshold: float = 0.5, replicates: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(label, point, lo, hi, n_valid) of F1 for each label of (id, label, y, p), and for `macro` and `micro` over all; rows are drawn."""
    cells = [c.alias(k) for k, c in M.confusion(F.coalesce(F.col("p") >= threshold, F.lit(False)), F.col("y")).items()]
    units = long.groupBy(F.col("id").alias("unit"), "label").agg(*cells)
    t = _draws(units, "unit", replicates, seed).groupBy("b", "label").agg(*(F.sum(F.col("w") * F.col(k)).alias(k) for k in COUNTS))
    f1 = lambda: M.zero_if_undefined(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    own = t.withColumn("f1", f1())
    macro = own.groupBy("b").agg(F.avg("f1").alias("f1")).withColumn("label", F.lit("macro"))
    micro = t.groupBy("b").agg(*(F.sum(k).alias(k) for k in COUNTS)).withColumn("f1", f1()).withColumn("label", F.lit("micro"))
    return _interval("f1", ["label"], reduce(DataFrame.unionByName, (x.select("b", "label", "f1") for x in (own, macro, micro))), alpha)


def domain_shift(df: DataFrame, scores: dict[str, float], flag: str, unit: str, community: str, k_min: int, replicates: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mean score and share above its threshold by label for flagged and other rows with cluster intervals; mean scores by community and flag, blank below k_min)."""
    t = df.select(flag, unit, community, *scores, *((F.col(s) >= th).cast("double").alias(f"above__{s}") for s, th in scores.items()))
    shift = cluster_difference(t, [*scores, *(f"above__{s}" for s in scores)], flag, unit, replicates, seed)
    cells = t.groupBy(community, flag).agg(F.count("*").alias("n"), *(F.avg(s).alias(f"mean__{s}") for s in scores)).withColumn("suppressed", F.col("n") < k_min)
    return shift, cells.withColumns({f"mean__{s}": F.when(~F.col("suppressed"), F.col(f"mean__{s}")) for s in scores})


# weights


def positive_weights(long: DataFrame, most: float = 10.0) -> DataFrame:
    """(label, n_pos, weight): sqrt(negatives / positives), within 1 and `most`; null where a label has no positive row."""
    t = long.groupBy("label").agg(F.sum(F.col("y").cast("long")).alias("n_pos"), F.count("*").alias("n"))
    return t.select("label", "n_pos", F.least(F.greatest(F.sqrt(ratio(F.col("n") - F.col("n_pos"), F.col("n_pos"))), F.lit(1.0)), F.lit(most)).alias("weight"))


def confidence_weights(df: DataFrame, confidence: str, floor: float = 0.5) -> DataFrame:
    """df with weight: confidence (1 where it is not known), at least floor, over its mean."""
    raw = F.greatest(F.coalesce(F.nanvl(F.col(confidence).cast("double"), F.lit(None).cast("double")), F.lit(1.0)), F.lit(floor))
    mean = df.agg(F.avg(raw).alias("mean_weight"))
    return df.join(F.broadcast(mean)).withColumn("weight", raw / F.col("mean_weight")).drop("mean_weight")  # one row


# thresholds by kind of score

#: Grids of thresholds, and what a category with too few positive rows gets.
GRIDS = {"probability": [i / 20 for i in range(1, 20)], "cosine": [i / 50 for i in range(0, 41)], "count": [1.0, 2.0, 3.0, 4.0, 5.0]}
DEFAULTS = {"probability": 0.5, "count": 1.0}
#: Above every cosine: a category that is never flagged.
NEVER = 1.01


def _best_thresholds(long: DataFrame, label: str) -> DataFrame:
    """(label, kind, n, n_pos, tuned, f1) from (label, kind, y, s): the threshold of the kind's grid with the best F1; ties go to that nearest to 0.5, then the smaller."""
    grid = reduce(lambda c, k: c.when(F.col("kind") == k, F.array(*map(F.lit, GRIDS[k]))), GRIDS, F.when(F.lit(False), F.array().cast("array<double>")))
    t = long.withColumn("reached", F.size(F.filter(grid, lambda g: g <= F.col("s"))))
    hist = t.groupBy(label, "kind", "reached").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    total = hist.groupBy(label, "kind").agg(F.sum("pos").alias("n_pos"), F.sum("n").alias("n_all"))
    steps = hist.withColumn("at", F.explode(F.transform(grid, lambda g, i: F.struct(g.alias("t"), i.alias("i"))))).where(F.col("reached") > F.col("at.i"))
    hits = steps.groupBy(label, "kind", F.col("at.t").alias("t")).agg(F.sum("pos").alias("tp"), F.sum(F.col("n") - F.col("pos")).alias("fp"))
    every = total.withColumn("t", F.explode(grid)).join(hits, [label, "kind", "t"], "left").na.fill(0, ["tp", "fp"])
    f1 = M.zero_if_undefined(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos"))
    best = F.max(F.struct(F.round(f1, 9).alias("f1"), (-F.round(F.abs(F.col("t") - 0.5), 9)).alias("near"), (-F.col("t")).alias("small")))
    return every.groupBy(label, "kind").agg(F.max("n_all").alias("n"), F.max("n_pos").alias("n_pos"), best.alias("b")).select(label, "kind", "n", "n_pos", (-F.col("b.small")).alias("tuned"), F.col("b.f1").alias("f1"))


def tune_thresholds(long: DataFrame, least_positive: int = 5, most_prevalent: float = 1.1) -> DataFrame:
    """(label, kind, tuned, applied, rule, f1, n_pos) from (id, label, kind, y, s).

    A category with fewer positive rows than least_positive keeps its default: 0.5 for a probability, 1 for a count, and for a cosine
    the one threshold that is best for all cosine categories together. One that is positive on more than most_prevalent of the rows
    can't say where a threshold belongs: a probability keeps 0.5 and a cosine is never flagged.
    """
    own = _best_thresholds(long, "label")
    pooled = _best_thresholds(long.where("kind = 'cosine'").withColumn("pool", F.lit("cosine")), "pool").agg(F.max("tuned").alias("pooled"))
    t = own.join(F.broadcast(pooled))  # one row
    default = F.when(F.col("kind") == "cosine", F.col("pooled")).when(F.col("kind") == "count", F.lit(DEFAULTS["count"])).otherwise(F.lit(DEFAULTS["probability"]))
    degenerate = (F.col("kind") != "count") & (F.col("n_pos") > most_prevalent * F.col("n"))
    low = F.col("n_pos") < least_positive
    rule = F.when(degenerate, "degenerate_prevalence").when(low, F.concat(F.lit("default_"), F.col("kind"))).otherwise("tuned")
    applied = F.when(degenerate, F.when(F.col("kind") == "cosine", F.lit(NEVER)).otherwise(F.lit(0.5))).when(low, default).otherwise(F.col("tuned"))
    return t.select("label", "kind", "tuned", applied.alias("applied"), rule.alias("rule"), "f1", "n_pos")


# splits


def evaluate_split(long: DataFrame, thresholds: DataFrame, none: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row (for each value of `by`) of (id, label, y, s) at (label, threshold, coverage): macro F1 over all labels, those with positive rows, and those of each coverage; precision, recall and F1 of `no label` against (id, is_none); labels a row."""
    by = list(by)
    t = long.join(thresholds.select("label", "threshold", "coverage"), "label").withColumn("hit", F.coalesce(F.col("s") >= F.col("threshold"), F.lit(False)))
    cells = M.from_confusion(t.groupBy(*by, "label", "coverage").agg(*(c.alias(k) for k, c in M.confusion(F.col("hit"), F.col("y")).items())))
    supported = F.col("tp") + F.col("fn") > 0
    labels = cells.groupBy(F.lit(1).alias("one"), *by).agg(F.avg("f1").alias("f1_macro"), F.avg(F.when(supported, F.col("f1"))).alias("f1_macro_supported"), *(F.avg(F.when(supported & (F.col("coverage") == c), F.col("f1"))).alias(f"f1_macro_{c}") for c in ("supervised", "zero_shot")))
    rows = t.groupBy(*by, "id").agg(F.count_if("hit").alias("n_labels")).join(none.select("id", "is_none"), "id")
    m = {k: c.alias(f"none_{k}") for k, c in M.confusion(F.col("n_labels") == 0, F.col("is_none")).items()}
    per = rows.groupBy(F.lit(1).alias("one"), *by).agg(F.avg("n_labels").alias("mean_labels"), F.avg((F.col("n_labels") == 0).cast("double")).alias("none_predicted_rate"), *(m[k] for k in ("tp", "fp", "fn")))
    out = labels.join(per, ["one", *by])
    tp, fp, fn = (F.col(f"none_{k}") for k in ("tp", "fp", "fn"))
    return out.select(*by, "f1_macro", "f1_macro_supported", "f1_macro_supervised", "f1_macro_zero_shot", M.zero_if_undefined(tp, tp + fp).alias("none_precision"), M.zero_if_undefined(tp, tp + fn).alias("none_recall"), M.zero_if_undefined(2 * tp, 2 * tp + fp + fn).alias("none_f1"), "none_predicted_rate", "mean_labels")


def select_method(report: DataFrame, method: str, metric: str, forced: str | None = None) -> DataFrame:
    """(method, metric, place, selected): methods ranked by a metric (unknown last, then by name); the forced one is selected, or else the first. Raises if the forced one is not there."""
    if forced is not None and not report.where(F.col(method) == forced).limit(1).count():
        raise ValueError(f"no method {forced!r}")
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(F.round(metric, 9)), method)  # a row for each method
    t = report.select(method, metric).withColumn("place", F.row_number().over(order))
    return t.withColumn("selected", (F.col(method) == forced) if forced is not None else F.col("place") == 1)


def aggregation_sensitivity(windows: DataFrame, labels: DataFrame, least_positive: int = 5) -> DataFrame:
    """(aggregation, label, tuned, applied, f1): thresholds tuned on (id, label, kind, y) for scores of windows (id, label, s) taken together as their max, mean or mean of the two best."""
    from tidewell.operators.scoring import window_scores

    keyed = windows.withColumn("key", F.struct("id", "label"))
    t = window_scores(keyed, "key", "s").select("key.id", "key.label", F.explode(F.array(*(F.struct(F.lit(a).alias("aggregation"), F.col(a).alias("s")) for a in ("max", "mean", "top2_mean")))).alias("x")).select("id", "label", "x.*")
    long = t.join(labels, ["id", "label"]).withColumn("label", F.concat_ws("|", "aggregation", "label"))
    out = tune_thresholds(long, least_positive)
    parts = F.split("label", r"\|", 2)
    return out.select(parts[0].alias("aggregation"), parts[1].alias("label"), "tuned", "applied", "f1")


def multiclass_report(long: DataFrame, merged: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per class: label, support, tp, fp, fn, precision, recall, f1; confusion: y, predicted, n; summary: n, accuracy, f1_macro, top_label_ece) of (id, label, p, y), y the true label of the row. With (label, category) scores are summed by category first, and rows keep the category of their label."""
    if merged is not None:
        long = long.join(merged, "label").groupBy("id", F.col("category").alias("label"), "y").agg(F.sum("p").alias("p"))
        long = long.join(merged.select(F.col("label").alias("y"), F.col("category").alias("true")), "y").select("id", "label", "p", F.col("true").alias("y"))
    best = long.groupBy("id", "y").agg(F.max(F.struct(F.round("p", 12).alias("p"), F.col("label"))).alias("b")).select("id", "y", F.col("b.label").alias("predicted"), F.col("b.p").alias("p"))
    confusion = best.groupBy("y", "predicted").agg(F.count("*").alias("n"))
    names = long.select("label").distinct()
    hit = confusion.where("y = predicted").select(F.col("y").alias("label"), F.col("n").alias("tp"))
    t = names.join(hit, "label", "left").join(confusion.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said")), "label", "left").join(confusion.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support")), "label", "left").na.fill(0)
    per = t.select("label", "support", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn")).withColumns({"precision": M.zero_if_undefined(F.col("tp"), F.col("tp") + F.col("fp")), "recall": M.zero_if_undefined(F.col("tp"), F.col("support")), "f1": M.zero_if_undefined(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
    right = best.withColumn("right", (F.col("y") == F.col("predicted")).cast("int"))
    summary = right.agg(F.count("*").alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy")).join(F.broadcast(per.agg(F.avg("f1").alias("f1_macro")))).join(F.broadcast(M.ece(right, "right", "p").withColumnRenamed("ece", "top_label_ece")))  # one row each
    return per, confusion, summary


def single_hit(hits: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """(key, predicted): the one category with a hit, null if there are none or several."""
    on = F.filter(F.array(*(F.when(F.col(c) > 0, F.lit(c)) for c in categories)), lambda x: x.isNotNull())
    return hits.select(key, F.when(F.size(on) == 1, on[0]).alias("predicted"))


def mapped_and_other(df: DataFrame, flags: dict[str, list[str]], group: str, k_min: int) -> DataFrame:
    """(category, n_mapped, n_other, rate_mapped, rate_other, ratio): how often flag__<category> is set in the groups that are mapped to it and in others, blank below k_min."""
    items = []
    for c, groups in flags.items():
        own, flag = F.col(group).isin(*groups), F.col(f"flag__{c}").cast("double")
        items.append(F.struct(F.lit(c).alias("category"), F.count_if(own).alias("n_mapped"), F.count_if(~own).alias("n_other"), F.avg(F.when(own, flag)).alias("m"), F.avg(F.when(~own, flag)).alias("o")))
    t = df.agg(F.array(*items).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    m, o = F.when(F.col("n_mapped") >= k_min, F.col("m")), F.when(F.col("n_other") >= k_min, F.col("o"))
    return t.select("category", "n_mapped", "n_other", m.alias("rate_mapped"), o.alias("rate_other"), ratio(m, o).alias("ratio"))


def runs_summary(runs: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Mean and sample deviation (0 for one run) of metrics over runs, by group."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *(F.avg(m).alias(f"{m}_mean") for m in names), *(F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std") for m in names))


def best_run(runs: DataFrame, run: str, metric: str) -> DataFrame:
    """The run with the best metric; the smaller of equals."""
    return runs.orderBy(F.desc_nulls_last(F.round(metric, 9)), run).limit(1).select(run, metric)


def masking_summary(runs: DataFrame, names: list[str]) -> DataFrame:
    """(metric, original, drop_topic, drop_control_mean, _sd, _min, _max, n_draws, exceeds): how much metrics fall when topic words are masked, against draws of as many random words; runs have condition original, topic_masked or control."""
    long = runs.select("condition", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names))).alias("x")).select("condition", "x.*")
    at = lambda c: F.max(F.when(F.col("condition") == c, F.col("v")))
    base = long.groupBy("metric").agg(at("original").alias("original"), at("topic_masked").alias("topic"))
    control = long.where("condition = 'control'").join(base, "metric").withColumn("d", F.col("original") - F.col("v"))
    t = control.groupBy("metric").agg(F.avg("d").alias("drop_control_mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("drop_control_sd"), F.min("d").alias("drop_control_min"), F.max("d").alias("drop_control_max"), F.count("*").alias("n_draws"))
    drop = F.col("original") - F.col("topic")
    return base.join(t, "metric").select("metric", "original", drop.alias("drop_topic"), "drop_control_mean", "drop_control_sd", "drop_control_min", "drop_control_max", "n_draws", (F.round(drop, 12) > F.round("drop_control_max", 12)).alias("exceeds"))


def masking_runs(df: DataFrame, key: str, text: str, y: str, pattern: str, score, n_words: int, draws: int = 5, token: str = "[MASK]", seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """(condition, draw, accuracy, f1) of a scorer on texts as they are, with topic words masked, and with n_words random other words masked in each of several draws. score(df, text) adds a column p."""
    from tidewell.operators.sampling import mask_words

    def run(condition: str, draw: int, texts: DataFrame) -> DataFrame:
        scored = score(texts, text)
        return M.binary_metrics(scored, y, "p", threshold).select(F.lit(condition).alias("condition"), F.lit(draw).alias("draw"), "accuracy", "f1")

    labels = df.select(key, y)
    parts = [run("original", 0, df), run("topic_masked", 0, df.withColumn(text, F.regexp_replace(text, pattern, token)))]
    for d in range(draws):
        parts.append(run("control", d, mask_words(df, key, text, n_words, token, seed + d, F.col("w").rlike(pattern)).join(labels, key)))
    return reduce(DataFrame.unionByName, parts)


# calibration and final reports


def multilabel_ece(long: DataFrame, n_bins: int = 15) -> DataFrame:
    """(label, ece) for each label of (label, y, p), the mean of these (`mean`) and over all rows together (`pooled`)."""
    p = F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0))

    def gap(t: DataFrame, by: list[str]) -> DataFrame:
        bins = t.groupBy(*by, M.bin_of(p, n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mp"), F.avg(F.col("y").cast("double")).alias("my"))
        return bins.groupBy(*by).agg(ratio(F.sum(F.col("n") * F.abs(F.col("my") - F.col("mp"))), F.sum("n")).alias("ece"))

    per = gap(long, ["label"])
    return per.unionByName(per.agg(F.avg("ece").alias("ece")).withColumn("label", F.lit("mean"))).unionByName(gap(long, []).withColumn("label", F.lit("pooled")))


def calibrated_report(validation: DataFrame, test: DataFrame, margin: str, y: str, unit: str, least_gain: float = 0.01, replicates: int = 100, seed: int = 42) -> DataFrame:
    """(threshold_kind, threshold, temperature, test metrics): a temperature and a threshold from the validation rows, the threshold applied only if its gain is clear, and the test rows at 0.5 and at the threshold that was tuned."""
    temperature = M.fit_temperature(validation, margin, y)
    p = lambda df: df.withColumn("p", 1 / (1 + F.exp(-F.col(margin) / temperature)))
    own = p(validation)
    tuned = M.choose_threshold(own, y, "p").first()["threshold"]
    gain = paired_gain(bootstrap_confusion(own, {"tuned": tuned, "half": 0.5}, unit, y, "p", replicates, seed), "f1", "tuned", "half")
    applied = decide_threshold(gain, tuned, least_gain).first()["applied"]
    at = lambda kind, t: M.binary_metrics(p(test), y, "p", t).select(F.lit(kind).alias("threshold_kind"), F.lit(t).alias("threshold"), F.lit(temperature).alias("temperature"), F.lit(applied == t).alias("applied"), "n", "accuracy", "precision", "recall", "f1", "brier")
    return at("half", 0.5).unionByName(at("tuned", float(tuned)))


def group_report(long: DataFrame, members: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Labels (id, label, y, p) seen as groups (label, grp): the probability of a group is the greatest of its labels', it is predicted if any of them reaches its threshold and holds if any of them does. (grp, support, precision, recall, f1, mean_p, observed_rate, predicted_rate)."""
    t = long.join(members, "label").join(thresholds, "label")
    rows = t.groupBy("id", "grp").agg(F.max(F.col("y").cast("int")).alias("y"), F.max("p").alias("p"), F.max(F.col("p") >= F.col("threshold")).alias("hit"))
    cells = rows.groupBy("grp").agg(F.sum("y").alias("support"), *(c.alias(k) for k, c in M.confusion(F.col("hit"), F.col("y")).items()), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed_rate"), F.avg(F.col("hit").cast("double")).alias("predicted_rate"))
    return M.from_confusion(cells).select("grp", "support", "precision", "recall", "f1", "mean_p", "observed_rate", "predicted_rate")


# agreement with other labels


def agreement_by(df: DataFrame, by: str, reference: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Metrics of each value of `by`, and how far accuracy, F1 and Brier are from those of reference rows."""
    names = ("accuracy", "f1", "brier")
    ref = M.binary_metrics(reference, y, p, threshold).select(*(F.col(m).alias(f"ref_{m}") for m in names))
    t = M.binary_metrics(df, y, p, threshold, [by]).join(F.broadcast(ref))  # one row
    return t.select(by, "n", "prevalence", *names, *((F.col(m) - F.col(f"ref_{m}")).alias(f"delta_{m}") for m in names))


def correlation_report(df: DataFrame, score: str, other: str, y: str) -> DataFrame:
    """How a score goes with another of the same rows: rank correlation, rows where the other is known, its mean by label, and the AUC of both for the label."""
    known = df.where(F.col(other).isNotNull())
    rho = M.spearman(known, score, other).select("rho")
    means = df.agg(F.count("*").alias("n"), F.count(other).alias("n_known"), F.avg(F.when(F.col(y) == 1, F.col(other))).alias("mean_1"), F.avg(F.when(F.col(y) == 0, F.col(other))).alias("mean_0"))
    auc = lambda t, c, name: M.roc_auc(t, y, c).select(F.col("roc_auc").alias(name))
    return means.join(F.broadcast(rho)).join(F.broadcast(auc(known, score, "auc_score"))).join(F.broadcast(auc(known, other, "auc_other")))  # one row each


def handcheck_noise(df: DataFrame, platform: str, auto: str, human: str, prevalence: DataFrame, least: int, least_cell: int = 3) -> DataFrame:
    """(platform, cells, agreement with its interval, ppv, q0, ceilings, status): how noisy automatic labels are by a hand-check, and what agreement with them can be reached at most; pending where too few rows are filled. Rows without a human label don't count."""
    a, h = F.col(auto), F.col(human)
    t = df.where(h.isin(0, 1)).groupBy(platform).agg(F.count("*").alias("n"), *(F.count_if((a == i) & (h == j)).alias(f"auto{i}_human{j}") for i in (1, 0) for j in (1, 0))).join(prevalence, platform, "left")
    n1, n0 = F.col("auto1_human1") + F.col("auto1_human0"), F.col("auto0_human1") + F.col("auto0_human0")
    agree = F.col("auto1_human1") + F.col("auto0_human0")
    lo, hi = wilson(agree, F.col("n"))
    ready = (F.col("n") >= least) & (n1 >= least_cell) & (n0 >= least_cell) & F.col("prevalence").isNotNull()
    ppv, q0 = F.when(ready, ratio(F.col("auto1_human1"), n1)), F.when(ready, ratio(F.col("auto0_human1"), n0))
    ceiling = M.noise_ceiling(ppv, q0, F.col("prevalence"))
    return t.select(platform, "n", *(f"auto{i}_human{j}" for i in (1, 0) for j in (1, 0)), ratio(agree, F.col("n")).alias("agreement"), lo.alias("agreement_lo"), hi.alias("agreement_hi"), ppv.alias("ppv"), q0.alias("q0"), *(c.alias(f"ceiling_{k}") for k, c in ceiling.items()), F.when(ready, "complete").otherwise("pending").alias("status"))


def handcheck_score(df: DataFrame, file: str, auto: str, human: str) -> DataFrame:
    """(file, n, agreement, auto1_human0, auto0_human1) for each file and for ALL."""
    t = df.where(F.col(human).isin(0, 1)).withColumn("f", F.explode(F.array(F.col(file), F.lit("ALL"))))
    a, h = F.col(auto), F.col(human)
    return t.groupBy(F.col("f").alias(file)).agg(F.count("*").alias("n"), F.avg((a == h).cast("double")).alias("agreement"), F.count_if((a == 1) & (h == 0)).alias("auto1_human0"), F.count_if((a == 0) & (h == 1)).alias("auto0_human1"))


def text_predicate_share(df: DataFrame, column: Column, thresholds: list[int]) -> DataFrame:
    """(over, share) of rows whose length is over each threshold."""
    return df.agg(F.array(*(F.struct(F.lit(t).alias("over"), F.avg((column > t).cast("double")).alias("share")) for t in thresholds)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def fit_platt_by_label(long: DataFrame, steps: int = 12) -> dict[str, tuple[float, float]]:
    """{label: (a, b)} of sigmoid(a * z + b) for (label, y, z) with smoothed targets. All labels take a Newton step with one aggregate; a stays positive."""
    n = {r["label"]: (r["pos"], r["n"] - r["pos"]) for r in long.groupBy("label").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n")).collect()}  # a row for each label
    params = dict.fromkeys(n, (1.0, 0.0))
    spark = long.sparkSession
    for _ in range(steps):
        now = spark.createDataFrame([(k, a, b, (n[k][0] + 1) / (n[k][0] + 2), 1 / (n[k][1] + 2)) for k, (a, b) in params.items()], "label string, a double, b double, hi double, lo double")
        t = long.join(now, "label").withColumn("p", 1 / (1 + F.exp(-(F.col("a") * F.col("z") + F.col("b")))))
        gap, w = F.col("p") - F.when(F.col("y").cast("int") == 1, F.col("hi")).otherwise(F.col("lo")), F.col("p") * (1 - F.col("p"))
        sums = t.groupBy("label").agg(F.sum(gap * F.col("z")).alias("ga"), F.sum(gap).alias("gb"), F.sum(w * F.col("z") * F.col("z")).alias("aa"), F.sum(w * F.col("z")).alias("ab"), F.sum(w).alias("bb")).collect()
        for r in sums:
            a, b = params[r["label"]]
            aa, bb = r["aa"] + 1e-9, r["bb"] + 1e-9
            if (det := aa * bb - r["ab"] ** 2) > 0:
                params[r["label"]] = (max(1e-6, a - (bb * r["ga"] - r["ab"] * r["gb"]) / det), b - (aa * r["gb"] - r["ab"] * r["ga"]) / det)
    return params


def multilabel_final(validation: DataFrame, test: DataFrame, excluded: DataFrame | None = None, least_positive: int = 5) -> tuple[DataFrame, DataFrame]:
    """(summary by way: `tuned`, `half`, `raw_half`, and `tuned_without_excluded` where rows to leave out are given; thresholds by label) of (id, label, y, z): logits calibrated by label and thresholds tuned on the validation rows, and the test rows once with each. A label with too few positive rows keeps 0.5."""
    params = fit_platt_by_label(validation)
    table = validation.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in params.items()], "label string, a double, b double")
    calibrated = lambda df: df.join(table, "label").withColumns({"p": 1 / (1 + F.exp(-(F.col("a") * F.col("z") + F.col("b")))), "raw": 1 / (1 + F.exp(-F.col("z")))}).drop("a", "b")
    own, held = calibrated(validation), calibrated(test)
    thresholds = tune_thresholds(own.select("id", "label", F.lit("probability").alias("kind"), "y", F.col("p").alias("s")), least_positive)
    at = held.join(thresholds.select("label", "applied"), "label")

    def summary(way: str, df: DataFrame, score: str, threshold: Column) -> DataFrame:
        shifted = df.select("id", "label", "y", (F.col(score) - threshold).alias("p"))  # above 0 is above its threshold
        return M.multilabel_summary(shifted, 0.0).select(F.lit(way).alias("way"), "f1_macro", "f1_micro", "precision_macro", "recall_macro", "subset_accuracy", "hamming_loss")

    parts = [summary("tuned", at, "p", F.col("applied")), summary("half", at, "p", F.lit(0.5)), summary("raw_half", at, "raw", F.lit(0.5))]
    if excluded is not None:
        parts.append(summary("tuned_without_excluded", at.join(excluded.select("id").distinct(), "id", "left_anti"), "p", F.col("applied")))
    return reduce(DataFrame.unionByName, parts), thresholds
