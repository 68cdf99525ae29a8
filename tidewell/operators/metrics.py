"""Quality of classifiers as aggregates: confusion counts, ranking, calibration, thresholds, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.stats import poisson1, ratio, running, short_hash


def zero_if_undefined(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def confusion(pred: Column, y: Column) -> dict[str, Column]:
    y = y.cast("int") == 1
    return {"tp": F.count_if(y & pred), "fp": F.count_if(~y & pred), "fn": F.count_if(y & ~pred), "tn": F.count_if(~y & ~pred)}


def from_confusion(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of either class from tp, fp, fn, tn; 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1, f0 = zero_if_undefined(2 * tp, 2 * tp + fp + fn), zero_if_undefined(2 * tn, 2 * tn + fp + fn)
    return df.withColumns({"accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": zero_if_undefined(tp, tp + fp), "recall": zero_if_undefined(tp, tp + fn), "f1": f1, "f1_macro": (f1 + f0) / 2})


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, by: list[str] = ()) -> DataFrame:
    pred = F.coalesce(F.col(p) >= threshold, F.lit(False))
    t = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("prevalence"), *(c.alias(k) for k, c in confusion(pred, F.col(y)).items()), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"), F.avg(pred.cast("double")).alias("predicted_positive_rate"))
    return from_confusion(t)


def score_counts(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Positives and negatives of each distinct score."""
    return df.groupBy(F.col(p).cast("double").alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve, tied scores averaged; null with one class only."""
    t = running(score_counts(df, y, p), "p", ["neg"])
    return t.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0)).alias("wins")).select("n_pos", "n_neg", ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Sum over thresholds of recall gained times precision; tied scores are one threshold."""
    counts = score_counts(df, y, p)
    t = running(counts, "p", ["pos", "neg"])
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    t = t.join(F.broadcast(total))  # a table of one row
    tp, fp = F.col("all_pos") - F.col("before_pos"), F.col("all_neg") - F.col("before_neg")
    return t.agg(ratio(F.sum(F.col("pos") * ratio(tp, tp + fp)), F.max("all_pos")).alias("average_precision"), F.max("all_pos").alias("n_pos"))


def bin_of(p: Column, n_bins: int = 15) -> Column:
    """The number of interior edges at or below p."""
    return F.size(F.filter(F.array(*(F.lit(i / n_bins) for i in range(1, n_bins))), lambda e: e <= p))


def reliability(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 15) -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    t = df.groupBy(bin_of(clipped, n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(clipped).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("frac_positive"))
    return t.withColumns({"bin_lo": F.col("bin") / float(n_bins), "bin_hi": (F.col("bin") + 1) / float(n_bins)})


def ece(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 15) -> DataFrame:
    return reliability(df, y, p, n_bins).agg(ratio(F.sum(F.col("n") * F.abs(F.col("frac_positive") - F.col("mean_p"))), F.sum("n")).alias("ece"))


def threshold_curve(df: DataFrame, y: str = "y", p: str = "p", lo: int = 5, hi: int = 95) -> DataFrame:
    """Counts at each threshold of a grid of hundredths, from one histogram of scores over the grid."""
    grid = [i / 100 for i in range(lo, hi + 1)]
    at = F.size(F.filter(F.array(*(F.lit(t) for t in grid)), lambda t: t <= F.col(p)))  # how many thresholds a score reaches
    hist = df.groupBy(at.alias("reached")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    total = hist.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    t = hist.select("pos", "neg", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda i: F.struct(i.alias("i"), (i < F.col("reached")).alias("hit")))).alias("g"))
    t = t.groupBy("g.i").agg(F.sum(F.when(F.col("g.hit"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("g.hit"), F.col("neg")).otherwise(0)).alias("fp")).join(F.broadcast(total))  # one row
    t = t.select(((F.col("i") + lo) / 100.0).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))
    return from_confusion(t).withColumn("youden", F.col("recall") - ratio(F.col("fp"), F.greatest(F.col("fp") + F.col("tn"), F.lit(1))))


def choose_threshold(df: DataFrame, y: str = "y", p: str = "p", criterion: str = "f1") -> DataFrame:
    """The grid threshold with the best f1 or youden; ties go to the one nearest to 0.5, then the smaller."""
    t = threshold_curve(df, y, p)
    best = F.round(F.col(criterion), 9)
    return t.orderBy(best.desc(), F.round(F.abs(F.col("threshold") - 0.5), 9), "threshold").limit(1).select("threshold", F.col(criterion).alias("value"))


def by_group(df: DataFrame, group: str, y: str = "y", p: str = "p", threshold: float = 0.5, min_n: int = 1) -> DataFrame:
    t = binary_metrics(df, y, p, threshold, [group])
    t = t.withColumns({"false_positive_rate": ratio(F.col("fp"), F.greatest(F.col("fp") + F.col("tn"), F.lit(1))), "false_negative_rate": ratio(F.col("fn"), F.greatest(F.col("fn") + F.col("tp"), F.lit(1)))})
    own = ["prevalence", "accuracy", "f1", "false_positive_rate", "false_negative_rate"]
    return t.select(group, "n", *(F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in own))


def multilabel(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per-label measures of (id, label, y, p)."""
    pred = F.coalesce(F.col("p") >= threshold, F.lit(False))
    t = long.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("support"), *(c.alias(k) for k, c in confusion(pred, F.col("y")).items()), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"), F.avg(pred.cast("double")).alias("predicted_positive_rate"))
    return from_confusion(t).drop("f1_macro")


def multilabel_summary(long: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Macro and micro averages, subset accuracy and Hamming loss."""
    labels = multilabel(long, threshold)
    macro = labels.agg(F.avg("f1").alias("f1_macro"), F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))
    micro = from_confusion(macro.withColumnRenamed("f1_macro", "m")).select(F.col("m").alias("f1_macro"), "precision_macro", "recall_macro", F.col("precision").alias("precision_micro"), F.col("recall").alias("recall_micro"), F.col("f1").alias("f1_micro"))
    wrong = (F.coalesce(F.col("p") >= threshold, F.lit(False)) != (F.col("y").cast("int") == 1)).cast("double")
    rows = long.groupBy("id").agg(F.max(wrong).alias("any"), F.sum(wrong).alias("wrong"), F.count("*").alias("l"))
    return micro.join(F.broadcast(rows.agg(F.avg(1 - F.col("any")).alias("subset_accuracy"), ratio(F.sum("wrong"), F.sum("l")).alias("hamming_loss"))))  # one row each


def average_ranks(df: DataFrame, col: str) -> DataFrame:
    """(value, rank): the average rank of each distinct value of a column."""
    counts = df.groupBy(F.col(col).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return running(counts, "value", ["n"]).select("value", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null if a side is constant."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    b = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if b[0] is None or b[0] == b[1] or b[2] == b[3]:
        return df.agg(F.lit(None).cast("double").alias("rho"), F.count("*").alias("n"))
    rx = average_ranks(df, x).select(F.col("value").alias("vx"), F.col("rank").alias("rx"))
    ry = average_ranks(df, y).select(F.col("value").alias("vy"), F.col("rank").alias("ry"))
    # ranks meet pairs of values, not rows
    pairs = df.groupBy(F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")).agg(F.count("*").alias("n")).join(rx, "vx").join(ry, "vy")
    n, m = F.col("n"), lambda a, b: F.sum(F.col("n") * a * b)
    t = pairs.agg(F.sum("n").alias("n"), F.sum(n * F.col("rx")).alias("sx"), F.sum(n * F.col("ry")).alias("sy"), m(F.col("rx"), F.col("rx")).alias("sxx"), m(F.col("ry"), F.col("ry")).alias("syy"), m(F.col("rx"), F.col("ry")).alias("sxy"))
    num = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    den = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")))
    return t.select(ratio(num, den).alias("rho"), "n")


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    ma, mb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    t = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).join(F.broadcast(chance))  # one row
    po, pe = F.col("same") / F.col("n").cast("double"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    return t.select("n", po.alias("agreement"), ratio(po - pe, 1 - pe).alias("kappa"))


def noise_ceiling(ppv1: Column, q0: Column, prevalence: Column) -> dict[str, Column]:
    """Best agreement with automatic labels that a classifier of the true ones can reach."""
    tp = prevalence * ppv1
    precision = ratio(tp, tp + (1 - prevalence) * q0)
    return {"roc_auc": 0.5 * (1 + ppv1 - q0), "accuracy": tp + (1 - prevalence) * (1 - q0), "f1": ratio(2 * precision * ppv1, precision + ppv1)}


def verdict(rules: DataFrame) -> DataFrame:
    """retrain if a retrain rule is met; ship if all others are. An unknown rule (null) neither asks for retraining nor lets ship be reached: it is a caveat."""
    met = F.coalesce(F.col("met"), F.lit(False))
    t = rules.agg(F.max(F.when(F.col("level") == "retrain", met)).alias("retrain"), F.min(F.when(F.col("level") != "retrain", met)).alias("ship"), F.count_if((F.col("level") != "retrain") & ~met).alias("n_caveats"))
    return t.select(F.when(F.coalesce("retrain", F.lit(False)), "retrain").when(F.coalesce("ship", F.lit(True)), "ship").otherwise("ship with caveats").alias("verdict"), "n_caveats")


def rule_states(rules: DataFrame) -> DataFrame:
    """(level, state, n): how many rules of each level are met, not met or unknown (null)."""
    state = F.when(F.col("met").isNull(), "unknown").when(F.col("met"), "met").otherwise("not met")
    return rules.groupBy("level", state.alias("state")).agg(F.count("*").alias("n"))


def log_loss_grid(df: DataFrame, margin: str, y: str, lo: float = -3.0, hi: float = 3.0, steps: int = 61) -> DataFrame:
    """Mean log loss of sigmoid(margin / T) over a grid of log T; the smallest first by the caller's order."""
    grid = F.array(*(F.lit(lo + (hi - lo) * i / (steps - 1)) for i in range(steps)))
    z = F.when(F.col(y).cast("int") == 1, F.col(margin)).otherwise(-F.col(margin))
    t = df.select(z.cast("double").alias("z"), F.explode(grid).alias("log_t"))
    u = -F.col("z") / F.exp("log_t")
    return t.groupBy("log_t").agg(F.avg(F.when(u > 30, u).otherwise(F.log1p(F.exp(u)))).alias("nll"))


def fit_temperature(df: DataFrame, margin: str, y: str, rounds: int = 3) -> float:
    """Temperature with the least log loss: the grid, narrowed around its best value with one aggregate for each round."""
    import math

    lo, hi = math.log(0.05), math.log(20.0)
    for _ in range(rounds):
        best = log_loss_grid(df, margin, y, lo, hi, 41).orderBy("nll", "log_t").first()["log_t"]
        step = (hi - lo) / 40
        lo, hi = best - step, best + step
    return math.exp(best)


def fit_platt(df: DataFrame, margin: str, y: str, steps: int = 12) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b) with smoothed targets, by Newton steps of five sums each; a stays positive."""
    n = df.agg(F.sum(F.col(y).cast("long")), F.count("*")).first()
    pos, neg = n[0] or 0, (n[1] or 0) - (n[0] or 0)
    target = F.when(F.col(y).cast("int") == 1, (pos + 1) / (pos + 2)).otherwise(1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(a) * F.col(margin) + F.lit(b))))
        w = p * (1 - p)
        g = df.agg(F.sum((p - target) * F.col(margin)), F.sum(p - target), F.sum(w * F.col(margin) * F.col(margin)), F.sum(w * F.col(margin)), F.sum(w)).first()
        if g[4] is None:
            break
        h11, h12, h22 = g[2] + 1e-9, g[3], g[4] + 1e-9
        det = h11 * h22 - h12 * h12
        if det <= 0:
            break
        a, b = max(1e-6, a - (h22 * g[0] - h12 * g[1]) / det), b - (h11 * g[1] - h12 * g[0]) / det
    return a, b


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int = 200, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Mean with a percentile interval from whole clusters drawn Poisson(1) times; sums of each cluster come first, so that replicates touch clusters, not rows."""
    sums = df.groupBy(F.col(cluster).alias("c")).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
    drawn = sums.select("c", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")).withColumn("w", poisson1(short_hash(F.concat_ws(":", F.col("b").cast("string"), F.col("c").cast("string")), str(seed))))
    means = drawn.groupBy("b").agg(ratio(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    point = sums.agg(ratio(F.sum("s"), F.sum("n")).alias("mean"), F.count("*").alias("n_clusters"))
    return point.join(F.broadcast(means.agg(F.percentile("m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("ci_high"))))  # one row each
