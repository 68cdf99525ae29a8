"""Quality of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.stats import rounded
from tidewell.operators import metrics
from tidewell.plans.registry import query, rnd
from tidewell.plans.views import PREDICTIONS_SQL, predictions

W = f"WITH {PREDICTIONS_SQL}"
_z = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"
CONF = "count(*) FILTER (WHERE y = 1 AND p >= {t}) AS tp, count(*) FILTER (WHERE y = 0 AND p >= {t}) AS fp, count(*) FILTER (WHERE y = 1 AND p < {t}) AS fn, count(*) FILTER (WHERE y = 0 AND p < {t}) AS tn"
DERIVED = f"round(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 8) AS accuracy, round({_z('tp', 'tp + fp')}, 8) AS precision, round({_z('tp', 'tp + fn')}, 8) AS recall, round({_z('2 * tp', '2 * tp + fp + fn')}, 8) AS f1, round(({_z('2 * tp', '2 * tp + fp + fn')} + {_z('2 * tn', '2 * tn + fp + fn')}) / 2, 8) AS f1_macro"


@query("binary_metrics", f"{W}, c AS (SELECT count(*) AS n, avg(CAST(y AS DOUBLE)) AS prevalence, {CONF.format(t='0.5e0')}, avg(pow(p - y, 2)) AS brier, avg(CAST(p >= 0.5e0 AS DOUBLE)) AS predicted_positive_rate FROM pr) SELECT n, {rnd('prevalence', 'prevalence')}, tp, fp, fn, tn, {rnd('brier', 'brier')}, {rnd('predicted_positive_rate', 'predicted_positive_rate')}, {DERIVED} FROM c")
def binary_metrics(spark, sf_dir):
    return rounded(metrics.binary_metrics(predictions(spark, sf_dir)))


@query("roc_auc", f"{W}, k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0e0 AS rk FROM pr), s AS (SELECT count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg, sum(rk) FILTER (WHERE y = 1) AS r FROM k) SELECT n_pos, n_neg, {rnd('(r - n_pos * (n_pos + 1) / 2.0e0) / (CAST(n_pos AS DOUBLE) * n_neg)', 'roc_auc')} FROM s")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(predictions(spark, sf_dir)))


@query("average_precision", f"{W}, g AS (SELECT p, sum(y) AS pos, count(*) AS n FROM pr GROUP BY p), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS m FROM g) SELECT {rnd('sum(pos * (tp / CAST(m AS DOUBLE))) / sum(pos)', 'average_precision')}, CAST(sum(pos) AS BIGINT) AS n_pos FROM c")
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(predictions(spark, sf_dir)))


EDGES = "[" + ", ".join(f"{i}.0e0 / 15.0e0" for i in range(1, 15)) + "]"
REL = f"{W}, rb AS (SELECT len(list_filter({EDGES}, lambda e: e <= p)) AS bin, y, p FROM pr), rel AS (SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(CAST(y AS DOUBLE)) AS frac_positive FROM rb GROUP BY bin)"


@query("reliability", f"{REL} SELECT bin, n, {rnd('mean_p', 'mean_p')}, {rnd('frac_positive', 'frac_positive')}, {rnd('bin / 15.0e0', 'bin_lo')}, {rnd('(bin + 1) / 15.0e0', 'bin_hi')} FROM rel")
def reliability(spark, sf_dir):
    return rounded(metrics.reliability(predictions(spark, sf_dir)))


@query("ece", f"{REL} SELECT {rnd('sum(n * abs(frac_positive - mean_p)) / sum(n)', 'ece')} FROM rel")
def ece(spark, sf_dir):
    return rounded(metrics.ece(predictions(spark, sf_dir)))


CURVE = f"{W}, th AS (SELECT i / 100.0e0 AS t FROM range(5, 96) x(i)), cv AS (SELECT t, {CONF.format(t='t')} FROM pr, th GROUP BY t)"


@query("threshold_curve", f"{CURVE} SELECT t AS threshold, tp, fp, fn, tn, {DERIVED}, {rnd(_z('tp', 'tp + fn') + ' - CAST(fp AS DOUBLE) / greatest(fp + tn, 1)', 'youden')} FROM cv")
def threshold_curve(spark, sf_dir):
    return rounded(metrics.threshold_curve(predictions(spark, sf_dir)))


@query("threshold_search", f"{CURVE}, f AS (SELECT t, {_z('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cv) SELECT t AS threshold, {rnd('f1', 'value')} FROM f ORDER BY round(f1, 9) DESC, round(abs(t - 0.5), 9), t LIMIT 1")
def threshold_search(spark, sf_dir):
    return rounded(metrics.choose_threshold(predictions(spark, sf_dir)))


_min = lambda e: f"CASE WHEN n >= 15 THEN {e} END"


@query("metrics_by_group", f"{W}, c AS (SELECT source, count(*) AS n, avg(CAST(y AS DOUBLE)) AS prev, {CONF.format(t='0.5e0')} FROM pr GROUP BY source) SELECT source, n, {rnd(_min('prev'), 'prevalence')}, {rnd(_min('CAST(tp + tn AS DOUBLE) / n'), 'accuracy')}, {rnd(_min(_z('2 * tp', '2 * tp + fp + fn')), 'f1')}, {rnd(_min('CAST(fp AS DOUBLE) / greatest(fp + tn, 1)'), 'false_positive_rate')}, {rnd(_min('CAST(fn AS DOUBLE) / greatest(fn + tp, 1)'), 'false_negative_rate')} FROM c")
def metrics_by_group(spark, sf_dir):
    return rounded(metrics.by_group(predictions(spark, sf_dir), "source", min_n=15))


ML = f"{W}, ml AS (SELECT doc_id AS id, unnest(['quality', 'toxic']) AS label, unnest([y, toxic]) AS y, unnest([p, 1 - p]) AS p FROM pr)"


def _long(spark, sf_dir):
    t = predictions(spark, sf_dir)
    item = lambda n, y, p: F.struct(F.lit(n).alias("label"), y.cast("int").alias("y"), p.alias("p"))
    return t.select(F.col("doc_id").alias("id"), F.explode(F.array(item("quality", F.col("y"), F.col("p")), item("toxic", F.col("toxic"), 1 - F.col("p")))).alias("x")).select("id", "x.*")


@query("multilabel_metrics", f"{ML}, c AS (SELECT label, count(*) AS n, CAST(sum(y) AS BIGINT) AS support, {CONF.format(t='0.5e0')}, avg(pow(p - y, 2)) AS brier, avg(CAST(p >= 0.5e0 AS DOUBLE)) AS ppr FROM ml GROUP BY label) SELECT label, n, support, tp, fp, fn, tn, {rnd('brier', 'brier')}, {rnd('ppr', 'predicted_positive_rate')}, {DERIVED.rsplit(', round((', 1)[0]} FROM c")
def multilabel_metrics(spark, sf_dir):
    return rounded(metrics.multilabel(_long(spark, sf_dir)))


@query(
    "multilabel_summary",
    f"""{ML}, c AS (SELECT label, {CONF.format(t="0.5e0")} FROM ml GROUP BY label), l AS (SELECT {_z("2 * tp", "2 * tp + fp + fn")} AS f, {_z("tp", "tp + fp")} AS pc, {_z("tp", "tp + fn")} AS rc, * FROM c),
    a AS (SELECT avg(f) AS f1_macro, avg(pc) AS precision_macro, avg(rc) AS recall_macro, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM l),
    w AS (SELECT id, max(CAST((p >= 0.5e0) <> (y = 1) AS INTEGER)) AS bad, sum(CAST((p >= 0.5e0) <> (y = 1) AS INTEGER)) AS wrong, count(*) AS k FROM ml GROUP BY id), h AS (SELECT avg(1.0e0 - bad) AS subset_accuracy, sum(wrong) / CAST(sum(k) AS DOUBLE) AS hamming_loss FROM w)
    SELECT {rnd("f1_macro", "f1_macro")}, {rnd("precision_macro", "precision_macro")}, {rnd("recall_macro", "recall_macro")}, {rnd(_z("tp", "tp + fp"), "precision_micro")}, {rnd(_z("tp", "tp + fn"), "recall_micro")}, {rnd(_z("2 * tp", "2 * tp + fp + fn"), "f1_micro")}, {rnd("subset_accuracy", "subset_accuracy")}, {rnd("hamming_loss", "hamming_loss")} FROM a, h""",
)
def multilabel_summary(spark, sf_dir):
    return rounded(metrics.multilabel_summary(_long(spark, sf_dir)))


@query("spearman", "WITH k AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0e0 AS a, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0e0 AS b FROM events) SELECT round(corr(a, b), 8) AS rho, count(*) AS n FROM k")
def spearman(spark, sf_dir):
    from tidewell.plans.registry import table

    return rounded(metrics.spearman(table(spark, sf_dir, "events"), "value", "user_id"))


@query("cohen_kappa", f"{W}, c AS (SELECT y AS a, CAST(p >= 0.5e0 AS INTEGER) AS b FROM pr), t AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po, avg(CAST(a AS DOUBLE)) AS pa, avg(CAST(b AS DOUBLE)) AS pb FROM c) SELECT n, {rnd('po', 'agreement')}, {rnd('(po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb)))', 'kappa')} FROM t")
def cohen_kappa(spark, sf_dir):
    return rounded(metrics.cohen_kappa(predictions(spark, sf_dir).withColumn("b", (F.col("p") >= 0.5).cast("int")), "y", "b"))


@query("noise_ceiling", f"{W}, t AS (SELECT avg(CAST(toxic AS DOUBLE)) FILTER (WHERE y = 1) AS ppv1, avg(CAST(toxic AS DOUBLE)) FILTER (WHERE y = 0) AS q0, avg(CAST(y AS DOUBLE)) AS pi FROM pr), u AS (SELECT *, pi * ppv1 / nullif(pi * ppv1 + (1 - pi) * q0, 0) AS pc FROM t) SELECT {rnd('0.5e0 * (1 + ppv1 - q0)', 'roc_auc')}, {rnd('pi * ppv1 + (1 - pi) * (1 - q0)', 'accuracy')}, {rnd('2 * pc * ppv1 / nullif(pc + ppv1, 0)', 'f1')} FROM u")
def noise_ceiling(spark, sf_dir):
    t = predictions(spark, sf_dir).agg(F.avg(F.when(F.col("y") == 1, F.col("toxic").cast("double"))).alias("ppv1"), F.avg(F.when(F.col("y") == 0, F.col("toxic").cast("double"))).alias("q0"), F.avg(F.col("y").cast("double")).alias("pi"))
    return rounded(t.select(*(c.alias(k) for k, c in metrics.noise_ceiling(F.col("ppv1"), F.col("q0"), F.col("pi")).items())))


@query(
    "verdict",
    f"""{W}, t AS (SELECT avg(CAST((p >= 0.5e0) = (y = 1) AS DOUBLE)) AS acc, avg(pow(p - y, 2)) AS brier FROM pr),
    rules AS (SELECT unnest(['retrain', 'ship', 'ship', 'caveat']) AS level, unnest([acc < 0.2e0, acc >= 0.6e0, brier <= 0.3e0, NULL]) AS met FROM t),
    v AS (SELECT bool_or(coalesce(met, false)) FILTER (WHERE level = 'retrain') AS retrain, bool_and(coalesce(met, false)) FILTER (WHERE level <> 'retrain') AS ship, count(*) FILTER (WHERE level <> 'retrain' AND NOT coalesce(met, false)) AS n_caveats FROM rules)
    SELECT CASE WHEN retrain THEN 'retrain' WHEN ship THEN 'ship' ELSE 'ship with caveats' END AS verdict, n_caveats FROM v""",
)
def verdict(spark, sf_dir):
    t = predictions(spark, sf_dir).agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("acc"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"))
    rule = lambda level, met: F.struct(F.lit(level).alias("level"), met.alias("met"))
    rules = t.select(F.explode(F.array(rule("retrain", F.col("acc") < 0.2), rule("ship", F.col("acc") >= 0.6), rule("ship", F.col("brier") <= 0.3), rule("caveat", F.lit(None).cast("boolean")))).alias("r")).select("r.*")
    return metrics.verdict(rules)


@query("temperature_grid", f"{W}, g AS (SELECT -3.0e0 + 6.0e0 * i / 60 AS log_t FROM range(0, 61) x(i)), m AS (SELECT CASE WHEN y = 1 THEN p * 6 - 3 ELSE -(p * 6 - 3) END AS z FROM pr) SELECT {rnd('log_t', 'log_t', 6)}, {rnd('avg(CASE WHEN -z / exp(log_t) > 30 THEN -z / exp(log_t) ELSE ln(1 + exp(-z / exp(log_t))) END)', 'nll', 6)} FROM m, g GROUP BY log_t")
def temperature_grid(spark, sf_dir):
    t = predictions(spark, sf_dir).withColumn("margin", F.col("p") * 6 - 3)
    return rounded(metrics.log_loss_grid(t, "margin", "y"), 6)


_POIS = "(" + " + ".join(f"CAST(u >= {c}e0 AS INTEGER)" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)) + ")"


@query(
    "cluster_bootstrap",
    f"""WITH c AS (SELECT user_id AS c, sum(value) AS s, count(*) AS n FROM events GROUP BY user_id), b AS (SELECT unnest(range(0, 100)) AS b),
    d AS (SELECT b, s, n, CAST(('0x' || substr(sha256('42:' || b || ':' || c), 1, 12)) AS BIGINT) / 281474976710656.0e0 AS u FROM c, b), m AS (SELECT b, sum({_POIS} * s) / nullif(sum({_POIS} * n), 0) AS m FROM d GROUP BY b)
    SELECT (SELECT round(sum(s) / sum(n), 6) FROM c) AS mean, (SELECT count(*) FROM c) AS n_clusters, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m""",
)
def cluster_bootstrap(spark, sf_dir):
    from tidewell.plans.registry import table

    return rounded(metrics.cluster_bootstrap(table(spark, sf_dir, "events"), "user_id", "value", 100), 6)


@query("mean_std_runs", "WITH x AS (SELECT event_type, user_id % 5 AS run, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n_runs FROM x GROUP BY event_type")
def mean_std_runs(spark, sf_dir):
    from tidewell.plans.registry import table

    runs = table(spark, sf_dir, "events").groupBy("event_type", F.col("user_id") % 5).agg(F.avg("value").alias("v"))
    return rounded(runs.groupBy("event_type").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("*").alias("n_runs")), 6)
