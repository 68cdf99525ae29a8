"""Reports on predictions: resampling, thresholds, splits, classes, groups, agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.stats import rounded
from tidewell.operators import evaluation as E
from tidewell.plans.metric_queries import _POIS, CONF, ML, W, _long, _z
from tidewell.plans.registry import hash_sql, query, rnd, table, wilson_sql
from tidewell.plans.views import predictions

B = 40


def _drawn(units: str, seed: int = 42) -> str:
    """Replicates of a table of units."""
    u = hash_sql("b || ':' || unit", str(seed))
    return f"(SELECT *, CASE WHEN b < 0 THEN 1 ELSE {_POIS} END AS w FROM (SELECT x.*, b, {u} AS u FROM {units} x, (SELECT unnest(range(-1, {B})) AS b)))"


def _interval(col: str) -> str:
    return f"round(max(CASE WHEN b < 0 THEN {col} END), 8) AS point, round(quantile_cont({col}, 0.025) FILTER (WHERE b >= 0), 8) AS lo, round(quantile_cont({col}, 0.975) FILTER (WHERE b >= 0), 8) AS hi, count({col}) FILTER (WHERE b >= 0) AS n_valid"


_conf = lambda t, n, y="y": ", ".join(f"count(*) FILTER (WHERE {y} = {i} AND p {op} {t}) AS {k}_{n}" for k, i, op in (("tp", 1, ">="), ("fp", 0, ">="), ("fn", 1, "<"), ("tn", 0, "<")))
_sums = ", ".join(f"sum(w * {k}_{n}) AS {k}_{n}" for n in ("half", "low") for k in E.COUNTS)
_UNITS = f"{W}, un AS (SELECT source AS unit, {_conf('0.5e0', 'half')}, {_conf('0.3e0', 'low')} FROM pr GROUP BY source), s AS (SELECT b, {_sums} FROM {_drawn('un')} GROUP BY b)"
_f1 = lambda n: _z(f"2 * tp_{n}", f"2 * tp_{n} + fp_{n} + fn_{n}")
_acc = lambda n: f"CAST(tp_{n} + tn_{n} AS DOUBLE) / nullif(tp_{n} + tn_{n} + fp_{n} + fn_{n}, 0)"


def _bootstrap(spark, sf_dir, seed=42):
    return E.bootstrap_confusion(predictions(spark, sf_dir), {"half": 0.5, "low": 0.3}, "source", replicates=B, seed=seed)


@query("metric_intervals", f"{_UNITS}, l AS (" + " UNION ALL ".join(f"SELECT b, '{n}' AS name, '{m}' AS metric, {e(n)} AS v FROM s" for n in ("half", "low") for m, e in (("f1", _f1), ("accuracy", _acc))) + f") SELECT name, metric, {_interval('v')} FROM l GROUP BY ALL")
def metric_intervals(spark, sf_dir):
    return rounded(E.metric_intervals(_bootstrap(spark, sf_dir), ("f1", "accuracy")))


@query("paired_gain", f"{_UNITS}, g AS (SELECT b, {_f1('low')} - {_f1('half')} AS v FROM s) SELECT round(max(CASE WHEN b < 0 THEN v END), 8) AS gain, round(quantile_cont(v, 0.025) FILTER (WHERE b >= 0), 8) AS lo, round(quantile_cont(v, 0.975) FILTER (WHERE b >= 0), 8) AS hi, round(avg(CAST(v > 0 AS DOUBLE)) FILTER (WHERE b >= 0), 8) AS share_above_0 FROM g")
def paired_gain(spark, sf_dir):
    return rounded(E.paired_gain(_bootstrap(spark, sf_dir), "f1", "low", "half"))


_OTHER = f"{W}, un AS (SELECT source AS unit, {_conf('0.5e0', 'half')} FROM pr GROUP BY source), uo AS (SELECT source AS unit, {_conf('0.5e0', 'half')} FROM pr WHERE lang = 'en' GROUP BY source)"
_half = ", ".join(f"sum(w * {k}_half) AS {k}_half" for k in E.COUNTS)


@query("independent_delta", f"{_OTHER}, a AS (SELECT b, {_half} FROM {_drawn('un')} GROUP BY b), c AS (SELECT b, {_half} FROM {_drawn('uo', 43)} GROUP BY b), d AS (SELECT a.b, x.f - y.f AS v FROM a JOIN (SELECT b, {_f1('half')} AS f FROM a) x USING (b) JOIN (SELECT b, {_f1('half')} AS f FROM c) y USING (b)) SELECT {_interval('v')} FROM d")
def independent_delta(spark, sf_dir):
    p = predictions(spark, sf_dir)
    own = lambda df, seed: E.bootstrap_confusion(df, {"half": 0.5}, "source", replicates=B, seed=seed)
    return rounded(E.independent_delta(own(p, 42), own(p.where("lang = 'en'"), 43), "f1"))


@query("decide_threshold", f"{_UNITS}, g AS (SELECT b, {_f1('low')} - {_f1('half')} AS v FROM s), r AS (SELECT max(CASE WHEN b < 0 THEN v END) AS gain, quantile_cont(v, 0.025) FILTER (WHERE b >= 0) AS lo, quantile_cont(v, 0.975) FILTER (WHERE b >= 0) AS hi FROM g) SELECT 0.3e0 AS tuned, CASE WHEN gain >= 0.01e0 AND lo > 0 THEN 0.3e0 ELSE 0.5e0 END AS applied, gain >= 0.01e0 AND lo > 0 AS is_clear, {rnd('gain', 'gain')}, {rnd('lo', 'lo')}, {rnd('hi', 'hi')} FROM r")
def decide_threshold(spark, sf_dir):
    return rounded(E.decide_threshold(E.paired_gain(_bootstrap(spark, sf_dir), "f1", "low", "half"), 0.3, 0.01))


_DIFF = f"{W}, un AS (SELECT source AS unit, sum(p) FILTER (WHERE toxic = 1) AS s1, sum(p) FILTER (WHERE toxic = 0) AS s0, sum(CAST(p >= 0.4e0 AS DOUBLE)) FILTER (WHERE toxic = 1) AS a1, sum(CAST(p >= 0.4e0 AS DOUBLE)) FILTER (WHERE toxic = 0) AS a0, count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0 FROM pr GROUP BY source), d AS (SELECT b, coalesce(sum(w * s1), 0) AS s1, coalesce(sum(w * s0), 0) AS s0, coalesce(sum(w * a1), 0) AS a1, coalesce(sum(w * a0), 0) AS a0, sum(w * n1) AS n1, sum(w * n0) AS n0 FROM {_drawn('un')} GROUP BY b), l AS (SELECT b, 'p' AS name, s1 / nullif(n1, 0) AS x, s0 / nullif(n0, 0) AS y FROM d UNION ALL SELECT b, 'above__p', a1 / nullif(n1, 0), a0 / nullif(n0, 0) FROM d)"


@query("cluster_difference", f"{_DIFF} SELECT name, round(max(CASE WHEN b < 0 THEN x END), 8) AS with_flag, round(max(CASE WHEN b < 0 THEN y END), 8) AS without, round(max(CASE WHEN b < 0 THEN x - y END), 8) AS diff, round(quantile_cont(x - y, 0.025) FILTER (WHERE b >= 0), 8) AS lo, round(quantile_cont(x - y, 0.975) FILTER (WHERE b >= 0), 8) AS hi FROM l GROUP BY name")
def cluster_difference(spark, sf_dir):
    shift, _ = E.domain_shift(predictions(spark, sf_dir).withColumn("flag", F.col("toxic") == 1), {"p": 0.4}, "flag", "source", "lang", 20, B)
    return rounded(shift)


@query("domain_shift_cells", f"{W} SELECT lang, toxic = 1 AS flag, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(p), 8) END AS mean__p, count(*) < 20 AS suppressed FROM pr GROUP BY ALL")
def domain_shift_cells(spark, sf_dir):
    _, cells = E.domain_shift(predictions(spark, sf_dir).withColumn("flag", F.col("toxic") == 1), {"p": 0.4}, "flag", "source", "lang", 20, 1)
    return rounded(cells)


_mf1 = _z("2 * tp", "2 * tp + fp + fn")


@query("bootstrap_multilabel", f"{ML}, un AS (SELECT id AS unit, label, {CONF.format(t='0.5e0')} FROM ml GROUP BY ALL), d AS (SELECT b, label, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn FROM {_drawn('un')} GROUP BY b, label), f AS (SELECT b, label, {_mf1} AS v FROM d UNION ALL SELECT b, 'macro', avg(v) FROM (SELECT b, {_mf1} AS v FROM d) GROUP BY b UNION ALL SELECT b, 'micro', {_z('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} FROM d GROUP BY b) SELECT label, {_interval('v')} FROM f GROUP BY label")
def bootstrap_multilabel(spark, sf_dir):
    return rounded(E.bootstrap_multilabel(_long(spark, sf_dir), 0.5, B))


@query("positive_weights", f"{ML} SELECT label, CAST(sum(y) AS BIGINT) AS n_pos, round(least(greatest(sqrt((count(*) - sum(y)) / nullif(CAST(sum(y) AS DOUBLE), 0)), 1.0e0), 10.0e0), 8) AS weight FROM ml GROUP BY label")
def positive_weights(spark, sf_dir):
    return rounded(E.positive_weights(_long(spark, sf_dir)))


@query("confidence_weights", f"{W}, c AS (SELECT doc_id, greatest(p, 0.5e0) AS c FROM pr) SELECT doc_id, round(c / avg(c) OVER (), 8) AS weight FROM c")
def confidence_weights(spark, sf_dir):
    return rounded(E.confidence_weights(predictions(spark, sf_dir), "p").select("doc_id", "weight"))


# three categories of three kinds of score
_KINDS = f"{W}, k AS (SELECT doc_id AS id, unnest(['quality', 'toxic', 'en', 'rare', 'both']) AS label, unnest(['probability', 'cosine', 'count', 'cosine', 'probability']) AS kind, unnest([y, toxic, CAST(lang = 'en' AS INTEGER), CAST(doc_id % 97 = 0 AS INTEGER), CAST(doc_id % 10 > 0 AS INTEGER)]) AS y, unnest([p, 0.8e0 * (1 - p), CAST(n_chars // 600 AS DOUBLE), 0.9e0 * p, p]) AS s FROM pr)"
_GRIDS = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest([{', '.join(f'CAST({x!r} AS DOUBLE)' for x in g)}]) AS t" for k, g in E.GRIDS.items())


def _tuned(source: str, label: str) -> str:
    return f"""(SELECT {label}, kind, n, n_pos, t AS tuned, f1 FROM (SELECT {label}, kind, t, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos, round(coalesce(2.0e0 * count(*) FILTER (WHERE y = 1 AND s >= t) / nullif(count(*) FILTER (WHERE s >= t) + sum(y), 0), 0), 9) AS f1
        FROM {source} JOIN ({_GRIDS}) g USING (kind) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {label}, kind ORDER BY f1 DESC, round(abs(t - 0.5e0), 9), t) = 1)"""


_TUNE = f"""{_KINDS}, own AS {_tuned('k', 'label')}, po AS {_tuned("(SELECT *, 'x' AS pool FROM k WHERE kind = 'cosine')", 'pool')},
th AS (SELECT label, kind, tuned, CASE WHEN kind <> 'count' AND n_pos > 0.85e0 * n THEN CASE WHEN kind = 'cosine' THEN 1.01e0 ELSE 0.5e0 END WHEN n_pos < 10 THEN CASE kind WHEN 'cosine' THEN (SELECT tuned FROM po) WHEN 'count' THEN 1.0e0 ELSE 0.5e0 END ELSE tuned END AS applied,
CASE WHEN kind <> 'count' AND n_pos > 0.85e0 * n THEN 'degenerate_prevalence' WHEN n_pos < 10 THEN 'default_' || kind ELSE 'tuned' END AS rule, f1, n_pos FROM own)"""


def _kinds(spark, sf_dir):
    t = predictions(spark, sf_dir)
    item = lambda n, k, y, s: F.struct(F.lit(n).alias("label"), F.lit(k).alias("kind"), y.cast("int").alias("y"), s.cast("double").alias("s"))
    items = (item("quality", "probability", F.col("y"), F.col("p")), item("toxic", "cosine", F.col("toxic"), 0.8 * (1 - F.col("p"))), item("en", "count", F.col("lang") == "en", F.floor(F.col("n_chars") / 600)), item("rare", "cosine", F.col("doc_id") % 97 == 0, 0.9 * F.col("p")), item("both", "probability", F.col("doc_id") % 10 > 0, F.col("p")))
    return t.select(F.col("doc_id").alias("id"), F.explode(F.array(*items)).alias("x")).select("id", "x.*")


@query("tune_thresholds", f"{_TUNE} SELECT label, kind, tuned, applied, rule, {rnd('f1', 'f1')}, n_pos FROM th")
def tune_thresholds(spark, sf_dir):
    return rounded(E.tune_thresholds(_kinds(spark, sf_dir), 10, 0.85))


_cov = "CASE WHEN kind = 'cosine' THEN 'zero_shot' ELSE 'supervised' END"
_EVAL = f"""{_TUNE}, e AS (SELECT {{m}} id, label, y, s >= applied AS h, {_cov} AS coverage FROM {{src}} JOIN th USING (label, kind)), c AS (SELECT {{g}} label, coverage, count(*) FILTER (WHERE y = 1 AND h) AS tp, count(*) FILTER (WHERE y = 0 AND h) AS fp, count(*) FILTER (WHERE y = 1 AND NOT h) AS fn FROM e GROUP BY ALL),
f AS (SELECT {{g}} avg(f) AS f1_macro, avg(f) FILTER (WHERE tp + fn > 0) AS f1_macro_supported, avg(f) FILTER (WHERE tp + fn > 0 AND coverage = 'supervised') AS f1_macro_supervised, avg(f) FILTER (WHERE tp + fn > 0 AND coverage = 'zero_shot') AS f1_macro_zero_shot FROM (SELECT *, {_mf1} AS f FROM c) {{by}}),
r AS (SELECT {{g}} id, count(*) FILTER (WHERE h) AS n, max(y) = 0 AS is_none FROM e GROUP BY ALL), q AS (SELECT {{g}} count(*) FILTER (WHERE n = 0 AND is_none) AS tp, count(*) FILTER (WHERE n = 0 AND NOT is_none) AS fp, count(*) FILTER (WHERE n > 0 AND is_none) AS fn, avg(CAST(n = 0 AS DOUBLE)) AS pr, avg(n) AS ml FROM r {{by}})
SELECT {{g}} {rnd('f1_macro', 'f1_macro')}, {rnd('f1_macro_supported', 'f1_macro_supported')}, {rnd('f1_macro_supervised', 'f1_macro_supervised')}, {rnd('f1_macro_zero_shot', 'f1_macro_zero_shot')}, {rnd(_z('tp', 'tp + fp'), 'none_precision')}, {rnd(_z('tp', 'tp + fn'), 'none_recall')}, {rnd(_mf1, 'none_f1')}, {rnd('pr', 'none_predicted_rate')}, {rnd('ml', 'mean_labels')} FROM f {{join}}"""


def _evaluated(spark, sf_dir, by=()):
    k = _kinds(spark, sf_dir)
    th = E.tune_thresholds(k, 10, 0.85).select("label", F.col("applied").alias("threshold"), F.when(F.col("kind") == "cosine", "zero_shot").otherwise("supervised").alias("coverage"))
    none = k.groupBy("id").agg(F.max("y").alias("any")).select("id", (F.col("any") == 0).cast("int").alias("is_none"))
    if by:
        k = k.withColumn("method", F.explode(F.array(F.lit("plain"), F.lit("half")))).withColumn("s", F.when(F.col("method") == "half", F.col("s") / 2).otherwise(F.col("s")))
    return E.evaluate_split(k, th, none, by)


@query("evaluate_split", _EVAL.format(m="", g="", src="k", by="", join=", q"))
def evaluate_split(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir))


_METHODS = "(SELECT * FROM k, (SELECT unnest(['plain', 'half']) AS method))"
_REPORT = _EVAL.replace("s >= applied", "CASE WHEN method = 'half' THEN s / 2 ELSE s END >= applied").format(m="method,", g="method,", src=_METHODS, by="GROUP BY method", join="JOIN q USING (method)")


@query("methods_report", _REPORT)
def methods_report(spark, sf_dir):
    return rounded(_evaluated(spark, sf_dir, ["method"]))


@query("select_method", f"WITH rep AS ({_REPORT}) SELECT method, f1_macro_supported, CAST(row_number() OVER (ORDER BY round(f1_macro_supported, 9) DESC NULLS LAST, method) AS INTEGER) AS place, method = 'half' AS selected FROM rep")
def select_method(spark, sf_dir):
    return rounded(E.select_method(_evaluated(spark, sf_dir, ["method"]), "method", "f1_macro_supported", "half"))


_WIN = f"""{W}, wl AS (SELECT doc_id AS id, unnest(['a', 'b']) AS label, 'probability' AS kind, unnest([y, toxic]) AS y FROM pr), ws AS (SELECT doc_id AS id, unnest(['a', 'a', 'a', 'b', 'b']) AS label, unnest([p, p / 2, 1 - p, 1 - p, p * p]) AS s FROM pr),
r AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY s DESC) AS k FROM ws), ag AS (SELECT id, label, max(s) AS mx, avg(s) AS mean, avg(s) FILTER (WHERE k <= 2) AS t2 FROM r GROUP BY ALL),
al AS (SELECT id, unnest(['max', 'mean', 'top2_mean']) || '|' || label AS label, unnest([mx, mean, t2]) AS s, kind, y FROM ag JOIN wl USING (id, label)), own AS {_tuned('al', 'label')}"""


@query("aggregation_sensitivity", f"{_WIN} SELECT split_part(label, '|', 1) AS aggregation, split_part(label, '|', 2) AS label, tuned, CASE WHEN n_pos < 5 THEN 0.5e0 ELSE tuned END AS applied, {rnd('f1', 'f1')} FROM own")
def aggregation_sensitivity(spark, sf_dir):
    t = predictions(spark, sf_dir)
    p, q = F.col("p"), lambda n, s: F.struct(F.lit(n).alias("label"), s.alias("s"))
    windows = t.select(F.col("doc_id").alias("id"), F.explode(F.array(q("a", p), q("a", p / 2), q("a", 1 - p), q("b", 1 - p), q("b", p * p))).alias("x")).select("id", "x.*")
    y = lambda n, c: F.struct(F.lit(n).alias("label"), F.lit("probability").alias("kind"), F.col(c).alias("y"))
    labels = t.select(F.col("doc_id").alias("id"), F.explode(F.array(y("a", "y"), y("b", "toxic"))).alias("x")).select("id", "x.*")
    return rounded(E.aggregation_sensitivity(windows, labels))


_CLASS = f"{W}, mc AS (SELECT doc_id AS id, lang AS y, unnest(['en', 'de', 'fr', 'es']) AS label, unnest([p, (1 - p) * 0.5e0, (1 - p) * 0.3e0, (1 - p) * 0.2e0]) AS p FROM pr)"
_BEST = "bs AS (SELECT id, y, label AS predicted, p FROM {src} QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(p, 12) DESC, label DESC) = 1)"


def _classes(spark, sf_dir):
    t = predictions(spark, sf_dir)
    p, q = F.col("p"), lambda n, s: F.struct(F.lit(n).alias("label"), s.alias("p"))
    return t.select(F.col("doc_id").alias("id"), F.col("lang").alias("y"), F.explode(F.array(q("en", p), q("de", (1 - p) * 0.5), q("fr", (1 - p) * 0.3), q("es", (1 - p) * 0.2))).alias("x")).select("id", "y", "x.*")


_PER = "pc AS (SELECT label, (SELECT count(*) FROM bs WHERE y = label) AS support, (SELECT count(*) FROM bs WHERE y = label AND predicted = label) AS tp, (SELECT count(*) FROM bs WHERE predicted = label) AS said FROM (SELECT DISTINCT label FROM {src}))"
_PERSEL = f"SELECT label, support, tp, said - tp AS fp, support - tp AS fn, {rnd(_z('tp', 'said'), 'precision')}, {rnd(_z('tp', 'support'), 'recall')}, {rnd(_z('2 * tp', 'said + support'), 'f1')} FROM pc"


@query("multiclass_per_class", f"{_CLASS}, {_BEST.format(src='mc')}, {_PER.format(src='mc')} {_PERSEL}")
def multiclass_per_class(spark, sf_dir):
    return rounded(E.multiclass_report(_classes(spark, sf_dir))[0])


@query("multiclass_confusion", f"{_CLASS}, {_BEST.format(src='mc')} SELECT y, predicted, count(*) AS n FROM bs GROUP BY ALL")
def multiclass_confusion(spark, sf_dir):
    return E.multiclass_report(_classes(spark, sf_dir))[1]


@query("multiclass_summary", f"{_CLASS}, {_BEST.format(src='mc')}, {_PER.format(src='mc')}, rb AS (SELECT len(list_filter([" + ", ".join(f"{i}.0e0 / 15.0e0" for i in range(1, 15)) + f"], lambda e: e <= p)) AS bin, count(*) AS n, avg(p) AS mp, avg(CAST(y = predicted AS DOUBLE)) AS my FROM bs GROUP BY 1) SELECT (SELECT count(*) FROM bs) AS n, round((SELECT avg(CAST(y = predicted AS DOUBLE)) FROM bs), 8) AS accuracy, round((SELECT avg({_z('2 * tp', 'said + support')}) FROM pc), 8) AS f1_macro, round((SELECT sum(n * abs(my - mp)) / sum(n) FROM rb), 8) AS top_label_ece")
def multiclass_summary(spark, sf_dir):
    return rounded(E.multiclass_report(_classes(spark, sf_dir))[2])


_CAT = f"{_CLASS}, ct AS (SELECT * FROM (VALUES ('en', 'germanic'), ('de', 'germanic'), ('fr', 'romance'), ('es', 'romance')) v(label, category)), mg AS (SELECT id, t.category AS y, c.category AS label, sum(p) AS p FROM mc JOIN ct c USING (label) JOIN ct t ON t.label = mc.y GROUP BY ALL)"


@query("multiclass_merged", f"{_CAT}, {_BEST.format(src='mg')}, {_PER.format(src='mg')} {_PERSEL}")
def multiclass_merged(spark, sf_dir):
    merged = spark.createDataFrame([("en", "germanic"), ("de", "germanic"), ("fr", "romance"), ("es", "romance")], "label string, category string")
    return rounded(E.multiclass_report(_classes(spark, sf_dir), merged)[0])


@query("single_hit", "WITH h AS (SELECT doc_id, regexp_matches(text, '(?i)the') AS a, regexp_matches(text, '(?i)der') AS b, regexp_matches(text, '(?i)que') AS c FROM documents) SELECT doc_id, CASE WHEN CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) = 1 THEN CASE WHEN a THEN 'a' WHEN b THEN 'b' ELSE 'c' END END AS predicted FROM h")
def single_hit(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    hits = d.select("doc_id", *(F.col("text").rlike(f"(?i){w}").cast("int").alias(c) for c, w in (("a", "the"), ("b", "der"), ("c", "que"))))
    return E.single_hit(hits, "doc_id", ["a", "b", "c"])


@query("mapped_and_other", f"{W}, f AS (SELECT source IN ('src1', 'src2', 'src3') AS m, toxic, source IN ('src7') AS m2, y FROM pr), r AS (SELECT 'toxic' AS category, count(*) FILTER (WHERE m) AS n_mapped, count(*) FILTER (WHERE NOT m) AS n_other, avg(toxic) FILTER (WHERE m) AS a, avg(toxic) FILTER (WHERE NOT m) AS b FROM f UNION ALL SELECT 'quality', count(*) FILTER (WHERE m2), count(*) FILTER (WHERE NOT m2), avg(y) FILTER (WHERE m2), avg(y) FILTER (WHERE NOT m2) FROM f), s AS (SELECT category, n_mapped, n_other, CASE WHEN n_mapped >= 30 THEN a END AS a, CASE WHEN n_other >= 30 THEN b END AS b FROM r) SELECT category, n_mapped, n_other, {rnd('a', 'rate_mapped')}, {rnd('b', 'rate_other')}, {rnd('a / nullif(b, 0)', 'ratio')} FROM s")
def mapped_and_other(spark, sf_dir):
    t = predictions(spark, sf_dir).withColumns({"flag__toxic": F.col("toxic") == 1, "flag__quality": F.col("y") == 1})
    return rounded(E.mapped_and_other(t, {"toxic": ["src1", "src2", "src3"], "quality": ["src7"]}, "source", 30))


_RUNS = f"{W}, rn AS (SELECT doc_id % 5 AS run, avg(CAST((p >= 0.5e0) = (y = 1) AS DOUBLE)) AS accuracy, avg(pow(p - y, 2)) AS brier FROM pr GROUP BY 1)"


def _runs(spark, sf_dir):
    from tidewell.operators import metrics

    return metrics.binary_metrics(predictions(spark, sf_dir).withColumn("run", F.col("doc_id") % 5), by=["run"])


@query("runs_summary", f"{_RUNS} SELECT 'all' AS model, count(*) AS n_runs, {rnd('avg(accuracy)', 'accuracy_mean')}, {rnd('avg(brier)', 'brier_mean')}, {rnd('coalesce(stddev_samp(accuracy), 0)', 'accuracy_std')}, {rnd('coalesce(stddev_samp(brier), 0)', 'brier_std')} FROM rn")
def runs_summary(spark, sf_dir):
    return rounded(E.runs_summary(_runs(spark, sf_dir).withColumn("model", F.lit("all")), ["model"], ["accuracy", "brier"]))


@query("best_run", f"{_RUNS} SELECT run, {rnd('accuracy', 'accuracy')} FROM rn ORDER BY round(accuracy, 9) DESC, run LIMIT 1")
def best_run(spark, sf_dir):
    return rounded(E.best_run(_runs(spark, sf_dir), "run", "accuracy"))


@query("masking_summary", f"{_RUNS}, c AS (SELECT CASE run WHEN 0 THEN 'original' WHEN 1 THEN 'topic_masked' ELSE 'control' END AS condition, accuracy FROM rn), o AS (SELECT max(accuracy) FILTER (WHERE condition = 'original') AS o, max(accuracy) FILTER (WHERE condition = 'topic_masked') AS t FROM c) SELECT 'accuracy' AS metric, {rnd('max(o)', 'original')}, {rnd('max(o - t)', 'drop_topic')}, {rnd('avg(o - accuracy)', 'drop_control_mean')}, {rnd('coalesce(stddev_samp(o - accuracy), 0)', 'drop_control_sd')}, {rnd('min(o - accuracy)', 'drop_control_min')}, {rnd('max(o - accuracy)', 'drop_control_max')}, count(*) AS n_draws, round(max(o - t), 12) > round(max(o - accuracy), 12) AS exceeds FROM c, o WHERE condition = 'control'")
def masking_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumn("condition", F.when(F.col("run") == 0, "original").when(F.col("run") == 1, "topic_masked").otherwise("control"))
    return rounded(E.masking_summary(runs, ["accuracy"]))


@query("masking_runs")
def masking_runs(spark, sf_dir):
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("y"))
    words = lambda df, text: df.withColumn("p", F.least(F.regexp_count(text, F.lit("(?i)idiot|scum|trash|moron|pathetic")) / 4.0, F.lit(1.0)))
    return rounded(E.masking_runs(t, "doc_id", "text", "y", r"(?i)\b(idiot|scum|moron)\b", words, 3, draws=2, threshold=0.25))


_EDGE = "[" + ", ".join(f"{i}.0e0 / 15.0e0" for i in range(1, 15)) + "]"


@query("multilabel_ece", f"{ML}, rb AS (SELECT label, len(list_filter({_EDGE}, lambda e: e <= p)) AS bin, y, p FROM ml), g AS (SELECT label, bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS my FROM rb GROUP BY ALL), l AS (SELECT label, sum(n * abs(my - mp)) / sum(n) AS e FROM g GROUP BY label), h AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(CAST(y AS DOUBLE)) AS my FROM rb GROUP BY bin) SELECT label, round(e, 8) AS ece FROM l UNION ALL SELECT 'mean', round(avg(e), 8) FROM l UNION ALL SELECT 'pooled', round(sum(n * abs(my - mp)) / sum(n), 8) FROM h")
def multilabel_ece(spark, sf_dir):
    return rounded(E.multilabel_ece(_long(spark, sf_dir)))


@query("group_report", f"{ML}, g AS (SELECT id, max(y) AS y, max(p) AS p, bool_or(p >= CASE WHEN label = 'toxic' THEN 0.6e0 ELSE 0.7e0 END) AS h FROM ml GROUP BY id), c AS (SELECT CAST(sum(y) AS BIGINT) AS support, count(*) FILTER (WHERE y = 1 AND h) AS tp, count(*) FILTER (WHERE y = 0 AND h) AS fp, count(*) FILTER (WHERE y = 1 AND NOT h) AS fn, avg(p) AS mp, avg(y) AS oy, avg(CAST(h AS DOUBLE)) AS ph FROM g) SELECT 'any' AS grp, support, {rnd(_z('tp', 'tp + fp'), 'precision')}, {rnd(_z('tp', 'tp + fn'), 'recall')}, {rnd(_mf1, 'f1')}, {rnd('mp', 'mean_p')}, {rnd('oy', 'observed_rate')}, {rnd('ph', 'predicted_rate')} FROM c")
def group_report(spark, sf_dir):
    members = spark.createDataFrame([("quality", "any"), ("toxic", "any")], "label string, grp string")
    thresholds = spark.createDataFrame([("quality", 0.7), ("toxic", 0.6)], "label string, threshold double")
    return rounded(E.group_report(_long(spark, sf_dir), members, thresholds))


_M3 = "avg(CAST((p >= 0.5e0) = (y = 1) AS DOUBLE)) AS accuracy, {f} AS f1, avg(pow(p - y, 2)) AS brier".format(f=_z("2 * count(*) FILTER (WHERE y = 1 AND p >= 0.5e0)", "count(*) FILTER (WHERE p >= 0.5e0) + sum(y)"))


@query("agreement_by", f"{W}, r AS (SELECT {_M3} FROM pr WHERE lang = 'en'), s AS (SELECT source, count(*) AS n, avg(y) AS prevalence, {_M3} FROM pr GROUP BY source) SELECT s.source, n, {rnd('prevalence', 'prevalence')}, {rnd('s.accuracy', 'accuracy')}, {rnd('s.f1', 'f1')}, {rnd('s.brier', 'brier')}, {rnd('s.accuracy - r.accuracy', 'delta_accuracy')}, {rnd('s.f1 - r.f1', 'delta_f1')}, {rnd('s.brier - r.brier', 'delta_brier')} FROM s, r")
def agreement_by(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(E.agreement_by(p, "source", p.where("lang = 'en'")))


_rk = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0e0"
_auc = lambda c: f"(sum({c}) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0e0) / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0))"


@query("correlation_report", f"{W}, o AS (SELECT y, p, CASE WHEN doc_id % 7 > 0 THEN doc_id % 13 + toxic END AS o FROM pr), k AS (SELECT y, {_rk('p')} AS a, {_rk('o')} AS b FROM o WHERE o IS NOT NULL) SELECT (SELECT count(*) FROM o) AS n, (SELECT count(o) FROM o) AS n_known, round((SELECT avg(o) FILTER (WHERE y = 1) FROM o), 8) AS mean_1, round((SELECT avg(o) FILTER (WHERE y = 0) FROM o), 8) AS mean_0, round(corr(a, b), 8) AS rho, round({_auc('a')}, 8) AS auc_score, round({_auc('b')}, 8) AS auc_other FROM k")
def correlation_report(spark, sf_dir):
    t = predictions(spark, sf_dir).withColumn("o", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 13 + F.col("toxic")))
    return rounded(E.correlation_report(t, "p", "o", "y"))


_LO, _HI = wilson_sql("(c11 + c00)", "n")
_HAND = f"{W}, h AS (SELECT lang, source, y AS a, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 9 = 1 THEN 1 - y ELSE y END END AS h FROM pr)"


def _hand(spark, sf_dir):
    return predictions(spark, sf_dir).withColumn("h", F.when(F.col("doc_id") % 3 > 0, F.when(F.col("doc_id") % 9 == 1, 1 - F.col("y")).otherwise(F.col("y"))))


@query(
    "handcheck_noise",
    f"""{_HAND}, pv AS (SELECT lang, avg(CAST(y AS DOUBLE)) AS prevalence FROM pr WHERE lang <> 'es' GROUP BY lang), c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE a = 1 AND h = 1) AS c11, count(*) FILTER (WHERE a = 1 AND h = 0) AS c10, count(*) FILTER (WHERE a = 0 AND h = 1) AS c01, count(*) FILTER (WHERE a = 0 AND h = 0) AS c00 FROM h WHERE h IS NOT NULL GROUP BY lang),
    r AS (SELECT c.*, prevalence AS pi, coalesce(n >= 20 AND c11 + c10 >= 3 AND c01 + c00 >= 3 AND prevalence IS NOT NULL, false) AS ok FROM c LEFT JOIN pv USING (lang)), v AS (SELECT *, CASE WHEN ok THEN c11 / CAST(c11 + c10 AS DOUBLE) END AS ppv, CASE WHEN ok THEN c01 / CAST(c01 + c00 AS DOUBLE) END AS q0 FROM r), u AS (SELECT *, pi * ppv / nullif(pi * ppv + (1 - pi) * q0, 0) AS pc FROM v)
    SELECT lang, n, c11 AS auto1_human1, c10 AS auto1_human0, c01 AS auto0_human1, c00 AS auto0_human0, {rnd('(c11 + c00) / CAST(n AS DOUBLE)', 'agreement')}, {rnd(_LO, 'agreement_lo')}, {rnd(_HI, 'agreement_hi')}, {rnd('ppv', 'ppv')}, {rnd('q0', 'q0')}, {rnd('0.5e0 * (1 + ppv - q0)', 'ceiling_roc_auc')}, {rnd('pi * ppv + (1 - pi) * (1 - q0)', 'ceiling_accuracy')}, {rnd('2 * pc * ppv / nullif(pc + ppv, 0)', 'ceiling_f1')}, CASE WHEN ok THEN 'complete' ELSE 'pending' END AS status FROM u""",
)
def handcheck_noise(spark, sf_dir):
    t = _hand(spark, sf_dir)
    prevalence = t.where("lang <> 'es'").groupBy("lang").agg(F.avg(F.col("y").cast("double")).alias("prevalence"))
    return rounded(E.handcheck_noise(t, "lang", "y", "h", prevalence, 20))


@query("handcheck_score", f"{_HAND}, x AS (SELECT unnest([lang, 'ALL']) AS lang, a, h FROM h WHERE h IS NOT NULL) SELECT lang, count(*) AS n, round(avg(CAST(a = h AS DOUBLE)), 8) AS agreement, count(*) FILTER (WHERE a = 1 AND h = 0) AS auto1_human0, count(*) FILTER (WHERE a = 0 AND h = 1) AS auto0_human1 FROM x GROUP BY lang")
def handcheck_score(spark, sf_dir):
    return rounded(E.handcheck_score(_hand(spark, sf_dir), "lang", "y", "h"))


@query("length_shares", "SELECT unnest([100, 1000, 5000]) AS over, round(unnest([avg(CAST(n_chars > 100 AS DOUBLE)), avg(CAST(n_chars > 1000 AS DOUBLE)), avg(CAST(n_chars > 5000 AS DOUBLE))]), 8) AS share FROM documents")
def length_shares(spark, sf_dir):
    return rounded(E.text_predicate_share(table(spark, sf_dir, "documents"), F.col("n_chars"), [100, 1000, 5000]))


@query("calibrated_report")
def calibrated_report(spark, sf_dir):
    t = predictions(spark, sf_dir).withColumn("margin", F.col("p") * 6 - 3)
    return rounded(E.calibrated_report(t.where("doc_id % 2 = 0"), t.where("doc_id % 2 = 1"), "margin", "y", "source", replicates=B))


@query("multilabel_final")
def multilabel_final(spark, sf_dir):
    long = _long(spark, sf_dir).withColumn("z", F.col("p") * 6 - 3)
    report, _ = E.multilabel_final(long.where("id % 2 = 0"), long.where("id % 2 = 1"), long.where("id % 7 = 0"))
    return rounded(report)
