"""Topics over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.stats import rounded
from tidewell.operators import topics
from tidewell.plans.registry import query, rnd, wilson_sql
from tidewell.plans.views import TOPICS_SQL, topic_counts

K_MIN = 20

SCOPED = f"{TOPICS_SQL}, sc AS (SELECT CAST(date_trunc('week', date) AS DATE) AS period, unnest([community, 'ALL']) AS community, topic_id, n AS n0 FROM tc), s AS (SELECT period, community, topic_id, CAST(sum(n0) AS BIGINT) AS n FROM sc GROUP BY ALL)"
GRID = f"""{SCOPED}, ends AS (SELECT community, min(period) AS lo, max(period) AS hi FROM s GROUP BY ALL),
g0 AS (SELECT community, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS period FROM ends),
tot AS (SELECT community, period, CAST(sum(n) AS BIGINT) AS n_period FROM s GROUP BY ALL),
grid AS (SELECT g0.community, g0.period, coalesce(n_period, 0) AS n_period FROM g0 LEFT JOIN tot USING (community, period)),
tops AS (SELECT DISTINCT community, topic_id FROM s WHERE topic_id <> -1),
cells AS (SELECT g.community, t.topic_id, g.period, g.n_period, coalesce(s.n, 0) AS n FROM grid g JOIN tops t USING (community) LEFT JOIN s ON s.community = g.community AND s.period = g.period AND s.topic_id = t.topic_id)"""
_w = wilson_sql("n", "n_total")
_hide = f"(n < {K_MIN} OR n_total < {K_MIN})"
_show = lambda e: f"CASE WHEN NOT {_hide} THEN {e} END"


@query("topic_share_week", f"WITH {SCOPED}, t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY period, community) AS BIGINT) AS n_total FROM s) SELECT period, community, topic_id, {_show('n')} AS n_topic, {_show('n_total')} AS n_total, {rnd(_show('n / CAST(n_total AS DOUBLE)'), 'share')}, {rnd(_show(_w[0]), 'ci_low')}, {rnd(_show(_w[1]), 'ci_high')}, {_hide} AS suppressed FROM t WHERE topic_id <> -1")
def topic_share_week(spark, sf_dir):
    return rounded(topics.share_series(topic_counts(spark, sf_dir), "week", K_MIN))


@query("period_grid", f"WITH {GRID} SELECT community, period, n_period FROM grid")
def period_grid(spark, sf_dir):
    return topics.period_grid(topics.scope_counts(topic_counts(spark, sf_dir), "week"), "week")


R, B, RATIO, COUNT, RUN = 4, 8, 1.1, 20, 1
EMERGING = f"""{GRID}, bk AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY period DESC) AS back FROM grid), g12 AS (SELECT * FROM bk WHERE back <= {R + B}),
sp AS (SELECT community, max(period) AS as_of_period, CAST(sum(CASE WHEN back <= {R} THEN n_period ELSE 0 END) AS BIGINT) AS nw, CAST(sum(CASE WHEN back > {R} THEN n_period ELSE 0 END) AS BIGINT) AS nb FROM g12 GROUP BY community HAVING count(*) = {R + B}),
cc AS (SELECT c.*, g.back FROM cells c JOIN g12 g USING (community, period)),
sm AS (SELECT community, topic_id, CAST(sum(CASE WHEN back <= {R} THEN n ELSE 0 END) AS BIGINT) AS cw, CAST(sum(CASE WHEN back > {R} THEN n ELSE 0 END) AS BIGINT) AS cb FROM cc GROUP BY ALL),
e1 AS (SELECT sm.*, as_of_period, nw, nb, cw / CAST(nw AS DOUBLE) AS sw, greatest(cb, {K_MIN}) / CAST(nb AS DOUBLE) AS sb FROM sm JOIN sp USING (community) WHERE nw >= {K_MIN} AND nb >= {K_MIN}),
h AS (SELECT cc.community, cc.topic_id, cc.period, coalesce(cc.n / nullif(CAST(cc.n_period AS DOUBLE), 0) / sb >= {RATIO}e0, false) AS hot FROM cc JOIN e1 USING (community, topic_id) WHERE back <= {R}),
hr AS (SELECT *, sum(CAST(NOT hot AS INTEGER)) OVER (PARTITION BY community, topic_id ORDER BY period) AS run FROM h),
lr AS (SELECT community, topic_id, max(k) AS max_run FROM (SELECT community, topic_id, run, count(*) FILTER (WHERE hot) AS k FROM hr GROUP BY ALL) GROUP BY ALL),
e2 AS (SELECT e1.*, sw / sb AS gr, max_run, {wilson_sql("cw", "nw")[0]} AS lo FROM e1 JOIN lr USING (community, topic_id)),
em AS (SELECT *, cw < {K_MIN} AS hid, cb < {K_MIN} AS low, coalesce(CASE WHEN cw >= {K_MIN} THEN cw >= {max(COUNT, K_MIN)} AND gr >= {RATIO}e0 AND max_run >= {RUN} AND lo > sb END, false) AS is_emerging FROM e2)"""


def _emerging(spark, sf_dir):
    return topics.emerging(topic_counts(spark, sf_dir), "week", K_MIN, R, B, COUNT, RATIO, RUN)


_e = lambda e: f"CASE WHEN NOT hid THEN {e} END"


@query(
    "topics_emerging",
    f"""WITH {EMERGING} SELECT community, topic_id, as_of_period, {_e("cw")} AS n_recent, nw AS n_recent_total, {rnd(_e("sw"), "share_recent")}, {_e("CASE WHEN NOT low THEN cb END")} AS n_baseline, nb AS n_baseline_total, {rnd(_e("sb"), "share_baseline_floored")},
    {rnd(_e("gr"), "growth_ratio")}, {_e("max_run")} AS max_consecutive_hot, {rnd(_e("lo"), "ci_low_recent")}, is_emerging, low AS baseline_below_k, hid AS suppressed FROM em""",
)
def topics_emerging(spark, sf_dir):
    return rounded(_emerging(spark, sf_dir))


PERSISTENT = f"""v AS (SELECT *, n / CAST(n_period AS DOUBLE) AS sh FROM cells WHERE n_period >= {K_MIN}),
p1 AS (SELECT community, topic_id, count(*) AS nv, count(*) FILTER (WHERE sh >= 0.08e0) AS above, avg(sh) AS ms, CAST(sum(n) AS BIGINT) AS nt FROM v GROUP BY ALL),
pe AS (SELECT *, nt < {K_MIN} AS phid, coalesce(CASE WHEN nt >= {K_MIN} THEN nv >= 8 AND above / CAST(nv AS DOUBLE) >= 0.6e0 END, false) AS is_persistent FROM p1)"""


def _persistent(spark, sf_dir):
    return topics.persistent(topic_counts(spark, sf_dir), "week", K_MIN, 0.08, 0.6, 8)


_p = lambda e: f"CASE WHEN NOT phid THEN {e} END"


@query("topics_persistent", f"WITH {GRID}, {PERSISTENT} SELECT community, topic_id, nv AS n_valid_periods, {_p('above')} AS n_periods_above, {rnd(_p('ms'), 'mean_share')}, {_p('nt')} AS n_topic_valid_periods, {rnd(_p('above / CAST(nv AS DOUBLE)'), 'fraction_above')}, is_persistent, phid AS suppressed FROM pe")
def topics_persistent(spark, sf_dir):
    return rounded(_persistent(spark, sf_dir))


@query("topics_status", f"WITH {EMERGING}, {PERSISTENT}, j AS (SELECT community, topic_id, coalesce(is_persistent, false) AS is_persistent, coalesce(is_emerging, false) AS is_emerging FROM pe FULL OUTER JOIN em USING (community, topic_id)) SELECT *, CASE WHEN is_persistent AND is_emerging THEN 'both' WHEN is_emerging THEN 'emerging' WHEN is_persistent THEN 'persistent' ELSE 'neither' END AS status FROM j")
def topics_status(spark, sf_dir):
    return topics.status(_emerging(spark, sf_dir), _persistent(spark, sf_dir))


@query(
    "ewma_cusum",
    """WITH RECURSIVE d AS (SELECT event_type AS source, CAST(ts AS DATE) AS day, avg(value) AS x FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day) AS i, avg(x) OVER (PARTITION BY source) AS m FROM d),
    w AS (SELECT source, day, i, x AS e, greatest(0.0e0, x - m) AS up, greatest(0.0e0, m - x) AS down FROM n WHERE i = 1
          UNION ALL SELECT n.source, n.day, n.i, 0.3e0 * n.x + 0.7e0 * w.e, greatest(0.0e0, w.up + n.x - n.m), greatest(0.0e0, w.down - n.x + n.m) FROM w JOIN n ON n.source = w.source AND n.i = w.i + 1)
    SELECT source, day, round(e, 6) AS ewma, round(up, 6) AS cusum_up, round(down, 6) AS cusum_down FROM w""",
)
def ewma_cusum(spark, sf_dir):
    from tidewell.plans.registry import table

    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("x"))
    return rounded(topics.ewma(d, "source", "day", "x"), 6)
