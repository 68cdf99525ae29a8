"""Rates, weights, lifts and shares over scored records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.stats import rounded
from tidewell.operators import rates
from tidewell.plans.registry import query, rnd, wilson_sql
from tidewell.plans.views import K_MIN, RECORDS_SQL, records

CELLS_SQL = """cells AS (
    SELECT CAST(date_trunc('{g}', date) AS DATE) AS period, CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source,
           CASE WHEN grouping(community) = 1 THEN 'ALL' ELSE community END AS community, grouping(source) + grouping(community) AS level,
           count(*) AS n_total, CAST(sum(CAST(stress_flag AS INTEGER)) AS BIGINT) AS n_stress, sum(stress_prob) AS prob_sum
    FROM r GROUP BY GROUPING SETS ((1, source, community), (1, source), (1)))"""


def _rate_sql(g: str) -> str:
    lo, hi = wilson_sql("n_stress", "n_total")
    show = lambda e: f"CASE WHEN n_total >= {K_MIN} THEN {e} END"
    return f"""WITH {RECORDS_SQL}, {CELLS_SQL.format(g=g)}
        SELECT period, source, community, {show("n_total")} AS n_total, {show("n_stress")} AS n_stress, {rnd(show("prob_sum / n_total"), "mean_stress_prob")},
               {rnd(show("CAST(n_stress AS DOUBLE) / n_total"), "stress_rate")}, {rnd(show(lo), "ci_low")}, {rnd(show(hi), "ci_high")}, n_total < {K_MIN} AS suppressed
        FROM cells"""


for _g in ("day", "week", "month"):

    @query(f"stress_rate_{_g}", _rate_sql(_g))
    def _rate(spark, sf_dir, g=_g):
        return rounded(rates.rate_table(rates.rate_cells(records(spark, sf_dir), g), K_MIN))


WEIGHTS_SQL = f"""w0 AS (SELECT source, community, count(*) AS n_ref FROM r WHERE CAST(date AS DATE) BETWEEN (SELECT min(CAST(date AS DATE)) FROM r) AND (SELECT min(CAST(date AS DATE)) FROM r) + 13 GROUP BY ALL),
w AS (SELECT source, community, n_ref, n_ref >= {K_MIN} AS usable,
      CASE WHEN n_ref >= {K_MIN} THEN n_ref ELSE 0 END / CAST(greatest(sum(CASE WHEN n_ref >= {K_MIN} THEN n_ref ELSE 0 END) OVER (), 1) AS DOUBLE) AS weight_all,
      coalesce(CASE WHEN n_ref >= {K_MIN} THEN n_ref ELSE 0 END / nullif(CAST(sum(CASE WHEN n_ref >= {K_MIN} THEN n_ref ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE), 0), 0.0e0) AS weight_in_source FROM w0)"""


@query("composition_weights", f"WITH {RECORDS_SQL}, {WEIGHTS_SQL} SELECT source, community, n_ref, usable, {rnd('weight_all', 'weight_all')}, {rnd('weight_in_source', 'weight_in_source')} FROM w")
def composition_weights(spark, sf_dir):
    return rounded(rates.reference_weights(records(spark, sf_dir), K_MIN, first_n_weeks=2))


_raw = wilson_sql("n_stress", "n_total")
_show = lambda e: f"CASE WHEN n_total >= {K_MIN} THEN {e} END"


@query(
    "adjusted_rate_week",
    f"""WITH {RECORDS_SQL}, {CELLS_SQL.format(g="week")}, {WEIGHTS_SQL},
    s AS (SELECT c.period, c.n_total, c.n_stress, 'ALL' AS scope, coalesce(w.weight_all, 0) AS w FROM cells c LEFT JOIN w USING (source, community) WHERE level = 0
          UNION ALL SELECT c.period, c.n_total, c.n_stress, c.source, coalesce(w.weight_in_source, 0) FROM cells c LEFT JOIN w USING (source, community) WHERE level = 0),
    t AS (SELECT *, n_total >= {K_MIN} AND w > 0 AS used, n_stress / CAST(n_total AS DOUBLE) AS p FROM s),
    a AS (SELECT scope, period, CAST(sum(n_total) AS BIGINT) AS n_total, CAST(sum(n_stress) AS BIGINT) AS n_stress, coalesce(sum(w) FILTER (WHERE used), 0) AS coverage,
                 sum(w * p) FILTER (WHERE used) AS wp, sum(w * w * p * (1 - p) / n_total) FILTER (WHERE used) AS v, count(*) FILTER (WHERE used) AS n_strata FROM t GROUP BY ALL),
    e AS (SELECT *, CASE WHEN coverage >= 0.8e0 THEN wp / coverage END AS est, CASE WHEN coverage >= 0.8e0 THEN sqrt(v) / coverage END AS se FROM a)
    SELECT scope, period, {_show("n_total")} AS n_total, {_show("n_stress")} AS n_stress, {rnd(_show("coverage"), "coverage")}, n_strata, {rnd(_show("est"), "adjusted_rate")},
           {rnd(_show("CASE WHEN est IS NOT NULL THEN least(greatest(est - 1.959963984540054e0 * se, 0), 1) END"), "adj_ci_low")}, {rnd(_show("CASE WHEN est IS NOT NULL THEN least(greatest(est + 1.959963984540054e0 * se, 0), 1) END"), "adj_ci_high")},
           {rnd(_show("CAST(n_stress AS DOUBLE) / n_total"), "raw_rate")}, {rnd(_show(_raw[0]), "raw_ci_low")}, {rnd(_show(_raw[1]), "raw_ci_high")}, n_total < {K_MIN} AS suppressed FROM e""",
)
def adjusted_rate_week(spark, sf_dir):
    r = records(spark, sf_dir)
    return rounded(rates.adjusted_series(rates.rate_cells(r, "week"), rates.reference_weights(r, K_MIN, first_n_weeks=2), K_MIN))


LIFT_SQL = f"""lp AS (SELECT unnest(['ALL', community]) AS scope, level, label, stress_flag, sample_weight AS w, p >= 0.5e0 AS present FROM emo),
l0 AS (SELECT scope, level, label, count(*) FILTER (WHERE stress_flag) AS n_flagged, count(*) FILTER (WHERE NOT stress_flag) AS n_unflagged_sampled, sum(w) FILTER (WHERE NOT stress_flag) AS n_unflagged_weighted,
       sum(w) FILTER (WHERE stress_flag AND present) / nullif(sum(w) FILTER (WHERE stress_flag), 0) AS pf0, sum(w) FILTER (WHERE NOT stress_flag AND present) / nullif(sum(w) FILTER (WHERE NOT stress_flag), 0) AS pu0 FROM lp GROUP BY ALL),
l1 AS (SELECT scope, level, label, n_flagged, n_unflagged_sampled, n_unflagged_weighted, CASE WHEN n_flagged > 0 THEN coalesce(pf0, 0) END AS pf, CASE WHEN n_unflagged_sampled > 0 THEN coalesce(pu0, 0) END AS pu, n_flagged < {K_MIN} OR n_unflagged_sampled < {K_MIN} AS suppressed FROM l0),
lift AS (SELECT scope, level, label, suppressed, CASE WHEN NOT suppressed THEN n_flagged END AS n_flagged, CASE WHEN NOT suppressed THEN n_unflagged_sampled END AS n_unflagged_sampled, CASE WHEN NOT suppressed THEN n_unflagged_weighted END AS n_unflagged_weighted,
         CASE WHEN NOT suppressed THEN pf END AS prev_flagged, CASE WHEN NOT suppressed THEN pu END AS prev_unflagged, CASE WHEN NOT suppressed THEN pf / nullif(pu, 0) END AS lift FROM l1)"""


@query("lift_by_label", f"WITH {RECORDS_SQL}, {LIFT_SQL} SELECT scope, level, label, suppressed, n_flagged, n_unflagged_sampled, {rnd('n_unflagged_weighted', 'n_unflagged_weighted', 6)}, {rnd('prev_flagged', 'prev_flagged')}, {rnd('prev_unflagged', 'prev_unflagged')}, {rnd('lift', 'lift')} FROM lift")
def lift_by_label(spark, sf_dir):
    t = rates.lift(records(spark, sf_dir), K_MIN)
    return rounded(t.withColumn("n_unflagged_weighted", F.round("n_unflagged_weighted", 6)))


@query("community_agreement", f"WITH {RECORDS_SQL}, {LIFT_SQL} SELECT c.level, c.label, {rnd('avg(CAST((c.lift > 1) = (a.lift > 1) AS DOUBLE))', 'community_agreement')}, count(*) AS n_communities FROM lift c JOIN lift a ON a.scope = 'ALL' AND c.scope <> 'ALL' AND a.level = c.level AND a.label = c.label AND a.lift IS NOT NULL AND c.lift IS NOT NULL GROUP BY ALL")
def agreement(spark, sf_dir):
    return rounded(rates.community_agreement(rates.lift(records(spark, sf_dir), K_MIN)))


_POISSON = "(" + " + ".join(f"CAST(u >= {c}e0 AS INTEGER)" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)) + ")"


@query(
    "lift_bootstrap_ci",
    f"""WITH {RECORDS_SQL}, b AS (SELECT unnest(range(0, 20)) AS b),
    d AS (SELECT b, event_id, CAST(('0x' || substr(sha256('42:' || b || ':' || event_id), 1, 12)) AS BIGINT) / 281474976710656.0e0 AS u FROM r, b WHERE second_stage_scored),
    dw AS (SELECT b, event_id, {_POISSON} AS m FROM d),
    s AS (SELECT dw.b, e.level, e.label, e.stress_flag, sum(m * sample_weight) AS n, coalesce(sum(m * sample_weight) FILTER (WHERE p >= 0.5e0), 0) AS k FROM dw JOIN emo e USING (event_id) GROUP BY ALL),
    l AS (SELECT level, label, b, max(k / nullif(n, 0)) FILTER (WHERE stress_flag) / nullif(max(k / nullif(n, 0)) FILTER (WHERE NOT stress_flag), 0) AS lift FROM s GROUP BY ALL)
    SELECT level, label, {rnd('quantile_cont(lift, 0.025)', 'lift_ci_low', 6)}, {rnd('quantile_cont(lift, 0.975)', 'lift_ci_high', 6)}, count(lift) AS n_replicates FROM l GROUP BY ALL""",
)
def lift_bootstrap_ci(spark, sf_dir):
    return rounded(rates.lift_bootstrap(records(spark, sf_dir), K_MIN, "event_id", 20), 6)


@query(
    "lift_bootstrap_scopes",
    f"""WITH {RECORDS_SQL}, b AS (SELECT unnest(range(0, 20)) AS b),
    d AS (SELECT b, event_id, CAST(('0x' || substr(sha256('42:' || b || ':' || event_id), 1, 12)) AS BIGINT) / 281474976710656.0e0 AS u FROM r, b WHERE second_stage_scored),
    dw AS (SELECT b, event_id, {_POISSON} AS m FROM d), es AS (SELECT event_id, level, label, stress_flag, sample_weight, p, unnest(['ALL', community]) AS scope FROM emo),
    s AS (SELECT dw.b, e.scope, e.level, e.label, e.stress_flag, sum(m * sample_weight) AS n, coalesce(sum(m * sample_weight) FILTER (WHERE p >= 0.5e0), 0) AS k FROM dw JOIN es e USING (event_id) GROUP BY ALL),
    l AS (SELECT scope, level, label, b, max(k / nullif(n, 0)) FILTER (WHERE stress_flag) / nullif(max(k / nullif(n, 0)) FILTER (WHERE NOT stress_flag), 0) AS lift FROM s GROUP BY ALL)
    SELECT scope, level, label, {rnd('quantile_cont(lift, 0.025)', 'lift_ci_low', 6)}, {rnd('quantile_cont(lift, 0.975)', 'lift_ci_high', 6)}, count(lift) AS n_replicates FROM l GROUP BY ALL""",
)
def lift_bootstrap_scopes(spark, sf_dir):
    return rounded(rates.lift_bootstrap(records(spark, sf_dir), K_MIN, "event_id", 20, per_community=True), 6)


_co = wilson_sql("k", "n")


@query(
    "cooccurrence",
    f"""WITH {RECORDS_SQL},
    x AS (SELECT level, label, CAST(p >= 0.5e0 AS INTEGER) AS present, unnest(['work', 'money', 'health']) AS stressor, unnest([work, money, health]) AS has FROM emo WHERE stress_flag),
    g AS (SELECT stressor, level, label, count(*) FILTER (WHERE has) AS n, CAST(sum(present) FILTER (WHERE has) AS BIGINT) AS k, avg(present) AS base FROM x GROUP BY ALL)
    SELECT stressor, level, label, CASE WHEN n >= {K_MIN} THEN n END AS n_stressor, {rnd(f"CASE WHEN n >= {K_MIN} THEN k / CAST(n AS DOUBLE) END", "prev_given_stressor")}, {rnd(f"CASE WHEN n >= {K_MIN} THEN {_co[0]} END", "ci_low")}, {rnd(f"CASE WHEN n >= {K_MIN} THEN {_co[1]} END", "ci_high")},
           {rnd(f"CASE WHEN n >= {K_MIN} THEN base END", "prev_all_flagged")}, {rnd(f"CASE WHEN n >= {K_MIN} AND base > 0 THEN k / CAST(n AS DOUBLE) / base END", "lift")}, n < {K_MIN} AS suppressed FROM g WHERE n > 0""",
)
def cooccurrence(spark, sf_dir):
    return rounded(rates.cooccurrence(records(spark, sf_dir), K_MIN))


_f, _t = wilson_sql("n_flag", "n"), wilson_sql("n_top", "n")
_s = lambda e: f"CASE WHEN n >= {K_MIN} THEN {e} END"


@query(
    "stressor_share",
    f"""WITH {RECORDS_SQL},
    f AS (SELECT CAST(date_trunc('week', date) AS DATE) AS period, unnest([community, 'ALL']) AS community, work, money, health, coalesce(stressor_top, 'none_unclear') AS top FROM r WHERE second_stage_scored AND stress_flag),
    d AS (SELECT period, community, count(*) AS n FROM f GROUP BY ALL),
    a AS (SELECT period, community, unnest(['work', 'money', 'health']) AS stressor, unnest([count(*) FILTER (WHERE work), count(*) FILTER (WHERE money), count(*) FILTER (WHERE health)]) AS n_flag FROM f GROUP BY period, community),
    b AS (SELECT period, community, top AS stressor, count(*) AS n_top FROM f GROUP BY ALL),
    j AS (SELECT period, community, stressor, coalesce(n_flag, 0) AS n_flag, coalesce(n_top, 0) AS n_top FROM a FULL OUTER JOIN b USING (period, community, stressor)),
    t AS (SELECT j.*, d.n FROM j LEFT JOIN d USING (period, community))
    SELECT period, community, stressor, {_s("n")} AS n_stress_scored, {_s("n_flag")} AS n_flag, {_s("n_top")} AS n_top, {rnd(_s("n_flag / CAST(n AS DOUBLE)"), "share_flag")}, {rnd(_s("n_top / CAST(n AS DOUBLE)"), "share_top")},
           {rnd(_s(_f[0]), "flag_ci_low")}, {rnd(_s(_f[1]), "flag_ci_high")}, {rnd(_s(_t[0]), "top_ci_low")}, {rnd(_s(_t[1]), "top_ci_high")}, n < {K_MIN} AS suppressed FROM t""",
)
def stressor_share(spark, sf_dir):
    return rounded(rates.stressor_share(records(spark, sf_dir), "week", K_MIN))
