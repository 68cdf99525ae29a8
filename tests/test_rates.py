import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import stats
from tidewell.operators import quality, rates


def values(df, *cols):
    return df.select(*cols).first()


def test_wilson(spark):
    rows = spark.createDataFrame([(5, 10), (0, 10), (10, 10), (0, 0)], "k long, n long")
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in rows.select(lo, hi).collect()]
    assert got[0] == pytest.approx((0.2366, 0.7634), abs=1e-4) and got[1] == pytest.approx((0, 0.2775), abs=1e-3)
    assert got[2] == pytest.approx((0.7225, 1), abs=1e-4) and got[3] == (None, None)


def test_unit_hash_is_sha256(spark):
    import hashlib

    got = {r[0]: r[1] for r in spark.range(200).select("id", stats.unit_hash(F.col("id"), 7)).collect()}
    assert all(u == int.from_bytes(hashlib.sha256(f"7:{i}".encode()).digest()[:8], "little") / 2**64 for i, u in got.items())


def test_running_sums(spark):
    r = random.Random(1)
    p = sorted({round(r.random(), 3) for _ in range(300)} | {0.0, 1.0})
    got = {x.p: x.before_n for x in stats.running(spark.createDataFrame([(x, i) for i, x in enumerate(p)], "p double, n long"), "p", ["n"], 16).collect()}
    assert all(got[x] == sum(range(i)) for i, x in enumerate(p))


def frame(spark):
    start = dt.datetime(2020, 1, 6)
    rows = [(start + dt.timedelta(days=d), "s", c, i < {"a": 6, "b": 2}[c], 0.8 if i < {"a": 6, "b": 2}[c] else 0.2) for d in range(70) for c in "ab" for i in range(10)]
    return spark.createDataFrame(rows, "date timestamp, source string, community string, stress_flag boolean, stress_prob double")


def test_cells_roll_up_and_suppress(spark):
    t = rates.rate_table(rates.rate_cells(frame(spark), "week"), 100)
    rows = t.collect()
    assert len(rows) == 10 * 4
    assert all(r.suppressed and r.n_total is None and r.stress_rate is None for r in rows if r.community in "ab")
    assert all(r.n_total == 140 and r.stress_rate == pytest.approx(0.4) for r in rows if r.source == "ALL")


def test_a_community_named_all_stays_apart(spark):
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1), "s", "ALL", True, 0.5)] * 3, "date timestamp, source string, community string, stress_flag boolean, stress_prob double")
    assert rates.rate_cells(d, "day").count() == 3


def test_standardising_removes_a_shift_of_mix(spark):
    start = dt.datetime(2020, 1, 6)
    rows = []
    for w in range(10):
        for c, n in (("a", 400 if w < 5 else 100), ("b", 100 if w < 5 else 400)):
            rows += [(start + dt.timedelta(weeks=w), "s", c, i < n * {"a": 0.6, "b": 0.2}[c], 0.5) for i in range(n)]
    df = spark.createDataFrame(rows, "date timestamp, source string, community string, stress_flag boolean, stress_prob double")
    t = rates.adjusted_series(rates.rate_cells(df, "week"), rates.reference_weights(df, 50, first_n_weeks=2), 50).where("scope = 'ALL'").orderBy("period").collect()
    assert t[0].raw_rate - t[-1].raw_rate > 0.2 and all(r.adjusted_rate == pytest.approx(0.52) for r in t)


def test_lift_recovers_what_is_planted(spark):
    r = random.Random(2)
    rows = []
    for i in range(8000):
        flag = i % 4 == 0
        scored = flag or r.random() < 0.2
        rows.append((i, "ab"[i % 2], flag, scored, (1.0 if flag else 5.0) if scored else None, 0.9 if r.random() < (0.6 if flag else 0.2) else 0.1, 0.9 if r.random() < 0.3 else None))
    df = spark.createDataFrame(rows, "id long, community string, stress_flag boolean, second_stage_scored boolean, sample_weight double, emotion_p__sadness double, emotion_p__joy double")
    got = {x.label: x for x in rates.lift(df, 50).where("scope = 'ALL'").collect()}
    assert got["sadness"].lift == pytest.approx(3, rel=0.2) and got["joy"].lift == pytest.approx(1, rel=0.2)
    ci = {x.label: x for x in rates.lift_bootstrap(df, 50, "id", 40).collect()}
    assert ci["sadness"].lift_ci_low < got["sadness"].lift < ci["sadness"].lift_ci_high
    assert all(x.suppressed and x.lift is None for x in rates.lift(df, 10**6).collect())


def test_publishing_is_refused(spark):
    ok = spark.createDataFrame([("a", 60)], "community string, n_total long")
    quality.check_publishable(ok, 50, ["n_total"])
    for bad in (ok.withColumnRenamed("community", "text"), ok.withColumn("community", F.repeat(F.lit("x"), 300)), ok.withColumn("n_total", F.lit(9))):
        with pytest.raises(ValueError):
            quality.check_publishable(bad, 50, ["n_total"])
    with pytest.raises(ValueError):
        quality.check_accounting(spark.createDataFrame([("kept", 3)], "reason string, n long"), 4)
