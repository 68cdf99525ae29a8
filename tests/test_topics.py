import datetime as dt

from tidewell.operators import topics


def counts(spark, shares, n=1000):
    rows = []
    for p, share in enumerate(shares):
        day = dt.date(2020, 1, 6) + dt.timedelta(weeks=p)
        own = [(t, round(n * s)) for t, s in share.items()]
        rows += [(day, "a", t, c) for t, c in own if c] + [(day, "a", -1, n - sum(c for _, c in own))]
    return spark.createDataFrame(rows, "date date, community string, topic_id int, n long")


def test_states(spark):
    steady = [{1: 0.10, 2: 0.05 if p < 9 else 0.15, 3: 0.2 if p == 10 else 0.01, 4: 0.1 if p >= 9 else 0} for p in range(12)]
    c = counts(spark, steady)
    e = topics.emerging(c, "week", 50, ratio_at_least=1.5, persistence=2)
    p = topics.persistent(c, "week", 50)
    got = {r.topic_id: r.status for r in topics.status(e, p).where("community = 'a'").collect()}
    assert got == {1: "persistent", 2: "both", 3: "neither", 4: "emerging"}
    assert topics.emerging(counts(spark, steady[:11]), "week", 50).count() == 0  # too few periods


def test_grid_has_no_gaps(spark):
    c = counts(spark, [{1: 0.2}] * 9).where("date <> date'2020-01-20'")
    grid = topics.period_grid(topics.scope_counts(c, "week"), "week").where("community = 'ALL'").orderBy("period").collect()
    assert len(grid) == 9 and grid[2].n_period == 0


def test_shares_hide_small_counts(spark):
    t = topics.share_series(counts(spark, [{1: 0.2, 2: 0.01}]), "week", 50).where("community = 'a'").collect()
    by = {r.topic_id: r for r in t}
    assert set(by) == {1, 2} and by[1].share == 0.2 and by[2].suppressed and by[2].n_total is None


def test_ewma(spark):
    s = spark.createDataFrame([("a", dt.date(2024, 1, 1 + i), float(x)) for i, x in enumerate([1, 1, 4])], "k string, day date, x double")
    got = topics.ewma(s, "k", "day", "x", 0.5).orderBy("day").collect()
    assert [r.ewma for r in got] == [1, 1, 2.5] and got[2].cusum_up == 2 and got[1].cusum_down == 2
