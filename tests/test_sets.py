import itertools
import random

from pyspark.sql import functions as F

from tidewell.functions.text import dedupe_key
from tidewell.operators import dedupe, metrics, sampling, scoring


def key(_):
    return dedupe_key(F.col("text"))


def test_first_and_conflicting(spark):
    df = spark.createDataFrame([(1, "A b", 1), (2, "a  B", 1), (3, "c", 0), (4, "c", 1), (5, "d", 0), (6, "e", None), (7, "e", 1)], "id long, text string, label int")
    assert {r.id for r in dedupe.keep_first(df, key(df), [F.col("id")]).collect()} == {1, 3, 5, 6}
    assert {r.id for r in dedupe.drop_conflicting(df, key(df), ["label"], [F.col("id")]).collect()} == {1, 5}
    assert {r.id for r in dedupe.without_matches(df, df.where("id in (2, 5)"), key).collect()} == {3, 4, 6, 7}
    assert {r.id for r in dedupe.overlap_flag(df, df.where("id = 1"), key).where("in_other").collect()} == {1, 2}


def test_near_duplicates(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(r.choices(words, k=40)) for _ in range(20)]
    texts += [t + " extra" for t in texts[:8]] + texts[:3] + ["short one", "short one", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def grams(t):
        w = t.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {t} if t else set()

    def near(a, b):
        x, y = grams(texts[a]), grams(texts[b])
        return bool(x and y) and len(x & y) / len(x | y) >= 0.9

    pairs = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if near(a, b)}
    got = {(p.a, p.b) for p in dedupe.similar_pairs(df, "id", 5, 0.9).collect()}
    assert got <= pairs
    gone, kept = set(), []
    for i in range(len(texts)):
        (gone.add(i) if any((k, i) in pairs for k in kept) else kept.append(i))
    assert {p.id for p in dedupe.greedy_near_duplicates(df, "id", 5, 0.9).collect()} == gone


def test_copies_of_a_dropped_text_go(spark):
    r = random.Random(2)
    z = " ".join(r.choices([f"w{i}" for i in range(200)], k=80))
    texts = [z, "other words that are like no text here", z + " extra", z + " extra", "Other  words that are like no text here", z + " extra"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert {p.id for p in dedupe.greedy_near_duplicates(df, "id", 5, 0.9).collect()} == {2, 3, 4, 5}


def test_containment(spark):
    corpus = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "d long, text string")
    q = spark.createDataFrame([(1, "b c d e f g h i j"), (2, "b c d e f g h x y z")], "q long, text string")
    assert [tuple(r) for r in dedupe.containment(q, corpus, "q", "d").collect()] == [(1, 1, 1.0)]
    assert [tuple(r) for r in dedupe.pooled_containment(q, corpus, "q").collect()] == [(1, 1.0)]


def test_samples_do_not_depend_on_order(spark):
    df = spark.range(3000).withColumn("c", F.col("id") % 3)
    a = {r.id for r in sampling.per_cell(df, ["c"], "id", 40).collect()}
    b = {r.id for r in sampling.per_cell(df.orderBy(F.desc("id")).repartition(7), ["c"], "id", 40).collect()}
    assert a == b and len(a) == 120
    split = sampling.group_split(df, "c", {"x": 0.5, "y": 0.5})
    assert split.groupBy("c").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    shares = {(r.c, r.split): r["count"] for r in sampling.stratified_split(df, "c", "id", {"train": 0.7, "test": 0.3}).groupBy("c", "split").count().collect()}
    assert all(abs(shares[c, "train"] - 700) <= 2 for c in range(3))
    cells = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1)], "name string, size long")
    got = {r.name: r.n_drawn for r in sampling.largest_remainder(cells, "name", "size", 30, 2).collect()}
    assert sum(got.values()) == 30 and got["c"] == 1 and got["b"] >= 2


def test_scores(spark):
    w = spark.createDataFrame([(0, 0.2), (0, 0.9), (0, 0.4), (1, 0.3), (2, 0.5), (2, 0.5)], "k long, s double")
    got = {r.k: r for r in scoring.window_scores(w, "k", "s").collect()}
    assert (got[0].max, round(got[0].top2_mean, 9)) == (0.9, 0.65) and got[1].top2_mean == 0.3 and got[2].top2_mean == 0.5
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "k long, v array<double>")
    cents = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 1.0])], "label int, c array<double>")
    assert {r.k: r.label for r in scoring.nearest(v, "k", "v", cents, 0.5).collect()} == {0: 10, 1: 10, 2: -1, 3: -1}


def test_metrics_against_plain_code(spark):
    r = random.Random(3)
    rows = [(r.random() < 0.4, round(r.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame([(int(y), p) for y, p in rows], "y int, p double")
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(df).first().roc_auc - auc) < 1e-12
    ap, tp, n = 0.0, 0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        at = [y for y, p in rows if p == t]
        tp, n = tp + sum(at), n + len(at)
        ap += sum(at) / len(pos) * tp / n
    assert abs(metrics.average_precision(df).first().average_precision - ap) < 1e-12
    assert metrics.roc_auc(df.where("y = 1")).first().roc_auc is None
    t = metrics.fit_temperature(df.withColumn("m", (F.col("y") * 2 - 1) * F.when(F.col("p") < 0.8, 2.0).otherwise(-2.0)), "m", "y")
    assert 0.05 < t < 20
    a, b = metrics.fit_platt(df.withColumn("m", F.col("p") * 4 - 2), "m", "y")
    assert a > 0


def test_samplers_lose_nothing(spark):
    same = spark.range(20_000).select(F.lit(7).alias("key"), (F.col("id") % 2).alias("cell"))
    assert sampling.per_cell(same, ["cell"], "key", 5).groupBy("cell").count().where("count = 5").count() == 2  # rows that share a key
    nulls = spark.range(100).select("id", F.when(F.col("id") % 2 == 0, "a").alias("s"))
    assert sampling.per_cell(nulls, ["s"], "id", 10).groupBy("s").count().where("count = 10").count() == 2
    split = sampling.stratified_split(nulls, "s", "id", {"train": 0.7, "test": 0.3})
    got = {(r.s, r.split): r["count"] for r in split.groupBy("s", "split").count().collect()}
    assert sum(got.values()) == 100 and got[None, "train"] == got["a", "train"] == 35 and split.columns == ["id", "s", "split"]
    masked = sampling.mask_words(spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "x"), (5, " ")], "k int, t string"), "k", "t", 2)
    out = {r.k: r.t for r in masked.collect()}
    assert out[2] is None and out[3] == "" and out[4] == "[MASK]" and out[5] == " " and out[1].count("[MASK]") == 2 and len(out) == 5


def test_stratified_split_equals_sql_beyond_the_sketch(spark, tmp_path):
    import duckdb

    from tidewell.plans.catalog import ORACLE_SQL, QUERIES

    kind = F.when(F.col("id") % 1000 == 999, None).when(F.col("id") < 7, "few").when(F.col("id") % 10 == 0, "some").otherwise("most")
    e = spark.range(700_000).select(F.when(F.col("id") % 5 == 4, F.lit(4)).when(F.col("id") == 11, None).otherwise(F.col("id")).alias("event_id"), kind.alias("event_type"))  # a fifth share one key
    e.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got, want = QUERIES["stratified_split"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL["stratified_split"]).df()
    by = ["event_type", "split", "event_id"]
    got, want = (x.fillna({"event_id": -1}).astype({"event_id": "int64"}).sort_values(by)[by].reset_index(drop=True) for x in (got, want))
    assert len(got) == 699_300 and got.equals(want)
