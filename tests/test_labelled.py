import pytest
from pyspark.sql import functions as F

from tidewell.operators import labelled as L, sampling

ROWS = [(1, "a b", 1, "train", "p1"), (2, "A  b", 1, "train", "p1"), (3, "c", 0, "train", "p2"), (4, "c", 1, "train", "p2"), (5, "d", 0, "train", "p3"), (6, "", 0, "train", "p3"), (7, "D", 1, "test", "p4"), (8, "e", 0, "test", "p5"), (9, "e", 1, "test", "p5")]


def frame(spark):
    return spark.createDataFrame(ROWS, "record_id long, text_clean string, label int, official_split string, post_id string")


def test_binary_set(spark):
    steps = L.Steps()
    got = {r.record_id: r.split for r in L.binary_set(frame(spark), "label", "post_id", steps, ["record_id"]).collect()}
    assert got.keys() == {1, 7, 8, 9} and got[7] == got[8] == got[9] == "test" and got[1] != "test"
    assert [(r.step, r.rows, r.dropped) for r in steps.table().orderBy("place").collect()] == [("loaded", 9, 0), ("not_empty", 8, 1), ("train_text_once", 5, 3), ("train_text_not_in_test", 4, 1)]


def test_finalised_columns_and_privacy(spark):
    out = L.finalised(frame(spark), ["label"])
    assert out.columns == [*L.UNIFIED, "label"] and out.where("record_id = 1").first().n_chars == 3
    with pytest.raises(ValueError):
        L.finalised(frame(spark).withColumn("text_clean", F.lit("mail me@x.org")), ["label"])


def test_label_matrices(spark):
    df = spark.createDataFrame([(1, "0,2"), (2, "1"), (3, " x"), (4, "9"), (5, None)], "record_id long, raw string").select("record_id", L.label_ids(F.col("raw")).alias("labels"))
    assert [list(r[0]) for r in df.where("record_id < 3").orderBy("record_id").select(L.multi_hot(F.col("labels"), 3)).collect()] == [[1, 0, 1], [0, 1, 0]]
    L.check_labels(df.where("record_id < 3"), "labels", 3)
    for bad in (3, 4, 5):
        with pytest.raises(ValueError):
            L.check_labels(df.where(F.col("record_id") == bad), "labels", 3)


def test_mappings_are_checked_as_a_whole(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    L.check_mapping(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "label string, category string"), labels)
    with pytest.raises(ValueError, match="b: duplicated; z: unknown; c: unmapped"):
        L.check_mapping(spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("z", "y")], "label string, category string"), labels)


def test_gold_sample_is_one_a_post(spark):
    df = spark.range(300).select(F.col("id").alias("record_id"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("community"), F.floor(F.col("id") / 3).alias("post_id"))
    got = L.gold_sample(df, 40, 3).collect()
    assert len(got) == 40 and len({r.post_id for r in got}) == 40 and sorted(r.place for r in got) == list(range(1, 41)) and {r.gold_split for r in got} == {"dev", "test"}


def test_pilot_set_keeps_the_earliest(spark):
    file = lambda rows: spark.createDataFrame(rows, "record_id string, created_at string, text_clean string, drop_reason string").withColumn("created_at", F.to_timestamp("created_at"))
    a, b = file([("a1", "2024-01-02", "same", None), ("a2", "2024-01-01", "gone", "bot")]), file([("b1", "2024-01-01", "same", None), ("b2", "2024-01-02", "Same", None)])
    assert [r.record_id for r in L.pilot_set([a, b], L.Steps()).collect()] == ["b1"]
    c = file([("c1", "2024-01-01", "same", None)])
    assert [r.record_id for r in L.pilot_set([c, b], L.Steps()).collect()] == ["c1"]  # ties go to the earlier file


def test_sheets(spark):
    df = spark.createDataFrame([("g1", " X", "", ""), ("g2", "0", "maybe", "1"), ("g3", "yes", "1.0", "y"), ("g4", None, None, None)], "id string, a string, b string, none string")
    got = {r.id: r for r in L.sheet_labels(df, "id", ["a", "b"], "none").collect()}
    assert got["g1"].a == 1 and got["g1"].annotated and not got["g1"].problems
    assert got["g2"].problems == ["b=maybe"] and got["g2"].none == 1 and got["g3"].problems == ["none beside a category"] and not got["g4"].annotated


def test_partitions_are_checked(spark):
    df = spark.range(4).select(F.col("id").alias("record_id"))
    whole = df.withColumn("split", F.lit("a"))
    sampling.check_partition(df, whole)
    for bad in (whole.where("record_id > 0"), whole.unionByName(whole.limit(1)), whole.unionByName(whole.limit(1).withColumn("record_id", F.lit(9).cast("long")))):
        with pytest.raises(ValueError):
            sampling.check_partition(df, bad)


def test_months_count_whole(spark):
    for start, end, want in (("2024-01", "2024-02", ("2024-01-01", "2024-03-01")), ("2024-01-05", "2024-02-09", ("2024-01-05", "2024-02-09"))):
        assert tuple(map(str, spark.range(1).select(*L.date_range(start, end)).first())) == want


def test_splits_are_locked(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("record_id"), (F.col("id") % 3).alias("c"))
    make = lambda t: sampling.stratified_split(t, "c", "record_id", {"train": 0.7, "test": 0.3})
    path = str(tmp_path / "split")
    first = {tuple(r) for r in L.locked_split(df, path, make).collect()}
    assert {tuple(r) for r in L.locked_split(df, path, lambda t: 1 / 0).collect()} == first and len(first) == 30
    fewer = df.where("record_id > 4")
    with pytest.raises(ValueError):
        L.locked_split(fewer, path, make)
    assert L.locked_split(fewer, path, make, force=True).count() == 25 and spark.read.parquet(path + ".old").count() == 30
    with pytest.raises(ValueError):
        L.locked_split(df, str(tmp_path / "bad"), lambda t: make(t).where("record_id > 0"))


def test_texts_are_encoded_once(spark, tmp_path):
    from tidewell.operators.vectors import cached_vectors, pooled

    seen = []

    def encode(t):
        rows = t.collect()
        seen.append(sorted(r.text for r in rows))
        return spark.createDataFrame([(r.digest, r.text, [float(len(r.text)), 1.0]) for r in rows], "digest string, text string, vector array<double>")

    path = str(tmp_path / "vectors")
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "k int, t string")
    assert {r.k: list(r.vector) for r in cached_vectors(df, "k", "t", "m", encode, path).collect()} == {1: [1, 1], 2: [2, 1], 3: [1, 1]}
    more = df.unionByName(spark.createDataFrame([(5, "ccc")], "k int, t string"))
    assert cached_vectors(more, "k", "t", "m", encode, path).count() == 4 and seen == [["a", "bb"], ["ccc"]]
    v = spark.createDataFrame([(1, [[3.0, 0.0], [3.0, 8.0]]), (2, [])], "k int, v array<array<double>>")
    got = {r.k: (r.m, r.c) for r in v.select("k", pooled(F.col("v")).alias("m"), pooled(F.col("v"), "cls", False).alias("c")).collect()}
    assert got[1] == ([0.6, 0.8], [3.0, 0.0]) and got[2] == (None, None)
