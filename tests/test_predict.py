import pytest
from pyspark.sql import functions as F

from tidewell import jobs
from tidewell.operators import evaluation as E, predict as P, quality as Q
from tidewell.operators.models import WordScorer
from tidewell.sources import lake, ledger, process


def parts(aggregate="mean"):
    lines = lambda text: F.split(text, "; ")
    stress = P.Part(("bad",), lines, P.by_scorer(WordScorer({"bad": ["bad"]})), P.tempered(1.0), aggregate)
    emotion = P.Part(("joy", "fear"), lines, P.by_scorer(WordScorer({"joy": ["fun"], "fear": ["afraid"]})))
    stressor = P.Part(("work", "money"), lines, P.by_scorer(WordScorer({"work": ["boss"], "money": ["rent"]})), together="max")
    return stress, emotion, stressor


TEXTS = [(1, "bad bad day"), (2, "a fun day"), (3, None), (4, "  "), (5, "!!"), (6, "[removed]"), (7, "bad boss; rent boss boss bad"), (8, "boss rent"), (9, "bad " * 6000)]


def run(spark, **more):
    stress, emotion, stressor = parts()
    df = spark.createDataFrame(TEXTS, "key long, t string")
    return {r.key: r for r in P.predict(df, "key", "t", stress, emotion, {"all": ["joy", "fear"]}, 0.7, stressor, {"work": 1.0, "money": 1.0}, **more).collect()}


def test_unified_output(spark):
    got = run(spark)
    assert [got[i].input_status for i in range(1, 10)] == ["ok", "ok", "none", "empty", "no_text", "empty_after_cleaning", "ok", "ok", "ok_truncated"]
    assert got[1].stress_flag and not got[2].stress_flag and got[3].stress_prob is None and got[3].stress_flag is None and got[3].stressor_top is None
    assert got[2].emotion_p__joy == got[2].emotion_group__all == 1 and got[7].n_chunks_stress == 2 and got[3].n_chunks_stress == 0
    assert got[7].stressor_top == "work" and got[7].stressor_flag__money  # both with margins, the greater one wins
    assert got[8].stressor_top == "none_unclear" and got[8].stressor_p__work == 1 and got[8].stressor_none_unclear  # the gate: not flagged
    assert run(spark, gate=False)[8].stressor_top == "work"


def test_two_stages(spark):
    got = run(spark, rate=0.0001)
    assert got[1].second_stage_scored and got[1].sample_weight == 1 and got[1].emotion_p__joy == 0
    assert not got[2].second_stage_scored and got[2].sample_weight is None and got[2].emotion_p__joy is None and got[2].stress_prob is not None
    assert not got[3].second_stage_scored
    assert all(got[i].second_stage_scored == (got[i].input_status in P.SCORED) for i in got) is False
    assert run(spark, rate=1.0)[2].sample_weight == 1
    with pytest.raises(ValueError):
        run(spark, rate=0.0)


def test_a_part_that_fails_gives_a_reason(spark):
    stress, emotion, _ = parts()
    nothing = P.Part(("bad",), lambda t: F.array().cast("array<string>"), stress.score)
    df = spark.createDataFrame([(1, "some text")], "key long, t string")
    r = P.predict(df, "key", "t", nothing, emotion, {}, 0.5).first()
    assert r.input_status == "error_chunking" and r.stress_prob is None


@pytest.mark.parametrize("how,want", [("mean", 1.0), ("max", 2.0), ("sum", 3.0), ("top2_mean", 1.5)])
def test_pieces_together(spark, how, want):
    part = P.Part(("n",), lambda t: F.split(t, ";"), lambda d: d.withColumn("n", F.regexp_count("piece", F.lit("x"))), together=how)
    df = spark.createDataFrame([(1, "x;xx;y")], "key long, t string")
    assert P.part_scores(df, "key", "t", part, "s_").first().s_n == want


def test_enrich_job_writes_each_date_once(spark, tmp_path):
    rows = [(f"r{i}", "s", "c", f"2024-01-0{1 + i % 2}", "bad boss today" if i % 3 else "a fine day") for i in range(12)]
    t = spark.createDataFrame(rows, "record_id string, source string, community string, at string, text_clean string").withColumn("created_at", F.to_timestamp("at"))
    root, out, marks, texts = (str(tmp_path / n) for n in ("lake", "enriched", "markers", "texts"))
    lake.write_lake(t, root)
    stress, emotion, _ = parts()
    predict = lambda day: P.predict(day, "record_id", "text_clean", stress, emotion, {}, 0.7)
    done = jobs.enrich_job(spark, root, out, marks, {"v": 1}, predict, texts)
    assert done == ["2024-01-01", "2024-01-02"] and jobs.enrich_job(spark, root, out, marks, {"v": 1}, predict) == []
    assert jobs.enrich_job(spark, root, out, marks, {"v": 2}, predict) == done
    enriched = lake.load_enriched(spark, out, ["record_id", "stress_prob"])
    assert enriched.count() == 12 and "text_clean" not in spark.read.parquet(out).columns and spark.read.parquet(texts).count() == 12
    assert lake.read_markers(marks)["2024-01-01"]["rows_scored"] == 6
    with pytest.raises(ValueError):
        lake.write_date(enriched, out, "2024-01-01", marks, {}, t, f"{out}/texts")


def test_ingest_job_accounts_for_every_row(spark, tmp_path):
    raw = spark.createDataFrame([("1", "c", "2024-01-01", "a text with more than five words in it"), ("2", "c", "2024-01-01", "short")], "record_id string, community string, at string, text_raw string").select("record_id", "community", F.to_timestamp("at").alias("created_at"), "text_raw")
    got = {r.reason: r.n for r in jobs.ingest_job(raw, "s", str(tmp_path / "lake"), ["record_id"]).collect()}
    assert got == {"kept": 1, "too_short": 1} and lake.read_lake(spark, str(tmp_path / "lake")).count() == 1


def test_bundles(tmp_path):
    for v, text in (("v1", "one"), ("v2", "two")):
        f = tmp_path / "stress" / v
        f.mkdir(parents=True)
        (f / "model.bin").write_text(text)
        ledger.write_manifest(f, note=v)
    assert ledger.pinned_version(tmp_path, "stress") == "v2" and ledger.pinned_version(tmp_path, "none") is None
    a, b = (ledger.load_bundle(tmp_path, {"stress": p}) for p in ("v1", "latest"))
    assert a["bundle_id"] != b["bundle_id"] and b["stress"]["version"] == "v2"
    (tmp_path / "stress" / "v2" / "model.bin").write_text("changed")
    with pytest.raises(ValueError):
        ledger.load_bundle(tmp_path, {"stress": "latest"})
    with pytest.raises(FileNotFoundError):
        ledger.pinned_version(tmp_path, "stress", "v9")


def test_external_process_is_aligned(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "ccc")], "k int, t string").coalesce(1)
    assert {r.k: r.answer for r in process.by_lines(df, "t", ["sed", "s/$/!/"], batch=2).collect()} == {1: "a b!", 2: "!", 3: "ccc!"}
    with pytest.raises(Exception, match="answered"):
        process.by_lines(df, "t", ["sed", "1d"]).collect()


def test_audits_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "short", "a long text of many words that no label would ever be"), (1, 0, "short", "a long text of many words that no label would ever be"), (2, 1, None, "another text which is also rather long for a column of codes")], "id int, flag int, code string, body string")
    g = Q.guess_text_and_label(df).first()
    assert (g.text_column, g.label_column) == ("body", "flag")
    r = Q.row_audit(df).first()
    assert (r.n, r.duplicate_rows, r.missing_total, r.all_numeric) == (3, 1, 1, False)
    assert [x.column for x in Q.free_text_columns(Q.tabular_audit(df)).collect()] == ["body"]
    kinds = Q.classify_header(["id", "post", "date", "author", "liwc_x", "misc"], frozenset({"author"}))
    assert kinds["other"] == ["misc"] and kinds["feature"] == ["liwc_x"] and kinds["text"] == ["post"] and kinds["author"] == ["author"]
    jobs.audit_job({"t": df}, "body", str(tmp_path / "audit.md"))
    assert "| body |" in (tmp_path / "audit.md").read_text() and (tmp_path / "audit-t-columns.csv").exists()


def test_thresholds_by_kind(spark):
    rows = [(i, "rare", "cosine", int(i == 0), 0.4 if i == 0 else 0.1) for i in range(40)] + [(i, "often", "cosine", int(i % 2), 0.6 if i % 2 else 0.2) for i in range(40)] + [(i, "all", "probability", 1, 0.9) for i in range(40)] + [(i, "n", "count", int(i % 4 == 0), 3.0 if i % 4 == 0 else 1.0) for i in range(40)]
    got = {r.label: r for r in E.tune_thresholds(spark.createDataFrame(rows, "id long, label string, kind string, y int, s double"), 5, 0.9).collect()}
    assert got["often"].rule == "tuned" and 0.2 < got["often"].applied <= 0.6 and got["n"].applied in (2.0, 3.0)
    assert got["rare"].rule == "default_cosine" and 0.2 < got["rare"].applied <= 0.6 and got["all"].rule == "degenerate_prevalence" and got["all"].applied == 0.5


def test_a_clear_gain_is_applied(spark):
    rows = [(i, int(i % 2 == 0), 0.4 if i % 2 == 0 else 0.1) for i in range(200)]
    draws = E.bootstrap_confusion(spark.createDataFrame(rows, "id long, y int, p double"), {"new": 0.3, "half": 0.5}, "id", replicates=20)
    g = E.paired_gain(draws, "f1", "new", "half")
    assert g.first().gain == 1 and E.decide_threshold(g, 0.3, 0.01).first().applied == 0.3 and E.decide_threshold(g, 0.3, 2.0).first().applied == 0.5
    assert E.decide_threshold(g, 0.5, 0.01).first().applied == 0.5


def test_calibration_by_label_and_final_report(spark):
    import math
    import random

    r = random.Random(3)
    rows = []
    for i in range(3000):
        for label, a, b in (("x", 0.5, 1.0), ("y", 2.0, -1.0)):
            z = r.gauss(0, 2)
            rows.append((i, label, int(r.random() < 1 / (1 + math.exp(-(a * z + b)))), z))
    long = spark.createDataFrame(rows, "id long, label string, y int, z double")
    got = E.fit_platt_by_label(long)
    assert got["x"] == pytest.approx((0.5, 1.0), abs=0.12) and got["y"] == pytest.approx((2.0, -1.0), abs=0.3)
    report, thresholds = E.multilabel_final(long.where("id % 2 = 0"), long.where("id % 2 = 1"), long.where("id < 100"))
    by = {x.way: x for x in report.collect()}
    assert set(by) == {"tuned", "half", "raw_half", "tuned_without_excluded"} and by["tuned"].f1_macro > 0.75 and by["tuned"].f1_macro >= by["raw_half"].f1_macro - 0.02
    assert thresholds.count() == 2


def test_temperature_and_platt_find_what_was_done(spark):
    import math
    import random

    from tidewell.operators import metrics as M

    r = random.Random(5)
    rows = [(z := r.gauss(0, 2), int(r.random() < 1 / (1 + math.exp(-z / 2)))) for _ in range(4000)]
    df = spark.createDataFrame(rows, "z double, y int")
    assert M.fit_temperature(df, "z", "y") == pytest.approx(2, rel=0.2) and M.fit_platt(df, "z", "y") == pytest.approx((0.5, 0), abs=0.1)


def test_classifier_keeps_no_ngrams(spark, monkeypatch):
    import random

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tidewell.operators import models
    from tidewell.sources import scratch

    tables, removed, real, remove = [], [], scratch.written, scratch.remove
    monkeypatch.setattr(scratch, "remove", removed.append)
    monkeypatch.setattr(scratch, "written", lambda df, name, **o: tables.append(real(df, name, **o)) or tables[-1])
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    rows = [(i, " ".join([*r.choices(words, k=60), *["bad" if i % 3 == 0 else "good"] * 20]), int(i % 3 == 0)) for i in range(300)] + [(300, None, 0), (301, "", 1)]
    df = spark.createDataFrame(rows, "id int, text string, y int")
    model, c, f1 = models.best_tfidf_classifier(df.where("id % 4 > 0"), df.where("id % 4 = 0"), "text", "y", (0.1, 10.0), 1 << 12)
    out = model.transform(models.with_ngrams(df, "text"))
    assert out.where("id < 300 and prediction = y").count() > 290 and f1[c] == max(f1.values())
    n = df.where("id % 4 > 0").select(F.size(models.char_ngrams(F.coalesce("text", F.lit("")))).alias("n")).agg(F.sum("n")).first()[0]
    assert sum(v for row in tables[0].collect() for i, v in zip(row.f.indices, row.f.values) if i >= 2 << 12) == n  # every n-gram counts
    for t in tables:  # no arrays of strings, and few rows in what a reader holds at once
        assert not any("array<string>" in kind for _, kind in t.dtypes)
        for path in t.inputFiles():
            meta = pq.ParquetFile(path.removeprefix("file://")).metadata
            assert all(meta.row_group(i).num_rows <= 64 for i in range(meta.num_row_groups))
    folder = tables[0].inputFiles()[0].rpartition("/")[0]
    assert removed == tables[:1] and scratch.exists(spark, folder)
    remove(tables[0])
    assert not scratch.exists(spark, folder)
