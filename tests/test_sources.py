import datetime as dt
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from tidewell.operators import quality
from tidewell.sources import adapters, lake, ledger
from tidewell.streaming import cells


def post(i, **kw):
    return json.dumps({"id": f"p{i}", "subreddit": "Calm", "created_utc": 1577836800 + i, "title": "T", "selftext": f"body {i}", "author": "x"} | kw)


LINES = [post(1), post(2, created_utc="1577836802"), "{broken", "[1]", post(3, subreddit="other"), post(4, created_utc=None), post(5, created_utc=9), post(6, author="AutoModerator"), post(7, removed_by_category="moderator"), post(8, selftext=None), post(9, selftext=" [Removed] "), post(10, selftext="  "), post(11, id=""), "", post(12, title=None)]
REASONS = {"kept": 3, "malformed_json": 2, "not_in_communities": 1, "missing_timestamp": 1, "outside_date_range": 1, "bot_account": 1, "removed_post": 1, "missing_field": 2, "removed_or_deleted": 1, "empty_selftext": 1}


@pytest.mark.parametrize("packed", [False, True])
def test_submissions_account_for_every_line(spark, tmp_path, packed):
    path = tmp_path / ("a.zst" if packed else "a.ndjson")
    data = "\n".join(LINES).encode()
    path.write_bytes(zstandard.ZstdCompressor().compress(data) if packed else data)
    t = adapters.submissions(adapters.json_lines(spark, [str(path)]), ["calm"], 1577836800, 1577836800 + 10**6, ["automoderator"])
    assert {r.reason: r.n for r in quality.drop_accounting(t).collect()} == REASONS
    assert not adapters.author_columns(t.columns)
    kept = t.where("drop_reason is null").orderBy("created_at").collect()
    assert kept[0].text_raw == "T\n\nbody 1" and kept[2].text_raw == "body 12" and kept[0].created_at == dt.datetime(2020, 1, 1, 0, 0, 1)


def test_csv_adapters(spark, tmp_path):
    (tmp_path / "pre.csv").write_text('subreddit,author,date,post,feat\nA,x,2020/01/02,"two\nlines ""q""",1\nA,x,bad,p,2\n')
    t = adapters.pilot_csv(spark, [str(tmp_path / "pre.csv")], ["pre.csv"]).orderBy("text_raw").collect()
    assert [r.text_raw for r in t] == ["p", 'two\nlines "q"'] and t[0].created_at is None and t[1].file_order == 0
    (tmp_path / "g.csv").write_text("id,c,t,when,author\n1,X,hello,1577836800000,z\n")
    g = adapters.generic(spark, [str(tmp_path / "g.csv")], "csv", {"id": "id", "community": "c", "created": "when", "text": "t"}, "epoch_ms").first()
    assert (g.community, g.text_raw, g.created_at) == ("x", "hello", dt.datetime(2020, 1, 1))
    with pytest.raises(ValueError):
        adapters.generic(spark, [], "csv", {"text": "author", "created": "when"})


def test_lake(spark, tmp_path):
    rows = [(f"r{i}", "s", "c", dt.datetime(2024, 1 + i % 2, 5, 1), "t", 1, 1, "en") for i in range(40)]
    df = spark.createDataFrame(rows, lake.LAKE)
    lake.write_lake(df, str(tmp_path / "lake"))
    lake.compact_lake(spark, str(tmp_path / "lake"), str(tmp_path / "small"))
    t = lake.read_lake(spark, str(tmp_path / "small"))
    assert t.count() == 40 and lake.read_day(t, "2024-01-05").count() == 20 and lake.manifest(spark, str(tmp_path / "small")).agg(F.sum("rows")).first()[0] == 40
    e = t.select("record_id", "source", F.to_date("created_at").alias("date"), F.lit("ok").alias("input_status"), F.lit(0.5).alias("emotion_p__joy"))
    lake.write_enriched(e, str(tmp_path / "e"))
    lake.write_enriched(e.where("date = date'2024-01-05'").limit(3), str(tmp_path / "e"))
    got = lake.load_enriched(spark, str(tmp_path / "e"), ["date"], ["emotion_p__"])
    assert got.count() == 23 and set(got.columns) == {"date", "emotion_p__joy"}
    with pytest.raises(ValueError):
        lake.write_gold(t.select("record_id"), str(tmp_path / "g"), 50)


def test_ledger(tmp_path):
    log, ran = ledger.Ledger(tmp_path / "l.jsonl"), []
    for force in (False, False, True):
        log.run("a", lambda: ran.append(1), force=force)
    with pytest.raises(ZeroDivisionError):
        log.run("b", lambda: 1 / 0)
    assert len(ran) == 2 and log.latest("b")["event"] == "failed"
    log.run("a", lambda: ran.append(1), fingerprint="new data")
    assert len(ran) == 3
    now = [("a", 1, 1.0), ("b", 2, 1.0), ("c", 3, 1.0)]
    assert ledger.changed_inputs(now, {"a": [1, 1.0], "b": [9, 1.0], "c": [3, 1.0]}) == ["b", "c"]
    split = ledger.lock_split(tmp_path / "s.json", {"train": ["1", "2"], "test": ["3"]})
    assert ledger.lock_split(tmp_path / "s.json", {"train": ["1"], "test": ["3", "2"]}) == split
    with pytest.raises(ValueError):
        ledger.lock_split(tmp_path / "s.json", {"train": ["9"], "test": ["3"]})


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    shape = lambda d: d.select(F.col("ts").cast("timestamp").alias("date"), F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("string").alias("community"), (F.col("value") >= 50).alias("stress_flag"), (F.col("value") / 99).alias("stress_prob"))
    got = cells.run_once(cells.rate_stream(shape(stream)), "cells", str(tmp_path / "c"))
    from tidewell.operators.rates import rate_cells

    want = rate_cells(shape(e), "week").where("level = 0")
    pick = lambda d: {(r.period, r.source, r.community): (r.n_total, r.n_stress) for r in d.collect()}
    assert pick(got) == pick(want)


def workbook(path, rows):
    """A workbook as a spreadsheet writes it: shared strings, numbers, a gap, an inline string."""
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared, cells = [], []
    for i, row in enumerate(rows, 1):
        out = []
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, str) and v.startswith("inline"):
                out.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                out.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                out.append(f'<c r="{at}"><v>{v}</v></c>')
        cells.append(f'<row r="{i}">{"".join(out)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    from tidewell.sources.xlsx import read_xlsx

    path = str(tmp_path / "a.xlsx")
    workbook(path, [["sID", "sentence", "label"], [1, "a text", "x"], [2, None, "inline y"], [3.5, "é &amp; z"]])
    assert [tuple(r) for r in read_xlsx(spark, path).collect()] == [("1", "a text", "x"), ("2", None, "inline y"), ("3.5", "é & z", None)]
    with pytest.raises(ValueError):
        workbook(path, [["a", "a"]])
        read_xlsx(spark, path)


def test_sources_are_ordered(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / f"{n}.txt").write_text(n)
    s = adapters.Source([str(tmp_path / "b.txt"), str(tmp_path / "a.txt")], lambda spark, p: spark.read.text(p))
    assert [(r.value, r.file_order) for r in s.rows(spark).orderBy("file_order").collect()] == [("b", 0), ("a", 1)] and len(s.inputs()) == 2
    with pytest.raises(FileNotFoundError):
        adapters.Source([], None)
    with pytest.raises(FileNotFoundError):
        adapters.json_lines(spark, [])


def test_enriched_types_by_name():
    got = adapters.schema_from_names(["record_id", "date", "created_at", "inference_ts", "stress_flag", "stressor_none_unclear", "stressor_flag__work", "stressor_top", "n_chunks_stress", "tension_relaxation", "sample_weight", "emotion_p__joy", "stressor_cos__work", "stress_version"])
    kinds = dict(x.split(" ") for x in got.replace("`", "").split(", "))
    assert kinds == {"record_id": "string", "date": "date", "created_at": "timestamp", "inference_ts": "timestamp", "stress_flag": "boolean", "stressor_none_unclear": "boolean", "stressor_flag__work": "boolean", "stressor_top": "string", "n_chunks_stress": "int", "tension_relaxation": "double", "sample_weight": "double", "emotion_p__joy": "double", "stressor_cos__work": "double", "stress_version": "string"}


def test_manifests_have_digests(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "t"))
    got = lake.manifest(spark, str(tmp_path / "t"), digests=True).collect()
    assert len(got) == 3 and sum(r.rows for r in got) == 30
    assert all(r.sha256 == ledger.file_digest(r.file.split(":", 1)[1].replace("///", "/")) for r in got)
