import re

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import ingest, quality, segment

STRINGS = ["Tom &amp; Jerry &amp;#x200B; café", "**bold** and *it* _em_ `code` ^(sup) \\* [a](http://x.org/b) ~~no~~", "mail me@x.org or u/someone, @other and +1 (555) 123-4567", "see https://a.b/c?d=e www.x.com example.com/path", "# Head\n> quote\n- item\n---\nend", "  ", "[removed] x [deleted]", "snake_case_name 2019 2020 2021 10 000 000", "<url> < URL >"]


def run(spark, *exprs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*STRINGS, None])], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_cleaning(spark):
    got = [r[0] for r in run(spark, T.clean_text(F.col("t")))]
    assert got[0] == "Tom & Jerry café" and got[1] == "bold and it em code sup * a <URL> no"
    assert got[2] == "mail or <USER>, <USER> and" and got[3] == "see <URL> <URL> <URL>" and got[4] == "Head quote item end"
    assert got[5] == got[9] == "" and got[6] == "x" and got[7] == "snake_case_name 2019 2020 2021 10 000 000" and got[8] == "<URL> <URL>"
    again = spark.createDataFrame([(g,) for g in got], "t string").select(T.clean_text(F.col("t"))).collect()
    assert [r[0] for r in again] == got
    assert not any(re.search(T.EMAIL, g) or "http" in g for g in got)


def test_keys_and_counts(spark):
    rows = run(spark, T.scrub_text(F.col("t")), T.token_estimate(F.col("t")))
    assert rows[2][0] == "mail <EMAIL> or <USER>, <USER> and <PHONE>" and rows[6][1] == 7
    k = spark.createDataFrame([("A b",), ("a   B ",), ("c",)], "t string").select(T.dedupe_key(F.col("t"))).collect()
    assert k[0] == k[1] != k[2]


def test_windows(spark):
    t = "Ok. My boss yelled at me again today. Rent is due!\nI can't sleep at all these days"
    df = spark.createDataFrame([(t,), ("",), (None,), ("Hi.",)], "t string")
    got = [r[0] for r in df.select(T.sentence_windows(F.col("t"), 1, 4)).collect()]
    assert got[0] == ["Ok. My boss yelled at me again today.", "Rent is due! I can't sleep at all these days"] and got[1] == [] and got[2] == [] and got[3] == ["Hi."]
    ten = spark.createDataFrame([(" ".join(f"Word{i} two three four." for i in range(10)),)], "t string")
    assert [w[:5] for w in ten.select(T.sentence_windows(F.col("t"), 1, 4, 4)).first()[0]] == ["Word0", "Word3", "Word6", "Word9"]
    assert len(ten.select(T.sentence_windows(F.col("t"), 3, 4)).first()[0]) == 4


@pytest.mark.parametrize("most,stride", [(8, 0), (8, 3), (20, 10), (5, 4)])
def test_chunks_cover_and_fit(most, stride):
    t = "One two three. Four five six seven! Eight nine ten eleven twelve thirteen fourteen fifteen sixteen. End?"
    spans = segment.chunk_spans(t, most, stride)
    assert all(n <= most for _, _, n in spans) and spans[0][0] == 0 and spans[-1][1] == len(t)
    words = {m.span() for m in re.finditer(r"\w+", t)}
    assert all(any(a <= x and y <= b for a, b, _ in spans) for x, y in words)
    assert all(a2 > a1 for (a1, *_), (a2, *_) in zip(spans, spans[1:]))


def test_every_row_has_its_reason(spark):
    long = "this is a text with more than five words"
    rows = [("1", "2024-01-01", long, "en"), ("2", "2024-01-01", long.upper(), "en"), ("3", None, long, "en"), ("4", "2023-01-01", long, "en"), ("5", "2024-01-01", "[removed]", "en"), ("6", "2024-01-01", "I am a bot and this is a reply", "en"), ("7", "2024-01-01", "too short", "en"), ("8", "2024-01-01", "dies ist ein Text mit vielen Worten", "de"), ("9", "2024-01-01", None, "en")]
    df = spark.createDataFrame(rows, "record_id string, at string, text_raw string, lang string").select("record_id", F.lit("c").alias("community"), F.to_timestamp("at").alias("created_at"), "text_raw", "lang")
    out = ingest.clean_and_filter(df, "s", ["record_id"], "2024-01-01", "2024-02-01")
    got = {r.record_id: r.drop_reason for r in out.collect()}
    assert got == {"1": None, "2": "duplicate", "3": "no_timestamp", "4": "out_of_range", "5": "empty", "6": "bot", "7": "too_short", "8": "non_english", "9": "empty"}
    quality.check_accounting(quality.drop_accounting(out), 9)


def test_status_ladder(spark):
    raw = F.col("t")
    df = spark.createDataFrame([(None, None), (" ", ""), ("[removed]", ""), ("!!1 <URL>", "!!1 <URL>"), ("fine text", "fine text"), ("a" * 20001, "a" * 20001)], "t string, c string")
    assert [r[0] for r in df.select(ingest.input_status(raw, F.col("c"))).collect()] == ["none", "empty", "empty_after_cleaning", "no_text", "ok", "ok_truncated"]


def test_keywords(spark):
    p = "(?U)" + T.keyword_pattern(["work*", "night shift"])
    df = spark.createDataFrame([("Working hard",), ("night\n shift",), ("homework",), ("nights",)], "t string")
    assert [r[0] for r in df.select(F.col("t").rlike(p)).collect()] == [True, True, False, False]


def test_both_ways_of_cleaning_agree(spark):
    """Built-in steps against the same steps in Python, on whole texts and pages."""
    for name, col in (("documents", "text"), ("pages", "html")):
        df = spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").select(col, T.clean_text(F.col(col)).alias("a"), T.clean_text(F.col(col), decode=False).alias("b"))
        for r in df.collect():
            assert r.a == T.clean_one(r[col])
            assert r.b == r.a or "&" in r[col]


def test_edits_are_counted_where_they_are_applied(spark):
    df = spark.createDataFrame([("[a](http://x.org) http://y.org &amp;lt; me@x.org **b** u/someone",), (None,), ("plain",)], "t string")
    got = [r.e.asDict() for r in df.select(T.edit_counts("t").alias("e")).collect()]
    assert {k: v for k, v in got[0].items() if v} == {"html_unescape": 2, "md_link": 1, "md_strong": 1, "email_removed": 1, "url": 1, "mention": 1, "url_placeholder": 2}  # a second pass sees the placeholders
    assert not any(got[1].values()) and not any(got[2].values())


def test_privacy_gate(spark):
    quality.check_records(spark.createDataFrame([("see <URL> and <USER>",)], "text_clean string"))
    for bad in ("see https://a.org/x", "me@x.org", "by u/someone", "www.x.com"):
        with pytest.raises(ValueError):
            quality.check_records(spark.createDataFrame([(bad,)], "text_clean string"))


def test_long_texts_are_chunked_in_proportion():
    import time

    start = time.process_time()
    spans = segment.chunk_spans("One two three four. " * 20_000, 64, 16)
    assert len(spans) > 1000 and time.process_time() - start < 20


def test_languages_by_frequent_words(spark):
    texts = ["The cat is on the mat and it was there for a day", "Der Hund ist in dem Haus und nicht auf der Straße", "Le chat est dans la maison et il ne sort pas", "El perro está en la casa y no sale por la noche", "", "xyzzy plugh", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.g for r in df.select("i", T.guess_language(F.col("t")).alias("g")).orderBy("i").collect()] == ["en", "de", "fr", "es", "und", "und", "und"]


def test_terms_are_masked(spark):
    df = spark.createDataFrame([("r/work and Work, homework; night shift/work",)], "t string")
    text, n = T.mask_terms(F.col("t"), ["work", "night shift"], "[X]")
    assert tuple(df.select(text, n).first()) == ("[X] and [X], homework; [X]/work", 3)


def test_models_that_run_out_of_memory_get_halves():
    from tidewell.operators.scoring import halved

    def score(texts):
        if len(texts) > 3:
            raise MemoryError
        return [[float(len(t))] for t in texts]

    assert halved(score, ["a" * i for i in range(10)]) == [[float(i)] for i in range(10)]
    with pytest.raises(MemoryError):
        halved(lambda _: (_ for _ in ()).throw(MemoryError), ["a"])


def test_input_status_equals_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from tidewell.plans.catalog import ORACLE_SQL, QUERIES

    texts = [None, "", "  ", "\u00a0\u2003", "\t\n", "https://www.example.com/", "[removed]", "<URL>", "a@b.com", "1 2 3", "ab", "\u200b", "&nbsp;", "-" * 20_001 + " words after that", "word " * 5000, "plain words"]
    spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate((t, g) for t in texts for g in ("en", "de", None))], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["input_status"](spark, str(tmp_path)).select("status", "n").collect()))
    assert got == sorted(con.execute(ORACLE_SQL["input_status"]).fetchall()) and sum(n for _, n in got) == 3 * len(texts)
