"""Builds, checks and samples of labelled sets over documents and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import labelled as L
from tidewell.plans.registry import hash_sql, query, table
from tidewell.plans.set_queries import KEY

_BASE = f"""lb AS (SELECT doc_id AS record_id, source AS community, lang, text, {KEY} AS k, quality, toxic, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS own_split,
    CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS official_split, doc_id // 3 AS post_id, n_chars / (n_chars + 2000.0e0) AS p FROM documents JOIN labels USING (doc_id))"""
_U = hash_sql("record_id", "42")


def _labelled(spark, sf_dir):
    """documents with labels as records of a labelled set."""
    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    split = F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train")
    own = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "validation").otherwise("train")
    return t.select(F.col("doc_id").alias("record_id"), F.col("source").alias("community"), "lang", F.col("text").alias("text_clean"), "quality", "toxic", own.alias("own_split"), split.alias("official_split"), F.floor(F.col("doc_id") / 3).alias("post_id"), (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("p"))


_TRAIN = f"""{_BASE}, tr AS (SELECT * FROM lb WHERE official_split = 'train' AND length(text) > 0), te AS (SELECT * FROM lb WHERE official_split = 'test' AND length(text) > 0),
g AS (SELECT min(record_id) AS record_id FROM tr GROUP BY k HAVING count(DISTINCT toxic) = 1), once AS (SELECT * FROM tr WHERE record_id IN (SELECT record_id FROM g)), clean AS (SELECT * FROM once WHERE k NOT IN (SELECT k FROM te))"""


@query("binary_set", f"WITH {_TRAIN} SELECT record_id, toxic, CASE WHEN {hash_sql('post_id', '42')} < 0.85e0 THEN 'train' ELSE 'validation' END AS split FROM clean UNION ALL SELECT record_id, toxic, 'test' FROM te")
def binary_set(spark, sf_dir):
    return L.binary_set(_labelled(spark, sf_dir), "toxic", "post_id", L.Steps(), ["record_id"]).select("record_id", "toxic", "split")


@query(
    "binary_set_steps",
    f"""WITH {_TRAIN}, t AS (SELECT count(*) AS n FROM te), s AS (SELECT 0 AS place, 'loaded' AS step, count(*) AS rows FROM lb UNION ALL SELECT 1, 'not_empty', (SELECT count(*) FROM tr) + n FROM t
    UNION ALL SELECT 2, 'train_text_once', (SELECT count(*) FROM once) + n FROM t UNION ALL SELECT 3, 'train_text_not_in_test', (SELECT count(*) FROM clean) + n FROM t)
    SELECT *, coalesce(lag(rows) OVER (ORDER BY place) - rows, 0) AS dropped FROM s""",
)
def binary_set_steps(spark, sf_dir):
    steps = L.Steps()
    L.binary_set(_labelled(spark, sf_dir), "toxic", "post_id", steps, ["record_id"])
    return steps.table()


@query("multilabel_set", f"WITH {_BASE} SELECT record_id, own_split AS split, CASE WHEN quality = 0 THEN 1 ELSE 0 END || CAST(quality AS VARCHAR) || CASE WHEN toxic = 0 THEN '10' ELSE '01' END AS hot FROM lb WHERE length(text) > 0")
def multilabel_set(spark, sf_dir):
    raw = F.concat_ws(",", F.col("quality").cast("string"), (F.col("toxic") + 2).cast("string"), F.lit("x"))
    t = L.multilabel_set(_labelled(spark, sf_dir).withColumn("raw", raw), "raw", L.Steps(), "own_split")
    L.check_labels(t, "labels", 4)
    return t.select("record_id", "split", F.array_join(F.transform(L.multi_hot(F.col("labels"), 4), lambda x: x.cast("string")), "").alias("hot"))


@query("cross_split_shared", f"WITH {_BASE}, s AS (SELECT DISTINCT own_split AS s, k FROM lb) SELECT x.s AS a, y.s AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.s < y.s GROUP BY ALL")
def cross_split_shared(spark, sf_dir):
    return L.cross_split_shared(_labelled(spark, sf_dir), "own_split")


@query("stressor_set", f"WITH {_BASE}, g AS (SELECT min(record_id) AS record_id FROM lb WHERE length(text) > 0 GROUP BY k HAVING count(DISTINCT quality * 2 + toxic) = 1) SELECT record_id, quality, toxic, community FROM lb WHERE record_id IN (SELECT record_id FROM g)")
def stressor_set(spark, sf_dir):
    return L.stressor_set(_labelled(spark, sf_dir), ["quality", "toxic", "community", "not_there"], ["quality", "toxic"], L.Steps(), ["record_id"]).drop("text_clean")


_FILES = f"""f AS (SELECT doc_id AS record_id, text, {KEY} AS k, DATE '2024-01-01' + CAST(doc_id % 7 AS INTEGER) AS created_at, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS file_order, CASE WHEN length(text) < 40 THEN 'too_short' END AS r FROM documents)"""


@query("pilot_set", f"WITH {_FILES} SELECT record_id, file_order FROM f WHERE r IS NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY created_at, file_order, record_id) = 1")
def pilot_set(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    f = d.select(F.col("doc_id").alias("record_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int")).cast("timestamp").alias("created_at"), F.col("text").alias("text_clean"), F.when(F.char_length("text") < 40, "too_short").alias("drop_reason"))
    return L.pilot_set([f.where("record_id % 2 = 0"), f.where("record_id % 2 = 1")], L.Steps()).select("record_id", "file_order")


_GRAM = "list_distinct(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda j: array_to_string(w[j:j + 7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"
_WORDS = "list_filter(string_split_regex(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), lambda x: x <> '')"


@query(
    "cross_platform_set",
    f"""WITH {_BASE}, own AS (SELECT record_id, lang AS file, CASE WHEN lang = 'en' THEN 'reddit' ELSE 'twitter' END AS platform, text, k, toxic AS label FROM lb WHERE length(text) > 0),
    g AS (SELECT min(record_id) AS record_id FROM own GROUP BY file, k HAVING count(DISTINCT label) = 1), o AS (SELECT item_id, text, {KEY} AS k FROM benchmark),
    a AS (SELECT * FROM own WHERE record_id IN (SELECT record_id FROM g) AND k NOT IN (SELECT k FROM o)),
    q AS (SELECT item_id, len(g) AS n_q, unnest(g) AS g FROM (SELECT item_id, {_GRAM} AS g FROM (SELECT item_id, {_WORDS} AS w FROM o))), d AS (SELECT record_id, unnest(g) AS g FROM (SELECT record_id, {_GRAM} AS g FROM (SELECT record_id, {_WORDS} AS w FROM a WHERE platform = 'reddit'))),
    h AS (SELECT DISTINCT record_id FROM (SELECT item_id, record_id, count(*) AS c, max(n_q) AS n_q FROM q JOIN d USING (g) GROUP BY ALL) WHERE c >= 0.8e0 * n_q)
    SELECT record_id, file, platform, label FROM a WHERE record_id NOT IN (SELECT record_id FROM h)""",
)
def cross_platform_set(spark, sf_dir):
    t = _labelled(spark, sf_dir).select("record_id", F.col("lang").alias("file"), F.when(F.col("lang") == "en", "reddit").otherwise("twitter").alias("platform"), "text_clean", F.col("toxic").alias("label"))
    others = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("record_id"), F.col("text").alias("text_clean"))
    return L.cross_platform_set(t, others, L.Steps(), ["record_id"]).drop("text_clean")


@query("platform_recheck", f"WITH {_BASE}, g AS (SELECT lang AS platform, k, count(*) AS n, count(DISTINCT toxic) AS l FROM lb GROUP BY ALL) SELECT platform, count(*) AS n_texts, count(*) FILTER (WHERE l > 1) AS n_conflicting, count(*) FILTER (WHERE n > 1) AS n_duplicated FROM g GROUP BY platform")
def platform_recheck(spark, sf_dir):
    return L.platform_recheck(_labelled(spark, sf_dir).select(F.col("lang").alias("platform"), "text_clean", F.col("toxic").alias("label")))


@query(
    "overlap_sidecar",
    f"""WITH {_BASE}, h AS (SELECT k, bool_or(own_split = 'train') AS a, bool_or(own_split = 'validation') AS b, bool_or(own_split = 'test') AS c FROM lb GROUP BY k)
    SELECT record_id, own_split AS split, a AND own_split <> 'train' AS text_in_train, b AND own_split <> 'validation' AS text_in_validation, c AND own_split <> 'test' AS text_in_test, own_split = 'test' AND (a OR b) AS exclude_for_test_sensitivity FROM lb JOIN h USING (k)""",
)
def overlap_sidecar(spark, sf_dir):
    return L.overlap_sidecar(_labelled(spark, sf_dir).withColumnRenamed("own_split", "split"), ["train", "validation", "test"])


@query("leave_one_out", f"WITH {_BASE} SELECT record_id, CASE WHEN community = 'src3' THEN 'test' ELSE own_split END AS split FROM lb WHERE community = 'src3' OR own_split <> 'test'")
def leave_one_out(spark, sf_dir):
    return L.leave_one_out(_labelled(spark, sf_dir), "community", "src3", "own_split").select("record_id", F.col("own_split").alias("split"))


@query("high_confidence", f"WITH {_BASE} SELECT record_id, s.split FROM lb LEFT JOIN (SELECT doc_id AS record_id, 'saved' AS split FROM documents WHERE doc_id % 2 = 0) s USING (record_id) WHERE p >= 0.4e0")
def high_confidence(spark, sf_dir):
    saved = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("record_id"), F.lit("saved").alias("split"))
    return L.attach_split(L.high_confidence(_labelled(spark, sf_dir), "p", 0.4), saved).select("record_id", "split")


#: Fixed values of the test: a map that leaves a label out, maps one twice and knows one too many.
_MAP = [("en", "west/english"), ("de", "west/german"), ("fr", "romance"), ("fr", "west/other"), ("xx", "none")]
_MAPSQL = "mp AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _MAP) + ") v(label, class))"


@query("mapping_problems", f"WITH {_MAPSQL}, l AS (SELECT DISTINCT lang AS label FROM documents), m AS (SELECT label, count(*) AS n FROM mp GROUP BY label), j AS (SELECT coalesce(m.label, l.label) AS label, CASE WHEN l.label IS NULL THEN 'unknown' WHEN n IS NULL THEN 'unmapped' WHEN n > 1 THEN 'duplicated' END AS problem FROM l FULL JOIN m ON l.label = m.label) SELECT * FROM j WHERE problem IS NOT NULL")
def mapping_problems(spark, sf_dir):
    return L.mapping_problems(spark.createDataFrame(_MAP, "label string, class string"), table(spark, sf_dir, "documents").select(F.col("lang").alias("label")))


@query("mapping_table", f"WITH {_MAPSQL}, n AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang) SELECT label, class, split_part(class, '/', 1) AS category, nullif(split_part(class, '/', 2), '') AS sub, coalesce(n, 0) AS n FROM mp LEFT JOIN n USING (label)")
def mapping_table(spark, sf_dir):
    return L.mapping_table(spark.createDataFrame(_MAP, "label string, class string"), table(spark, sf_dir, "documents"), "lang")


@query(
    "gold_sample",
    f"""WITH {_BASE}, one AS (SELECT * FROM (SELECT *, {_U} AS u FROM lb) QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY u, record_id) = 1), c AS (SELECT community AS name, count(*) AS size FROM one GROUP BY community), b AS (SELECT *, least(size, 2) AS base FROM c),
    q AS (SELECT *, least(coalesce(greatest(60 - sum(base) OVER (), 0) * CAST(size - base AS DOUBLE) / nullif(CAST(sum(size - base) OVER () AS DOUBLE), 0), 0), size - base) AS quota, least(60 - sum(base) OVER (), sum(size - base) OVER ()) AS lft FROM b),
    w AS (SELECT *, floor(quota) AS whole FROM q), r AS (SELECT *, lft - sum(whole) OVER () AS more, row_number() OVER (ORDER BY round(quota - whole, 9) DESC, name) AS rk FROM w),
    n AS (SELECT name AS community, base + whole + CASE WHEN rk <= more AND base + whole < size THEN 1 ELSE 0 END AS n_drawn FROM r),
    d AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY u, record_id) AS rank FROM one JOIN n USING (community))
    SELECT record_id, community, CASE WHEN rank <= round(n_drawn * 0.5e0) THEN 'dev' ELSE 'test' END AS gold_split, row_number() OVER (ORDER BY u, record_id) AS place FROM d WHERE rank <= n_drawn""",
)
def gold_sample(spark, sf_dir):
    return L.gold_sample(_labelled(spark, sf_dir), 60, 2).select("record_id", "community", "gold_split", "place")


@query("sample_with_text", f"WITH {_BASE}, s AS (SELECT record_id FROM lb WHERE toxic = 1 ORDER BY {_U}, record_id LIMIT 25) SELECT record_id, text AS text_clean FROM lb JOIN s USING (record_id)")
def sample_with_text(spark, sf_dir):
    t = _labelled(spark, sf_dir)
    return L.sample_with_text(t.select("record_id", (F.col("toxic") == 1).alias("flag")), t.select("record_id", "text_clean"), "flag", 25).select("record_id", "text_clean")


@query("texts_of_flagged", f"WITH {_BASE} SELECT doc_id AS record_id FROM documents WHERE doc_id IN (SELECT record_id FROM lb WHERE toxic = 1)")
def texts_of_flagged(spark, sf_dir):
    records = _labelled(spark, sf_dir).select("record_id", (F.col("toxic") == 1).alias("flag"))
    return L.texts_of_flagged(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text"), records, "flag").select("record_id")


@query("assignments_with_meta", "WITH a AS (SELECT event_id, CAST(user_id % 6 AS INTEGER) AS topic_id FROM events WHERE event_id % 3 > 0) SELECT CAST(ts AS DATE) AS date, event_type AS community, topic_id, count(*) AS n FROM a JOIN events USING (event_id) GROUP BY ALL")
def assignments_with_meta(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("ts").alias("date"), F.col("event_type").alias("community"), "user_id")
    return L.with_meta(e.where("record_id % 3 > 0").select("record_id", (F.col("user_id") % 6).cast("int").alias("topic_id")), e)


@query("date_range", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE ts >= DATE '2024-01-10' AND ts < DATE '2024-02-01' GROUP BY 1")
def date_range(spark, sf_dir):
    lo, hi = L.date_range("2024-01-10", "2024-01")
    return table(spark, sf_dir, "events").where((F.col("ts") >= lo) & (F.col("ts") < hi)).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


_SHEET = f"{_BASE}, sh AS (SELECT record_id, own_split, CASE WHEN toxic = 1 THEN ' X ' WHEN record_id % 5 = 0 THEN '1.0' END AS work, CASE WHEN quality = 0 THEN 'yes' WHEN record_id % 11 = 0 THEN 'maybe' ELSE '0' END AS money, CASE WHEN record_id % 4 = 0 THEN '1' ELSE '' END AS none_unclear FROM lb)"
_ONE = "CASE WHEN lower(trim(coalesce({c}, ''))) IN ('1', '1.0', 'x', 'y', 'yes') THEN 1 ELSE 0 END"
_READ = f"{_SHEET}, lab AS (SELECT record_id, own_split, {_ONE.format(c='work')} AS work, {_ONE.format(c='money')} AS money, {_ONE.format(c='none_unclear')} AS none_unclear, CASE WHEN money = 'maybe' THEN 1 ELSE 0 END AS odd FROM sh), st AS (SELECT *, work + money + none_unclear > 0 AS annotated, odd + CASE WHEN none_unclear = 1 AND work + money > 0 THEN 1 ELSE 0 END AS n_problems FROM lab)"


def _sheet(spark, sf_dir):
    work = F.when(F.col("toxic") == 1, " X ").when(F.col("record_id") % 5 == 0, "1.0")
    money = F.when(F.col("quality") == 0, "yes").when(F.col("record_id") % 11 == 0, "maybe").otherwise("0")
    return _labelled(spark, sf_dir).select("record_id", "own_split", work.alias("work"), money.alias("money"), F.when(F.col("record_id") % 4 == 0, "1").otherwise("").alias("none_unclear"))


@query("sheet_labels", f"WITH {_READ} SELECT record_id, work, money, none_unclear, annotated, CAST(n_problems AS INTEGER) AS n_problems FROM st")
def sheet_labels(spark, sf_dir):
    return L.sheet_labels(_sheet(spark, sf_dir), "record_id", ["work", "money"], "none_unclear").select("record_id", "work", "money", "none_unclear", "annotated", F.size("problems").alias("n_problems"))


@query("sheet_status", f"WITH {_READ} SELECT own_split, count(*) AS rows, count(*) FILTER (WHERE annotated) AS annotated, CAST(sum(n_problems) AS BIGINT) AS n_problems, count(*) FILTER (WHERE annotated AND work = 1) AS n_work, count(*) FILTER (WHERE annotated AND money = 1) AS n_money FROM st GROUP BY own_split")
def sheet_status(spark, sf_dir):
    s = _sheet(spark, sf_dir)
    lab = L.sheet_labels(s, "record_id", ["work", "money"], "none_unclear").join(s.select("record_id", "own_split"), "record_id")
    return L.sheet_status(lab, "own_split", ["work", "money"])


_SCORED = "sc AS (SELECT record_id, toxic, text, p AS a, 1 - p AS b, abs(2 * p - 1) AS c, rank FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY {u}, record_id) AS rank FROM lb) WHERE rank <= 20)"


@query(
    "handcheck_sheet",
    f"""WITH {_BASE}, {_SCORED.format(u=_U)}, o AS (SELECT record_id, toxic, list_sort([(-round(a, 6), 'a'), (-round(b, 6), 'b'), (-round(c, 6), 'c')]) AS l, a, b, c FROM sc)
    SELECT record_id, toxic, CASE WHEN a >= 0.4e0 OR b >= 0.5e0 OR c >= 0.3e0 THEN concat_ws(', ', CASE WHEN a >= 0.4e0 THEN 'a' END, CASE WHEN b >= 0.5e0 THEN 'b' END, CASE WHEN c >= 0.3e0 THEN 'c' END) ELSE '(none)' END AS above_threshold, l[1][2] AS first_label FROM o""",
)
def handcheck_sheet(spark, sf_dir):
    t = _labelled(spark, sf_dir).withColumns({"p__a": F.col("p"), "p__b": 1 - F.col("p"), "p__c": F.abs(2 * F.col("p") - 1)})
    sheet = L.handcheck_sheet(t, ["a", "b", "c"], {"a": 0.4, "b": 0.5, "c": 0.3}, "toxic", 40, 2)
    return sheet.select("record_id", "toxic", "above_threshold", F.substring("top_labels", 1, 1).alias("first_label"))


@query("machine_labels", f"WITH {_BASE} SELECT record_id, CASE WHEN p >= 0.5e0 OR 1 - p >= 0.7e0 THEN concat_ws(',', CASE WHEN p >= 0.5e0 THEN 'a' END, CASE WHEN 1 - p >= 0.7e0 THEN 'b' END) WHEN toxic = 1 THEN 'other_unclear' ELSE 'none_unclear' END AS labels FROM lb")
def machine_labels(spark, sf_dir):
    t = _labelled(spark, sf_dir).withColumns({"p__a": F.col("p"), "p__b": (1 - F.col("p")) - 0.2})
    return t.select("record_id", F.array_join(L.machine_labels(t, ["a", "b"], 0.5, F.col("toxic") == 1), ",").alias("labels"))
