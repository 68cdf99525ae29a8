"""Unified scores of texts from models whose logits are counts, so that SQL can say the same; audits of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.stats import rounded
from tidewell.operators import predict as P, quality as Q
from tidewell.plans.registry import query, table
from tidewell.plans.set_queries import _U

#: Fixed values of the test: words whose counts are logits.
_WORDS = {"joy": "the", "sad": "der", "fear": "que"}
_count = lambda w: F.regexp_count("piece", F.lit(f"(?i){w}")).cast("double")


def _parts():
    lines = lambda text: F.filter(F.split(text, r"\."), lambda x: F.trim(x) != "")
    stress = P.Part(("z",), lines, lambda d: d.withColumn("z", _count("e") - 8), P.tempered(2.0), "mean", "v1")
    emotion = P.Part(tuple(_WORDS), lines, lambda d: d.withColumns({n: _count(w) - 1 for n, w in _WORDS.items()}), P.platt({"joy": (1.0, 0.0), "sad": (2.0, -0.5), "fear": (0.5, 0.1)}), "mean", "v2")
    stressor = P.Part(("work", "money"), lines, lambda d: d.withColumns({"work": _count("ing") / 4, "money": _count("er") / 4}), together="max", version="v3")
    return stress, emotion, stressor


def _predicted(spark, sf_dir, rate=None):
    stress, emotion, stressor = _parts()
    d = table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return P.predict(d, "key", "text", stress, emotion, {"good": ["joy"], "bad": ["sad", "fear"]}, 0.4, stressor, {"work": 0.5, "money": 0.75}, {"money": "cos"}, None, True, rate)


_n = lambda w: f"len(regexp_extract_all(piece, '(?i){w}'))"
_SCORES = f"""c AS (SELECT conv_id * 1000 + turn AS key, text FROM conversations), st AS (SELECT key, text, CASE WHEN text IS NULL THEN 'none' WHEN trim(text) = '' THEN 'empty' WHEN len(regexp_extract_all(text, '\\p{{L}}')) < 3 THEN 'no_text' WHEN length(text) > 20000 THEN 'ok_truncated' ELSE 'ok' END AS status FROM c),
pc AS (SELECT key, unnest(list_filter(string_split(text, '.'), lambda x: trim(x) <> '')) AS piece FROM st WHERE status IN ('ok', 'ok_truncated')),
sc AS (SELECT key, count(*) AS n, avg(1 / (1 + exp(-(({_n('e')} - 8) / 2.0e0)))) AS sp, avg(1 / (1 + exp(-({_n('the')} - 1.0e0)))) AS joy, avg(1 / (1 + exp(-(2.0e0 * ({_n('der')} - 1) - 0.5e0)))) AS sad, avg(1 / (1 + exp(-(0.5e0 * ({_n('que')} - 1) + 0.1e0)))) AS fear, max({_n('ing')} / 4.0e0) AS work, max({_n('er')} / 4.0e0) AS money FROM pc GROUP BY key)"""
_BY_RATE = "r AS (SELECT st.key, status, n, sp, sp >= 0.4e0 AS flag, {on} AS second, {weight} AS w, joy, sad, fear, work, money FROM st LEFT JOIN sc USING (key) LEFT JOIN uh USING (key))"
_OUT = """SELECT key, status AS input_status, round(sp, 6) AS stress_prob, flag AS stress_flag, round(CASE WHEN second THEN joy END, 6) AS emotion_p__joy, round(CASE WHEN second THEN greatest(sad, fear) END, 6) AS emotion_group__bad,
CASE WHEN second THEN work END AS stressor_p__work, CASE WHEN second THEN money END AS stressor_cos__money, CASE WHEN second THEN flag AND work >= 0.5e0 END AS stressor_flag__work, CASE WHEN second THEN flag AND money >= 0.75e0 END AS stressor_flag__money,
CASE WHEN second THEN CASE WHEN NOT flag OR (work < 0.5e0 AND money < 0.75e0) THEN 'none_unclear' WHEN work >= 0.5e0 AND (money < 0.75e0 OR round(work - 0.5e0, 12) >= round(money - 0.75e0, 12)) THEN 'work' ELSE 'money' END END AS stressor_top,
CAST(CASE WHEN status LIKE 'ok%' THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_chunks_stress, second AS second_stage_scored, round(w, 6) AS sample_weight FROM r"""
_COLUMNS = ("key", "input_status", "stress_prob", "stress_flag", "emotion_p__joy", "emotion_group__bad", "stressor_p__work", "stressor_cos__money", "stressor_flag__work", "stressor_flag__money", "stressor_top", "n_chunks_stress", "second_stage_scored", "sample_weight")
_HASH = f"uh AS (SELECT key, {_U} AS u FROM (SELECT key, sha256('42:' || key) AS h FROM c))"


@query("predict_all", f"WITH {_SCORES}, {_HASH}, {_BY_RATE.format(on='sp IS NOT NULL', weight='CASE WHEN sp IS NOT NULL THEN 1.0e0 END')} {_OUT}")
def predict_all(spark, sf_dir):
    return rounded(_predicted(spark, sf_dir).select(*_COLUMNS), 6)


@query("predict_two_stage", f"WITH {_SCORES}, {_HASH}, {_BY_RATE.format(on='sp IS NOT NULL AND (sp >= 0.4e0 OR u < 0.3e0)', weight='CASE WHEN sp >= 0.4e0 THEN 1.0e0 WHEN sp IS NOT NULL AND u < 0.3e0 THEN 1 / 0.3e0 END')} {_OUT}")
def predict_two_stage(spark, sf_dir):
    return rounded(_predicted(spark, sf_dir, 0.3).select(*_COLUMNS), 6)


@query("hybrid_scores", "WITH c AS (SELECT event_id AS key, unnest(['a/x', 'a/y', 'b', 'none']) AS class, unnest([value / 700, value / 1100, 0.2e0, 0.1e0]) AS p FROM events), m AS (SELECT * FROM (VALUES ('a/x', 'a'), ('a/y', 'a'), ('b', 'b'), ('none', NULL), (NULL, 'z')) v(class, category)) SELECT key, category, round(sum(p), 6) AS p, 'probability' AS kind FROM c JOIN m USING (class) WHERE category IS NOT NULL GROUP BY ALL UNION ALL SELECT event_id, 'z', CASE WHEN event_id % 3 > 0 THEN round(value / 1000, 6) END, 'cosine' FROM events")
def hybrid_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v, item = F.col("value"), lambda n, p: F.struct(F.lit(n).alias("class"), p.alias("p"))
    classes = e.select(F.col("event_id").alias("key"), F.explode(F.array(item("a/x", v / 700), item("a/y", v / 1100), item("b", F.lit(0.2)), item("none", F.lit(0.1)))).alias("x")).select("key", "x.*")
    mapping = spark.createDataFrame([("a/x", "a"), ("a/y", "a"), ("b", "b"), ("none", None), (None, "z")], "class string, category string")
    cosine = e.where("event_id % 3 > 0").select(F.col("event_id").alias("key"), F.lit("z").alias("category"), (v / 1000).alias("p"))
    return rounded(P.hybrid_scores(classes, mapping, cosine, "key"), 6)


@query("keyword_flags", "WITH h AS (SELECT doc_id, len(list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '(?i)the'))) AS a, len(list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '(?i)der'))) AS b FROM documents) SELECT doc_id, a >= 2 AS flag__a, b >= 1 AS flag__b FROM h")
def keyword_flags(spark, sf_dir):
    from tidewell.operators.scoring import keyword_hits

    hits = keyword_hits(table(spark, sf_dir, "documents"), "doc_id", F.split("text", r"\."), {"a": "(?i)the", "b": "(?i)der"})
    return P.keyword_flags(hits, "doc_id", {"a": 2, "b": 1})


_AUDIT = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_returnflag": "string"}


@query("tabular_audit", " UNION ALL ".join(f"SELECT '{c}' AS column, '{t}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_unique, " + ("CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean_chars" if t != "string" else "NULL, NULL, avg(length({c}))").format(c=c) + " FROM lineitem" for c, t in _AUDIT.items()))
def tabular_audit(spark, sf_dir):
    return Q.tabular_audit(table(spark, sf_dir, "lineitem").select(*_AUDIT))


@query("row_audit", "WITH d AS (SELECT l_orderkey % 50 AS a, l_linenumber AS b, l_returnflag AS c FROM lineitem), g AS (SELECT count(*) AS n FROM d GROUP BY a, b, c) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS missing_total, false AS all_numeric FROM g")
def row_audit(spark, sf_dir):
    return Q.row_audit(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("a"), "l_linenumber", "l_returnflag"))


@query("guess_text_and_label", "SELECT 'text' AS text_column, 'quality' AS label_column")
def guess_text_and_label(spark, sf_dir):
    return Q.guess_text_and_label(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id"))


@query("rule_states", "WITH r AS (SELECT event_type AS level, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value >= 50 END AS met FROM events) SELECT level, CASE WHEN met IS NULL THEN 'unknown' WHEN met THEN 'met' ELSE 'not met' END AS state, count(*) AS n FROM r GROUP BY ALL")
def rule_states(spark, sf_dir):
    from tidewell.operators.metrics import rule_states as states

    return states(table(spark, sf_dir, "events").select(F.col("event_type").alias("level"), F.when(F.col("event_id") % 3 > 0, F.col("value") >= 50).alias("met")))


@query("pooled_vectors", "WITH e AS (SELECT label, [CAST(avg(embedding[1]) AS DOUBLE), CAST(avg(embedding[2]) AS DOUBLE)] AS m, count(*) AS n FROM embeddings GROUP BY label) SELECT label, round(m[1] / sqrt(m[1] * m[1] + m[2] * m[2]), 5) AS a, round(m[2] / sqrt(m[1] * m[1] + m[2] * m[2]), 5) AS b FROM e")
def pooled_vectors(spark, sf_dir):
    from tidewell.operators.vectors import pooled

    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list(F.slice("embedding", 1, 2)).alias("v"))
    return rounded(e.select("label", pooled(F.col("v")).alias("p")).select("label", F.col("p")[0].alias("a"), F.col("p")[1].alias("b")), 5)
