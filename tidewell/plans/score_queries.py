"""Vector scores, aggregation of windows and chunks, class merging, topic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.stats import rounded
from tidewell.operators import scoring
from tidewell.plans.registry import query, table
from tidewell.plans.set_queries import _U
from tidewell.plans.views import RECORDS_SQL, records

NORM = "list_transform({v}, lambda x: CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST({v} AS DOUBLE[]), CAST({v} AS DOUBLE[]))))"
CENT = f"""p AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM p GROUP BY ALL), mc AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label),
cent AS (SELECT label, {NORM.format(v="v")} AS c FROM mc), vec AS (SELECT vec_id, {NORM.format(v="embedding")} AS v FROM embeddings)"""
SIMS = f"{CENT}, sim AS (SELECT vec_id, label, list_inner_product(v, c) AS s FROM vec, cent), best AS (SELECT vec_id, label, s FROM sim QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, label) = 1)"


def _nearest(spark, sf_dir, floor):
    e = table(spark, sf_dir, "embeddings")
    return scoring.nearest(e, "vec_id", "embedding", scoring.centroids(e, "embedding", "label"), floor)


@query("nearest_centroid", f"WITH {SIMS} SELECT vec_id, CASE WHEN s >= 0.3e0 THEN label ELSE -1 END AS label, round(s, 6) AS similarity FROM best")
def nearest_centroid(spark, sf_dir):
    return rounded(_nearest(spark, sf_dir, 0.3), 6)


@query("centroid_agreement", f"WITH {SIMS} SELECT round(avg(CAST(b.label = e.label AS DOUBLE)), 8) AS agreement, count(*) AS n FROM best b JOIN embeddings e USING (vec_id)")
def centroid_agreement(spark, sf_dir):
    t = _nearest(spark, sf_dir, -1.0).join(table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("own")), "vec_id")
    return rounded(t.agg(F.avg((F.col("label") == F.col("own")).cast("double")).alias("agreement"), F.count("*").alias("n")))


@query("cosine_prototypes", f"WITH {CENT}, sim AS (SELECT vec_id % 50 AS post, label, list_inner_product(v, c) AS s FROM vec, cent) SELECT post, label, round(max(s), 6) AS similarity FROM sim GROUP BY ALL")
def cosine_prototypes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    packed = scoring.centroids(e, "embedding", "label").agg(F.collect_list(F.struct("label", "c")).alias("cents"))
    v = e.select((F.col("vec_id") % 50).alias("post"), scoring.normalised(F.col("embedding")).alias("v")).join(F.broadcast(packed))  # one row with a vector for each label
    sims = v.select("post", F.explode(F.transform("cents", lambda c: F.struct(c["label"].alias("label"), scoring.dot(F.col("v"), c["c"]).alias("s")))).alias("x"))
    return rounded(sims.groupBy("post", "x.label").agg(F.max("x.s").alias("similarity")), 6)


CH = "ch AS (SELECT user_id, value / (value + 50) AS s, value + 1 AS w FROM events)"


@query("chunk_scores", f"WITH {CH} SELECT user_id, round(avg(s), 8) AS mean, round(max(s), 8) AS max, round(sum(s * w) / sum(w), 8) AS weighted_mean FROM ch GROUP BY user_id")
def chunk_scores(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", (F.col("value") / (F.col("value") + 50)).alias("s"), (F.col("value") + 1).alias("w"))
    return rounded(scoring.chunk_scores(t, "user_id", "s", "w"))


@query("window_top2_mean", f"WITH {CH}, k AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC) AS r FROM ch) SELECT user_id, round(max(s), 8) AS max, round(avg(s), 8) AS mean, round(avg(s) FILTER (WHERE r <= 2), 8) AS top2_mean, round(sum(s), 8) AS sum FROM k GROUP BY user_id")
def window_top2_mean(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("user_id", (F.col("value") / (F.col("value") + 50)).alias("s"))
    return rounded(scoring.window_scores(t, "user_id", "s"))


@query("group_max_noisy_or", f"WITH {RECORDS_SQL} SELECT event_id, round(greatest(joy, sadness, anger), 8) AS group_max, round(1 - (1 - joy) * (1 - sadness) * (1 - anger), 8) AS noisy_or FROM r")
def group_max_noisy_or(spark, sf_dir):
    cols = ["emotion_p__joy", "emotion_p__sadness", "emotion_p__anger"]
    return rounded(records(spark, sf_dir).select("event_id", scoring.group_max(cols).alias("group_max"), scoring.noisy_or(cols).alias("noisy_or")))


CLASSES = "cl AS (SELECT event_id, unnest(['joy', 'sadness', 'anger']) AS class, unnest([joy, sadness, anger]) AS p FROM r), mp AS (SELECT unnest(['joy', 'sadness', 'anger']) AS class, unnest([NULL, 'low', 'low']) AS category), mg AS (SELECT event_id, category, sum(p) AS p FROM cl JOIN mp USING (class) WHERE category IS NOT NULL GROUP BY ALL)"


def _classes(spark, sf_dir):
    r = records(spark, sf_dir)
    long = r.select("event_id", F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"emotion_p__{c}").alias("p")) for c in ("joy", "sadness", "anger")))).alias("x")).select("event_id", "x.*")
    return long, spark.createDataFrame([("joy", None), ("sadness", "low"), ("anger", "low")], "class string, category string")


@query("class_merge", f"WITH {RECORDS_SQL}, {CLASSES} SELECT event_id, category, round(p, 8) AS p FROM mg")
def class_merge(spark, sf_dir):
    long, mapping = _classes(spark, sf_dir)
    return rounded(scoring.merge_classes(long, mapping, "event_id"))


@query(
    "stressor_flags_top",
    f"""WITH {RECORDS_SQL}, cl AS (SELECT event_id, unnest(['joy', 'sadness', 'anger']) AS category, unnest([joy, sadness, anger]) AS p, unnest([0.6e0, 0.5e0, 0.7e0]) AS t FROM r), m AS (SELECT *, round(p - t, 12) AS margin FROM cl),
    b AS (SELECT event_id, category FROM m WHERE margin >= 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY margin DESC, category) = 1), n AS (SELECT event_id, count(*) FILTER (WHERE margin >= 0) AS n_flags FROM m GROUP BY event_id)
    SELECT n.event_id, n_flags, coalesce(category, 'none_unclear') AS top FROM n LEFT JOIN b USING (event_id)""",
)
def stressor_flags_top(spark, sf_dir):
    long, _ = _classes(spark, sf_dir)
    thresholds = spark.createDataFrame([("joy", 0.6), ("sadness", 0.5), ("anger", 0.7)], "category string, threshold double")
    return scoring.flags_and_top(long.withColumnRenamed("class", "category"), "event_id", thresholds)


@query("softmax", f"WITH {RECORDS_SQL}, z AS (SELECT event_id, exp(joy / 2) AS a, exp(sadness / 2) AS b, exp(anger / 2) AS c FROM r) SELECT event_id, round(a / (a + b + c), 8) AS p_joy, round(b / (a + b + c), 8) AS p_sadness, round(c / (a + b + c), 8) AS p_anger FROM z")
def softmax(spark, sf_dir):
    t = records(spark, sf_dir).select("event_id", scoring.softmax(F.array("emotion_p__joy", "emotion_p__sadness", "emotion_p__anger"), 2.0).alias("p"))
    return rounded(t.select("event_id", F.col("p")[0].alias("p_joy"), F.col("p")[1].alias("p_sadness"), F.col("p")[2].alias("p_anger")))


@query("parity_diff", "SELECT unnest(['value', 'event_type']) AS column, count(*) AS n, unnest([count(*) FILTER (WHERE event_id % 100 = 0), 0]) AS n_differ, unnest([0.5e0, NULL]) AS max_abs_diff FROM events")
def parity_diff(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    b = a.withColumn("value", F.when(F.col("event_id") % 100 == 0, F.col("value") + 0.5).otherwise(F.col("value")))
    return rounded(scoring.parity(a, b, "event_id"))


_SEP = r"[^\p{L}\p{N}\p{M}_]"
_times = lambda w: f"CAST(len(regexp_extract_all(t, '(?i)(^|{_SEP}){w}($|{_SEP})')) AS DOUBLE)"


@query(
    "keyword_two_stage",
    f"""WITH d AS (SELECT doc_id, regexp_replace(text, '({_SEP})', '\\1\\1', 'g') AS t, sha256('42:' || doc_id) AS h FROM documents), s AS (SELECT doc_id, t, {_times('the')} AS stage1__the, {_U} AS u FROM d),
    f AS (SELECT *, stage1__the > 5 AS stress_flag, stage1__the > 5 OR u < 0.15e0 AS on2 FROM s)
    SELECT doc_id, stage1__the, stress_flag, on2 AS second_stage_scored, CASE WHEN stress_flag THEN 1.0e0 WHEN on2 THEN 1.0e0 / 0.15e0 END AS sample_weight, CASE WHEN on2 THEN {_times('and')} END AS stage2__and, CASE WHEN on2 THEN {_times('of')} END AS stage2__of FROM f""",
)
def keyword_two_stage(spark, sf_dir):
    from tidewell.operators.models import WordScorer

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first, second = WordScorer({"the": ["the"]}), WordScorer({"and": ["and"], "of": ["of"]})
    return scoring.two_stage_score(d, "doc_id", "text", first, second, lambda t: F.coalesce(F.col("stage1__the") > 5, F.lit(False)), 0.15).drop("text")


@query("lda_topics")
def lda_topics(spark, sf_dir):
    from tidewell.operators.models import lda_keywords

    return lda_keywords(table(spark, sf_dir, "documents"), "doc_id", "text", 4)


@query("lda_assign")
def lda_assign(spark, sf_dir):
    from tidewell.operators.models import lda_assign as assign

    return assign(table(spark, sf_dir, "documents"), "doc_id", "text", 4)


@query("cluster_topics")
def cluster_topics(spark, sf_dir):
    from tidewell.operators.models import cluster_topics as cluster

    return cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query("embedding_classifier")
def embedding_classifier(spark, sf_dir):
    from tidewell.operators.models import embedding_classifier as classifier
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings")
    model = classifier(e.where("vec_id % 5 > 0"), "embedding", "label")
    test = e.where("vec_id % 5 = 0").withColumn("features", array_to_vector(F.col("embedding").cast("array<double>")))
    return model.transform(test).select("vec_id", F.col("prediction").cast("int").alias("predicted"), "label")


@query("tfidf_classifier")
def tfidf_classifier(spark, sf_dir):
    from tidewell.operators.models import best_tfidf_classifier, with_ngrams

    t = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("toxic").alias("y"))
    model, _, _ = best_tfidf_classifier(t.where("doc_id % 5 > 1"), t.where("doc_id % 5 = 1"), "text", "y", (0.1, 10.0), 1 << 14)
    return model.transform(with_ngrams(t.where("doc_id % 5 = 0"), "text")).select("doc_id", "y", F.col("prediction").cast("int").alias("predicted"))


@query("topic_terms", "WITH w AS (SELECT lang, unnest(list_filter(string_split_regex(lower(text), '[^a-zà-ÿ]+'), lambda x: length(x) > 2)) AS term FROM documents), t AS (SELECT lang, term, count(*) AS tf FROM w GROUP BY ALL), c AS (SELECT term, sum(tf) AS f FROM t GROUP BY term), a AS (SELECT sum(tf) / CAST(count(DISTINCT lang) AS DOUBLE) AS avg FROM t), n AS (SELECT lang, sum(tf) AS n FROM t GROUP BY lang), s AS (SELECT lang, term, tf / CAST(n AS DOUBLE) * ln(1 + avg / f) AS w FROM t JOIN c USING (term) JOIN n USING (lang), a) SELECT lang, term, round(w, 6) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY lang ORDER BY round(w, 10) DESC, term) <= 5")
def topic_terms(spark, sf_dir):
    from tidewell.operators.models import class_tfidf

    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), "[^a-zà-ÿ]+"), lambda x: F.length(x) > 2)
    return rounded(class_tfidf(d.select("lang", F.explode(words).alias("term")), "lang", 5), 6)
