"""Exact, conflicting and near duplicates; overlaps between sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.text import dedupe_key, shingles
from tidewell.sources.scratch import written


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key in a given order. One struct of order and row is kept while rows are read, so a hot key never meets in one place."""
    row = F.struct(*order, F.struct(*df.columns).alias("row"))
    return df.groupBy(key.alias("__key")).agg(F.min(row).alias("r")).select("r.row.*")


def drop_conflicting(df: DataFrame, key: Column, labels: list[str], order: list[Column]) -> DataFrame:
    """keep_first, without the keys whose rows disagree on the labels (a null is a value too)."""
    row, label = F.struct(*order, F.struct(*df.columns).alias("row")), F.struct(*labels)
    # the least and the greatest label differ exactly if any two do
    t = df.groupBy(key.alias("__key")).agg(F.min(row).alias("r"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return t.where(F.col("lo").eqNullSafe(F.col("hi"))).select("r.row.*")


def conflicting_groups(df: DataFrame, key: Column, label: str) -> DataFrame:
    t = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct(F.struct(label)).alias("n_labels"))
    return t.where("n_labels > 1")


def without_matches(train: DataFrame, test: DataFrame, key) -> DataFrame:
    """Rows of train whose key no row of test has."""
    keys = test.select(key(test).alias("__k")).where("__k is not null").distinct()
    return train.withColumn("__k", key(train)).join(keys, "__k", "left_anti").drop("__k")


def overlap_flag(df: DataFrame, other: DataFrame, key, name: str = "in_other") -> DataFrame:
    """df with a flag that says whether its key occurs in the other set."""
    keys = other.select(key(other).alias("__k")).where("__k is not null").distinct().withColumn("__hit", F.lit(True))
    return df.withColumn("__k", key(df)).join(keys, "__k", "left").withColumn(name, F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


#: Rows (n-grams of queries) that may go to every task; more are joined in a shuffle.
MOST_BROADCAST = 500_000


def small_side(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def containment(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, n: int = 8, threshold: float = 0.8) -> DataFrame:
    """(query, document, share) where one document holds at least `threshold` of a query's n-grams. Few queries go to the corpus, which is then not shuffled."""
    q = queries.select(F.col(query_id).alias("q"), shingles(F.col("text"), n).alias("g")).where(F.size("g") > 0).select("q", F.size("g").alias("n_q"), F.explode("g").alias("g"))
    d = corpus.select(F.col(doc_id).alias("d"), F.explode(shingles(F.col("text"), n)).alias("g"))
    hits = d.join(small_side(q), "g").groupBy("q", "d").agg(F.count("*").alias("k"), F.max("n_q").alias("n_q"))
    return hits.where(F.col("k") >= threshold * F.col("n_q")).select(F.col("q").alias(query_id), F.col("d").alias(doc_id), (F.col("k") / F.col("n_q")).alias("share"))


def pooled_containment(queries: DataFrame, corpus: DataFrame, query_id: str, n: int = 8, threshold: float = 0.8) -> DataFrame:
    """Share of each query's n-grams found anywhere in the corpus, for those that reach the threshold."""
    q = queries.select(F.col(query_id).alias("q"), F.explode(shingles(F.col("text"), n)).alias("g"))
    # n-grams of queries that the corpus has: what no query has is gone before anything is dealt out
    seen = corpus.select(F.explode(shingles(F.col("text"), n)).alias("g")).join(small_side(q.select("g").distinct()), "g").distinct().withColumn("hit", F.lit(1))
    t = q.join(seen, "g", "left").groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    return t.where(F.col("k") >= threshold * F.col("n")).select(F.col("q").alias(query_id), (F.col("k") / F.col("n")).alias("share"))


def _shingle_sets(df: DataFrame, id_col: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(texts with their shingles: id, s, k; the first id of each shingle set: k, id). k tells equal sets."""
    own = F.array_sort(F.transform(shingles(F.col("text"), n), lambda g: F.xxhash64(g)))  # two shingles of one hash count as one
    sets = written(df.select(F.col(id_col).alias("id"), own.alias("s")).where(F.size("s") > 0).withColumn("k", F.sha2(F.array_join(F.transform("s", lambda h: h.cast("string")), ","), 256)), "shingles")
    return sets, sets.groupBy("k").agg(F.min("id").alias("id"))


def _copies(sets: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b): b is a later text with the shingle set whose first text is a."""
    return sets.select("id", "k").join(first.select("k", F.col("id").alias("a")), "k").where("id <> a").select("a", F.col("id").alias("b"))


def _similar_sets(sets: DataFrame, first: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of different shingle sets with a similarity of at least `threshold`, each named by its first id (a < b).

    Of each set only a prefix is joined, its rarest shingles; similar sets share one there, so a shingle that many texts have is
    joined for those texts only that hold little else.
    """
    reps = sets.join(first, ["k", "id"], "left_semi").dropDuplicates(["k"]).withColumn("n", F.size("s"))
    long = reps.select("id", "n", F.explode("s").alias("g"))
    # shingles of one text only come first in every prefix and are never joined: they are only counted
    shared = long.join(long.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "g")
    own = Window.partitionBy("id")
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "g"))
    prefix = shared.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1)
    a, b = (prefix.select("g", F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("r").alias(f"r_{c}")) for c in "ab")
    # what follows the common shingle in both texts must still reach the similarity
    follow = 1 + F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b")) >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6
    cand = a.join(b, "g").where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & follow).select("a", "b").distinct()
    own = lambda c: reps.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    t = cand.join(own("a"), "a").join(own("b"), "b").withColumn("jaccard", both / (F.size("s_a") + F.size("s_b") - both))
    return t.where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def similar_pairs(df: DataFrame, id_col: str, n: int = 5, threshold: float = 0.9) -> DataFrame:
    """Pairs (a < b) of texts with a Jaccard similarity of shingles of at least `threshold`, exactly.

    Equal shingle sets are compared once: the first text of a set stands for it in the pairs with other sets, and its copies are
    paired with that text alone.
    """
    sets, first = _shingle_sets(df, id_col, n)
    return _similar_sets(sets, first, threshold).unionByName(_copies(sets, first).withColumn("jaccard", F.lit(1.0)))


def greedy_near_duplicates(df: DataFrame, id_col: str, n: int = 5, threshold: float = 0.9) -> DataFrame:
    """Ids dropped when texts are gone through by id and one goes if it is similar to an earlier one that stayed.

    Of equal shingle sets at most the first text stays: a copy is similar to it, or to the kept text for which it went. Rounds therefore
    run over sets. They settle all sets without an unsettled earlier neighbour at once; the number of rounds is the length of the longest chain.
    """
    sets, first = _shingle_sets(df, id_col, n)
    pairs = written(_similar_sets(sets, first, threshold).select("a", "b"), "pairs")
    state = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("state", F.lit(0))  # 1 stays, 2 goes
    while True:
        before = pairs.join(state.select(F.col("id").alias("a"), "state"), "a").groupBy("b").agg(F.max(F.when(F.col("state") == 1, 1).otherwise(0)).alias("kept"), F.max(F.when(F.col("state") == 0, 1).otherwise(0)).alias("open"))
        new = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("kept", F.lit(0)) == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = written(state.join(before.withColumnRenamed("b", "id"), "id", "left").select("id", new.alias("state")), "state")
        if not state.where("state = 0").limit(1).count():
            gone = state.where("state = 2").select("id").unionByName(_copies(sets, first).select(F.col("b").alias("id")))
            return gone.select(F.col("id").alias(id_col)).distinct()


def duplicate_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows, surplus copies of equal raw texts and of equal normalised ones, and how many texts are duplicated; nulls don't count."""
    t = df.where(F.col(text).isNotNull())
    raw = t.groupBy(F.col(text).alias("k")).agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("exact_duplicates"), F.count_if(F.col("c") > 1).alias("duplicated_texts"))
    norm = t.groupBy(dedupe_key(F.col(text)).alias("k")).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("normalised_duplicates"))
    return raw.join(F.broadcast(norm))  # one row each


def shared_keys(sets: DataFrame, set_col: str, key_col: str) -> DataFrame:
    """(a, b, shared) for all pairs of sets with common keys; sets are few, keys are aggregated first."""
    own = sets.where(F.col(key_col).isNotNull()).groupBy(F.col(key_col).alias("k")).agg(F.array_sort(F.collect_set(set_col)).alias("s")).where(F.size("s") > 1)
    packed = own.groupBy("s").agg(F.count("*").alias("n"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return packed.select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("shared"))


def set_fingerprint(df: DataFrame, id_col: str) -> DataFrame:
    """sha256 over the digests of 4,096 blocks of sorted ids, and their number: equal for equal sets of ids, and no task holds more than a block."""
    parts = df.select(F.col(id_col).cast("string").alias("id")).distinct().groupBy(F.substring(F.sha2("id", 256), 1, 3).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "\n"), 256).alias("fingerprint"), F.sum("n").alias("n_ids"))


def new_texts(df: DataFrame, seen: DataFrame | None, key: Column, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows whose text is new, first of each text; the keys seen so far): a file's turn when files come one after another. seen has a column key; None before the first."""
    fresh = keep_first(df, key, order).withColumn("__k", key)
    if seen is not None:
        fresh = fresh.join(seen.withColumnRenamed("key", "__k"), "__k", "left_anti")
    keys = fresh.select(F.col("__k").alias("key"))
    return fresh.drop("__k"), keys if seen is None else seen.unionByName(keys)


def compare_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, merge): left_only, right_only or both, for each key of two tables."""
    own = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    t = own(a, "l").join(own(b, "r"), key, "full_outer")
    return t.select(key, F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("both").alias("merge"))
