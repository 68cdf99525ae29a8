"""Scores from vectors, keywords and windows, and their aggregation to records and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewell.functions.stats import ratio
from tidewell.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    return let(F.sqrt(dot(v, v)), lambda n: F.transform(v.cast("array<double>"), lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))


def centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Normalised mean vector of each label, summed place by place so that partial sums are small."""
    long = df.select(F.col(label).alias("label"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).select("label", normalised(F.col("c")).alias("c"))


#: Centroids are held in memory by every task up to this many; beyond it they are met block by block.
MOST_CENTROIDS = 4096


def nearest(df: DataFrame, key: str, vector: str, cents: DataFrame, floor: float = -1.0) -> DataFrame:
    """(key, label, similarity) of the most similar centroid, the smaller label of equals; label -1 below the floor."""
    n = cents.count()
    best = None
    for part in ([cents] if n <= MOST_CENTROIDS else cents.randomSplit([1.0] * -(-n // MOST_CENTROIDS), 7)):
        packed = part.agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), "c"))).alias("cents"))
        v = df.select(key, normalised(F.col(vector)).alias("v")).join(F.broadcast(packed))  # one row of at most MOST_CENTROIDS vectors
        sims = F.transform("cents", lambda c: F.struct(F.round(dot(F.col("v"), c["c"]), 12).alias("s"), (-c["label"]).alias("l")))
        own = v.select(key, F.array_max(sims).alias("m"))
        best = own if best is None else best.unionByName(own)
    if n > MOST_CENTROIDS:
        best = best.groupBy(key).agg(F.max("m").alias("m"))
    return best.select(key, F.when(F.col("m.s") >= floor, -F.col("m.l")).otherwise(-1).alias("label"), F.col("m.s").alias("similarity"))


def chunk_scores(df: DataFrame, key: str, score: str, weight: str) -> DataFrame:
    s, w = F.col(score), F.col(weight)
    return df.groupBy(key).agg(F.avg(s).alias("mean"), F.max(s).alias("max"), ratio(F.sum(s * w), F.sum(w)).alias("weighted_mean"))


def window_scores(df: DataFrame, key: str, score: str) -> DataFrame:
    """max, mean, mean of the two best, and sum. The two best are the largest and what a second largest leaves: no list is kept."""
    t = df.groupBy(key, F.col(score).alias("s")).agg(F.count("*").alias("n"))
    big = t.groupBy(key).agg(F.max("s").alias("max"), F.sum(F.col("s") * F.col("n")).alias("sum"), F.sum("n").alias("n"), F.max_by("n", "s").alias("ties"))
    second = t.join(big.select(key, "max"), key).where(F.col("s") < F.col("max")).groupBy(key).agg(F.max("s").alias("second"))
    pair = F.when(F.col("ties") > 1, F.col("max")).otherwise(F.coalesce(F.col("second"), F.col("max")))
    return big.join(second, key, "left").select(key, "max", (F.col("sum") / F.col("n")).alias("mean"), ((F.col("max") + pair) / 2).alias("top2_mean"), "sum")


def group_max(labels: list[str]) -> Column:
    return F.greatest(*(F.col(c) for c in labels)) if len(labels) > 1 else F.col(labels[0])


def noisy_or(labels: list[str]) -> Column:
    keep = F.lit(1.0)
    for c in labels:
        keep = keep * (1 - F.col(c))
    return 1 - keep


def merge_classes(long: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Class probabilities summed to categories by a (class, category) map; classes without one are left out."""
    return long.join(mapping, "class").where(F.col("category").isNotNull()).groupBy(key, "category").agg(F.sum("p").alias("p"))


def flags_and_top(long: DataFrame, key: str, thresholds: DataFrame) -> DataFrame:
    """Flags by category threshold, and the flagged category with the greatest margin (none_unclear if none)."""
    t = long.join(thresholds, "category").withColumn("margin", F.round(F.col("p") - F.col("threshold"), 12))
    hit = F.col("margin") >= 0
    # of equal margins the first name wins: a hash-free key that orders names downwards
    best = F.min(F.when(hit, F.struct((-F.col("margin")).alias("m"), F.col("category").alias("category"))))
    return t.groupBy(key).agg(F.count_if(hit).alias("n_flags"), F.coalesce(best["category"], F.lit("none_unclear")).alias("top"))


def keyword_hits(df: DataFrame, key: str, windows: Column, patterns: dict[str, str]) -> DataFrame:
    """Windows of each text that match a category's pattern."""
    w = df.select(key, windows.alias("w"))
    matching = lambda p: F.size(F.filter("w", lambda x: x.rlike(p)))
    return w.select(key, *(matching(p).alias(c) for c, p in patterns.items()))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    e = let(F.array_max(logits).cast("double"), lambda m: F.transform(logits.cast("array<double>"), lambda x: F.exp((x - m) / temperature)))
    return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))


def sigmoid(z: Column, temperature: float = 1.0, bias: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-(z / temperature + bias)))


class Scorer:
    """What a model must offer: names of its scores, and scores of a batch of texts (one row each)."""

    names: tuple[str, ...] = ()

    def load(self) -> None:
        """Called once in each task before the first batch."""

    def score(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


def halved(score: Callable[[list[str]], list[list[float]]], texts: list[str]) -> list[list[float]]:
    """Scores of texts in as few calls as memory allows: where a call runs out of it, its texts go in two halves. A single text that is too much is an error."""
    try:
        return score(texts)
    except MemoryError:
        if len(texts) < 2:
            raise
        mid = len(texts) // 2
        return [*halved(score, texts[:mid]), *halved(score, texts[mid:])]


def run_scorer(df: DataFrame, text: str, scorer: Scorer, prefix: str) -> DataFrame:
    """df with a column for each score; null where the text is null. Texts go to the model in order of length, so that batches are even."""
    schema = StructType([*df.schema.fields, *(StructField(prefix + n, DoubleType()) for n in scorer.names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.load()
        for b in batches:
            ok = b[text].notna()
            order = b.loc[ok, text].str.len().sort_values(kind="stable").index
            got = pd.DataFrame(halved(scorer.score, b.loc[order, text].tolist()), index=order, columns=[prefix + n for n in scorer.names]) if len(order) else pd.DataFrame(columns=[prefix + n for n in scorer.names])
            yield b.join(got.reindex(b.index).astype(float))

    return df.mapInPandas(run, schema)


def two_stage_score(df: DataFrame, key: str, text: str, first: Scorer, second: Scorer, flag: Callable[[DataFrame], Column], rate: float, seed: int = 42) -> DataFrame:
    """First-stage scores for all rows; second-stage ones for flagged rows and a hash sample of the rest. Rows are parted before the second model, since a Python function in a CASE runs for every row."""
    from tidewell.operators.sampling import two_stage

    one = run_scorer(df, text, first, "stage1__")
    one = two_stage(one.withColumn("stress_flag", flag(one)), key, "stress_flag", rate, seed)
    two = run_scorer(one.where("second_stage_scored"), text, second, "stage2__")
    rest = one.where("not second_stage_scored").withColumns({f"stage2__{n}": F.lit(None).cast("double") for n in second.names})
    return two.unionByName(rest)


def parity(a: DataFrame, b: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """(column, n, n_differ, max_abs_diff) of two tables with the same rows; rows of one only differ in every column."""
    names = [c for c in a.columns if c != key]
    x = a.select(key, F.lit(True).alias("in_a"), *(F.col(c).alias(f"a_{c}") for c in names))
    y = b.select(key, F.lit(True).alias("in_b"), *(F.col(c).alias(f"b_{c}") for c in names))
    numeric = {c for c, t in a.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint")}

    def item(c: str) -> Column:
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        gap = F.abs(p.cast("double") - q.cast("double")) if c in numeric else F.lit(None).cast("double")
        same = p.eqNullSafe(q) if c not in numeric else p.eqNullSafe(q) | F.coalesce(gap <= tolerance, F.lit(False))
        both = F.col("in_a") & F.col("in_b")
        return F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(~F.coalesce(same & both, F.lit(False))).alias("n_differ"), F.max(gap).alias("max_abs_diff"))

    return x.join(y, key, "full_outer").agg(F.array(*map(item, names)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
