"""Deterministic samples and splits: every draw is a hash of a seed and a key, so that no order or partition matters."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.stats import short_hash, unit_hash


def two_stage(df: DataFrame, key: str, flag: str, rate: float, seed: int = 42) -> DataFrame:
    """Flagged rows with weight 1, a hash sample of the rest with weight 1 / rate; others unscored with a null weight."""
    drawn = unit_hash(F.col(key), seed) < rate
    return df.withColumns({"second_stage_scored": F.col(flag) | drawn, "sample_weight": F.when(F.col(flag), 1.0).when(drawn, 1.0 / rate)})


def smallest_hashes(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest hashes."""
    return df.withColumn("u", short_hash(F.col(key), str(seed))).orderBy("u", key).limit(n)


def per_cell(df: DataFrame, cell: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to n rows of each cell (null is a cell too), those with the smallest hashes. The planner keeps n rows of a cell in each partition before it deals them out, so that a hot cell is never ranked whole."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("u", key))
    return df.withColumn("u", short_hash(F.col(key), str(seed))).withColumn("rank", rank).where(F.col("rank") <= n)


def busiest_day(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The first n rows, by key, of the day with most rows (the earliest of several)."""
    day = F.col(ts).cast("date")
    top = df.groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1).select("day")
    return df.withColumn("day", day).join(F.broadcast(top), "day").orderBy(key).limit(n)  # one row


def group_split(df: DataFrame, group: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Splits by a hash of the group, which never spans two of them."""
    u, out, total = short_hash(F.col(group), str(seed)), None, 0.0
    for name, share in list(shares.items())[:-1]:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    last = list(shares)[-1]
    return df.withColumn("split", out.otherwise(last) if out is not None else F.lit(last))


#: Bins of [0, 1) in which uniform hashes are counted before those in a quantile's own bin are ranked.
HASH_BINS = 1 << 14


def hash_quantiles(hashed: DataFrame, stratum: str, u: str, shares: list[Fraction]) -> DataFrame:
    """(__s, __q): for each share the smallest u that so much of its stratum's rows do not exceed, exactly. Counts by bin tell in which bin a quantile
    lies, and only that bin's values are ranked, so that no stratum is any single task's."""
    t = hashed.where(F.col(u).isNotNull()).select(F.col(stratum).alias("__s"), F.col(u).alias("__u"), F.floor(F.col(u) * HASH_BINS).alias("__b"))
    bins = t.groupBy("__s", "__b").agg(F.count("*").alias("n"))
    n, upto = F.sum("n").over(Window.partitionBy("__s")), F.sum("n").over(Window.partitionBy("__s").orderBy("__b"))  # at most HASH_BINS rows
    ranks = [F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.expr(f"(n_all * {q.numerator} + {q.denominator - 1}) div {q.denominator}")).alias("rank")) for i, q in enumerate(shares)]
    own = bins.withColumns({"n_all": n, "upto": upto}).select("__s", "__b", "n", "upto", F.explode(F.array(*ranks)).alias("x")).where("x.rank > upto - n AND x.rank <= upto")
    own = own.select(F.col("__s").alias("__t"), F.col("__b").alias("__c"), (F.col("x.rank") - (F.col("upto") - F.col("n"))).alias("rank"), "x.i")
    at = t.join(own, F.col("__s").eqNullSafe(F.col("__t")) & (F.col("__b") == F.col("__c"))).groupBy("__s", "i", "rank", "__u").agg(F.count("*").alias("n"))
    at = at.withColumn("upto", F.sum("n").over(Window.partitionBy("__s", "i").orderBy("__u"))).where("upto >= rank").groupBy("__s", "i").agg(F.min("__u").alias("q"))
    return at.groupBy("__s").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("__q"))  # as many as shares


def stratified_split(df: DataFrame, stratum: str, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Splits of the given shares in each stratum (null is one too), up to a row: hashes are cut at their exact quantiles within it."""
    cuts, total = [], Fraction(0)
    for share in list(shares.values())[:-1]:
        total += Fraction(str(share)).limit_denominator(1_000_000)
        cuts.append(min(Fraction(1), total))
    hashed = df.withColumn("u", short_hash(F.col(key), str(seed)))
    names = list(shares)
    if not cuts:
        return hashed.withColumn("split", F.lit(names[-1])).drop("u")
    t = hashed.join(hash_quantiles(hashed, stratum, "u", cuts), F.col(stratum).eqNullSafe(F.col("__s")), "left")
    out = F.lit(names[-1])
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(F.col("u") <= F.col("__q")[i], names[i]).otherwise(out)
    return t.withColumn("split", out).drop("u", "__q", "__s")


def largest_remainder(cells: DataFrame, name: str, size: str, total: int, floor: int = 1) -> DataFrame:
    """How many of `total` each cell gets: its floor (at most its size), then whole quotas of the rest, then one each by largest remainder; never more than it has."""
    whole = Window.partitionBy(F.lit(1))  # a row for each stratum
    base = cells.withColumn("base", F.least(F.col(size), F.lit(floor)))
    left = F.greatest(F.lit(total) - F.sum("base").over(whole), F.lit(0))
    spare = F.col(size) - F.col("base")
    quota = F.coalesce(F.try_divide(left.cast("double") * spare, F.sum(spare).over(whole)), F.lit(0.0))
    t = base.withColumn("quota", F.least(quota, spare.cast("double"))).withColumn("whole", F.floor("quota"))
    rest = t.withColumn("left", F.least(F.lit(total) - F.sum("base").over(whole), F.sum(F.col(size) - F.col("base")).over(whole)) - F.sum("whole").over(whole))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("quota") - F.col("whole"), 9)), name))
    rest = rest.withColumn("rank", rank)
    extra = F.when((F.col("rank") <= F.col("left")) & (F.col("base") + F.col("whole") < F.col(size)), 1).otherwise(0)
    return rest.select(name, size, (F.col("base") + F.col("whole") + extra).cast("long").alias("n_drawn"))


def mask_words(df: DataFrame, key: str, text: str, n: int, token: str = "[MASK]", seed: int = 42, protect: Column | None = None) -> DataFrame:
    """text with n words, those with the smallest hashes of key and place, replaced by a token; a null text stays null."""
    words = df.select(key, F.posexplode_outer(F.split(F.col(text), " ")).alias("pos", "w"))
    u = short_hash(F.concat_ws(":", F.col(key).cast("string"), F.col("pos").cast("string")), str(seed))
    ok = F.coalesce(F.col("w") != "", F.lit(False)) if protect is None else F.coalesce((F.col("w") != "") & ~protect, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.when(ok, u).otherwise(2.0), "pos"))
    t = words.withColumn("w", F.when(ok & (rank <= n), token).otherwise(F.col("w")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ")
    return t.groupBy(key).agg(F.when(F.max("pos").isNotNull(), whole).alias(text))


def balanced_group_split(df: DataFrame, group: str, label: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Splits that no group spans and that hold like shares of each label: groups are split within those of the same commonest label (the smaller of equals)."""
    cells = df.groupBy(F.col(group).alias("__g"), F.col(label).alias("__l")).agg(F.count("*").alias("n"))
    own = cells.groupBy("__g").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("__l"))).alias("m")).select("__g", F.col("m.__l").alias("__l"))
    split = stratified_split(own, "__l", "__g", shares, seed).select("__g", "split")
    return df.join(split, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def check_partition(df: DataFrame, splits: DataFrame, key: str = "record_id") -> None:
    """Raises unless a (key, split) table gives every row of df exactly one split and holds nothing else."""
    own = splits.groupBy(key).agg(F.count("*").alias("n"))
    t = df.select(key).distinct().withColumn("here", F.lit(True)).join(own, key, "full_outer")
    bad = t.agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("n").isNull()).alias("without"), F.count_if(F.col("here").isNull()).alias("unknown")).first()
    if any(bad):
        raise ValueError(f"splits: {bad['twice']} keys twice, {bad['without']} without, {bad['unknown']} unknown")


def top_ngrams(df: DataFrame, tokens: str, by: list[str], sizes: tuple[int, ...], top: int) -> DataFrame:
    """(by, ngram, n): the commonest runs of so many tokens in each group; ties by name."""
    runs = lambda k: F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))
    grams = df.select(*by, F.explode(F.concat(*(runs(k) for k in sizes))).alias("ngram")).groupBy(*by, "ngram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "ngram"))
    return grams.withColumn("rank", rank).where(F.col("rank") <= top)
