"""Labelled data sets: builds with a count for every step, label matrices, mappings, splits and samples of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions import text as T
from tidewell.functions.stats import short_hash
from tidewell.operators import dedupe, sampling
from tidewell.operators.quality import check_records
from tidewell.sources.scratch import exists

#: Columns that every record has, in order; those of a data set follow.
UNIFIED = ("record_id", "source", "community", "created_at", "text_clean", "lang", "n_chars", "n_tokens_est")


def text_key(_: DataFrame) -> Column:
    return T.dedupe_key(F.col("text_clean"))


def finalised(df: DataFrame, extra: list[str]) -> DataFrame:
    """Unified columns (null where df has none) and then extra, with lengths; raises if personal data is left."""
    df = df.withColumns({"n_chars": F.char_length("text_clean"), "n_tokens_est": T.token_estimate(F.col("text_clean"))})
    out = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("timestamp" if c == "created_at" else "string").alias(c) for c in UNIFIED), *(c for c in extra if c not in UNIFIED))
    check_records(out)
    return out


class Steps:
    """Rows after each step of a build, as one small table."""

    def __init__(self):
        self.counts: list[DataFrame] = []

    def after(self, step: str, df: DataFrame) -> DataFrame:
        self.counts.append(df.agg(F.lit(len(self.counts)).alias("place"), F.lit(step).alias("step"), F.count("*").alias("rows")))
        return df

    def table(self) -> DataFrame:
        """(place, step, rows, dropped): rows after each step, and how many fewer than after the one before."""
        t = reduce(DataFrame.unionByName, self.counts)
        before = F.lag("rows").over(Window.partitionBy(F.lit(1)).orderBy("place"))  # a row for each step
        return t.withColumn("dropped", F.coalesce(before - F.col("rows"), F.lit(0)))


def without_empty(df: DataFrame) -> DataFrame:
    return df.where(F.char_length("text_clean") > 0)


def binary_set(df: DataFrame, label: str, group: str, steps: Steps, order: list[str], official: str = "official_split", validation: float = 0.15, seed: int = 42) -> DataFrame:
    """A binary set with a fixed test part.

    In train, equal texts are kept once, and not at all if their labels differ; train texts that test has go; train is split into
    train and validation by a hash of the group, which never spans both. Test stays as it is.
    """
    df = steps.after("not_empty", without_empty(steps.after("loaded", df)))
    train, test = df.where(F.col(official) == "train"), df.where(F.col(official) == "test")
    train = dedupe.drop_conflicting(train, text_key(train), [label], [F.col(c) for c in order])
    steps.after("train_text_once", train.unionByName(test))
    train = dedupe.without_matches(train, test, text_key)
    steps.after("train_text_not_in_test", train.unionByName(test))
    return sampling.group_split(train, group, {"train": 1 - validation, "validation": validation}, seed).unionByName(test.withColumn("split", F.lit("test")))


def label_ids(raw: Column) -> Column:
    """Comma-separated ids as an array of ints; what is no number is left out."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def multilabel_set(df: DataFrame, raw_labels: str, steps: Steps, official: str = "official_split") -> DataFrame:
    """Rows with their labels as an array and the official split as split; raises if ids repeat."""
    out = steps.after("not_empty", without_empty(steps.after("loaded", df))).withColumn("labels", label_ids(F.col(raw_labels))).withColumn("split", F.col(official))
    if out.groupBy("record_id").count().where("count > 1").limit(1).count():
        raise ValueError("record ids are not unique")
    return out


def cross_split_shared(df: DataFrame, split: str = "split") -> DataFrame:
    """(a, b, shared): texts that two splits share."""
    return dedupe.shared_keys(df.select(F.col(split).alias("set"), text_key(df).alias("key")), "set", "key")


def stressor_set(df: DataFrame, keep: list[str], labels: list[str], steps: Steps, order: list[str]) -> DataFrame:
    """Whitelisted columns of texts that are there once and whose labels agree."""
    keep = [c for c in keep if c in df.columns]
    df = steps.after("not_empty", without_empty(steps.after("loaded", df.select("record_id", "text_clean", *keep))))
    return steps.after("text_once", dedupe.drop_conflicting(df, text_key(df), labels, [F.col(c) for c in order]))


def pilot_set(files: list[DataFrame], steps: Steps, near: bool = False) -> DataFrame:
    """Rows of files in order (record_id, created_at, text_clean, drop_reason): what a file's own filters keep, the earliest copy of each text over all files (ties by file), and if asked for no near-duplicates of an earlier one."""
    df = reduce(DataFrame.unionByName, (f.withColumn("file_order", F.lit(i)) for i, f in enumerate(files)))
    df = steps.after("filtered", steps.after("loaded", df).where("drop_reason is null").drop("drop_reason"))
    df = steps.after("text_once", dedupe.keep_first(df, text_key(df), [F.col("created_at"), F.col("file_order"), F.col("record_id")]))
    if near:
        gone = dedupe.greedy_near_duplicates(df.select("record_id", F.col("text_clean").alias("text")), "record_id")
        df = steps.after("no_near_duplicate", df.join(gone, "record_id", "left_anti"))
    return df


def cross_platform_set(df: DataFrame, others: DataFrame, steps: Steps, order: list[str], contained_on: str = "reddit", n: int = 8, threshold: float = 0.8) -> DataFrame:
    """Rows (file, platform, record_id, text_clean, label) whose label is 0 or 1; in each file equal texts once, and not at all if their labels differ; without texts of another set, and on one platform without those that contain one of its texts."""
    df = steps.after("labelled", without_empty(steps.after("loaded", df)).where(F.col("label").isin(0, 1)))
    key = F.concat_ws("\n", "file", text_key(df))  # within a file
    df = steps.after("text_once_in_file", dedupe.drop_conflicting(df, key, ["label"], [F.col(c) for c in order]))
    df = steps.after("text_not_in_other", dedupe.without_matches(df, others, text_key))
    queries = others.select(F.col("record_id").alias("q"), F.col("text_clean").alias("text"))
    corpus = df.where(F.col("platform") == contained_on).select("record_id", F.col("text_clean").alias("text"))
    holding = dedupe.containment(queries, corpus, "q", "record_id", n, threshold).select("record_id").distinct()
    return steps.after("contains_no_other", df.join(holding, "record_id", "left_anti"))


def platform_recheck(df: DataFrame) -> DataFrame:
    """(platform, n_texts, n_conflicting, n_duplicated): texts of each platform, those with several labels and those that are there more than once."""
    groups = df.groupBy("platform", text_key(df).alias("k")).agg(F.count("*").alias("n"), F.countDistinct(F.struct("label")).alias("labels"))
    return groups.groupBy("platform").agg(F.count("*").alias("n_texts"), F.count_if(F.col("labels") > 1).alias("n_conflicting"), F.count_if(F.col("n") > 1).alias("n_duplicated"))


def overlap_sidecar(df: DataFrame, splits: list[str], split: str = "split") -> DataFrame:
    """record_id, split, text_in_<split> (whether another split has the text), exclude_for_test_sensitivity."""
    keyed = df.select("record_id", split, text_key(df).alias("k"))
    held = keyed.groupBy("k").agg(*(F.max((F.col(split) == s).cast("int")).alias(f"has_{s}") for s in splits))
    t = keyed.join(held, "k").withColumns({f"text_in_{s}": (F.col(f"has_{s}") == 1) & (F.col(split) != s) for s in splits})
    leaks = reduce(lambda a, b: a | b, (F.col(f"text_in_{s}") for s in splits if s != "test"))
    return t.select("record_id", split, *(f"text_in_{s}" for s in splits), ((F.col(split) == "test") & leaks).alias("exclude_for_test_sensitivity"))


def attach_split(df: DataFrame, splits: DataFrame) -> DataFrame:
    """df with the split of a saved (record_id, split) table; null where it has none."""
    return df.join(splits.select("record_id", "split"), "record_id", "left")


def locked_split(df: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], force: bool = False, key: str = "record_id") -> DataFrame:
    """The split (key, split) that lies at path, if it was made for the same keys; it is made and written where there is none. Other keys are an error, unless a new one is forced: then the old one stays beside it. No keys come to the driver."""
    spark = df.sparkSession
    mark = dedupe.set_fingerprint(df, key).first()["fingerprint"]
    if exists(spark, path):
        old = spark.read.parquet(path)
        if old.select("fingerprint").first()[0] == mark and not force:
            return old.select(key, "split")
        if not force:
            raise ValueError("the split was made for other records")
        old.write.mode("overwrite").parquet(f"{path.rstrip('/')}.old")
    new = make(df).select(key, "split").withColumn("fingerprint", F.lit(mark))
    sampling.check_partition(df, new, key)
    new.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select(key, "split")


def high_confidence(df: DataFrame, column: str = "confidence", least: float = 0.8) -> DataFrame:
    return df.where(F.col(column) >= least)


def leave_one_out(df: DataFrame, group: str, held_out: str, split: str = "split") -> DataFrame:
    """Train and validation without a group, and all of the group as test."""
    own = F.col(group).eqNullSafe(F.lit(held_out))
    return df.where(own | F.col(split).isin("train", "validation")).withColumn(split, F.when(own, "test").otherwise(F.col(split)))


# labels


def multi_hot(labels: Column, n: int) -> Column:
    """0 or 1 for each of n label ids."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(labels, i).cast("int"))


def check_labels(df: DataFrame, labels: str, n: int) -> None:
    """Raises if a row has no label, or one outside 0 to n - 1."""
    bad = df.agg(F.count_if(F.coalesce(F.size(labels), F.lit(0)) <= 0).alias("none"), F.count_if(F.exists(labels, lambda x: (x < 0) | (x >= n))).alias("outside")).first()
    if bad["none"] or bad["outside"]:
        raise ValueError(f"{bad['none']} rows have no label, {bad['outside']} have one outside 0 to {n - 1}")


def mapping_problems(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, problem) of a map (label, category): labels that are unknown, mapped more than once (duplicated), or not at all (unmapped)."""
    mapped = mapping.groupBy("label").agg(F.count("*").alias("n"))
    t = labels.select("label", F.lit(True).alias("known")).distinct().join(mapped, "label", "full_outer")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "unmapped").when(F.col("n") > 1, "duplicated")
    return t.select("label", problem.alias("problem")).where("problem is not null")


def check_mapping(mapping: DataFrame, labels: DataFrame) -> None:
    """Raises with all problems of a map at once."""
    if found := mapping_problems(mapping, labels).orderBy("problem", "label").limit(1000).collect():
        raise ValueError("; ".join(f"{r.label}: {r.problem}" for r in found))


def mapping_table(mapping: DataFrame, rows: DataFrame, label: str) -> DataFrame:
    """(label, class, category, sub, n): where each label goes, a class `category/sub` in its parts, and how many rows have it."""
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    parts = F.split("class", "/")
    return mapping.join(n, "label", "left").select("label", "class", parts[0].alias("category"), F.get(parts, F.lit(1)).alias("sub"), F.coalesce("n", F.lit(0)).alias("n"))


# samples


def gold_sample(df: DataFrame, total: int, floor: int, post: str = "post_id", stratum: str = "community", dev: float = 0.5, seed: int = 42) -> DataFrame:
    """total rows, one for each post, dealt over strata by largest remainders with a floor, halved into dev and test within each, in the order of their hashes (place)."""
    u = short_hash(F.col("record_id"), str(seed))
    one = dedupe.keep_first(df.withColumn("u", u), F.col(post), [F.col("u"), F.col("record_id")])
    wanted = sampling.largest_remainder(one.groupBy(F.col(stratum).alias("name")).agg(F.count("*").alias("size")), "name", "size", total, floor)
    drawn = sampling.per_cell(one.drop("u"), [stratum], "record_id", total, seed).join(wanted.select(F.col("name").alias(stratum), "n_drawn"), stratum)
    drawn = drawn.where(F.col("rank") <= F.col("n_drawn"))
    half = F.when(F.col("rank") <= F.round(F.col("n_drawn") * dev), "dev").otherwise("test")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("u", "record_id"))  # `total` rows
    return drawn.withColumns({"gold_split": half, "place": place}).drop("rank", "n_drawn", "u")


def sample_with_text(records: DataFrame, texts: DataFrame, flag: str, n: int, seed: int = 42) -> DataFrame:
    """The n flagged records with the smallest hashes, with their texts."""
    meta = sampling.smallest_hashes(records.where(F.col(flag)), "record_id", n, seed).drop("u")
    return texts.join(F.broadcast(meta), "record_id") if n <= dedupe.MOST_BROADCAST else texts.join(meta, "record_id")


def texts_of_flagged(texts: DataFrame, records: DataFrame, flag: str) -> DataFrame:
    """Texts of the flagged records."""
    return texts.join(records.where(F.col(flag)).select("record_id").distinct(), "record_id", "left_semi")


def with_meta(assigned: DataFrame, records: DataFrame) -> DataFrame:
    """Topic counts by date and community: assignments (record_id, topic_id) joined with what is known of their records."""
    return assigned.join(records.select("record_id", F.to_date("date").alias("date"), "community"), "record_id").groupBy("date", "community", "topic_id").agg(F.count("*").alias("n"))


def date_range(start: str, end: str) -> tuple[Column, Column]:
    """[start, end) as dates; a bound without a day is a month, and such an end counts with all of it."""
    day = lambda s: F.to_date(F.lit(s if len(s) > 7 else f"{s}-01"))
    return day(start), day(end) if len(end) > 7 else F.add_months(day(end), 1)


# annotation sheets


def sheet_labels(df: DataFrame, key: str, categories: list[str], none: str) -> DataFrame:
    """A hand-filled sheet as 0 or 1 for each column (blank is 0; 1, x, y and yes are 1), annotated (any is 1), and problems: cells with anything else, and `none` beside a category."""
    value = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    one, zero = ("1", "1.0", "x", "y", "yes"), ("", "0", "0.0")
    columns = [*categories, none]
    t = df.select(key, *(value(c).isin(*one).cast("int").alias(c) for c in columns), F.filter(F.array(*(F.when(~value(c).isin(*one, *zero), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns)), lambda x: x.isNotNull()).alias("odd"))
    total = reduce(lambda a, b: a + b, (F.col(c) for c in categories))
    clash = F.when((F.col(none) == 1) & (total > 0), F.array(F.lit(f"{none} beside a category"))).otherwise(F.array().cast("array<string>"))
    return t.select(key, *columns, (total + F.col(none) > 0).alias("annotated"), F.concat("odd", clash).alias("problems"))


def sheet_status(labels: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """Rows, annotated rows, problems and positives of each column, by split."""
    return labels.groupBy(split).agg(F.count("*").alias("rows"), F.count_if("annotated").alias("annotated"), F.sum(F.size("problems")).alias("n_problems"), *(F.count_if((F.col(c) == 1) & F.col("annotated")).alias(f"n_{c}") for c in columns))


def handcheck_sheet(df: DataFrame, names: list[str], thresholds: dict[str, float], label: str, n: int, top: int = 3, seed: int = 42) -> DataFrame:
    """n rows, half of either label, with their scrubbed text, the top labels with their scores and all labels above their thresholds as strings, and an empty column to fill."""
    drawn = sampling.per_cell(df, [label], "record_id", n // 2, seed).drop("rank", "u")
    scored = F.array(*(F.struct((-F.round(F.col(f"p__{c}"), 6)).alias("s"), F.lit(c).alias("n")) for c in names))
    best = F.slice(F.array_sort(scored), 1, top)
    above = F.filter(F.array(*(F.when(F.col(f"p__{c}") >= t, F.lit(c)) for c, t in thresholds.items())), lambda x: x.isNotNull())
    shown = F.array_join(F.transform(best, lambda x: F.concat(x["n"], F.lit(" ("), F.format_number(-x["s"], 2), F.lit(")"))), ", ")
    return drawn.select("record_id", label, T.scrub_text(F.col("text_clean")).alias("text"), shown.alias("top_labels"), F.when(F.size(above) > 0, F.array_join(above, ", ")).otherwise("(none)").alias("above_threshold"), F.lit("").alias("plausible"))


def machine_labels(df: DataFrame, categories: list[str], threshold: float, named: Column) -> Column:
    """Labels from entailment scores: the categories that reach the threshold; else other_unclear where something else is named, and none_unclear where nothing is."""
    hit = F.filter(F.array(*(F.when(F.col(f"p__{c}") >= threshold, F.lit(c)) for c in categories)), lambda x: x.isNotNull())
    return F.when(F.size(hit) > 0, hit).when(F.coalesce(named, F.lit(False)), F.array(F.lit("other_unclear"))).otherwise(F.array(F.lit("none_unclear")))
