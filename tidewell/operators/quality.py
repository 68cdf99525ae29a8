"""Audits of data sets: volumes, distributions, duplicates, missing values, privacy and publishability."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tidewell.functions.stats import ratio

#: Names that a table of records, or a published aggregate, must not have.
FORBIDDEN_RECORD = re.compile(r"(?i)^(author.*|user.*|username|screen_name|.*_url|url|permalink)$")
FORBIDDEN_AGGREGATE = re.compile(r"(?i)^(record_id|id|text|text_clean|texts?_raw|body|selftext|title|author\w*|user\w*|username|post_id|doc\w*|representative\w*)$")
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    qs = F.percentile(col, F.array(*(F.lit(p) for p in PERCENTILES)))
    t = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"), qs.alias("q"))
    return t.select("n", "mean", "std", "min", "max", *(F.col("q")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(PERCENTILES)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share). The total is a sum over the counted values, joined back as one row."""
    t = df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("<NA>")).alias("value")).agg(F.count("*").alias("n"))
    return t.join(F.broadcast(t.agg(F.sum("n").alias("total")))).select("value", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def volumes(df: DataFrame, period, by: str) -> DataFrame:
    return df.groupBy(period.alias("period"), by).agg(F.count("*").alias("n"))


def length_histogram(df: DataFrame, length, width: int = 500) -> DataFrame:
    return df.groupBy((F.floor(length / width) * width).alias("bin_start")).agg(F.count("*").alias("n"))


def missing_text(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(col).isNull()).alias("n_null"), F.count_if(F.trim(F.col(col)) == "").alias("n_empty"))


def null_overview(df: DataFrame) -> DataFrame:
    """(column, type, nulls), in one pass."""
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_null")) for c, t in df.dtypes))
    return df.agg(items.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))


def label_pairs(df: DataFrame, labels: str) -> DataFrame:
    """How many rows have both of two labels; rows are packed by their set of labels first."""
    packed = df.groupBy(F.array_sort(F.array_distinct(labels)).alias("s")).agg(F.count("*").alias("n"))
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return packed.select("n", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def labels_per_row(df: DataFrame, labels: str) -> DataFrame:
    return df.groupBy(F.size(labels).alias("n_labels")).agg(F.count("*").alias("n"))


def shape_shares(df: DataFrame, text: str) -> DataFrame:
    share = lambda p: F.avg(F.col(text).rlike(p).cast("double"))
    return df.agg(share("[A-Z]").alias("upper"), share("[.!?]").alias("sentence_end"), share(r"\n").alias("newline"), share("(http|www)").alias("url_like"))


def drop_accounting(reasons: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Rows by reason; kept rows have none."""
    return reasons.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def check_accounting(counts: DataFrame, rows_in: int) -> None:
    """Raises unless every row that came in was kept or dropped for a reason."""
    seen = counts.agg(F.sum("n")).first()[0] or 0
    if seen != rows_in:
        raise ValueError(f"{rows_in} rows came in, but {seen} are accounted for")


def check_records(df: DataFrame, text: str = "text_clean") -> None:
    """Raises if a table of records has a column that may name a person, or texts in which personal data survives."""
    from tidewell.functions import text as T

    if bad := [c for c in df.columns if FORBIDDEN_RECORD.match(c)]:
        raise ValueError(f"columns that may name a person: {bad}")
    bare = F.regexp_replace(text, T.PLACEHOLDER, " ")
    left = df.agg(*(F.count_if(bare.rlike(f"(?U){p}")) for p in (T.EMAIL, T.URL, T.MENTION))).first()
    if sum(left):
        raise ValueError(f"personal data is left in {sum(left)} texts")


def check_publishable(df: DataFrame, k_min: int, counts: list[str]) -> None:
    """Raises if an aggregate could hold identifiers or text, or shows a count below k_min."""
    if bad := [c for c in df.columns if FORBIDDEN_AGGREGATE.match(c)]:
        raise ValueError(f"columns that may identify records: {bad}")
    strings = [c for c, t in df.dtypes if t == "string"]
    row = df.agg(F.lit(0).alias("z"), *(F.max(F.char_length(c)).alias(f"s_{c}") for c in strings), *(F.count_if(F.col(c) < k_min).alias(f"c_{c}") for c in counts)).first()
    if long := [c for c in strings if (row[f"s_{c}"] or 0) > 200]:
        raise ValueError(f"columns with strings of over 200 characters: {long}")
    if low := [c for c in counts if row[f"c_{c}"]]:
        raise ValueError(f"columns with counts below {k_min}: {low}")


def length_stats(df: DataFrame, key: str, text: str, thresholds: tuple[int, ...], sample: int, seed: int = 42) -> DataFrame:
    """(measure, n, mean, std, min, max, percentiles, over_<threshold>): lengths in characters of all texts, and in tokens of a hash sample with the share over each threshold (null for characters)."""
    from tidewell.functions.text import token_estimate
    from tidewell.operators.sampling import smallest_hashes

    known = df.where(F.col(text).isNotNull())
    chars = describe_numeric(known.select(F.char_length(text).alias("n")), "n").withColumns({"measure": F.lit("chars"), **{f"over_{t}": F.lit(None).cast("double") for t in thresholds}})
    drawn = smallest_hashes(known.select(key, text), key, sample, seed).select(token_estimate(F.col(text)).alias("n"))
    shares = drawn.agg(*(F.avg((F.col("n") > t).cast("double")).alias(f"over_{t}") for t in thresholds))
    tokens = describe_numeric(drawn, "n").withColumn("measure", F.lit("tokens")).join(F.broadcast(shares))  # one row each
    return chars.unionByName(tokens)


def length_relation(df: DataFrame, a, b) -> DataFrame:
    """(pearson, median_ratio) of two measures of the same rows."""
    t = df.select(a.cast("double").alias("a"), b.cast("double").alias("b"))
    return t.agg(F.corr("a", "b").alias("pearson"), F.median(F.try_divide("a", "b")).alias("median_ratio"))


def tabular_audit(df: DataFrame) -> DataFrame:
    """(column, type, n_null, n_unique, min, max, mean_chars), in one pass; min and max of numbers, mean_chars of strings."""
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    text = {c for c, t in df.dtypes if t == "string"}

    def item(c: str, t: str):
        col, none = F.col(f"`{c}`"), F.lit(None).cast("double")
        return F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(col.isNull()).alias("n_null"), F.count_distinct(col).alias("n_unique"), *((f(col).cast("double") if c in numeric else none).alias(n) for n, f in (("min", F.min), ("max", F.max))), (F.avg(F.char_length(col)) if c in text else none).alias("mean_chars"))

    return df.agg(F.array(*(item(c, t) for c, t in df.dtypes)).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def row_audit(df: DataFrame) -> DataFrame:
    """(n, duplicate_rows, missing_total, all_numeric) of a whole table; rows are packed by their digest first."""
    rows = df.select(F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)))), 256).alias("k"), sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0)).alias("missing"))
    t = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"))
    numeric = all(k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal") for _, k in df.dtypes)
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_total"), F.lit(numeric).alias("all_numeric"))


def free_text_columns(audit: DataFrame, least: float = 30.0) -> DataFrame:
    """Columns of a tabular_audit whose strings are over `least` characters long on average."""
    return audit.where(F.col("mean_chars") > least).select("column")


def guess_text_and_label(df: DataFrame) -> DataFrame:
    """(text_column, label_column): the string column with the longest values, and the first column that holds 0 and 1 and nothing else."""
    order = {c: i for i, c in enumerate(df.columns)}
    t = tabular_audit(df).withColumn("place", F.create_map(*(F.lit(x) for c, i in order.items() for x in (c, i)))[F.col("column")])
    text = F.max(F.when(F.col("mean_chars").isNotNull(), F.struct("mean_chars", (-F.col("place")).alias("p"), "column")))["column"]
    binary = (F.col("n_unique") == 2) & (F.col("min") == 0) & (F.col("max") == 1)
    label = F.min(F.when(binary, F.struct("place", "column")))["column"]
    return t.agg(text.alias("text_column"), label.alias("label_column"))


#: Names by which columns of a header are told apart, and beginnings of names of features.
HEADER_KINDS = {"text": ("post", "text", "body", "selftext", "title"), "date": ("date", "created_utc", "timestamp", "time"), "id": ("id", "post_id", "postid", "name", "link_id")}
FEATURE_PREFIXES = ("liwc_", "tfidf_", "sent_", "n_")


def classify_header(columns: list[str], author_fields: frozenset[str]) -> dict[str, list[str]]:
    """Columns of a header by kind: feature, text, date, id, author; other is all that is none of these."""
    kinds: dict[str, list[str]] = {k: [c for c in columns if c.lower() in names] for k, names in HEADER_KINDS.items()}
    kinds["feature"] = [c for c in columns if c.startswith(FEATURE_PREFIXES)]
    kinds["author"] = [c for c in columns if c.lower() in author_fields]
    seen = {c for own in kinds.values() for c in own}
    return kinds | {"other": [c for c in columns if c not in seen]}


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; raises if it has more rows than a report should."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(map(cell, df.columns)) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_report(path, title: str, parts: dict[str, DataFrame]) -> None:
    """Small tables under their headings as one Markdown file, and each as a CSV sheet beside it."""
    import csv
    from pathlib import Path

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    text = [f"# {title}", ""]
    for name, df in parts.items():
        text += [f"## {name}", "", markdown_table(df), ""]
        with path.with_name(f"{path.stem}-{name}.csv").open("w", newline="") as f:
            out = csv.writer(f)
            out.writerow(df.columns)
            out.writerows(df.collect())
    path.write_text("\n".join(text))
