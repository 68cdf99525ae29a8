"""Statistical column expressions: intervals, suppression, hash uniforms, ranks and running totals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

Z95 = 1.959963984540054


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval for k of n, within [0, 1]; null at n = 0."""
    k, n, z2 = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0)), F.lit(z * z)
    p = k / n
    centre, scale = p + z2 / (2.0 * n), 1.0 + z2 / n
    half = F.lit(z) * F.sqrt(F.greatest(p * (1.0 - p) / n + z2 / (4.0 * n * n), F.lit(0.0)))
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return clip((centre - half) / scale), clip((centre + half) / scale)


def suppress(df: DataFrame, n_col: str, k_min: int, blank: Iterable[str], extra: Column | None = None) -> DataFrame:
    """Blanks n_col and the columns of blank where a group is smaller than k_min (or extra holds), and says so in `suppressed`. A null count is not small."""
    small = F.coalesce(F.col(n_col) < k_min, F.lit(False))
    if extra is not None:
        small = small | F.coalesce(extra, F.lit(False))
    df = df.withColumn("suppressed", small)
    return df.withColumns({c: F.when(~F.col("suppressed"), F.col(c)) for c in dict.fromkeys([n_col, *blank]) if c in df.columns})


def unit_hash(key: Column, seed: int) -> Column:
    """Uniform in [0, 1): the first eight bytes of sha256("seed:key"), little-endian, over 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
    swapped = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def short_hash(key: Column, salt: str) -> Column:
    """Uniform in [0, 1) from twelve hex digits of sha256("salt:key"): exact in a double."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 12), 16, 10).cast("bigint").cast("double") / F.lit(float(2**48))


#: Cumulative Poisson(1) probabilities, for draws by inversion.
POISSON1 = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson1(u: Column) -> Column:
    """A Poisson(1) draw (at most 8) from a uniform."""
    return F.size(F.filter(F.array(*(F.lit(p) for p in POISSON1)), lambda p: p <= u)).cast("double")


def running(scores: DataFrame, score: str, sums: Iterable[str], bins: int = 256) -> DataFrame:
    """scores (one row per score) with before_<c>, the total of c over smaller scores.

    Scores are dealt into bins that hold about as many each, whatever their distribution; each bin is summed on its own and the
    table of bins, of fixed size, gives what lies before it. No window spans the table.
    """
    from pyspark.ml.feature import Bucketizer

    sums = list(sums)
    edges = sorted({*scores.approxQuantile(score, [i / bins for i in range(1, bins)], 1 / (4 * bins))} - {float("inf"), float("-inf")})
    if edges:
        binned = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=score, outputCol="bin", handleInvalid="keep").transform(scores)
    else:
        binned = scores.withColumn("bin", F.lit(0.0))
    whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = binned.groupBy("bin").agg(*(F.sum(c).alias(f"o_{c}") for c in sums)).select("bin", *(F.coalesce(F.sum(f"o_{c}").over(whole), F.lit(0)).alias(f"o_{c}") for c in sums))
    own = Window.partitionBy("bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    out = binned.join(F.broadcast(offsets), "bin")  # at most bins + 1 rows
    return out.withColumns({f"before_{c}": F.col(f"o_{c}") + F.coalesce(F.sum(c).over(own), F.lit(0)) for c in sums}).drop("bin", *(f"o_{c}" for c in sums))


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, so that sums in another order print alike."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def period_start(ts: Column, granularity: str) -> Column:
    """First day of the day, ISO week or month of an instant (UTC)."""
    if granularity not in ("day", "week", "month"):
        raise ValueError(f"granularity must be day, week or month, not {granularity!r}")
    return F.date_trunc(granularity, ts).cast("date")
