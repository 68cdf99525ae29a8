"""Exact top-k by inner product with columnar branch-and-bound.

Components become floor(64 * x). Candidates are dealt into bands by norm and, within a band, into blocks of bounded size by a hash
of their id; each block of queries meets each block of candidates in one task. There the candidates lie in vertical layout, one
dimension after another. For a query, products accumulate dimension block by dimension block; what a candidate can still gain is
bounded by the product of the remaining norms, and candidates whose bound is below the k-th best score known are compacted away.

The band of the greatest norms is searched first. Its k-th best score is a floor for each query: in the second step a query meets
only the bands whose greatest norm can reach it, and starts there from its floor. At most k rows for each query leave a block; a
last step ranks them.

Vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths do not meet.
Rows that repeat an id count once, with the smallest vector; rows without id take no part. Ties go to the smaller id. Scores are
exact integers; a score that 64 bits can't hold counts as the nearest that they can. A component whose 64-fold a double can't hold
counts as the largest double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidewell.llm.common import cut

CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK, DIMS_PER_STEP, BANDS = 16384, 8192, 16, 8
#: Vectors with norms up to this multiply exactly in doubles.
EXACT_NORM = 2.0**26
LEAST, MOST = -(2**63), 2**63 - 1


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, step: int = DIMS_PER_STEP, floors: np.ndarray | None = None) -> tuple[list, list, list]:
    """The k best candidates of each query within a block: query ids, candidate ids, scores. x and q are whole numbers as float64 with norms up to EXACT_NORM; floors are scores below which no candidate counts."""
    order = np.argsort(x_ids, kind="stable")  # then a stable sort by score leaves ties to smaller ids
    x, x_ids = x[order], x_ids[order]
    d = x.shape[1]
    vertical = np.ascontiguousarray(x.T)
    cuts = list(range(0, d, step))
    rest = lambda v: [np.sqrt((v[:, c:] ** 2).sum(1)) * (1 + 1e-9) for c in [*cuts[1:], d]]
    x_rest, q_rest = rest(x), rest(q)
    out: tuple[list, list, list] = ([], [], [])
    for i, own in enumerate(q_ids):
        v, alive = q[i], None
        partial = v[:step] @ vertical[:step]
        mine = np.searchsorted(x_ids, own)
        mine = int(mine) if mine < len(x_ids) and x_ids[mine] == own else -1
        if mine >= 0:
            partial[mine] = -np.inf
        floor = -np.inf if floors is None else floors[i]
        if len(x_ids) > 4 * k:
            # any k candidates give a k-th score that the result reaches; the best so far give a good one
            first = np.argpartition(partial, -2 * k)[-2 * k :]
            scores = v @ vertical[:, first[first != mine]]
            floor = max(floor, np.partition(scores, -k)[-k])
        for j, c in enumerate(cuts):
            if j:
                block = vertical[c : c + step]
                partial = partial + v[c : c + step] @ (block if alive is None else block[:, alive])
            if floor > -np.inf and j < len(cuts) - 1:
                bound = partial + (x_rest[j] if alive is None else x_rest[j][alive]) * q_rest[j][i]
                keep = np.flatnonzero(bound >= floor - 1e-6 * (1 + abs(floor)))
                alive, partial = keep if alive is None else alive[keep], partial[keep]
        alive = np.arange(len(x_ids)) if alive is None else alive
        keep = partial >= floor if mine < 0 else (partial >= floor) & (alive != mine)
        partial, alive = partial[keep], alive[keep]
        best = np.argsort(-partial, kind="stable")[:k]
        out[0].extend([int(own)] * len(best))
        out[1].extend(x_ids[alive[best]].tolist())
        out[2].extend(int(s) for s in partial[best])
    return out


def search_large(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """The same by whole numbers of any size, without bounds."""
    whole = lambda v: np.array([[int(c) for c in row] for row in v.tolist()], object).reshape(v.shape)
    wide_x, out = whole(x), ([], [], [])
    for own, v in zip(q_ids.tolist(), whole(q), strict=True):
        scored = sorted((-min(MOST, max(LEAST, s)), i) for s, i in zip((wide_x @ v).tolist(), x_ids.tolist(), strict=True) if i != own)[:k]
        out[0].extend([own] * len(scored))
        out[1].extend(i for _, i in scored)
        out[2].extend(-s for s, _ in scored)
    return out


def block_of(q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> list[list]:
    with np.errstate(over="ignore"):
        q_large, x_large = (np.sqrt((v**2).sum(1)) > EXACT_NORM for v in (q, x))
    parts = [search(q[~q_large], q_ids[~q_large], x[~x_large], x_ids[~x_large], k, floors=floors[~q_large]) if (~x_large).any() else ([], [], [])]
    if q_large.any():
        parts.append(search_large(q[q_large], q_ids[q_large], x, x_ids, k))
    if x_large.any():
        parts.append(search_large(q[~q_large], q_ids[~q_large], x[x_large], x_ids[x_large], k))
    return [sum((p[i] for p in parts), []) for i in range(3)]


def _searched(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each query in each block. candidates: d, band, c, b, id, v; queries: d, band, c, b, id, v, floor."""
    grid = candidates.withColumn("floor", F.lit(None).cast("double")).withColumn("q", F.lit(False)).unionByName(queries.withColumn("q", F.lit(True)))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        q = group["q"].combine_chunks().to_numpy(zero_copy_only=False)
        found = [[], [], []]
        if q.any() and not q.all():
            values = group["v"].combine_chunks().flatten().to_numpy().reshape(-1, group["d"][0].as_py())
            floors = group["floor"].combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
            ids = group["id"].to_numpy()
            found = block_of(values[q], ids[q], floors[q], values[~q], ids[~q], k)
        return pa.table([pa.array(f, pa.int64()) for f in found], names=["query_id", "vec_id", "score"])

    return grid.groupBy("d", "band", "c", "b").applyInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the column is_query holds, its k best others."""
    v = F.col(vector_col)
    times = lambda x: F.greatest(F.least(x * scale, F.lit(1.7e308)), F.lit(-1.7e308))
    whole = F.transform(v.cast("array<double>"), lambda x: F.when(F.abs(times(x)) < 2.0**52, F.floor(times(x)).cast("double")).otherwise(times(x)))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(v) > 0) & sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("d", F.size("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = cut(rows.withColumn("norm", norm), "vectors")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    edges = sorted({*rows.approxQuantile("norm", [i / BANDS for i in range(1, BANDS)], 0.01)}, reverse=True)
    band = F.aggregate(F.array(*map(F.lit, edges)), F.lit(0), lambda a, e: a + (F.col("norm") < e).cast("int")) if edges else F.lit(0)
    rows = rows.withColumn("band", band)  # 0 holds the greatest norms
    sizes = {r["band"]: (r["n"], r["top"]) for r in rows.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}  # at most BANDS rows
    n, n_queries = sum(s for s, _ in sizes.values()), rows.where("q").count()
    n_q = max(1, -(-n_queries // QUERIES_PER_BLOCK))
    blocks = {b: max(-(-s // CANDIDATES_PER_BLOCK), min(cores, -(-s // 2048)), 1) for b, (s, _) in sizes.items()}
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    count_of = lambda of: F.element_at(F.create_map(*(F.lit(x) for b in sorted(blocks) for x in (b, of(b)))), F.col("band"))
    others = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = rows.select("d", "band", block(count_of(blocks.get), 1).alias("c"), others(F.lit(n_q)).alias("b"), "id", "v")
    queries = rows.where("q").withColumn("b", block(F.lit(n_q), 2)).select("d", "b", "id", "v", "norm")
    ranked = lambda best: best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    first = queries.withColumn("band", F.lit(0)).withColumn("floor", F.lit(None).cast("double")).withColumn("c", others(count_of(blocks.get)))
    best = cut(ranked(_searched(dealt.where("band = 0"), first.select("d", "band", "c", "b", "id", "v", "floor"), k)), "first-best")
    if len(sizes) > 1:
        floors = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        bands = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(top).alias("top")) for b, (_, top) in sorted(sizes.items()) if b))
        reach = lambda t: F.col("floor").isNull() | (t["top"] * F.col("norm") * (1 + 1e-9) >= F.col("floor"))
        then = queries.join(floors, "id", "left").withColumn("t", F.explode(F.filter(bands, reach))).withColumn("band", F.col("t.band")).withColumn("c", others(count_of(blocks.get)))
        rest = _searched(dealt.where("band > 0"), then.select("d", "band", "c", "b", "id", "v", "floor"), k)
        best = ranked(best.drop("rank").unionByName(rest))
    return best.select("query_id", "rank", "vec_id", "score")
