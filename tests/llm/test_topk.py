import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import topk

ROWS = "vec_id long, embedding array<double>, id long, v string, q int, d int"


def brute(rows, k, of=lambda i: i % 20 == 0):
    whole = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        whole[i] = min(whole.get(i, w), w)
    out = set()
    for q, v in whole.items():
        if of(q):
            scored = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(v, w)))), i) for i, w in whole.items() if i != q and len(w) == len(v))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 2048), (37, 5)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", blocks[1])
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(40)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 40) for i in range(60)]  # ties
    rows += [(400, None), (420, []), (440, [None] * 40), (460, [float("nan")] * 40), (480, [float("inf")] * 40), (500, [0.1, 0.2]), (520, [0.3, -0.2]), (None, [0.1] * 40)]
    rows += [(20, rows[20][1]), (40, [9.0] * 40)]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], ROWS)
    got = {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()}
    assert got == brute(rows, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(i, [1e7 + i, -1e7, 3.0]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], ROWS)
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()} == brute(rows, 5)


def test_bounds_prune():
    r = np.random.default_rng(1)
    x = np.floor(64 * r.normal(0, 1, (4000, 64)) * np.linspace(2, 0.1, 64))
    ids = np.arange(4000)
    q, found, score = topk.search(x[:10], ids[:10], x, ids, 20)
    for i in range(10):
        s = x @ x[i]
        s[i] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        assert found[20 * i : 20 * i + 20] == want.tolist() and score[20 * i : 20 * i + 20] == s[want].astype(int).tolist()


def test_components_beyond_64_bits(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) * 10.0 ** r.choice([0, 0, 3, 8, 17, 30]) for _ in range(6)]) for i in range(120)] + [(200, [3e8] * 6), (201, [1e30, -1e30, 1.0, 0.0, 0.0, 0.0]), (220, [-1e30, 1e30, 1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], ROWS)
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect()} == brute(rows, 7)
    wide = [(i, [float(np.float32(c)) if abs(c) < 1e38 else 1e30 for c in v]) for i, v in rows]
    as_floats = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in wide], ROWS.replace("array<double>", "array<float>"))
    assert {tuple(x) for x in topk.top_k(as_floats, F.col("vec_id") % 20 == 0, 7).collect()} == brute(wide, 7)


def test_norms_far_apart(spark):
    """Bands of small norms are left out, and negative best scores keep them in."""
    r = random.Random(10)
    rows = [(i, [r.gauss(0, 1) * 1.03 ** (i % 200) for _ in range(8)]) for i in range(600)] + [(1000, [-1.0] * 8)] + [(1001 + i, [5.0] * 8) for i in range(40) if (1001 + i) % 20]
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], ROWS)
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 20 == 0, 9).collect()} == brute(rows, 9)
