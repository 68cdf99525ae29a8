"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three lower-case characters are hashed into BUCKETS places. Document frequencies come from all texts that may
be learned from. The weights are trained with follow-the-regularised-leader and elastic-net penalties on a bounded sample
(about PER_LANG texts of each language, drawn by a hash of id and text; equal rows count once), and a temperature is fitted on a fifth of it that the weights
never saw. Prediction reads every whole text.

A null text, or one without a letter, is `und` with score 0. Rows without id or lang are predicted but not learned from; an
empty table, or one with nothing to learn from, gives `und` throughout. Rows repeat as they are given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import small

BITS = 14
BUCKETS = 1 << BITS
PER_LANG, EPOCHS = 600, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
_M = np.uint32(0x9E3779B1)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a text."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    grams = c * np.uint32(0x85EBCA6B)
    for n in (1, 2, 3):
        if n > 1:
            grams = grams[:-1] * np.uint32(0xC2B2AE35) + c[n - 1 :]
        if len(grams):
            h = (grams ^ (grams >> np.uint32(15))) * _M
            out += np.bincount(h >> np.uint32(32 - BITS), minlength=BUCKETS)
    at = np.flatnonzero(out)
    return at, out[at]


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(n) * idf[at]
    return v / (np.sqrt(v @ v) or 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (BUCKETS, n_classes) by FTRL-proximal."""
    z, g2 = np.zeros((BUCKETS, n_classes)), np.zeros((BUCKETS, n_classes))

    def weights(z, g2):
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2), 0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zi, gi = z[at], g2[at]
            w = weights(zi, gi)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            new = gi + g * g
            z[at] = zi + g - (np.sqrt(new) - np.sqrt(gi)) / ALPHA * w
            g2[at] = new
    return weights(z, g2)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """That with the least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(softmax(logits / math.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, r = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    for _ in range(40):
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    return math.exp((lo + hi) / 2)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(texts, documents by bucket), over all texts. Each task sums its own; at most BUCKETS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    df[counts(text)[0]] += 1
                    n += 1
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return int(out[BUCKETS]), out[:BUCKETS]


def fit(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """(languages, idf, weights, temperature), or None if there is nothing to learn from."""
    known = docs.where(learnable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not share:
        return None
    langs = sorted(share)
    n_docs, df = document_frequencies(known.select("text"))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.lit(False)
    for lang, p in share.items():
        drawn = drawn | ((F.col("lang") == lang) & (draw < p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f[i].astype(np.int32).tobytes() for f in found], pa.binary()) for i in (0, 1))], names=["id", "lang", "at", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    sample = known.where(drawn).mapInArrow(run, f"id {kind}, lang string, at binary, n binary").dropDuplicates().collect()  # about per_lang rows for each language
    sample.sort(key=lambda r: (r["id"], r["lang"], r["at"], r["n"]))
    sample = [r for r in sample if len(r["at"])]
    rows = [(at := np.frombuffer(r["at"], np.int32), tfidf(at, np.frombuffer(r["n"], np.int32), idf)) for r in sample]
    y = np.array([langs.index(r["lang"]) for r in sample])
    aside = np.arange(len(rows)) % 5 == 4
    w = train([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], len(langs))
    t = temperature(np.array([x @ w[at] for (at, x), a in zip(rows, aside, strict=True) if a]), y[aside]) if aside.any() else 1.0
    return langs, idf, w, t


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score. Learns from rows for which held_out is false."""
    flag = F.coalesce(held_out, F.lit(False))
    model = fit(docs, held_out.isNotNull() & ~flag, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model and (model[0], model[1].astype(np.float32), model[2].astype(np.float32), model[3]))  # BUCKETS by languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small(batches):
            langs, scores = [], []
            for text in batch.column(2).to_pylist():
                if own is None or not text or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                names, idf, w, t = own
                at, n = counts(text)
                p = softmax(tfidf(at, n, idf).astype(np.float32) @ w[at] / t)
                best = int(np.argmax(p))
                langs.append(names[best])
                scores.append(min(1.0, float(p[best])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, flag.alias("held_out"), text_col).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
