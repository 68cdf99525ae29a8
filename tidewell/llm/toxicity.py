"""Toxicity by a classifier chain over the label columns of a table.

The chain predicts the columns one after another, the one that decides last: here quality, then toxic. Each link is a linear
(logistic) model on the presence of words and word beginnings, on beginnings that two or four different words share, and on the
probabilities of the columns before it. In training those are out-of-fold predictions, so that a later link sees earlier ones as
good as they will be on new texts; folds go by a hash of what a text holds, so that copies of a text are in one fold.

Models are fitted on a bounded sample of labelled documents (about PER_CLASS of either class of the deciding column, drawn by a
hash of the id, weighted back to their true shares; of an id with several texts the one with the smallest hash). The decision
threshold is that with the best F-half score out of fold. Every whole text is scored.

A null or empty text has probability 0 and is not toxic. Rows repeat as they are given. An id with several labels has the largest
of each column; where a column other than the deciding one is null, its link does not learn from that row, and rows without the
deciding label are not learned from. Columns that the labels lack are left out. Without labels of both classes nothing is toxic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import Memo, small

PER_CLASS, FOLDS, MOST_FEATURES, L1, STEPS = 1500, 5, 2048, 2e-4, 150
PREFIXES = (3, 4, 6)
#: What features of words leave out anyway: off before words are looked up, fewer are different.
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
LEVELS = (1, 2, 4)
#: Label columns in the order of the chain; the last decides.
LINKS = ("quality", "toxic")


def word_features(raw: str) -> tuple[int, ...]:
    """Hashes of the word and its beginnings; none for what has no letter."""
    word = raw.casefold() if raw.isalpha() else "".join(c for c in raw.casefold() if c.isalpha())
    if not word:
        return ()
    return tuple(zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in (word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)))


_STEP, _BACK = 2654435761, pow(2654435761, -1, 1 << 32)


def at_least(h: int, n: int) -> int:
    """The feature of n or more different words that share a feature."""
    return h if n == 1 else (h * _STEP + n * 40503) & 0xFFFFFFFF


def base(h: int, n: int) -> int:
    """The feature whose at_least(., n) is h."""
    return h if n == 1 else (h - n * 40503) * _BACK & 0xFFFFFFFF


def features(text: str, memo: Memo) -> np.ndarray:
    """Distinct feature hashes of a text, sorted: what its words have, and what several different words of it have."""
    counts: dict[int, int] = {}
    for own in {memo[raw] for raw in set(text.split())}:  # one for each different word
        for h in own:
            counts[h] = counts.get(h, 0) + 1
    return np.array(sorted({at_least(h, n) for h, c in counts.items() for n in LEVELS if c >= n}), np.uint32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Link:
    """L1 logistic regression on chosen features and the earlier probabilities."""

    def fit(self, rows: list[np.ndarray], before: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Link:
        every, at = np.unique(np.concatenate(rows), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        pos = np.bincount(at, weights=(y * weight)[owner], minlength=len(every)) / max(1e-9, (y * weight).sum())
        neg = np.bincount(at, weights=((1 - y) * weight)[owner], minlength=len(every)) / max(1e-9, ((1 - y) * weight).sum())
        df = np.bincount(at, minlength=len(every))
        gain = np.where(df >= 3, np.abs(pos - neg) / np.sqrt(pos + neg + 1e-4), 0)
        chosen = np.sort(np.argsort(-gain, kind="stable")[:MOST_FEATURES])
        self.known = every[chosen]
        place = np.full(len(every), -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((len(rows), len(chosen) + before.shape[1] + 1), np.float32)
        ok = place[at] >= 0
        x[owner[ok], place[at][ok]] = 1
        x[:, len(chosen) : -1] = before
        x[:, -1] = 1
        s = (weight / weight.sum()).astype(np.float32)
        v = np.ones(x.shape[1], np.float32)
        for _ in range(15):
            v = x.T @ (s * (x @ v))
            v /= np.linalg.norm(v)
        rate = 1 / (0.3 * float(np.linalg.norm(x.T @ (s * (x @ v)))) + 1e-9)
        w = u = np.zeros(x.shape[1], np.float32)
        t = 1.0
        for _ in range(STEPS):
            new = u - rate * (x.T @ (s * (sigmoid(x @ u) - y)))
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * L1, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            u, w, t = (new + (t - 1) / t2 * (new - w)).astype(np.float32), new, t2
        self.weights, self.before, self.bias = w[: len(chosen)].astype(float), w[len(chosen) : -1].astype(float), float(w[-1])
        return self

    def predict(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        return sigmoid(np.array([self.weights[np.isin(self.known, r, assume_unique=True)].sum() for r in rows]) + before @ self.before + self.bias)


def fit_chain(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[list[Link], np.ndarray, float]:
    """(links, out-of-fold probabilities, threshold). y has a column for each link, with nan where a label is unknown."""
    fold = np.array([zlib.crc32(r.tobytes()) % FOLDS for r in rows])
    out = np.zeros(y.shape)
    links = []
    pick = lambda mask: [r for r, m in zip(rows, mask, strict=True) if m]
    for c in range(y.shape[1]):
        known = ~np.isnan(y[:, c])
        fit = lambda mask: Link().fit(pick(mask), out[mask, :c], y[mask, c], weight[mask])  # noqa: B023, E731
        for f in range(FOLDS):
            own = fold == f
            if own.any() and (known & ~own).any():
                out[own, c] = fit(known & ~own).predict(pick(own), out[own, :c])
        links.append(fit(known))
    best, threshold = -1.0, 0.5
    for t in np.arange(0.1, 0.951, 0.05):
        hit = out[:, -1] >= t
        tp, got, all_pos = (weight * y[:, -1])[hit].sum(), weight[hit].sum(), (weight * y[:, -1]).sum()
        f = 1.25 * tp / (got + 0.25 * all_pos) if got else 0
        if f > best:
            best, threshold = f, float(t)
    return links, out, threshold


class Chain:
    """Links for scoring. The weights of each feature at all levels are one row of a table; words are looked up once and cached, and the rows of a batch of texts are summed as arrays."""

    def __init__(self, links: list[Link], threshold: float):
        self.n, self.threshold = len(links), threshold
        self.bias, self.before = np.array([k.bias for k in links]), [k.before for k in links]
        weight: dict[int, np.ndarray] = {}
        for c, link in enumerate(links):
            for h, w in zip(link.known.tolist(), link.weights, strict=True):
                if w:
                    weight.setdefault(h, np.zeros(self.n))[c] = w
        # a weight may belong to a feature at any level
        features_ = sorted({base(h, n) for h in weight for n in LEVELS})
        self.place = {h: i for i, h in enumerate(features_)}
        none = np.zeros(self.n)
        self.weights = np.array([[weight.get(at_least(h, n), none) for n in LEVELS] for h in features_]).reshape(-1, len(LEVELS), self.n)

    def word(self, raw: str) -> tuple[int, ...]:
        """The word's hash, and the places of those of its features that have weight at some level; nothing if none has."""
        own = word_features(raw)
        heavy = tuple(self.place[h] for h in own if h in self.place)
        return (own[0], *heavy) if heavy else ()

    def scores(self, texts: list[str | None], memo: Memo) -> np.ndarray:
        """A row of probabilities for each text; zeros for those without any character."""
        sizes, found = [], []
        for text in texts:
            own = list(chain.from_iterable(w[1:] for w in set(map(memo.__getitem__, {w.strip(EDGES) for w in set(text.split())})))) if text else []
            sizes.append(len(own))
            found.append(own)
        z = np.tile(self.bias, (len(texts), 1))
        flat = np.fromiter(chain.from_iterable(found), np.int64, sum(sizes))
        if len(flat):
            width = len(self.weights)
            pairs, count = np.unique(np.repeat(np.arange(len(texts)), sizes) * width + flat, return_counts=True)
            at, feature = pairs // width, pairs % width
            for i, n in enumerate(LEVELS):
                enough = count >= n
                for c in range(self.n):
                    z[:, c] += np.bincount(at[enough], self.weights[feature[enough], i, c], len(texts))
        p = np.zeros((len(texts), self.n))
        for c in range(self.n):
            p[:, c] = sigmoid(z[:, c] + p[:, :c] @ self.before[c])
        return np.where(np.array([bool(t) for t in texts], bool)[:, None], p, 0.0) if texts else p

    def score(self, text: str | None, memo: Memo) -> np.ndarray:
        return self.scores([text], memo)[0]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: tuple[str, ...] = LINKS, per_class: int = PER_CLASS) -> Chain | None:
    links = tuple(c for c in links if c in labels.columns)
    known = labels.where(F.col(id_col).isNotNull() & F.col(links[-1]).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max(c).cast("float").alias(f"y{i}") for i, c in enumerate(links)))
    y_last = F.col(f"y{len(links) - 1}")
    n = {r["y"]: r["n"] for r in known.groupBy((y_last > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}  # two rows
    if not n.get(0) or not n.get(1):
        return None
    share = {y: min(1.0, per_class / n[y]) for y in (0, 1)}
    drawn = known.where(F.pmod(F.xxhash64("id", F.lit(4)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.when(y_last > 0, share[1]).otherwise(share[0]))
    names = [f"y{i}" for i in range(len(links))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(word_features)
        for batch in small(batches):
            found = pa.array([features(t, memo).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], found], names=["id", *names, "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    read = texts.join(F.broadcast(drawn), "id").select("id", "text", *names).mapInArrow(run, f"id {kind}, {', '.join(f'{y} float' for y in names)}, f binary")
    # about 2 * per_class rows, one for each drawn id
    rows = read.groupBy("id").agg(F.min(F.struct(F.xxhash64("f").alias("h"), "f", *names)).alias("r")).select("id", "r.*").collect()
    rows = sorted((r for r in rows if len(r["f"])), key=lambda r: (r["h"], r["f"], str(r["id"])))
    y = np.array([[np.nan if r[c] is None else float(r[c] > 0) for c in names] for r in rows], np.float32).reshape(-1, len(links))
    if len(set(y[:, -1].tolist())) < 2:
        return None
    useful = [c for c in range(len(links)) if len(set(y[~np.isnan(y[:, c]), c].tolist())) == 2]  # a column with one value predicts nothing
    x = [np.frombuffer(r["f"], np.uint32) for r in rows]
    weight = np.array([1 / share[int(v)] for v in y[:, -1]])
    fitted, _, threshold = fit_chain(x, y[:, useful], weight)
    found = Chain(fitted, threshold)
    found.links = [links[c] for c in useful]
    return found


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: tuple[str, ...] = LINKS) -> DataFrame:
    """docs with p_<link> for each link of the chain (0 for one that could not be fitted) and is_<last link>; all other columns stay, but those of these names."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, links))  # at most MOST_FEATURES weights for each link
    new = [*(f"p_{k}" for k in links), f"is_{links[-1]}"]
    own = [c for c in docs.columns if c not in new]
    text_at = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        memo = Memo(found.word) if found else None
        for batch in small(batches):
            p = np.zeros((batch.num_rows, len(links)))
            flag = np.zeros(batch.num_rows, bool)
            if found:
                p[:, [links.index(c) for c in found.links]] = found.scores(batch.column(text_at).to_pylist(), memo)
                flag = p[:, -1] >= found.threshold
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(p[:, c]) for c in range(len(links))), pa.array(flag)], names=[*own, *new])

    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    source = docs.select(*(F.col(f"`{c}`") for c in own))
    return source.mapInArrow(run, StructType([*source.schema.fields, *(StructField(c, DoubleType()) for c in new[:-1]), StructField(new[-1], BooleanType())]))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: tuple[str, ...] = LINKS) -> DataFrame:
    """docs without the rows that the chain rejects; all columns stay as they are, whatever they are called."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, links))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        memo = Memo(found.word) if found else None
        for batch in small(batches):
            keep = found.scores(batch.column(text_at).to_pylist(), memo)[:, -1] < found.threshold if found else np.ones(batch.num_rows, bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
