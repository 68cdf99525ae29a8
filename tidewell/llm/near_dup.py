"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its sequence of words (case-folded, letters and digits only); its k-mers are runs of five words, each labelled with
how often it has occurred before. Each of N_SKETCHES sketches takes the PER_SKETCH labelled k-mers with the smallest hashes
and keeps them in text order; texts that agree in a sketch are candidates. A pair counts as near-duplicate if an alignment of
the words within a band leaves at least 0.8 of their k-mers in common: M / (n1 + n2 - M) >= 0.8, M the k-mers inside aligned runs.

Equal texts are one node from the start. In each bucket only pairs with two leaders are aligned, whatever its size; buckets
that then still hold several classes are taken apart exactly: by prefixes of their labelled k-mers, rarest first, of which two
texts with that similarity must share one, and by signatures that bound how far two texts differ. A pair that shares several such
k-mers leaves the join at the first of them only. Classes are connected components of the verified links. No step collects a group;
tables of leaders are written before they are joined, so that the adaptive planner can split the rows of a hot bucket.

Null texts count as empty; equal texts (empty ones too) are one class. Texts of fewer than five words match equal texts only.
Rows without id take no part (near_duplicates leaves them out, drop_near_duplicates keeps them). Rows that share an id are one
document: their texts fall into one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewell.llm.common import Memo, cut, discard, small
from tidewell.llm.decontaminate import token_hash, tokens

K, N_SKETCHES, PER_SKETCH, SIMILARITY = 5, 18, 3, 0.8
#: Groups of up to this many texts that share a rare k-mer are compared as they are; leaders are tried first in larger ones.
SMALL_GROUP, LEADERS = 32, (3, 4, 5)
#: Longs of a text's signature: bit i is the parity of the number of labelled k-mers with hash i. Each k-mer that only one of two
#: texts has flips one bit, so that the bits in which they differ never exceed the k-mers in which they do.
SIGNATURE = 16
MARKS = [f"m{i}" for i in range(SIGNATURE)]
#: Each k-mer of a prefix carries so many that come before it. A pair that shares one of those has met there already; a pair whose
#: earlier common k-mers all lie further back meets again, which costs a row and changes nothing.
LOOK_BACK = 8
BEFORE = [f"p{i}" for i in range(LOOK_BACK)]
#: Words whose hashes a task keeps.
MOST_WORDS = 100_000
_A = np.array([(0xD1342543DE82EF95 * (2 * i + 1)) & (2**64 - 1) | 1 for i in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def kmers(toks: np.ndarray) -> np.ndarray:
    n = len(toks) - K + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(K):
        out += toks[i : i + n] * _A[i]
    return mix(out)


def labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of k-mers with their occurrence numbers: all different."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    occ = np.empty(len(h), np.uint64)
    occ[order] = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return np.where(occ == 0, h, mix(h + occ * _A[40]))


def signature(toks: np.ndarray) -> np.ndarray:
    h = labelled(kmers(toks))
    odd = np.bincount((h * _A[50] >> np.uint64(40)).astype(np.int64) % (64 * SIGNATURE), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(toks: np.ndarray) -> np.ndarray:
    """N_SKETCHES hashes, or none for a text without k-mers."""
    h = kmers(toks)
    if not len(h):
        return np.empty(0, np.int64)
    g, l = labelled(h), min(PER_SKETCH, len(h))
    v = (g[None, :] ^ _A[:N_SKETCHES, None]) * _A[41]
    v ^= v >> np.uint64(32)
    v *= _A[42]
    at = np.sort(np.argpartition(v, l - 1, axis=1)[:, :l] if l < len(h) else np.tile(np.arange(l), (N_SKETCHES, 1)), axis=1)
    out = np.arange(1, N_SKETCHES + 1, dtype=np.uint64) * _A[43]
    for j in range(l):
        out = mix(out * _A[44 + j] + h[at[:, j]])
    return out.view(np.int64)


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """K-mers inside the runs of an alignment of two token sequences with the fewest substitutions, insertions and deletions, or -1 if that leaves the band that the similarity allows."""
    n, m = len(a), len(b)
    top = min(n, m)
    head = int(np.argmin(np.append(a[:top] == b[:top], False)))
    total = n + m - 2 * (K - 1)
    most = int(total / 9) + 1  # each edit costs a k-mer or more of either text, of which (1 - s) / (1 + s) may go
    if abs(n - m) > most:
        return -1
    width = 2 * most + 3
    goal = m - n + most + 1
    reach = np.full(width, -(1 << 40), np.int64)  # furthest place in a on the diagonal b - a = i - most - 1
    score = np.zeros(width, np.int64)
    reach[most + 1], score[most + 1] = head, max(0, head - K + 1)
    diag = np.arange(width) - most - 1
    for d in range(1, most + 2):
        if reach[goal] >= n:
            return int(score[goal])
        if d > most:
            break
        lo, hi = most + 1 - d, most + 2 + d
        window = slice(lo, hi)
        # substitution stays on the diagonal, insertion comes from the one before, deletion from the one after
        options = np.stack([reach[window] + 1, reach[lo - 1 : hi - 1], reach[lo + 1 : hi + 1] + 1])
        scores = np.stack([score[window], score[lo - 1 : hi - 1], score[lo + 1 : hi + 1]])
        best = np.lexsort((scores, options), axis=0)[-1]
        x = np.take_along_axis(options, best[None], 0)[0]
        s = np.take_along_axis(scores, best[None], 0)[0]
        limit = np.minimum(n, m - diag[window])
        x = np.where((x < 0) | (x > limit) | (x + diag[window] < 0), -(1 << 40), x)
        start = x.copy()
        live = np.flatnonzero((x >= 0) & (x < limit))
        while len(live):
            if len(live) <= 3:
                for i in live.tolist():
                    p, e, k, size = int(x[i]), int(limit[i]), int(diag[lo + i]), 64
                    while p < e:
                        q = min(e, p + size)
                        off = a[p:q] != b[p + k : q + k]
                        if off.any():
                            p += int(np.argmax(off))
                            break
                        p, size = q, size * 4
                    x[i] = p
                break
            live = live[a[x[live]] == b[x[live] + diag[lo + live]]]
            x[live] += 1
            live = live[x[live] < limit[live]]
        reach[window], score[window] = x, s + np.maximum(0, x - start - K + 1)
    return -1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n, m = len(a) - K + 1, len(b) - K + 1
    if n <= 0 or m <= 0 or min(n, m) < SIMILARITY * max(n, m):
        return False
    if n == m and np.array_equal(a, b):
        return True
    shared = len(np.intersect1d(labelled(kmers(a)), labelled(kmers(b)), assume_unique=True))
    enough = lambda c: c >= SIMILARITY * (n + m - c) - 1e-9
    return enough(shared) and enough(in_common(a, b))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with an id: id, text, key (a digest that equal texts share)."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.sha2("text", 256))


def _sketched(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(token_hash, MOST_WORDS)
        for batch in small(batches):
            n, found, marks = [], [], []
            for text in batch.column(1).to_pylist():
                toks = tokens(text, memo)
                n.append(max(0, len(toks) - K + 1))
                found.append(sketches(toks))
                marks.append(signature(toks))
            own = np.array(marks, np.int64).reshape(-1, SIGNATURE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64())), *(pa.array(own[:, i]) for i in range(SIGNATURE))], names=["id", "key", "n", "omh", *MARKS])

    return rows.mapInArrow(run, "id long, key string, n int, omh array<bigint>, " + ", ".join(f"{m} long" for m in MARKS))


def _sequences(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(token_hash, MOST_WORDS)
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokens(t, memo).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "seq"])

    return rows.select("id", "text").mapInArrow(run, "id long, seq binary")


def _as_tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.uint64)


def _verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield batch.filter(pa.array([similar(_as_tokens(x.as_py()), _as_tokens(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())).select(["a", "b"])

    both = pairs.join(sequences.select(F.col("id").alias("b"), F.col("seq").alias("y")), "b").join(sequences.select(F.col("id").alias("a"), F.col("seq").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label): each linked node with the smallest id of its component.

    In each round every node takes the neighbour, or itself, with most links (ties by hash), and the links then run between what
    was taken. A star is one node after a round, and of a path a fixed share is left, so that links shrink geometrically.
    """
    edges = cut(links.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("to"))).where("id <> to").distinct(), "links")
    steps = []
    while True:
        degrees = cut(edges.groupBy("id").agg(F.count("*").alias("degree")), "degrees")
        order = lambda node: F.struct((-F.col("degree")).alias("d"), F.xxhash64(node).alias("h"), F.col(node).alias("node"))
        nearest = edges.join(degrees.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min(order("to")).alias("nearest"))
        steps.append(cut(degrees.join(nearest, "id").select("id", F.least(order("id"), "nearest")["node"].alias("label")), "labels"))
        taken = lambda end: steps[-1].select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        done = edges
        edges = cut(edges.join(taken("id"), "id").join(taken("to"), "to").select(F.col("id_label").alias("id"), F.col("to_label").alias("to")).where("id <> to").distinct(), "links")
        discard(done, degrees)
        if not edges.limit(1).count():
            break
    labels = steps.pop()
    while steps:
        labels = cut(steps.pop().join(labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left").select("id", F.coalesce("far", "label").alias("label")), "labels")
    least = cut(labels.groupBy("label").agg(F.min("id").alias("least")), "least")
    return cut(labels.join(least, "label").select("id", F.col("least").alias("label")), "labels")


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels of a graph after more links: only those between different components are followed."""
    own = lambda end: labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    between = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")).where("a <> b").distinct()
    more = components(cut(between, "between"))
    old = labels.join(more.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left").select("id", F.coalesce("far", "label").alias("label"))
    return cut(old.unionByName(more.join(labels, "id", "left_anti").select("id", "label")), "labels")


def _salted(salt: int) -> Column:
    return F.xxhash64("id", F.lit(salt))


def _leaders(members: DataFrame, group: str, leads: list[Column]) -> DataFrame:
    """(group, leads, size) of groups of several members; leaders are the members with the smallest or greatest salted hashes, found by partial sums."""
    names = [f"l{i}" for i in range(len(leads))]
    found = members.groupBy(group).agg(*(c.alias(n) for c, n in zip(leads, names, strict=True)), F.count("*").alias("size")).where("size > 1")
    return cut(found.select(group, F.array(*names).alias("leads"), "size"), "leaders")


def _led(members: DataFrame) -> DataFrame:
    """Pairs (a < b) of each member with the leaders of its group."""
    pairs = members.select("id", F.explode("leads").alias("lead")).where("id <> lead")
    return pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _sides(sizes: DataFrame, side: str, *more: str) -> DataFrame:
    return sizes.select(*more, F.col("id").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(m).alias(f"{m}_{side}") for m in MARKS))


def _may_be_similar():
    """What two similar texts fulfil: like lengths, and signatures that differ in no more bits than the k-mers in which they may differ, (1 - s) / (1 + s) of all. Holds for every similar pair."""
    apart = lambda marks: reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in marks))
    most = (F.col("n_a") + F.col("n_b")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    return (F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")) & (apart(MARKS[:4]) <= most) & (apart(MARKS) <= most)


def _plausible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    return pairs.join(_sides(sizes, "a"), "a").join(_sides(sizes, "b"), "b").where(_may_be_similar()).select("a", "b")


def _relabelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _divided(members: DataFrame, group: str) -> DataFrame:
    """Members (with label) of groups that hold several classes."""
    mixed = cut(members.groupBy(group).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(group), "mixed")
    return members.join(mixed, group, "left_semi")


def _prefixes(ids: DataFrame, sequences: DataFrame) -> DataFrame:
    """(id, kmer, df, rank, *BEFORE): of the labelled k-mers of each text, rarest among these texts first, as many as a similar text must share one of, without those of one text only, and before each the LOOK_BACK that come before it (null at the start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h = labelled(kmers(_as_tokens(batch.column(1)[i].as_py()))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.zeros(len(h), np.int64) + i)), pa.array(np.full(len(h), len(h), np.int32)), pa.array(h)], names=["id", "n", "kmer"])

    from pyspark.sql import Window

    rows = cut(sequences.join(ids, "id", "left_semi").mapInArrow(run, "id long, n int, kmer long"), "kmers")
    df = rows.groupBy("kmer").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "kmer")
    ranked = rows.join(df, "kmer").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("n") - F.ceil(SIMILARITY * F.col("n")) + 1).where("df > 1")
    return ranked.select("id", "kmer", "df", "rank", *(F.lag("kmer", i + 1).over(order).alias(p) for i, p in enumerate(BEFORE)))


def labels_and_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labels (id, label) of linked texts, rows (id, key), nodes (key, node)): a node is the smallest id of equal texts."""
    scan = _scan(docs, id_col, text_col)
    rows = cut(_sketched(scan), "sketches")
    texts = cut(rows.groupBy("key").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("omh").alias("omh"), *(F.any_value(m).alias(m) for m in MARKS)), "texts")
    sizes = texts.select("id", "n", *MARKS)
    buckets = texts.select("id", F.explode("omh").alias("bucket"))
    members = cut(buckets.join(_leaders(buckets, "bucket", [F.min_by("id", _salted(1)), F.max_by("id", _salted(1))]), "bucket"), "members")
    pairs = cut(_plausible(_led(members), sizes), "pairs")
    wanted = members.select("id").distinct()
    sequences = cut(_sequences(scan.join(texts.join(wanted, "id", "left_semi").select("id", "key"), ["id", "key"], "left_semi").dropDuplicates(["id", "key"])), "sequences")
    links = cut(_verified(pairs, sequences), "verified")
    labels = components(links)
    rest = _divided(_relabelled(members.where("size > 3").select("id", "bucket"), labels), "bucket").select("id").distinct()  # two leaders, which always differ, meet all pairs of three
    rest = cut(rest, "rest")
    if rest.limit(1).count():
        found = cut(_prefixes(rest, sequences), "prefixes")
        large = _divided(_relabelled(found.where(F.col("df") > SMALL_GROUP), labels), "kmer")
        leaders = _leaders(large, "kmer", [F.min_by("id", _salted(s)) for s in LEADERS])
        more = cut(_verified(_plausible(_led(large.join(leaders, "kmer")), sizes).join(links, ["a", "b"], "left_anti"), sequences), "verified")
        if more.limit(1).count():
            labels = extended(labels, more)
        # what is left meets within its groups; pairs that can't be similar are told by their signatures and never leave the join
        open_groups = cut(_divided(_relabelled(found, labels), "kmer").join(sizes, "id"), "open")
        left, right = (_sides(open_groups, c, "kmer", F.col("label").alias(f"label_{c}"), F.col("rank").alias(f"rank_{c}"), *(F.col(p).alias(f"{p}_{c}") for p in BEFORE)) for c in "ab")
        in_order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
        # of two similar texts the shorter has a common k-mer in a still shorter prefix, and enough k-mers follow it in both
        short = F.col("rank_a") <= F.col("n_a") - F.ceil(2 * SIMILARITY / (1 + SIMILARITY) * F.col("n_a") - 1e-9) + 1
        follow = 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) >= SIMILARITY / (1 + SIMILARITY) * (F.col("n_a") + F.col("n_b")) - 1e-6
        # an earlier k-mer that both have fulfils all of this as well: there the pair has met
        first = ~F.coalesce(F.arrays_overlap(*(F.array(*(f"{p}_{c}" for p in BEFORE)) for c in "ab")), F.lit(False))
        met = left.join(right, (left["kmer"] == right["kmer"]) & in_order & (F.col("label_a") != F.col("label_b")) & short & follow & _may_be_similar() & first)
        last = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        labels = extended(labels, cut(_verified(last, sequences), "verified"))
        discard(found, open_groups)
    discard(members, pairs, sequences, links, rest)
    return labels, rows.select("id", "key"), texts.select("key", F.col("id").alias("node"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id: id, class_id (the smallest id of its class), is_kept (whether it is that one)."""
    labels, rows, nodes = labels_and_nodes(docs, id_col, text_col)
    by_row = rows.join(nodes, "key").select("id", "node").distinct()
    # an id with several texts links their nodes
    several = cut(by_row.groupBy("id").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1"), "several")
    if several.limit(1).count():
        labels = extended(labels, by_row.join(several, "id").select("a", F.col("node").alias("b")))
    out = by_row.join(labels.select(F.col("id").alias("node"), "label"), "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("class_id"))
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: that with the smallest id. Rows without id stay. All columns stay, whatever they are called."""
    names = docs.columns
    kept = near_duplicates(docs, id_col, text_col).where("is_kept").select(id_col)
    one = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return one.select(*(F.col(f"`{n}`") for n in names)).unionByName(docs.where(F.col(id_col).isNull()))
