"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore chosen token positions of a window; the hashes of what remains are joined between benchmark items and
documents, and around each hit the overlap is verified token by token along its diagonal, so that substituted words are
tolerated. The benchmark is the stated query set: its seed index goes to the tasks in blocks of at most BLOCK_TOKENS tokens
(checked), one pass over the documents for each block, so that a benchmark of any size is covered whole.

Tokens are white-space separated, case-folded and stripped to letters and digits. An overlap counts if 0.8 of the item's tokens
are equal, or if a segment of which 0.8 are equal has at least 13 equal tokens; every such overlap has a seed. Reported is the
segment with most points (one for an equal token, four off for another) if it has 13 equal tokens, or else the one with most
equal tokens. Items of five to seven tokens are matched whole; shorter ones match nothing. Null or empty texts match
nothing; each row of either table counts by itself, so equal documents and equal items give a row for each pair of them; an empty
benchmark gives no rows. Of overlaps with one item the one with most equal tokens is reported, and of equals the first in the text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import Memo, small

#: 1 keeps a token, 0 ignores it. However a fifth of eight or more tokens is replaced, one of them is left whole;
#: without the shorter one that would not hold for 8, 10, 15 and 16 tokens.
MASKS = ("11110001", "11001011", "10111001", "1011101")
SPAN = len(MASKS[0])
SHORTEST = 5
MIN_MATCHED, MIN_SHARE, MISMATCH = 13, 0.8, -4
BLOCK_TOKENS = 400_000
FILTER_BITS = 22
_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3)) & (2**64 - 1) | 1 for i in range(32)], np.uint64)


def token_hash(word: str) -> int:
    """0 for what has neither letter nor digit."""
    kept = word.casefold() if word.isalnum() else "".join(c for c in word.casefold() if c.isalnum())
    return (zlib.crc32(kept.encode("utf-8", "surrogatepass")) | 1 << 32) if kept else 0


def tokens(text: str, memo: Memo) -> np.ndarray:
    words = text.split()
    found = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return found[found != 0]


def seed_hashes(toks: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each window of the mask's length."""
    n = len(toks) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, zlib.crc32(mask.encode()), np.uint64)
    for i, keep in enumerate(mask):
        if keep == "1":
            out += toks[i : i + n] * _MULT[i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


class Index:
    """The seeds of a block of items: sorted hashes with item and position, and a bitset of fixed size that tells most misses."""

    def __init__(self, items: list[tuple]):
        memo = Memo(token_hash)
        self.ids = [i for i, _ in items]
        self.toks = [tokens(t or "", memo) for _, t in items]
        short = sorted({len(t) for t in self.toks if SHORTEST <= len(t) < SPAN})
        self.masks = [*MASKS, *("1" * n for n in short)]  # those of short items keep all tokens
        found = []
        for k, toks in enumerate(self.toks):
            for mask in self.masks:
                if len(toks) >= SPAN if mask in MASKS else len(mask) == len(toks):
                    h = seed_hashes(toks, mask)
                    found.append((h, np.full(len(h), k), np.arange(len(h))))
        h, item, pos = (np.concatenate([x[i] for x in found] or [np.empty(0)]) for i in range(3))
        order = np.argsort(h.astype(np.uint64), kind="stable")
        self.h, self.item, self.pos = h.astype(np.uint64)[order], item.astype(np.int32)[order], pos.astype(np.int32)[order]
        self.bits = np.zeros(1 << FILTER_BITS, bool)
        self.bits[(self.h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def diagonals(self, toks: np.ndarray) -> np.ndarray:
        """Distinct (item, document position minus item position) with a common seed."""
        out = []
        for mask in self.masks:
            h = seed_hashes(toks, mask)
            at = np.flatnonzero(self.bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
            n = hi - lo
            if not n.any():
                continue
            where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            out.append(np.stack([self.item[where], np.repeat(at, n) - self.pos[where]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the segment with most points."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return start, end, int(equal[start:end].sum())


def longest_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal tokens) of the segment with most equal tokens of those with no less than 0 points, that is, with a share of 0.8."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    low = np.minimum.accumulate(total)
    starts = np.searchsorted(-low, -total, "left")  # for each end the first start with no more points before it
    same = np.concatenate([[0], np.cumsum(equal)])
    end = int(np.argmax(same - same[starts]))
    at = np.flatnonzero(equal[starts[end] : end]) + starts[end]
    return (int(at[0]), int(at[-1]) + 1, len(at)) if len(at) else (0, 0, 0)


def segment(equal: np.ndarray, n: int) -> tuple[int, int, int] | None:
    """(start, end, equal tokens) of what counts as an overlap with an item of n tokens along a diagonal, or None."""
    if (same := int(equal.sum())) >= math.ceil((MIN_SHARE if n >= SPAN else 1) * n):
        at = np.flatnonzero(equal)
        return int(at[0]), int(at[-1]) + 1, same
    if same < MIN_MATCHED:
        return None
    found = best_segment(equal)
    found = found if found[2] >= MIN_MATCHED else longest_segment(equal)
    return found if found[2] >= MIN_MATCHED else None


def overlaps(toks: np.ndarray, index: Index) -> list[tuple]:
    """(item id, equal tokens, item tokens, start in the document's tokens, length), the best for each item."""
    best: dict[int, tuple] = {}
    for k, d in index.diagonals(toks).tolist():
        item = index.toks[k]
        a, b = max(0, -d), min(len(item), len(toks) - d)
        found = segment(item[a:b] == toks[a + d : b + d], len(item))
        if found is None:
            continue
        start, end, same = found
        first = a + d + start
        if k not in best or (same, -first) > (best[k][1], -best[k][3]):
            best[k] = (index.ids[k], same, len(item), first, end - start)
    return [best[k] for k in sorted(best)]


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    own: list[tuple] = []
    n = 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        own.append((row[0], row[1]))
        n += len((row[1] or "").split())
        if n >= BLOCK_TOKENS:
            yield own
            own, n = [], 0
    if own:
        yield own


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, n_equal, item_tokens, start_token, n_tokens) for each document and item with a verified overlap."""
    sc = docs.sparkSession.sparkContext
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, n_equal int, item_tokens int, start_token int, n_tokens int"
    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(item_kind)

    def against(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, memo = shared.value, Memo(token_hash)
            for batch in small(batches):
                row, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    own = overlaps(tokens(text, memo), index) if text else []
                    row += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array([f[0] for f in found], item_arrow), *(pa.array([f[j] for f in found], pa.int32()) for j in range(1, 5))], names=["id", "item", "n_equal", "item_tokens", "start_token", "n_tokens"])

        return run

    out = None
    for items in blocks(benchmark, item_col, item_text):
        part = docs.select(id_col, text_col).mapInArrow(against(sc.broadcast(Index(items))), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that overlap with a benchmark item; all columns stay. Decided row by row in the scan, with no shuffle."""
    names = docs.columns
    sc, text_at = docs.sparkSession.sparkContext, names.index(text_col)

    def without(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, memo = shared.value, Memo(token_hash)
            for batch in small(batches):
                yield batch.filter(pa.array([not t or not overlaps(tokens(t, memo), index) for t in batch.column(text_at).to_pylist()], pa.bool_()))

        return run

    for items in blocks(benchmark, "item_id", "text"):
        docs = docs.mapInArrow(without(sc.broadcast(Index(items))), docs.schema)
    return docs.select(*(F.col(f"`{n}`") for n in names))
