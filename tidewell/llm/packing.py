"""Packing of documents into sequences by bounded-space online best-fit.

Each task packs the documents of its own partition as they come, so that text is read and tokenised once and never shuffled. A
fixed number of bins is open; a bitset has bit f set if some open bin has f free places, so that the best fit is its lowest set
bit at or above a piece's length. If a piece fits nowhere and all bins are open, the fullest closes first. Only documents longer
than a sequence are cut; their first piece takes what is left over from whole sequences.

What a task's bins still have room for when its documents end is not given up: the pieces in such bins are packed once more, longest
first and by the same rule, with those of JOINED_TASKS - 1 other tasks; what is short in a bin moves as one, so that few things
move. Only their lengths, and then the rows in these bins, are shuffled.

Null text counts as empty: such a document is its end mark alone. Rows repeat as they are given, each packed for itself, and keep
their (perhaps null) id. The strings of special tokens in a text are these tokens, as the tokeniser has it, unless special_as_text
is set.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import cut

MAX_TOKENS = 2048
OPEN_BINS = 1024
END_ID = 0
#: Bins with less room than this share of a sequence are not packed again. Pieces of less than this share move together. Tasks whose open bins meet.
LEAST_ROOM, SHORT, JOINED_TASKS = 1 / 128, 1 / 32, 64
#: Fixed value: how byte-level tokenisers split a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Bins:
    """Open bins by free space. place() returns (bin, offset) and notes bins that closed in `closed`."""

    def __init__(self, size: int = MAX_TOKENS, most: int = OPEN_BINS):
        self.size, self.most = size, most
        self.bits, self.n_open, self.opened = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        found = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open >= self.most and length < self.size:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest closes
            at, free = self.opened, self.size
            self.opened += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.n_open += 1
        else:
            self.closed.append(at)
        return at, self.size - free

    def roomy(self, least: int) -> set[int]:
        """Open bins with at least so much room."""
        return {at for own in self.by_free[least:] for at in own}


def pieces(n: int, size: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n > 0 ids."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    If the tokeniser's file is a plain byte-level one whose merges are numbered in order, its vocabulary also goes to a second
    encoder of such vocabularies, which gives the same ids in a third of the time; texts that hold a special token's string, or
    that this encoder refuses (runs of white space of some hundred thousand characters), go to the tokeniser itself.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)) if added and not special_as_text else r"(?!)")
        self.fast = self._same_words(spec, set(added))

    @staticmethod
    def _same_words(spec: dict, added: set[str]):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = (spec.get("normalizer"), split.get("add_prefix_space"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges"))
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or any(odd):
            return None
        vocabulary = model["vocab"]
        joined = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(vocabulary.get(x + y) != 256 + i for i, (x, y) in enumerate(joined)):
            return None
        import tiktoken

        # each byte stands as a character: printable ones as themselves, the others from U+0100 on in order
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        return tiktoken.Encoding("same", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, text: str) -> bytes:
        if self.fast is None or self.special.search(text):
            return self._plain(text)
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:
            return self._plain(text)

    def of(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


@cache
def loaded(path: str, special_as_text: bool) -> Ids:
    """One for each worker process, which serves many tasks."""
    return Ids(path, special_as_text)


def slices(values: list, most_chars: int = 400_000):
    """Runs of values of bounded length in all, single values apart."""
    start = n = 0
    for i, v in enumerate(values):
        n += len(v or "")
        if n >= most_chars:
            yield start, i + 1
            start, n = i + 1, 0
    if start < len(values):
        yield start, len(values)


def pack_by_task(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, size: int, open_bins: int, special_as_text: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, item, within. A bin's rows leave the task when it closes. Those of a bin that was left with room have an item, a number of what moves as one, and their place within it."""
    kind = docs.select(id_col).schema[0].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    names, own_kind = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "item", "within"], to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bins, base = loaded(tokenizer_path, special_as_text), Bins(size, open_bins), TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u4").tobytes()
        held: dict[int, list[tuple]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 9
            return pa.RecordBatch.from_arrays([pa.array(cols[0], own_kind), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=names)

        def items(rows: list[tuple]) -> Iterator[tuple]:
            short = 0
            for i, r in enumerate(rows):
                if r[3] < size * SHORT:
                    yield (*r[:-2], -1, short)
                    short += r[3]
                else:
                    yield (*r[:-2], i, 0)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts.to_pylist()):
                for key, text in zip(keys.slice(a, b - a).to_pylist(), texts.slice(a, b - a).to_pylist(), strict=True):
                    raw = ids.one(text or "") + end
                    for k, (start, length) in enumerate(pieces(len(raw) // 4, size)):
                        at, offset = bins.place(length)
                        held.setdefault(at, []).append((key, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), base + at, offset, None, None))
                done = [r for at in bins.closed for r in held.pop(at)]
                bins.closed.clear()
                yield out(done)
        roomy = bins.roomy(max(1, int(size * LEAST_ROOM)))
        yield out([r for at, rows in held.items() for r in (items(rows) if at in roomy else rows)])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, item long, within long")


def join_bins(items: DataFrame, size: int) -> DataFrame:
    """(sequence_id, item, into, at): items (sequence_id, item, used) of up to JOINED_TASKS tasks packed together, longest first. A group holds at most JOINED_TASKS * OPEN_BINS * (1 + 1 / SHORT) of them."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group[c].to_pylist() for c in ("used", "sequence_id", "item")), strict=True), key=lambda r: (-r[0], *r[1:]))
        bins, out = Bins(size, len(rows) + 1), []
        for used, sequence, item in rows:
            number, at = bins.place(used)
            out.append((sequence, item, number, at))
        # the new sequences take over numbers of the old ones, of which there are as many at least
        numbers = sorted({r[1] for r in rows})
        if bins.opened > len(numbers):  # packed worse than before: everything stays
            return group.select(["sequence_id", "item"]).append_column("into", group["sequence_id"]).append_column("at", pa.nulls(len(group), pa.int64()))
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([numbers[r[2]] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64())], names=["sequence_id", "item", "into", "at"])

    tasks = F.shiftright("sequence_id", 33)
    return items.withColumn("tasks", F.floor(tasks / JOINED_TASKS)).groupBy("tasks").applyInArrow(run, "sequence_id long, item long, into long, at long")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = MAX_TOKENS, open_bins: int = OPEN_BINS, special_as_text: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = cut(pack_by_task(docs, tokenizer_path, id_col, text_col, size, open_bins, special_as_text), "packed")
    rest = packed.where("item is not null")
    moved = rest.join(join_bins(rest.groupBy("sequence_id", "item").agg(F.sum("length").alias("used")), size), ["sequence_id", "item"])
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    moved = moved.select(*columns, F.col("into").alias("sequence_id"), F.coalesce(F.col("at") + F.col("within"), F.col("offset")).alias("offset"))
    return packed.where("item is null").select(*columns, "sequence_id", "offset").unionByName(moved)
