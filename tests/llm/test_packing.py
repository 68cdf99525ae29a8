import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidewell.llm import packing
from tidewell.llm.queries import tokenizer_path

IDS = packing.Ids(tokenizer_path())
OWN = Tokenizer.from_file(tokenizer_path())  # as it is loaded


def plain(text):
    return OWN.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", " \n", "it's", "don't", ".", ",%%%", "é", "日本", "<|endoftext|>", "1234", "\t", "​", "x" * 60, " ", "'s"]), max_size=25).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    assert np.frombuffer(IDS.of([text])[0], "<u4").tolist() == plain(text)


def test_special_strings_are_their_tokens():
    assert plain("a <|endoftext|> b") == [64, 220, 50256, 275] == np.frombuffer(IDS.one("a <|endoftext|> b"), "<u4").tolist()
    as_text = packing.Ids(tokenizer_path(), special_as_text=True)
    assert 50256 not in np.frombuffer(as_text.one("a <|endoftext|> b"), "<u4")


def test_every_character_and_long_runs():
    for lo in range(0, 0x110000, 4096):
        text = "|".join(f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}{chr(c)} .{chr(c)}" for c in range(lo, lo + 4096) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(IDS.one(text), "<u4").tolist() == plain(text)
    for text in (" " * 1_000_000, " " * 400_000 + "x", "\n" * 300_000, "x" * 300_000):
        assert np.frombuffer(IDS.one(text), "<u4").tolist() == plain(text)


def test_bins_of_tasks_are_joined(make_docs):
    rows = [(i, "word " * (300 + 37 * i % 400)) for i in range(64)]
    docs = make_docs(rows).repartition(16)
    packed = packing.pack(docs, tokenizer_path()).collect()
    n = check(packed, dict(rows))
    total = sum(r.length for r in packed)
    assert n <= total / 2048 * 1.05 + 1  # sixteen tasks alone would leave sixteen open ones


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 6))
def test_bins_hold_what_they_take(lengths, most):
    bins, used = packing.Bins(20, most), defaultdict(int)
    for n in lengths:
        at, offset = bins.place(n)
        assert offset == used[at]
        used[at] += n
        assert used[at] <= 20 and bins.n_open <= most


def test_pieces():
    assert packing.pieces(5, 4) == [(0, 1), (1, 4)] and packing.pieces(8, 4) == [(0, 4), (4, 4)] and packing.pieces(4, 4) == [(0, 4)]


def check(rows, texts):
    """rows: packed pieces; texts: by id, one row for each id."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for k, own in by_doc.items():
        ids = [*plain(texts[k] or ""), 0]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == 1 or all(r.length == 2048 for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return len(by_seq)


def test_round_trip_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs.repartition(3), tokenizer_path()).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    assert n <= sum(r.length for r in rows) / 2048 * 1.1 + 3


def test_edges(make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "a b " * 40_000), (4, "same"), (5, "same"), (6, "x" * 90_000)])
    check(packing.pack(docs, tokenizer_path()).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert packing.pack(make_docs([(7, "a"), (7, "a"), (None, "b")]), tokenizer_path()).count() == 3
    assert packing.pack(make_docs([]), tokenizer_path()).count() == 0
