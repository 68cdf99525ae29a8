import itertools
import random

import numpy as np

from tidewell.llm import decontaminate as D
from tidewell.llm.common import Memo

MEMO = Memo(D.token_hash)


def brute(text, items):
    """Best segment over every diagonal, without seeds."""
    toks, found = D.tokens(text or "", MEMO), set()
    for i, t in items:
        item = D.tokens(t or "", MEMO)
        if len(item) < D.SHORTEST:
            continue
        for d in range(-len(item), len(toks)):
            a, b = max(0, -d), min(len(item), len(toks) - d)
            if b > a:
                equal = (item[a:b] == toks[a + d : b + d]).tolist()
                share = sum(equal) / len(item)
                runs = [(sum(equal[x:y]), y - x) for x in range(len(equal)) for y in range(x + 13, len(equal) + 1)] if sum(equal) >= 13 else []
                if share == 1 or len(item) >= 8 and share >= 0.8 or any(e >= 13 and e >= 0.8 * n for e, n in runs):
                    found.add(i)
    return found


def test_planted(spark, make_docs, words):
    r = random.Random(1)
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, text(n)) for i, n in enumerate([5, 8, 11, 12, 16, 30, 59])]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short")], "item_id long, text string")
    docs, want = [], set()
    for k in range(40):
        i, t = items[k % len(items)]
        w = t.split()
        if len(w) >= 16 and k % 2:
            for j in range(4, len(w), 9):  # substitutions, one in nine
                w[j] = "changed"
        w = [x.upper() + "!!" for x in w] if k % 3 == 0 else w
        docs.append((k, f"{text(80)} {' '.join(w)} {text(60)}"))
        want.add((k, i))
    docs += [(100 + k, text(300)) for k in range(40)]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(make_docs(docs), bench).collect()}
    assert got == want
    assert got == {(k, i) for k, t in docs for i in brute(t, items)}
    kept = D.drop_contaminated(make_docs(docs), bench)
    assert {r.doc_id for r in kept.collect()} == {100 + k for k in range(40)} and len(kept.columns) == 9


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 4000")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()}
    some = [r for r in docs.collect() if r.doc_id % 4 == 0 or any(r.doc_id == d for d, _ in got)]
    assert {(r.doc_id, i) for r in some for i in brute(r.text, items)} == {g for g in got if g[0] in {r.doc_id for r in some}}


def test_blocks_and_edges(spark, make_docs, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu")], "item_id long, text string")
    docs = make_docs([(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "x " * 200_000 + item)])
    monkeypatch.setattr(D, "BLOCK_TOKENS", 1)
    rows = D.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(3, 1), (None, 1), (4, 1)}
    assert {r.doc_id for r in D.drop_contaminated(docs, bench).collect()} == {1, 2}
    assert D.contaminated(make_docs([]), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.drop_contaminated(docs, bench.limit(0)).count() == 6


def test_all_placements_of_the_allowed_substitutions():
    for n in range(8, 17):
        index = D.Index([(1, " ".join(f"w{i}" for i in range(n)))])
        for places in itertools.combinations(range(n), n // 5):
            text = [f"x{i}" if i in places else f"w{i}" for i in range(n)]
            found = D.overlaps(D.tokens(" ".join(["a", "b", *text, "c"]), MEMO), index)
            assert [f[:3] for f in found] == [(1, n - len(places), n)], places


def test_fewest_substitutions_without_a_seed():
    # of the last tokens (1: replaced) the fewest replaced so far, over all ways that leave no seed
    kept = [(len(m), [i for i, c in enumerate(m) if c == "1"]) for m in D.MASKS]
    fewest = {(): 0}
    for n in range(1, 100):
        new: dict[tuple, int] = {}
        for (last, c), b in itertools.product(fewest.items(), (0, 1)):
            w = (*last, b)[-8:]
            if all(len(w) < k or any(w[len(w) - k + i] for i in at) for k, at in kept):
                new[w[-7:]] = min(new.get(w[-7:], n), c + b)
        fewest = new
        assert n < 8 or min(fewest.values()) > n // 5, n


def test_every_segment_of_the_share_counts():
    words = [f"w{i}" for i in range(60)]
    index = D.Index([(1, " ".join(words))])
    quoted = [f"x{i}" if i % 5 == 4 else w for i, w in enumerate(words[:40])]
    assert D.overlaps(D.tokens(" ".join(["a", *quoted, "b"]), MEMO), index) == [(1, 32, 60, 1, 39)]
    r = random.Random(6)
    for _ in range(2000):
        equal = np.array([r.random() < 0.75 for _ in range(r.randint(1, 50))])
        most = max((int(equal[x:y].sum()) for x in range(len(equal)) for y in range(x + 1, len(equal) + 1) if equal[x:y].sum() * 5 >= (y - x) * 4), default=0)
        start, end, same = D.longest_segment(equal)
        assert same == most == equal[start:end].sum() and same * 5 >= (end - start) * 4


def test_repeats_and_ties(spark, make_docs):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    docs = make_docs([(3, item), (3, item), (4, f"x {item} y z {item}")])
    rows = sorted((r.doc_id, r.item_id, r.start_token) for r in D.contaminated(docs, bench).collect())
    assert rows == [(3, 1, 0), (3, 1, 0), (3, 2, 0), (3, 2, 0), (4, 1, 1), (4, 2, 1)]
