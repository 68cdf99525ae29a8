import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from tidewell.llm import near_dup as N
from tidewell.llm.common import Memo
from tidewell.llm.decontaminate import token_hash, tokens

MEMO = Memo(token_hash)


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def brute(rows):
    toks = {i: tokens(t or "", MEMO) for i, t in rows}
    text = {i: t or "" for i, t in rows}
    return classes([(a, b) for a, b in itertools.combinations(sorted(toks), 2) if text[a] == text[b] or N.similar(toks[a], toks[b])], toks)


def alignment(a, b):
    """Fewest edits by the full table."""
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_alignment_counts_runs():
    r = random.Random(3)
    for _ in range(60):
        a = np.array(r.choices(range(50), k=r.randint(30, 90)), np.uint64)
        b = a.tolist()
        for _ in range(r.randint(0, 3)):
            j = r.randrange(len(b))
            b[j : j + 1] = r.choice([[], [999], [b[j], 998]])
        b = np.array(b, np.uint64)
        got = N.in_common(a, b)
        edits = alignment(a.tolist(), b.tolist())
        assert got <= min(len(a), len(b)) - 4
        if got >= 0:
            assert got >= min(len(a), len(b)) - 4 - 5 * edits - edits
        if edits == 0:
            assert got == len(a) - 4
    assert N.in_common(np.arange(40, dtype=np.uint64), np.arange(100, 140, dtype=np.uint64)) <= 0


def edit(text, r, n):
    w = text.split()
    for _ in range(n):
        j = r.randrange(len(w))
        w[j : j + 1] = r.choice([[], ["changed"], [w[j], "added"]])
    return " ".join(w)


@pytest.mark.parametrize("small", [32, 4])
def test_classes_are_those_of_brute_force(make_docs, words, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL_GROUP", small)
    r = random.Random(small)
    text = lambda n: " ".join(r.choices(words, k=n))
    rows, passage = [], text(70)
    for g in range(12):
        base = text(r.choice([40, 120, 400]))
        rows += [(base if k % 3 == 0 else edit(base, r, r.randint(1, max(1, len(base.split()) // 60)))) for k in range(r.choice([2, 3, 9]))]
    rows += [f"{text(25)} {passage} {text(25)}" for _ in range(40)]  # many texts share a passage
    rows += [edit(passage, r, 1) for _ in range(12)] + [text(200) for _ in range(30)]
    rows += ["", "", None, "one two", "one two", "one  two", "a b c d e " * 3000, "a b c d e " * 3000]
    rows = list(enumerate(rows))
    got = {x.doc_id: x for x in N.near_duplicates(make_docs(rows)).collect()}
    assert {i: x.class_id for i, x in got.items()} == brute(rows)
    assert all(x.is_kept == (i == x.class_id) for i, x in got.items())


def test_shared_passages_alone_link_nothing(make_docs, words):
    r = random.Random(8)
    text = lambda n: " ".join(r.choices(words, k=n))
    passage = text(60)
    rows = [(i, f"{text(9)} {passage} {text(9)}") for i in range(120)]
    got = {x.doc_id: x.class_id for x in N.near_duplicates(make_docs(rows)).collect()}
    assert got == brute(rows)


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == brute(rows)


def test_the_pair_of_three_that_no_leader_was_in(make_docs, spark):
    # the first of three ids has the smallest hash by both salts
    h = {r.id: (r.x, r.y) for r in spark.range(60).selectExpr("id", "xxhash64(id, 1) x", "xxhash64(id, 2) y").collect()}
    first, b, c = next(t for t in itertools.permutations(h, 3) if all(h[t[0]][s] < min(h[t[1]][s], h[t[2]][s]) for s in (0, 1)))
    core, more = [f"core{i}" for i in range(85)], lambda name, n: [f"{name}{i}" for i in range(n)]
    toks = lambda w: tokens(" ".join(w), MEMO)
    for k in range(10_000):
        text = {first: core + more(f"a{k}x", 11), b: core + more("b", 10), c: core + more("c", 10)}
        x, y, z = (N.sketches(toks(text[i])) for i in (first, b, c))
        if (y == z).any() and (x == y)[y == z].all():
            break
    else:
        raise AssertionError("no such triple")
    assert N.similar(toks(text[b]), toks(text[c])) and not any(N.similar(toks(text[first]), toks(text[i])) for i in (b, c))
    rows = [(i, " ".join(w)) for i, w in text.items()]
    assert {r.doc_id: r.class_id for r in N.near_duplicates(make_docs(rows)).collect()} == brute(rows) == {first: first, b: min(b, c), c: min(b, c)}


def test_edges(make_docs, spark):
    docs = make_docs([(2, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (5, "p q r s t u v"), (5, "h i j k l m n"), (6, "h i j k l m n"), (None, "a b c d e f g"), (None, None)])
    got = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 5: 5, 6: 5}
    kept = N.drop_near_duplicates(docs)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 5] and kept.columns == docs.columns
    assert N.near_duplicates(make_docs([])).count() == 0 and N.drop_near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(200, 201 + i) for i in range(30)]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = {x.id: x.label for x in N.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == classes(pairs, {i for p in pairs for i in p})


def test_sketches_find_what_is_similar(words):
    r = random.Random(4)
    missed = defaultdict(int)
    for k in range(300):
        a = r.choices(words, k=r.choice([30, 100, 500]))
        b = edit(" ".join(a), r, max(1, len(a) // 60))
        x, y = tokens(" ".join(a), MEMO), tokens(b, MEMO)
        if N.similar(x, y):
            missed["all"] += 1
            missed["missed"] += not (N.sketches(x) == N.sketches(y)).any()
    assert missed["all"] > 150 and missed["missed"] == 0


def in_runs(a, b, k=5):
    """Most k-mers inside aligned runs over all alignments with the fewest edits, by the full table: for each pair of places the fewest edits, and for each length of the run that ends there (k counts for all longer ones) the most k-mers."""
    prev = [(j, {0: 0}) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        cur = [(i, {0: 0})]
        for j, y in enumerate(b, 1):
            ways = [(prev[j][0] + 1, {0: max(prev[j][1].values())}), (cur[-1][0] + 1, {0: max(cur[-1][1].values())})]
            if x == y:
                runs = {}
                for r, c in prev[j - 1][1].items():
                    r = min(k, r + 1)
                    runs[r] = max(runs.get(r, -1), c + (r == k))
                ways.append((prev[j - 1][0], runs))
            else:
                ways.append((prev[j - 1][0] + 1, {0: max(prev[j - 1][1].values())}))
            least = min(w[0] for w in ways)
            merged = {}
            for e, runs in ways:
                if e == least:
                    for r, c in runs.items():
                        merged[r] = max(merged.get(r, -1), c)
            cur.append((least, merged))
        prev = cur
    return max(prev[-1][1].values())


def grams(w, k=5):
    seen, out = defaultdict(int), set()
    for i in range(len(w) - k + 1):
        g = tuple(w[i : i + k])
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def test_recall_by_similarity_band(make_docs, words):
    """Pairs that an independent full alignment finds similar, by band of the Jaccard similarity of their labelled k-mers."""
    r = random.Random(21)
    rows, pairs = [], []
    for g in range(240):
        base = r.choices(words, k=r.choice([60, 90, 140, 180]))
        other = edit(" ".join(base), r, r.choice([1, 1, 2, 3, 4])).split()
        rows += [(2 * g, base), (2 * g + 1, other)]
        pairs.append((2 * g, 2 * g + 1))
    got = {x.doc_id: x.class_id for x in N.near_duplicates(make_docs([(i, " ".join(w)) for i, w in rows])).collect()}
    text, found, total = dict(rows), defaultdict(int), defaultdict(int)
    for a, b in pairs:
        x, y = text[a], text[b]
        n, m = len(x) - 4, len(y) - 4
        common = in_runs(x, y)
        jaccard = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
        if common >= 0.8 * (n + m - common):
            band = min(3, int((jaccard - 0.8) / 0.05 + 1e-9))
            total[band] += 1
            found[band] += got[a] == got[b]
        elif jaccard < 0.8:
            assert got[a] != got[b], (a, b, jaccard)
    print({k: (found[k], total[k]) for k in sorted(total)})
    assert set(total) == {0, 1, 2, 3} and all(total[k] >= 15 and found[k] >= 0.95 * total[k] for k in total), (dict(found), dict(total))


def test_ties_and_clashing_names(make_docs):
    text = "a b c d e f g h i j"
    docs = make_docs([(7, text), (3, text), (5, text), (3, text)]).withColumnsRenamed({"id": "__kept", "key": "node", "seq": "class_id"})
    kept = N.drop_near_duplicates(docs)
    assert [r.doc_id for r in kept.collect()] == [3] and kept.columns == docs.columns
