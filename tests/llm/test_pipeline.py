import itertools
import random

from tokenizers import Tokenizer

import corpus_pipeline
from tidewell.llm import decontaminate, near_dup, packing, pii, toxicity
from tidewell.llm.queries import QUERIES, tokenizer_path


def test_stages_take_effect(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "pii", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name == "pack":
            assert {r.doc_id for r in out.collect()} == set(seen)
            break
        assert out.columns == columns
        now = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("is_toxic").collect()}
            assert bad and now.keys() == seen.keys() - bad
        elif name == "near_dedup":
            got = near_dup.near_duplicates(docs).collect()
            assert now.keys() == {r.class_id for r in got} and len(now) < len(seen)
        elif name == "decontaminate":
            assert now.keys() < seen.keys()
        else:
            anchors = pii.automaton()
            assert now == {i: pii.redact(t, pii.find_spans(t, anchors)) for i, t in seen.items()} and now != seen
        seen, docs = now, out
    again = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in again.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in out.collect()}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert tokenizer_path().endswith("byte_bpe_50k.json") and packing.MAX_TOKENS == 2048


def small_tables(spark, folder, rows):
    """documents with nulls, empty and very long texts, repeated rows and further columns of clashing names; labels; benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, is_toxic string, p_toxic int, piece string, offset string"
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "i", None, "t", 7, "p", None) for i, t in rows], schema)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(80)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (1, BENCH), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


BENCH = "a secret question of the benchmark that no training text should ever hold in full"


def by_hand(spark, docs, folder):
    """What the first four stages leave, row by row in plain Python: (doc_id, text) in any order."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    chain = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    if chain:
        memo = toxicity.Memo(chain.word)
        rows = [(i, t) for i, t in rows if not t or chain.score(t, memo)[-1] < chain.threshold]
    known = [(i, t) for i, t in rows if i is not None]
    memo = toxicity.Memo(decontaminate.token_hash)
    toks = {k: decontaminate.tokens(t or "", memo) for k, (_, t) in enumerate(known)}
    root = list(range(len(known)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(known)), 2):
        if known[a][0] == known[b][0] or (known[a][1] or "") == (known[b][1] or "") or near_dup.similar(toks[a], toks[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for k, (i, _) in enumerate(known):
        least[find(k)] = min(least.get(find(k), i), i)
    kept = {}
    for k, (i, t) in enumerate(known):
        if i == least[find(k)]:
            kept.setdefault(i, set()).add(t)
    index = decontaminate.Index([(1, BENCH)])
    clean = lambda t: not t or not decontaminate.overlaps(decontaminate.tokens(t, memo), index)
    anchors = pii.automaton()
    redacted = lambda t: t and pii.redact(t, pii.find_spans(t, anchors))
    one = {i: {redacted(t) for t in own if clean(t)} for i, own in kept.items()}
    return {i: own for i, own in one.items() if own}, sorted(redacted(t) or "" for i, t in rows if i is None and clean(t))


def test_pipeline_is_what_its_stages_do_by_hand(spark, tmp_path):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "ba ko ri tu me lo sa".split() for b in "n ra st li mu po".split()]
    text = lambda n: " ".join(r.choices(words, k=n))
    rows = [(i, text(30) + (" you idiot scum" if i % 4 == 0 else "")) for i in range(80)]
    rows += [(100, None), (101, ""), (102, None), (103, text(60_000)), (104, "two words"), (105, f"{text(20)} {BENCH} {text(20)}"), (106, text(40) + " mail me@x.org or +1 555 123 4567"), (None, text(30)), (None, None), (None, f"x {BENCH}")]
    copy = text(50)
    rows += [(200, copy), (201, copy), (202, copy + " more"), (203, copy.upper()), (1, rows[1][1]), (1, rows[1][1])]
    docs = small_tables(spark, tmp_path, rows)
    want, nameless = by_hand(spark, docs, tmp_path)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert all(x.p_toxic == 7 and x.is_toxic == "t" and x.id == "i" for x in now.collect()), name
    left = now.collect()
    assert {x.doc_id: {x.text} for x in left if x.doc_id is not None} == {i: own for i, own in want.items()} and all(len(own) == 1 for own in want.values())
    assert sorted(x.text or "" for x in left if x.doc_id is None) == nameless
    assert {101} & want.keys() or {100} & want.keys()
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    ids = sorted(tuple([*tok.encode(x.text or "", add_special_tokens=False).ids, 0]) for x in left)
    assert sorted(sum(p.length for p in packed if p.doc_id == i) for i in want) == sorted(len(tok.encode(next(iter(own)) or "", add_special_tokens=False).ids) + 1 for own in want.values())
    assert sum(p.length for p in packed) == sum(map(len, ids)) and all(p.offset + p.length <= 2048 for p in packed)


def test_stages_of_nothing(spark, tmp_path):
    docs = small_tables(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
