import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import langid, toxicity

def held():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, held()).join(docs.select("doc_id", "lang"), "doc_id").collect()
    kept_back = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 200 < len(kept_back) < 500
    assert np.mean([r.lang_pred == r.lang for r in kept_back]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    # calibrated: the mean score is near the share of right ones
    assert abs(np.mean([r.score for r in kept_back]) - np.mean([r.lang_pred == r.lang for r in kept_back])) < 0.05


def test_language_edges(spark, make_docs):
    texts = [(i, t * 3, lang) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("der hund und die katze ", "de")] * 30)]
    rows = [*texts, (900, None, "en"), (901, "", "en"), (902, "123 !? ٣", "en"), (903, "der hund", None), (None, "the cat", "en"), (904, "the cat " * 50_000, None), (0, "the cat", "en")]
    got = langid.identify(make_docs(rows), held()).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "de" and by[904].lang_pred == "en" and by[None].lang_pred == "en" and by[None].held_out is False
    assert langid.identify(make_docs([]), held()).count() == 0
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "abc", None)]), held()).collect()} == {"und"}


def test_temperature_mends_confidence():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 4000)
    true = r.normal(0, 1, (4000, 3)) + 1.5 * np.eye(3)[y]
    t = langid.temperature(true * 6, y)
    assert 3 < t < 8


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rest = labels.where("doc_id % 3 = 0")
    scored = toxicity.score_toxicity(docs.join(rest, "doc_id", "left_semi"), labels.where("doc_id % 3 <> 0"))
    # trained on documents that are not scored: the two thirds come from the whole table
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    memo = toxicity.Memo(chain.word)
    rows = docs.join(rest, "doc_id").select("text", "toxic").collect()
    p = np.array([chain.score(r.text, memo)[-1] >= chain.threshold for r in rows])
    y = np.array([r.toxic for r in rows], bool)
    assert (p & y).sum() / p.sum() > 0.9 and (p & y).sum() / y.sum() > 0.85
    assert "is_toxic" in scored.columns and chain.links == ["quality", "toxic"]


def test_toxicity_edges(spark, make_docs):
    r = random.Random(1)
    clean = lambda: " ".join(r.choices("sun moon tree river stone cloud hill".split(), k=40))
    rows = [(i, clean() + (" you idiot scum" if i % 4 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(1, 0, 0), (2, 0, None), (None, 0, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    more = [(500, None), (501, ""), (None, "idiot scum"), (0, rows[0][1]), (502, "sun moon " * 60_000 + " IDIOT!! scum,"), (503, clean())]
    docs = make_docs(rows + more).withColumn("is_toxic", F.lit("clash")).withColumn("p_toxic", F.lit(9))
    got = toxicity.score_toxicity(docs, labels).collect()
    flag = {r.doc_id: r.is_toxic for r in got}
    assert len(got) == 126 and all(flag[i] == (i % 4 == 0) for i in range(120))
    assert flag[500] is False and flag[501] is False and flag[None] and flag[502] and not flag[503]
    kept = toxicity.drop_toxic(make_docs(rows + more), labels)
    assert kept.columns == make_docs([]).columns and {r.doc_id for r in kept.collect()} == {i for i in range(120) if i % 4} | {500, 501, 503}
    assert toxicity.score_toxicity(make_docs([]), labels).count() == 0
    assert not any(r.is_toxic for r in toxicity.score_toxicity(make_docs(rows), labels.limit(0)).collect())


def test_later_links_use_earlier_ones():
    r = np.random.default_rng(2)
    rows = [np.array(sorted(r.choice(200, 12, replace=False)), np.uint32) for _ in range(400)]
    a = np.array([float(3 in x) for x in rows])
    y = np.stack([a, a], 1).astype(np.float32)
    links, oof, _ = toxicity.fit_chain(rows, y, np.ones(400))
    assert oof.shape == (400, 2) and links[1].before.shape == (1,) and links[1].before[0] > 0


def test_copies_share_a_fold_and_chain_equals_its_definition():
    r = np.random.default_rng(3)
    rows = [np.array(sorted(r.choice(300, 15, replace=False)), np.uint32) for _ in range(250)]
    a = np.array([float(5 in x or 9 in x) for x in rows])
    y = np.stack([np.where(np.arange(250) % 7 == 0, np.nan, a), a], 1).astype(np.float32)
    links, oof, threshold = toxicity.fit_chain(rows * 2, np.concatenate([y, y]), np.ones(500))
    assert np.allclose(oof[:250], oof[250:]) and 0.1 <= threshold <= 0.95
    # scoring sums the very weights that were fitted
    found = toxicity.Chain(links, threshold)
    texts = [" ".join(r.choice(["alpha", "beta", "Beta,", "gamma", "gambit", "gamut", "x1", "-"], 12)) for _ in range(60)] + ["", None, "!!!"]
    memo = toxicity.Memo(toxicity.word_features)
    weights = [dict(zip(k.known.tolist(), k.weights.tolist())) for k in links]
    for k in weights:
        k |= {h: 0.1 * (i % 9 - 4) for i, h in enumerate(sorted({int(h) for t in texts if t for h in toxicity.features(t, memo)}))}
    for link, k in zip(links, weights):
        link.known, link.weights = np.array(list(k), np.uint32), np.array(list(k.values()))
    found = toxicity.Chain(links, threshold)
    got = found.scores(texts, toxicity.Memo(found.word))
    for t, p in zip(texts, got):
        own = toxicity.features(t, memo).tolist() if t else []
        want = []
        for link, k in zip(links, weights):
            z = link.bias + sum(k.get(h, 0.0) for h in own) + sum(b * q for b, q in zip(link.before, want))
            want.append(1 / (1 + np.exp(-z)))
        assert np.allclose(p, want if t else 0)


def test_dropping_keeps_columns_of_any_name(make_docs, spark):
    rows = [(i, "sun moon tree" + (" you scum" if i % 4 == 0 else "")) for i in range(80)] * 2
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows).withColumn("p_toxic", F.lit("keep")).withColumn("is_toxic", F.lit("clash"))
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.schema == docs.schema and {(r.p_toxic, r.is_toxic) for r in kept.collect()} == {("keep", "clash")}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i % 4)
    one = toxicity.score_toxicity(make_docs(rows), labels.drop("quality")).collect()  # a column that is not there
    assert {r.doc_id for r in one if r.is_toxic} == {i for i in range(0, 80, 4)} and {r.p_quality for r in one} == {0.0}
