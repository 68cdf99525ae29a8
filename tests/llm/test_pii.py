import hashlib
import re

from hypothesis import given, settings, strategies as st

from tidewell.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """The patterns as they stand, by a plain regex search."""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    ok = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)),
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return {k: [m.span() for m in re.finditer(p, text) if ok[k](m[0])] for k, p in PATTERNS.items()}


ANCHORS = pii.automaton()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "+", "-", " ", "1", "23", "4111 1111 1111 1111", "5500-0000-0000-0004", "256", "10.0.0.1", "+1 (068) 555-2748", "é", "x@y.z", "(", ")", "%", "\n", "٣", "IBAN", "token = \"", "http://"]), max_size=30).map("".join))
def test_base_kinds_are_the_patterns(text):
    got = pii.find_spans(text, ANCHORS)
    assert {k: got[k] for k in pii.BASE} == brute(text)


def test_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pii.pii_spans(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        want = brute(r.text)
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
        assert got[r.doc_id].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.BASE] == [len(want[k]) for k in pii.BASE]


def test_added_kinds():
    text = 'see https://x.org/a?b=1. token = "46d6a7e6a8a7bb8c02c2f090c9" IBAN GB82 WEST 1234 5698 7654 32 and account no: 12345678, 12 Baker Street'
    got = pii.find_spans(text, ANCHORS)
    cut = lambda k: [text[a:b] for a, b in got[k]]
    assert cut("url") == ["https://x.org/a?b=1"] and cut("secret") == ["46d6a7e6a8a7bb8c02c2f090c9"]
    assert cut("iban") == ["GB82 WEST 1234 5698 7654 32"] and cut("account") == ["12345678"] and cut("address") == ["12 Baker Street"]


def test_edges_and_redaction(make_docs, spark):
    long = "9" * 50_000 + "@" * 50_000 + " a@b.co"
    docs = make_docs([(1, None), (2, ""), (3, "a@b.co or 10.0.0.1"), (3, "a@b.co or 10.0.0.1"), (None, "+1 (068) 555-2748"), (4, long)])
    rows = pii.pii_spans(docs).collect()
    assert len(rows) == 6 and sum(r.n_email for r in rows) == 3
    empty = hashlib.sha256(b"").hexdigest()
    assert [r.base_sha256 for r in rows if r.doc_id in (1, 2)] == [empty, empty]
    out = pii.redact_pii(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[3].text == "<EMAIL> or <IP>" and texts[3].n_chars == 15 and texts[None].text == "<PHONE>" and texts[1].text is None
    assert pii.pii_spans(make_docs([])).count() == 0


def test_cues_in_any_case():
    for text, kind, want in (
        ("My IbaN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("Password = abcdefgh12345678XYZ", "secret", "abcdefgh12345678XYZ"),
        ("API_KEY: 0123456789abcdef0123", "secret", "0123456789abcdef0123"),
        ("Api-Key='0123456789abcdef0123'", "secret", "0123456789abcdef0123"),
        ("ACCOUNT NUMBER: 12345678", "account", "12345678"),
        ("İİ Account No 12345678", "account", "12345678"),
    ):
        assert [text[a:b] for a, b in pii.find_spans(text, ANCHORS)[kind]] == [want], text
    assert not pii.find_spans("la calle tres 14 y el street 5", ANCHORS)["address"]
