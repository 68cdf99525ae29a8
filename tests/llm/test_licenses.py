import random
import re

from tidewell.llm import licenses as L

S = L.Scanner()


def names(text):
    return [f[2] for f in S.scan(text)]


def test_wordings():
    for name, texts in L.TEMPLATES.items():
        for t in texts:
            assert name in names(f"some prose before\n{t}\nand after"), (name, t)
            assert name in names("filler words in a row " * 9 + t + " filler words in a row" * 9), (name, t)


def test_exact_wording_decides():
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0"]
    assert names("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and names("Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert names("Licensed under CC BY-NC 5.0.") == [] and names("a licence to kill and a copyright of none") == []
    mit = L.TEMPLATES["MIT"][-1].replace("associated documentation files", "documentation").replace("(the \"Software\")", "")
    found = S.scan("Copyright 2020 X\n\n" + "\n".join(re.findall(r".{1,60}(?:\s|$)", mit)))
    assert [f[2] for f in found] == ["MIT"] and "-associated" in found[0][4]


def test_repeated_notices_are_all_found():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    for gap, n in ((5, 3), (40, 6), (900, 5), (0, 40)):  # one line, a long line, far apart, side by side
        text = ("filler " * gap).join(f"{mit} filler {apache} " for _ in range(n))
        want = sorted((m.start(), m.end() - 1, name) for t, name in ((mit, "MIT"), (apache, "Apache-2.0")) for m in re.finditer(re.escape(t), text))
        got = S.scan(text)
        assert [(a, name) for a, _, name, *_ in got] == [(a, name) for a, _, name in want] and not any(f[4] for f in got), (gap, n)
    # a nearer passage of another wording does not hide one
    assert names("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0", "CC-BY-4.0", "CC-BY-NC-4.0"]


def test_find_is_approximate_matching():
    t = L.Template("x", "a b c d e f g h i j")
    assert t.find("q q a b c d e f g h i j q".split()) == (12, 0)
    assert t.find("q a b c x e f g h i j q".split())[1] == 1
    assert t.find("a b q q q q q".split()) is None


def test_documents_and_edges(spark, make_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {(r.doc_id, n, m.start()) for r in docs.collect() for t, n in lines.items() for m in re.finditer(re.escape(t), r.text)}
    got = {(r.doc_id, r.license, r.start) for r in L.license_passages(docs).collect()}
    assert got == want
    long = "word " * 100_000 + "Released under the MIT License." + " word" * 100_000
    rows = L.license_passages(make_docs([(1, None), (2, ""), (3, long), (4, "İ" * 50 + "\nReleased under the MIT License."), (4, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.\n\nReleased under the MIT License.")])).collect()
    assert sorted((r.doc_id or 0, r.license) for r in rows) == [(0, "CC-BY-4.0"), (0, "MIT"), (3, "MIT"), (4, "MIT"), (4, "MIT")]
    assert L.license_passages(make_docs([])).count() == 0


def nearest(pattern, words):
    """Fewest word edits between a pattern and any passage, by the full table."""
    row, best = list(range(len(pattern) + 1)), len(pattern)
    for w in words:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != w)))
        row, best = new, min(best, new[-1])
    return best


def test_differing_wordings_against_brute_force():
    """A template whose words were edited is reported if and only if the full table finds a passage near enough that leaves its deciding words alone."""
    r = random.Random(11)
    long = [(n, t) for n, ts in L.TEMPLATES.items() for t in ts if len(L.words(t)) >= 20]
    seen = {True: 0, False: 0}
    for _ in range(150):
        name, text = r.choice(long)
        own = text.split()
        for _ in range(r.randint(0, len(own) // 3)):
            j = r.randrange(len(own))
            if not L.deciding(own[j].strip('.,:;()"').lower()) and not any(map(L.deciding, (w for w, _, _ in L.words(own[j])))):
                own[j : j + 1] = r.choice([["other"], [], [own[j], "more"]])
        block = "Copyright notice and permission: " + " ".join(own)
        pattern = [w for w, _, _ in L.words(text)]
        distance = nearest(pattern, [w for w, _, _ in L.words(block)])
        got = name in names(block)
        if distance <= 0.12 * len(pattern):
            assert got, (name, distance, len(pattern), block)
        elif distance > L.MOST_DIFFERENT * len(pattern) and not any(n == name and nearest([w for w, _, _ in L.words(t)], [w for w, _, _ in L.words(block)]) <= L.MOST_DIFFERENT * len(L.words(t)) for n, t in long):
            assert not got, (name, distance, len(pattern), block)
        else:
            continue
        seen[got] += 1
    assert min(seen.values()) > 10


def test_long_lines_and_ties():
    mit = "Released under the MIT License."
    for n in (300, 900, 5000, 40_000):
        assert names("word " * n + mit + " word" * n) == ["MIT"]
    assert [f[:2] for f in S.scan(f"{mit} {mit}")] == [(0, 30), (32, 62)]
