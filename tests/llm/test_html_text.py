import html
import re

from tidewell.llm import html_text as H

PAGES = "page_id long, url string, html string, host string, blocks string, row long"


def one(source):
    return " ".join(H.read_page(source)[0])


def test_article_only():
    page = """<!doctype html><html><head><title>T</title><style>x{}</style><script>var a="</p><p>no";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li>menu</ul></nav>
    <!-- <p>gone</p> --><div class="cookie-notice">We use cookies</div><article><header><h1>Head &amp; line</h1></header><p>One <b>bo</b>ld&nbsp;word<br>two   &lt;3 a < b<p>Next<div class=ad>Buy</div><ul><li>x<li>y</ul>
    <section id="comments"><p>nice post</p></section></article><aside>side</aside><form>q<input></form><footer>&copy;</footer>"""
    assert one(page) == "Head & line One bold word two <3 a < b Next x y"


def test_without_an_article_and_broken_markup():
    assert one("<div id=main-content><p>a<p>b</div><div class='ads'>no</div>tail") == "a b tail"
    assert one("plain text") == "plain text" and one("") == "" and one("<p") == "<p" and one("<script>never closed") == ""
    assert one("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"
    assert one('<p title="a > b">x</p><p class=\'no>isy">y') != ""
    assert one("<div>" * 5000 + "deep") == "deep"


def plain(source):
    a = source[source.index("<article>") + 9 :].split("</article>")[0]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", a))).split())


def test_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    got = {r.page_id: r for r in H.main_text(pages).collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_templates_of_a_site_go(spark):
    promo = "<div class=x1><p>Read our other pages and write to us</p></div>"
    own = lambda i: f"<div><h1>Title {i}</h1><p>body {i} of its own</p>{promo}<p>end {i}</p></div>"
    rows = [(i, "http://a.org/%d" % i, own(i)) for i in range(8)] + [(100 + i, "http://b.org/%d" % i, own(i)) for i in range(2)]
    quoted = "<p>" + "a passage that many articles quote " * 9 + "</p>"
    rows += [(200 + i, "http://c.org/%d" % i, f"<article><h1>T {i}</h1>{quoted}<p>own {i}</p></article>") for i in range(8)]
    rows += [(300 + i, "http://d.org/%d" % i, "<div><h1>Same</h1><div><p>copied page</p></div><p>all over</p></div>") for i in range(9)]
    rows += [(400, None, None), (401, None, ""), (402, "nonsense", "<p>x</p>"), (402, "nonsense", "<p>x</p>"), (None, "http://a.org/z", "<p>long " + "word " * 100_000)]
    got = H.main_text(spark.createDataFrame([(*r, "h", "b", 7) for r in rows], PAGES)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"Title {i} body {i} of its own end {i}" for i in range(8))
    assert all("Read our other pages" in text[100 + i] for i in range(2))
    assert all("many articles quote" in text[200 + i] for i in range(8))
    assert all(text[300 + i] == "Same copied page all over" for i in range(9))
    assert text[400] == text[401] == "" and text[402] == "x" and len(text[None]) == 4 + 5 * 100_000
    assert H.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_what_a_few_pages_of_a_host_share_stays(spark):
    shared = "<section><p>A passage</p><ul><li>and a list</ul></section>"
    rows = [(i, f"http://a.org/{i}", f"<div><h1>T {i}</h1>{shared if i < 5 else ''}<p>own {i}</p></div>") for i in range(40)]
    rows += [(100 + i, f"http://b.org/{i}", f"<article><h1>T {i}</h1>{shared}<p>own {i}</p></article>") for i in range(8)]
    rows += [(200 + i, f"http://c.org/{i}", f"<article><h1>T {i}</h1><div>Read on</div><p>own {i}</p></article>") for i in range(8)]
    rows += [(300 + i, f"http://d.org/{i}", f"<div><h1>T {i % 10}</h1>{shared if i % 10 < 6 else ''}<p>own {i % 10}</p></div>") for i in range(40)]  # copies count once
    got = {r.page_id: r for r in H.main_text(spark.createDataFrame([(*r, "h", "b", 7) for r in rows], PAGES)).collect()}
    assert all(got[i].text == f"T {i} A passage and a list own {i}" and not got[i].n_deleted for i in range(5))
    assert all(got[100 + i].text == f"T {i} A passage and a list own {i}" and not got[100 + i].n_deleted for i in range(8))
    assert all(got[200 + i].text == f"T {i} own {i}" and got[200 + i].n_deleted == 1 for i in range(8))
    assert all("A passage" not in got[300 + i].text for i in range(40))


def test_deep_markup_takes_time_in_proportion():
    import time

    for source in ("<div>" * 100_000 + "x" + "</p>" * 100_000, "<b>" * 50_000 + "<p>x" * 50_000, "<div class=ad>" * 50_000 + "x", "<article>" * 30_000 + "x", "<ul><li>x" * 30_000, "<table><tr><td>" * 20_000 + "x"):
        H.read_page("<p>warm")
        start = time.process_time()
        H.read_page(source)
        assert time.process_time() - start < 4, source[:20]  # a square of it would take minutes


def test_what_is_no_markup_stays():
    assert one("<article><p>a <math><mi>x</mi><mo>+</mo></math> b</p><svg><text>label</text></svg><object>fallback</object><template>t</template></article>") == "a x+ b labelfallbackt"


def test_ties_of_articles():
    assert one("<article>one</article><article>two</article>") == "one"
    assert one("<article><article>in</article></article>") == "in"


def test_site_furniture_goes_by_count(spark, monkeypatch):
    """Without any word of class names, what recurs on a host's pages goes; what is on too few pages is left to the tags."""
    for name in ("NOISE_WORDS", "NOISE_TAGS", "NOISE_NAMES", "NOISE_ROLES"):
        monkeypatch.setattr(H, name, frozenset())
    furniture = "<nav><ul><li><a href=/x>Home</a><li><a href=/y>All</a></ul></nav><div class=ad>Buy now</div>"
    rows = [(i, f"http://a.org/{i}", f"{furniture}<div><h1>T {i}</h1><p>own {i}</p></div><footer>by us</footer>") for i in range(9)]
    rows += [(100 + i, f"http://b.org/{i}", f"{furniture if i < 6 else ''}<article><h1>T {i}</h1><p>own {i}</p></article><footer>by us {i}</footer>") for i in range(30)]
    got = {r.page_id: r for r in H.main_text(spark.createDataFrame([(*r, "h", "b", 7) for r in rows], PAGES)).collect()}
    assert all(got[i].text == f"T {i} own {i}" and got[i].n_deleted >= 3 for i in range(9))
    assert all(got[100 + i].text == f"T {i} own {i}" and (got[100 + i].n_deleted >= 2) == (i < 6) for i in range(30))


def brute(rows):
    """Main texts with templates counted by plain sets."""
    read = [(H.host(url) or "", *H.read_page(source or "")) for _, url, source in rows]
    apart, contents, at = {}, {}, {}
    for site, blocks, trees, content in read:
        contents.setdefault(site, set()).add(content)
        for h, lo, hi, other, outside in trees:
            apart.setdefault((site, h, outside), set()).add(other)
            at.setdefault((site, h, outside), set()).add((other, content))
    out = {}
    for (i, _, _), (site, blocks, trees, _) in zip(rows, read, strict=True):
        inside = {h for h, *_ in trees if len(apart.get((site, h, False), ())) >= 5 and len(at[site, h, False]) >= 0.5 * len(contents[site])}
        dead = [(lo, hi) for h, lo, hi, _, outside in trees if h in inside or outside and len(apart[site, h, True]) >= 5]
        out[i] = (" ".join(b for k, b in enumerate(blocks) if not any(lo <= k < hi for lo, hi in dead)), len(dead))
    return out


def test_deletions_are_those_of_brute_force(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.where("url like '%ion%.example.%'").collect()]
    # the same pages without the mark of their article, so that the rest is told by count and class alone
    rows += [(10_000 + i, u, h.replace("article", "div")) for i, u, h in rows]
    frame = spark.createDataFrame([(*r, "h", "b", 7) for r in rows], PAGES)
    want = brute(rows)
    got = {r.page_id: (r.text, r.n_deleted) for r in H.main_text(frame).collect()}
    assert got == want and sum(n for _, n in want.values()) > 0
    monkeypatch.setattr(H, "MOST_BROADCAST", -1)
    assert {r.page_id: (r.text, r.n_deleted) for r in H.main_text(frame).collect()} == want
