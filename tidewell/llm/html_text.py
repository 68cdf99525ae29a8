"""Main text of web pages by site template removal.

Each page is read once into blocks of text and the element subtrees of the whole page. A subtree's hash covers its tags and text.
Subtrees are counted for each host in Spark, over pages with different main content (the smallest block hash outside the subtree
tells them apart, so that copies of a page do not make its text a template), and deleted where they recur: outside what tags and
classes mark as the article, from MIN_PAGES different pages of the host on; within it, or on pages that mark none, only if they
are also on a share MIN_SHARE of the host's different pages, since unrelated articles may quote the same passage.

Tags finish the work on what is left: where a page marks its article only that is read, and menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments that recur on too few pages go by tag, role and class. In a marked
article paragraphs, headings, list items and cells are never templates, alone or as all that a container holds.

Null html counts as empty; a page without text gives an empty one. A null url is a host of its own. Rows repeat as they are
given. Broken mark-up is closed as HTML prescribes for paragraphs, list items and table parts; what is never closed ends with the
page. Of articles of equal length the outer one counts, and then the first. Reading takes time in proportion to a page's length,
however deep its mark-up.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.common import Memo, cut, small

#: A subtree is a template from so many different pages of a host; within articles, if they are also this share of its different pages.
MIN_PAGES, MIN_SHARE = 5, 0.5
#: Templates (8 bytes each) up to which all of them go to every task; more meet the pages in a shuffle.
MOST_BROADCAST = 500_000

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr caption figcaption".split())
CONTAINER = frozenset("div section nav header footer aside ul ol dl table tbody thead tfoot form fieldset figure address details dialog main article body center menu hgroup summary".split())
BREAKING = FLOW | CONTAINER | {"hr", "html", "head"}
CLOSES = {t: frozenset({"p"}) for t in BREAKING - {"td", "th", "tr", "tbody", "thead", "tfoot"}} | {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
SCOPE = frozenset("table ul ol dl div section article main body td th aside nav header footer form blockquote figure".split())
#: What is not part of an article.
NOISE_TAGS = frozenset("nav footer aside form dialog button select noscript menu fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar alertdialog".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notification newsletter subscribe signup login sidebar rail nav navbar navigation menu breadcrumb breadcrumbs footer comment comments respond disqus discussion replies share sharing social related recommended popup modal overlay banner toolbar pagination pager".split())
NOISE_NAMES = frozenset("header site-header page-header masthead topbar site-top".split())
NOT_NOISE = frozenset("has no with without is".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")
_BASE, _MOD = 0x1B873593CC9E2D51, (1 << 61) - 1
_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
#: Elements that hold a page or its article: never noise or a template as such.
WHOLE = frozenset("html head body main article".split())


def host(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


def noise(tag: str, attrs: str) -> bool:
    if tag in NOISE_TAGS:
        return True
    if not attrs or "=" not in attrs:
        return False
    for name, *values in _NAMES.findall(attrs):
        value = "".join(values).lower()
        name = name.lower()
        if name == "role" and value in NOISE_ROLES or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = re.split(r"[-_]+", word)
                if word in NOISE_NAMES or parts[0] not in NOT_NOISE and not NOISE_WORDS.isdisjoint(parts):
                    return True
    return False


def text_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") % _MOD


_tag_hash = Memo(lambda tag: text_hash(f"<{tag}>"), 10_000)


class Page:
    """blocks: texts in page order. elements: [tag, noise, first block, end block, hash, depth, within noise]."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.elements: list[list] = []
        self.stack: list[tuple[str, int, int, int]] = []  # tag, index in elements or -1, hash and events before it
        self.places: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.scopes: list[int] = []  # where in the stack a scope is open
        self.run: list[str] = []
        self.hash, self.events, self.noisy = 0, 0, 0
        at, n = 0, len(source)
        while at < n:
            m = _MARKUP.search(source, at)
            if m is None:
                self.run.append(source[at:])
                break
            if m.start() > at:
                self.run.append(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            else:
                attrs = m[3] or m[6] or ""
                self.open(tag, attrs)
                if tag in RAW:
                    end = _END[tag].search(source, at) if not attrs.endswith("/") else None
                    at = end.end() if end else at if attrs.endswith("/") else n
        self.flush()
        self.pop_to(0)

    def event(self, what: int) -> None:
        self.hash = (self.hash * _BASE + what) % _MOD
        self.events += 1

    def flush(self) -> None:
        if self.run:
            text = " ".join(entities.unescape("".join(self.run)).split())
            self.run = []
            if text:
                self.blocks.append(text)
                self.event(text_hash(text))

    def open(self, tag: str, attrs: str) -> None:
        if tag == "br" or tag == "wbr":
            self.run.append(" " * (tag == "br"))
            return
        if tag in RAW:
            return
        if tag in BREAKING or tag in NOISE_TAGS:
            self.flush()
        if closes := CLOSES.get(tag):
            # what it closes, up to the nearest scope
            while (i := max((own[-1] for t in closes if (own := self.places.get(t))), default=-1)) >= (self.scopes[-1] if self.scopes else 0):
                self.pop_to(i)
        if tag in VOID:
            return
        at, bad = -1, noise(tag, attrs)
        if tag in BREAKING or bad:
            if tag not in BREAKING:
                self.flush()
            at = len(self.elements)
            self.elements.append([tag, bad, len(self.blocks), -1, 0, len(self.stack), self.noisy > 0])
            self.noisy += bad and tag not in WHOLE
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, at, self.hash, self.events))
        self.event(_tag_hash[tag])

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, at, before, n = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if at >= 0:
                self.flush()
                own = self.elements[at]
                own[3] = len(self.blocks)
                own[4] = (self.hash - before * pow(_BASE, self.events - n, _MOD)) % _MOD
                self.noisy -= own[1] and tag not in WHOLE

    def close(self, tag: str) -> None:
        if tag in BREAKING:
            self.flush()
        if own := self.places.get(tag):
            self.pop_to(own[-1])

    def main(self) -> tuple[int, int, bool]:
        """(first block, end block, marked): the longest article outside what is noise, or else main, or else the page."""
        size = [0]
        for b in self.blocks:
            size.append(size[-1] + len(b))
        for tag in ("article", "main"):
            own = [e for e in self.elements if e[0] == tag and e[3] > e[2] and not e[6]]
            if own:
                e = max(own, key=lambda e: (size[e[3]] - size[e[2]], -e[5]))
                return e[2], e[3], True
        return 0, len(self.blocks), False


def covered(ranges: list[tuple[int, int]], n: int) -> list[bool]:
    """Which of n places lie in one of the ranges."""
    step = [0] * (n + 1)
    for a, b in ranges:
        step[a] += 1
        step[b] -= 1
    out, depth = [], 0
    for d in step[:n]:
        depth += d
        out.append(depth > 0)
    return out


def read_page(source: str) -> tuple[list[str], list[tuple[int, int, int, int, bool]], int]:
    """(blocks of the article by tags alone, subtrees of the page, hash of its content): a subtree has its hash, its first and end block among these blocks, the smallest hash of those outside it, and whether none is inside."""
    page = Page(source)
    n = len(page.blocks)
    lo, hi, marked = page.main()
    # a header that holds the headline of an article is part of it
    drop = covered([(a, b) for tag, bad, a, b, *_ in page.elements if (bad or tag == "header" and not (marked and lo <= a and b <= hi)) and not (a <= lo and hi <= b and (marked or tag == "body"))], n)
    protected = covered([(a, b) for tag, _, a, b, *_ in page.elements if marked and tag in FLOW and lo <= a and b <= hi and not (a <= lo and hi <= b)], n)
    kept = [i for i in range(lo, hi) if not drop[i]]
    blocks = [page.blocks[i] for i in kept]
    before, bare = [0], [0]  # kept blocks, and those of them that may be part of a template, before each block
    taken = iter(kept)
    nxt = next(taken, -1)
    for i in range(n):
        own = i == nxt
        before.append(before[-1] + own)
        bare.append(bare[-1] + (own and not protected[i]))
        if own:
            nxt = next(taken, -1)
    own = [text_hash(b) for b in blocks]
    first, last = [_MOD], [_MOD]  # smallest hash of the first and of the last i blocks
    for h in own:
        first.append(min(first[-1], h))
    for h in reversed(own):
        last.append(min(last[-1], h))
    trees = []
    for tag, _, a, b, h, *_ in page.elements:
        if a < b and tag not in WHOLE:
            x, y = before[a], before[b]
            if x == y:
                trees.append((h, 0, 0, first[-1], True))
            elif y - x < len(blocks) and lo <= a and b <= hi and bare[b] > bare[a] and not (marked and tag in FLOW):
                trees.append((h, x, y, min(first[x], last[len(blocks) - y]), False))
    return blocks, trees, sum(own) % _MOD


TREE = pa.struct([("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("other", pa.int64()), ("outside", pa.bool_())])


def parse_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, url, host (a hash), blocks, trees, content. A tree's key is a hash of its own and of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            blocks, sizes, hosts, content, trees = [], [0], [], [], []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b, t, c = read_page(source or "")
                site = text_hash(host(url) or "")
                blocks.append(b)
                trees += [((h * _BASE + site) % _MOD, *rest) for h, *rest in t]
                sizes.append(len(trees))
                hosts.append(site)
                content.append(c)
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*trees, strict=True)) or [()] * 5, TREE, strict=True)], fields=list(TREE))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.int64()), pa.array(blocks, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat), pa.array(content, pa.int64())], names=["id", "url", "host", "blocks", "trees", "content"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, host long, blocks array<string>, trees array<struct<key:bigint,lo:int,hi:int,other:bigint,outside:boolean>>, content long")


def templates(parsed: DataFrame) -> DataFrame:
    """(key, inside): subtrees that recur on many different pages of a host, outside or inside articles. Distinct before counting, so that a hot host or key is summed where it is read."""
    trees = lambda inside, *cols: parsed.select("host", "content", F.explode(F.filter("trees", lambda t: t["outside"] != inside)).alias("t")).select(*cols).distinct()
    outside = trees(False, "t.key", "t.other").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    apart = trees(True, "host", "t.key", "t.other", "content").groupBy("host", "key", "other").agg(F.count("*").alias("n"))
    counts = apart.groupBy("host", "key").agg(F.count("*").alias("n_apart"), F.sum("n").alias("n")).where(F.col("n_apart") >= MIN_PAGES)
    hosts = parsed.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("n_pages"))
    inside = counts.join(hosts, "host").where(F.col("n") >= MIN_SHARE * F.col("n_pages"))
    return outside.select("key", F.lit(False).alias("inside")).unionByName(inside.select("key", F.lit(True).alias("inside")))


def without(parsed: DataFrame, id_col: str, url_col: str, known) -> DataFrame:
    """Pages without their templates: known.value holds the sorted keys outside and inside articles, or else each page has its own in `gone` and `gone_inside`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            trees, texts, n_deleted = batch.column(3), [], []
            flat, ends = trees.flatten(), np.cumsum([0, *pc.fill_null(pc.list_value_length(trees), 0).to_pylist()])
            key, lo, hi, _, outside = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            if known is not None:
                gone = np.where(outside.astype(bool), np.isin(key, np.concatenate(known.value)), np.isin(key, known.value[1]))
            else:
                own = [({*(a or ()), *(b or ())}, {*(b or ())}) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                at = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                gone = np.array([k in own[i][not o] for k, i, o in zip(key.tolist(), at.tolist(), outside.tolist(), strict=True)], bool)
            for i, blocks in enumerate(batch.column(2).to_pylist()):
                cuts = np.flatnonzero(gone[ends[i] : ends[i + 1]]) + ends[i]
                n_deleted.append(len(cuts))
                if (ranges := [(lo[j], hi[j]) for j in cuts if lo[j] < hi[j]]) and blocks:
                    blocks = [b for b, c in zip(blocks, covered(ranges, len(blocks)), strict=True) if not c]
                texts.append(" ".join(blocks or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(n_deleted, pa.int32())], names=["id", "url", "text", "n_chars", "n_deleted"])

    kinds = [parsed.schema[c].dataType.simpleString() for c in ("id", "url")]
    columns = ["id", "url", "blocks", "trees", *(["gone", "gone_inside"] if known is None else [])]
    return parsed.select(*columns).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long, n_deleted int")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, n_deleted (template subtrees)."""
    parsed = cut(parse_pages(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "pages", "zstd")
    found = cut(templates(parsed), "templates")
    if found.count() <= MOST_BROADCAST:
        rows = found.toArrow()
        key, within = rows["key"].to_numpy(), rows["inside"].to_numpy()
        keys = (np.sort(key[~within]), np.sort(key[within]))
        return without(parsed, id_col, url_col, pages.sparkSession.sparkContext.broadcast(keys))
    hits = parsed.select("row", F.explode("trees.key").alias("key")).join(found, "key").groupBy("row").agg(F.collect_set(F.when(~F.col("inside"), F.col("key"))).alias("gone"), F.collect_set(F.when(F.col("inside"), F.col("key"))).alias("gone_inside"))
    return without(parsed.join(hits, "row", "left"), id_col, url_col, None)
