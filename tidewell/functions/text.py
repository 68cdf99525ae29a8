"""Text cleaning as column expressions, in the order that gives them their meaning.

Unicode classes ((?U)) make white space and word characters mean what they do for text, not for ASCII. Only two steps have no
built-in function, Unicode composition and character references; with them, all steps are one Arrow UDF.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

URL_TOKEN, USER_TOKEN, EMAIL_TOKEN, PHONE_TOKEN = "<URL>", "<USER>", "<EMAIL>", "<PHONE>"

#: Fixed values that results must share: patterns of what is removed or replaced.
ZERO_WIDTH = "[​‌‍⁠﻿­]"
URL_PLACEHOLDER = r"(?i)<\s*url\s*>"
REMOVED_MARKERS = ("[removed]", "[deleted]", "[removed by reddit]")
MD_LINK = r'!?\[([^\]\n]*)\]\(\s*(?:[^()\s]|\([^()\s]*\))*\s*(?:"[^"]*")?\)'
MD_RULE = r"(?m)^[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*$"
MD_HEADING = r"(?m)^[ \t]{0,3}#{1,6}[ \t]+"
MD_QUOTE = r"(?m)^[ \t]*(?:>[ \t]?)+"
MD_BULLET = r"(?m)^[ \t]*[-*+][ \t]+"
MD_STRONG = r"(\*\*|__|~~)(?=\S)(.+?)(?<=\S)\1"
MD_EM_STAR = r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])"
MD_EM_UNDERSCORE = r"(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])"
MD_CODE = r"`{1,3}([^`]*)`{1,3}"
MD_SUPERSCRIPT = r"\^\(([^)]*)\)|\^(?=\S)"
MD_ESCAPE = r"\\([\\`*_{}\[\]()#+\-.!>~|^])"
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
URL = r"(?i)\b(?:https?://|www\.)\S+|\b[a-z0-9.-]+\.(?:com|org|net|edu|gov|io|co|uk|ly|me)(?:/\S*)?\b"
MENTION = r"(?i)(?<![\w/])(?:/?u/[A-Za-z0-9_-]{2,}|@[A-Za-z0-9_]{2,})"
PHONE = r"(?<![\w+])(?:(?:\+?1[\s.-]?)?(?:\(\d{3}\)\s?|\d{3}[\s.-])\d{3}[\s.-]\d{4}|\+\d{1,3}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4}|\d{10,11})(?!\w)"
BOT_PATTERNS = ("i am a bot", "this action was performed automatically", "contact the moderators of this subreddit", "^(?:your )?(?:post|submission) has been (?:automatically )?removed")
TOKEN = r"\w+|[^\w\s]"
PLACEHOLDER = "<(?:URL|USER|EMAIL|PHONE)>"
SENTENCE_END = r"(?<=[.!?…])[\"'”’)\]]*\s+(?=\S)"
NEGATIONS = ("no", "not", "never", "nor", "nothing", "nobody", "none", "neither", "nowhere", "cannot")

#: English function words, left out on the lexical path.
STOP_WORDS = tuple("a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its me more most my of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your im ive dont didnt doesnt cant wont isnt youre thats really just like get got know".split())

PASSES = 4


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a function of an array's elements computes what it captures anew for each of them."""
    return F.transform(F.array(value), body)[0]


def _u(pattern: str) -> str:
    return f"(?U){pattern}"


#: The steps of a pass in order, in groups: what a text must contain for any pattern of the group to match (a pattern itself, or
#: None where that is as dear), and each pattern with what takes its place.
STEPS: tuple[tuple[str | None, tuple[tuple[str, str], ...]], ...] = (
    (None, ((ZERO_WIDTH, ""),)),
    (r"[<\[]", ((URL_PLACEHOLDER, URL_TOKEN), ("(?i)" + "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in REMOVED_MARKERS), " "), (MD_LINK, f"$1 {URL_TOKEN}"))),
    (r"(?m)^[ \t]*[-*_#>+]", ((MD_RULE, " "), (MD_HEADING, ""), (MD_QUOTE, ""), (MD_BULLET, ""))),
    (r"[*_~`^\\]", ((MD_STRONG, "$2"), (MD_EM_STAR, "$1"), (MD_EM_UNDERSCORE, "$1"), (MD_CODE, "$1"), (MD_SUPERSCRIPT, "$1"), (MD_ESCAPE, "$1"))),
    ("@", ((EMAIL, " "),)),
    (r"(?i)://|www\.|\.(?:com|org|net|edu|gov|io|co|uk|ly|me)", ((URL, URL_TOKEN),)),
    ("[@/]", ((MENTION, USER_TOKEN),)),
    (r"\+|\d\d\d", ((PHONE, " "),)),
)
def once(t: Column) -> Column:
    """One pass of all cleaning steps that are built in."""

    def group(x: Column, trigger: str | None, steps) -> Column:
        done = reduce(lambda y, step: F.regexp_replace(y, _u(step[0]), step[1]), steps, x)
        return done if trigger is None else F.when(x.rlike(_u(trigger)), done).otherwise(x)

    for trigger, steps in STEPS:
        t = let(t, lambda x: group(x, trigger, steps)) if trigger else group(t, trigger, steps)  # noqa: B023  it is called at once
    return F.trim(F.regexp_replace(t, _u(r"\s+"), " "))


def decoded(t: str) -> str:
    """NFC, then character references up to five deep."""
    t = unicodedata.normalize("NFC", t)
    for _ in range(5):
        if (u := html.unescape(t)) == t:
            break
        t = u
    return t


def clean_one(t: str, passes: int = PASSES) -> str:
    """All steps on one text, to a fixed point."""
    for _ in range(passes):
        new = decoded(t)
        for trigger, steps in _compiled():
            if trigger is None or trigger.search(new):
                for pattern, by in steps:
                    new = pattern.sub(by, new)
        new = " ".join(new.split())
        if new == t:
            break
        t = new
    return t


@cache
def _compiled() -> list[tuple]:
    of = lambda by: re.sub(r"\$(\d)", r"\\\1", by)
    return [(trigger and re.compile(trigger), [(re.compile(p), of(by)) for p, by in steps]) for trigger, steps in STEPS]


@F.pandas_udf(StringType())
def _cleaned(text: pd.Series) -> pd.Series:
    return text.map(clean_one, na_action="ignore")


def clean_text(t: Column, passes: int = PASSES, decode: bool = True) -> Column:
    """Cleaned text, to a fixed point of at most four passes; null gives "".

    Patterns run only on texts that hold what they need, and a pass after the first only where the one before changed something. All
    passes are one call of an Arrow UDF: decoding has no built-in function, and these patterns with their Unicode classes take
    the JVM twenty times as long (sf0.1: 0.4 s of Python on each of 8 cores for 10,000 documents). With decode=False character references and
    composition stay as they are, and all steps are built in.
    """

    def settled(x: Column, left: int) -> Column:
        return let(once(x), lambda y: y if left == 1 else F.when(y == x, y).otherwise(settled(y, left - 1)))

    t = F.coalesce(t, F.lit(""))
    return _cleaned(t) if decode else let(t, lambda x: settled(x, passes))


def scrub_text(t: Column, emails: bool = True, urls: bool = True, mentions: bool = True, phones: bool = True) -> Column:
    """Placeholders for personal data, each rule switchable; null stays null. Patterns run only on texts that hold what they need."""
    needs = {pattern: trigger for trigger, steps in STEPS for pattern, _ in steps}
    for on, pattern, token in ((emails, EMAIL, EMAIL_TOKEN), (urls, URL, URL_TOKEN), (mentions, MENTION, USER_TOKEN), (phones, PHONE, PHONE_TOKEN)):
        if on:
            t = let(t, lambda x: F.when(x.rlike(needs[pattern]), F.regexp_replace(x, _u(pattern), token)).otherwise(x))  # noqa: B023  it is called at once
    return t


def term_pattern(terms: list[str]) -> str:
    """Whole words, in any case, of any of some terms, longest first; a term also matches with r/ before it."""
    return r"(?i)(?<![\w/])(?:r/)?(?:" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + r")(?!\w)"


def mask_terms(t: Column, terms: list[str], token: str = "[MASK]") -> tuple[Column, Column]:
    """(text with every term replaced by a token, how many were)."""
    pattern = _u(term_pattern(terms))
    return F.regexp_replace(t, pattern, token.replace("\\", r"\\").replace("$", r"\$")), F.regexp_count(t, F.lit(pattern))


#: Names under which edits are counted, for the patterns of STEPS in order.
EDITS = ("zero_width", "url_placeholder", "removed_marker", "md_link", "md_rule", "md_heading", "md_quote", "md_bullet", "md_strong", "md_em", "md_em", "md_code", "md_superscript", "md_escape", "email_removed", "url", "mention", "phone_removed")
EDIT_NAMES = ("html_unescape", *dict.fromkeys(EDITS))


def edits_of(t: str | None) -> dict[str, int]:
    """How often each rule changes something while a text is cleaned, counted where it is applied, over all passes."""
    found = dict.fromkeys(EDIT_NAMES, 0)
    t = t or ""
    for _ in range(PASSES):
        new = unicodedata.normalize("NFC", t)
        for _ in range(5):
            if (u := html.unescape(new)) == new:
                break
            found["html_unescape"] += 1
            new = u
        for name, (pattern, by) in zip(EDITS, (step for _, steps in _compiled() for step in steps), strict=True):
            new, n = pattern.subn(by, new)
            found[name] += n
        new = " ".join(new.split())
        if new == t:
            break
        t = new
    return found


@F.pandas_udf(StructType([StructField(n, LongType()) for n in EDIT_NAMES]))
def edit_counts(text: pd.Series) -> pd.DataFrame:
    """A struct with the number of edits by rule: each count needs the text as the rules before left it."""
    return pd.DataFrame([edits_of(t) for t in text], columns=list(EDIT_NAMES), dtype="int64")


#: What the last of BOT_PATTERNS matches, which a text must start with.
_REMOVED_NOTICES = [f"{a}{b} has been {c}removed" for a in ("your ", "") for b in ("post", "submission") for c in ("automatically ", "")]


def is_bot_text(t: Column) -> Column:
    """Any of BOT_PATTERNS in any case, by plain search in the lower-case text."""
    return let(F.lower(t), lambda x: reduce(lambda a, b: a | b, [*(x.contains(p) for p in BOT_PATTERNS[:3]), *(x.startswith(p) for p in _REMOVED_NOTICES)]))


def token_estimate(t: Column) -> Column:
    """Word runs and punctuation marks."""
    return F.regexp_count(t, F.lit(_u(TOKEN)))


def letters(t: Column) -> Column:
    return F.regexp_count(F.regexp_replace(t, PLACEHOLDER, " "), F.lit(r"\p{L}"))


def squash(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, _u(r"\s+"), " "))


def dedupe_key(t: Column) -> Column:
    """sha1 of the lower-case text with white space collapsed."""
    return F.sha1(F.lower(squash(t)))


def record_id(source: Column, native: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", source, native.cast("string")), 256), 1, 20)


def lexical_tokens(t: Column) -> Column:
    """Lower-case word tokens without placeholders, stop words and single letters; a plural s is taken off. Negations stay."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(t, PLACEHOLDER, " ")), "’", "'")
    words = F.transform(F.regexp_extract_all(plain, F.lit(r"([a-z]+(?:'[a-z]+)*)"), 1), lambda w: F.replace(w, F.lit("'"), F.lit("")))
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    return F.transform(kept, lambda w: F.when((F.length(w) > 3) & w.rlike("[^s]s$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


#: Frequent words by which a language is told when no detector is at hand.
COMMON_WORDS = {
    "en": "the and of to in is that for it was with as on be at by this are from or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
}
LANGUAGE_CHARS = 1000


def language_hits(t: Column) -> dict[str, Column]:
    """How many of the words among the first LANGUAGE_CHARS characters are frequent in each language."""
    words = F.split(F.lower(F.substring(F.coalesce(t, F.lit("")), 1, LANGUAGE_CHARS)), r"[^\p{L}]+")
    return {lang: let(words, lambda w: F.size(F.filter(w, lambda x: x.isin(*common)))) for lang, common in COMMON_WORDS.items()}  # noqa: B023  it is called at once


def guess_language(t: Column, least: float = 0.5) -> Column:
    """en if at least so much of all hits are English; else the language with most hits (the first by name of equals), und if there are none."""
    hits = language_hits(t)
    total = reduce(lambda a, b: a + b, hits.values())
    best = F.array_max(F.array(*(F.struct(c.alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang")) for i, (lang, c) in enumerate(sorted(hits.items())))))
    return F.when(total == 0, "und").when(F.try_divide(hits["en"].cast("double"), total.cast("double")) >= least, "en").otherwise(best["lang"])


def keyword_pattern(keywords: list[str]) -> str:
    """Whole words, case-insensitive; a trailing * takes any ending, spaces any white space."""
    def part(kw: str) -> str:
        body = r"\s+".join(w for w in kw.lower().rstrip("*").split())
        return body + r"\w*" * kw.endswith("*")

    return r"(?i)\b(?:" + "|".join(sorted(map(part, keywords), key=len, reverse=True)) + r")\b"


def shingles(t: Column, n: int) -> Column:
    """Distinct runs of n words; a shorter text is one shingle, an empty one has none."""
    words = F.filter(F.split(F.lower(squash(t)), " "), lambda x: x != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return let(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(runs(w))).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))


def sentences(t: Column) -> Column:
    """Paragraphs, then sentences within them."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(t, F.lit("")), r"\n+"), F.trim), lambda p: p != "")
    return F.filter(F.flatten(F.transform(paragraphs, lambda p: F.transform(F.split(p, _u(SENTENCE_END)), F.trim))), lambda s: s != "")


def evenly(items: Column, most: int) -> Column:
    """At most so many items, evenly spaced, first and last kept; half-way places round to even."""

    def pick(own):
        n = F.size(own)
        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(max(1, most - 1)))).cast("int")))
        return F.when(n <= most, own).otherwise(F.transform(places, lambda i: F.get(own, i)))

    return let(items, pick)


def sentence_windows(t: Column, per_window: int = 1, min_words: int = 4, most: int | None = None) -> Column:
    """Sentences, short ones merged into the next (a short rest joins the last), grouped per_window at a time."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("rest"))

    def fold(acc, s):
        own = F.when(acc["rest"] == "", s).otherwise(F.concat_ws(" ", acc["rest"], s))
        full = F.regexp_count(own, F.lit(_u(r"\w+"))) >= min_words
        return F.struct(F.when(full, F.array_append(acc["done"], own)).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(own).alias("rest"))

    def finish(acc):
        done, rest = acc["done"], acc["rest"]
        n = F.size(done)
        joined = F.array_append(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.concat_ws(" ", F.get(done, n - 1), rest))
        return F.when(rest == "", done).when(n == 0, F.array(rest)).otherwise(joined)

    units = F.aggregate(sentences(t), start, fold, finish)
    if per_window > 1:
        groups = lambda own: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(own) / per_window).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(own, i * per_window + 1, F.lit(per_window)), " "))
        units = let(units, lambda own: F.when(F.size(own) > 0, groups(own)).otherwise(own))
    return evenly(units, most) if most else units
