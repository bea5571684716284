"""Text expressions. All run inside the JVM; regular expressions use Unicode classes."""
from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Characters the text layer of a page writes as one and their plain forms
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
QUOTES_FROM, QUOTES_TO = "’‘“”", "''\"\""
# Ranges of scripts
KANA_RANGE, IDEOGRAPH_RANGE, HANGUL_RANGE, CYRILLIC_RANGE = r"\u3040-\u30ff", r"\u3400-\u9fff", r"\uac00-\ud7af", r"\u0400-\u04ff"
HAN_RANGE = r"\u4e00-\u9fff"
CJK = f"[{KANA_RANGE}{IDEOGRAPH_RANGE}{HANGUL_RANGE}]"

# What the structuring rules look for. The heading patterns apply to normalised keys.
PAGE_NUMBER = r"(?i)^(?:\d{1,4}|[ivxlcdm]{1,7})$"
REFERENCES = r"^(?:\d+|[ivxl]+)?\.?(?:references(?:andnotes)?|bibliography|literaturecited|workscited|参考文献)[.:：]?$"
CHECKLIST = (r"^(?:[a-z]|\d+)?\.?(?:neurips|icml|iclr|aaai|ijcai|acl|emnlp|naacl|cvpr|iccv|eccv|ml)?"
             r"(?:paper|reproducibility|responsiblenlp(?:research)?)?checklist:?$")
APPENDIX = r"^(?:[a-z]|\d+)?\.?(?:technical)?(?:appendix|appendices|supplementa(?:ry|l))"
# What the text of such a key starts with, other than a heading's, among the characters that keys lack
_APART = r"[ \-–—\u00ad]*"
MAY_NAME_PART = (rf"(?i)^{_APART}(?:(?:[\divxl]{_APART})*\.?{_APART}(?:r{_APART}e|b{_APART}i|l{_APART}i|w{_APART}o|参)|a{_APART}p|s{_APART}u)")
ABBREVIATIONS = ("e\\.g", "i\\.e", "et al", "cf", "vs", "viz", "resp", "approx", "ca", "Fig", "Figs", "Eq", "Eqs", "Sec", "Secs",
                 "Tab", "Ref", "Refs", "No", "Nos", "Dr", "Prof", "Mr", "Ms", "Mrs", "St", "Vol", "pp", "Ch", "Def", "Thm",
                 "Lem", "Prop", "Cor", "Alg", "App")
CLOSERS = "\"'”’)\\]"
CLOSING = "\"'”’)]"           # the same characters, not as a class
ENDING = max(len(a.replace("\\", "")) for a in ABBREVIATIONS) + 2
OPENERS = "A-Z0-9(\\[\"“‘"
MIN_SENTENCE_WORDS = 3

MARK, CUT = "\u0001", "\u0002"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value computed once per row: an expression used twice is computed twice, and a plain column used inside
    a lambda may be inlined into it and computed again for every element."""
    return F.transform(F.array(value), body)[0]


def sums_before(ns: Column, width: int = 32) -> Column:
    """For each number of an array the sum of those before it. Sums run inside pieces of ``width``, then over the pieces, so that
    no array grows by one element at a time over the whole length."""
    def running(xs: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + of(x)))

    def shift(pieces: Column) -> Column:
        return let(running(pieces, lambda p: F.element_at(p, -1)), lambda bases: F.flatten(F.transform(
            pieces, lambda p, k: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x + F.get(bases, k)))))

    def cut(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(width))
        return F.transform(starts, lambda at: running(F.slice(xs, at, F.lit(width)), lambda x: x))

    return let(let(ns, cut), shift)


def collapse(c: str | Column) -> Column:
    """Whitespace runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def brief(c: str | Column, n: int = 80) -> Column:
    return F.trim(F.substring(collapse(F.coalesce(col(c), F.lit(""))), 1, n))


def expand_ligatures(c: str | Column) -> Column:
    out = F.translate(col(c), QUOTES_FROM, QUOTES_TO)
    for one, many in LIGATURES.items():
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def norm_key(c: str | Column) -> Column:
    """The matching key of a text: lower case, ligatures expanded, without whitespace, hyphens and dashes."""
    return F.regexp_replace(expand_ligatures(F.lower(col(c))), r"(?U)[\s\-–—\u00ad]", "")


def dehyphenate(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"([A-Za-z])-(?U:\s+)([a-z])", "$1$2")


def word_count(c: str | Column) -> Column:
    """Words of a collapsed text."""
    return F.when(F.length(col(c)) == 0, 0).otherwise(F.size(F.split(col(c), " ")))


def raw_sentences(c: str | Column) -> Column:
    """The pieces of a paragraph at its end marks, before short pieces are merged."""
    text = collapse(c)
    marked = F.regexp_replace(text, f"([.!?][{CLOSERS}]*)(?=\\s+[{OPENERS}])", "$1" + MARK)

    def shortened(p: Column) -> Column:
        """An abbreviation ends the piece: looked for in its last characters, one more than the longest has."""
        return F.right(F.rtrim(p, F.lit(CLOSING)), F.lit(ENDING)).rlike(f"(?U)\\b(?:{'|'.join(ABBREVIATIONS)}|[A-Z])\\.$")

    def unmarked(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p, i: F.when((i == F.size(parts) - 1) | shortened(p), p).otherwise(F.concat(p, F.lit(MARK)))), "")

    pieces = F.split(let(F.split(marked, MARK), unmarked), MARK)
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: F.length(p) > 0)


def split_sentences(c: str | Column) -> Column:
    """The sentences of a paragraph as an array.

    A piece of fewer than three words joins its predecessor, and a predecessor of fewer takes the next piece. Only the
    first sentence can start with a short piece, so a piece opens a sentence exactly when it is long enough and at least
    three words stand before it: no fold over the pieces is needed.
    """
    pieces = raw_sentences(c)

    def opens(p: Column, i: Column, parts: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), F.least(i, F.lit(MIN_SENTENCE_WORDS))), F.lit(0),
                             lambda n, x: n + word_count(x))
        return (i > 0) & (word_count(p) >= MIN_SENTENCE_WORDS) & (before >= MIN_SENTENCE_WORDS)

    joined = let(pieces, lambda parts: F.split(F.array_join(F.transform(
        parts, lambda p, i: F.concat(F.when(i == 0, F.lit("")).when(opens(p, i, parts), F.lit(CUT)).otherwise(F.lit(" ")), p)), ""), CUT))
    return F.filter(joined, lambda s: F.length(s) > 0)


def count_matches(c: str | Column, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


# a named or numeric character reference, as html.unescape finds it
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def read_references(found: pd.Series) -> pd.Series:
    return found.map(lambda refs: [html.unescape(r) for r in refs], na_action="ignore")


def unescape(c: str | Column) -> Column:
    """Named and numeric character references as the characters they stand for. Only the references go to Python, not the texts."""
    text = col(c)
    read = read_references(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    pieces = F.zip_with(F.split(text, REFERENCE, -1), read, lambda rest, ref: F.concat(rest, F.coalesce(ref, F.lit(""))))
    return F.array_join(pieces, "")


def html_text(c: str | Column) -> Column:
    """Markup as plain text: tags to spaces, character references read, collapsed."""
    return collapse(unescape(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<[^>]+>", " ")))


def note_title(c: str | Column) -> Column:
    """The text of the first heading, else of the whole note, at most 200 characters."""
    markup = F.coalesce(col(c), F.lit(""))
    heading = F.regexp_extract(markup, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    has = markup.rlike(r"(?is)<h1[^>]*>.*?</h1>")
    return F.substring(collapse(F.regexp_replace(F.when(has, heading).otherwise(markup), r"<[^>]+>", "")), 1, 200)


def note_body(c: str | Column) -> Column:
    """The text of a note without its first heading."""
    markup = F.coalesce(col(c), F.lit(""))
    parts = F.split(markup, r"(?is)<h1[^>]*>.*?</h1>", 2)
    return html_text(F.array_join(parts, " "))


def token_estimate(c: str | Column) -> Column:
    """Tokens of a text: 1.3 per Chinese, Japanese or Korean character, a quarter per other one."""
    wide = count_matches(c, CJK)
    return F.floor(wide * F.lit(1.3) + (F.length(col(c)) - wide) / F.lit(4.0)).cast("long")
