"""Text analysis as column expressions: a column of text in, an array of terms out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.config import at_least

Analyzer = Callable[[Column], Column]

ENGLISH = tuple("a an and are as at be but by for from has he if in into is it its no not of on or s she such t that the their then there these they this to was were will with".split())
SPACES = r"[\p{Z}\t-\r\x1c-\x1f]+"
SEPARATORS = r"(?:[^\p{L}\p{Nd}]|[\x{10000}-\x{10FFFF}])+"


def lowered(text: Column) -> Column:
    """Lower case character by character: no letter becomes two, no sigma is final."""
    return F.lower(F.translate(F.coalesce(text.cast("string"), F.lit("")), "İΣ", "iσ"))


def standard(stopwords: tuple[str, ...] = (), min_length: int = 1, stemmer: Callable[[Column], Column] | None = None) -> Analyzer:
    """Runs of letters and digits, lower-cased; length and stop-words are tested before stemming."""

    def analyze(text: Column) -> Column:
        terms = F.filter(F.split(lowered(text), SEPARATORS), lambda t: F.length(t) >= max(1, min_length))
        if stopwords:
            terms = F.filter(terms, lambda t: ~t.isin(*stopwords))
        return F.transform(terms, stemmer) if stemmer else terms

    return analyze


def light_stem(t: Column) -> Column:
    """Plural endings, then -ing, -ed and -ly."""
    n, cut = F.length, lambda c, k: F.substring(c, F.lit(1), F.length(c) - k)
    ends = lambda c, *suffixes: c.rlike(f"(?:{'|'.join(suffixes)})$")
    one = (
        F.when((n(t) > 4) & ends(t, "ies"), F.concat(cut(t, 3), F.lit("y")))
        .when((n(t) > 4) & ends(t, "ses", "xes", "zes", "ches", "shes"), cut(t, 2))
        .when((n(t) > 3) & ends(t, "s") & ~ends(t, "ss"), cut(t, 1))
        .otherwise(t)
    )

    def second(s: Column) -> Column:
        return F.when((n(s) > 5) & ends(s, "ing"), cut(s, 3)).when((n(s) > 4) & ends(s, "ed"), cut(s, 2)).when((n(s) > 4) & ends(s, "ly"), cut(s, 2)).otherwise(s)

    return F.transform(F.array(one), second)[0]


def ngrams(n: int) -> Analyzer:
    """Windows of n characters of each run between white space; a shorter run is one term."""
    at_least("n", n)

    def analyze(text: Column) -> Column:
        runs = F.filter(F.split(lowered(text), SPACES), lambda r: r != "")
        windows = lambda r: F.when(F.length(r) <= n, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(n))))
        return F.flatten(F.transform(runs, windows))

    return analyze


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Words, and every other character that isn't white space by itself."""
    value = lowered(text) if lower else F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_extract_all(value, F.lit(r"[\p{L}\p{Nd}]+|[^\p{L}\p{Nd}\p{Z}\t-\r\x1c-\x1f]"), F.lit(0))


def topic_vector(text: Column, topics: dict[str, set[str]]) -> Column:
    """How many words of each topic's lexicon the text has: a toy embedding."""
    words = standard()(text)

    def count(lexicon: set[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*sorted(lexicon)))).cast("float")

    return F.array(*map(count, topics.values()))
