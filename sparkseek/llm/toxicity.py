"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text, normalised by length.

Folding maps homoglyphs (Cyrillic, Greek, full-width, mathematical and accented letters) and digit or symbol
substitutions ("1d10t", "tr@sh") to one ASCII letter each, and drops combining and zero-width marks; `1`, `!` and `|`
stand for `l` or `i`: the automaton holds one class for all five, and a match must then agree in its own letters.  A match counts where it begins and ends at the edge of a word
of the *original* text ("stupid!!!" has one, "scumble" none) and no exception phrase covers it ("trash can").

A pattern that ends in `*` is a stem and may end within a word.  learned() adds stems that set toxic from clean labelled rows
apart, language by language (log-odds of word beginnings), as the fixed list knows few languages.

    score = 100 * (sum of weights of the matches that count) / max(words, MIN_WORDS);   toxic = score >= THRESHOLD

Defined results: null or empty text has 0 words, score 0 and isn't toxic; matches in a text of any length all count;
of the patterns that end, then of those that begin at one place, only the longest counts; repeated rows each get their own result; other
columns are kept, and columns of the operator's names are replaced.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import hidden, small_batches
from .text import lean, parts, utf8

THRESHOLD, MIN_WORDS = 0.5, 25
#: learned(): rows of each language and label, letters of stems, clean rows a language needs, times a row must have a stem to count, toxic rows a stem needs, their share, and log-odds; weight by log-odds.
SAMPLE, STEM, LEAST_CLEAN, TIMES, LEAST_TOXIC, SHARE, ODDS, SCALE = 500, (4, 8), 20, 2, 5, 0.2, 3.0, 0.08

LEXICON: dict[str, float] = {
    **dict.fromkeys("trash whore pathetic loser clown stupid dumb lame jerk creep coward liar freak ugly filthy fool".split(), 1.0),
    **dict.fromkeys("idiot moron worthless disgusting scum imbecile cretin scumbag dumbass loathsome repulsive vermin parasite lowlife degenerate garbage subhuman brainless halfwit".split(), 1.5),
    **dict.fromkeys("bastard asshole bitch slut dickhead motherfucker fuck fucking fucker bullshit shithead cunt retard retarded".split(), 3.0),
    **dict.fromkeys("dummkopf vollidiot arschloch abschaum miststück hurensohn connard salaud crétin ordure abruti imbécile enfoiré gilipollas cabrón imbécil idiota estúpido hijoputa".split(), 2.0),
    "kill yourself": 4.0, "piece of shit": 3.0, "waste of space": 2.0, "go to hell": 2.0, "drop dead": 2.0, "shut up": 1.0,
}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "taking out the trash", "class clown", "clown fish", "clown car", "idiot proof", "idiot-proof", "pathetic fallacy", "sore loser", "pond scum", "garbage collection", "garbage collector", "garbage can", "garbage truck", "parasite host", "dumb terminal", "flame retard", "host parasite")

_PAIRS = {
    "a": "аɑαＡ@4ª", "b": "Ьвʙβ8", "c": "сϲƈ¢©", "d": "ԁɗđ", "e": "еєεҽ3€ə", "f": "ƒϝ", "g": "ɡɢց9", "h": "һнհ", "i": "іιɩıɪ1!|lⅼӏƖ£", "j": "јʝ", "k": "кκҡ",
    "m": "мｍ", "n": "ոηпո", "o": "оοօσ0øө", "p": "рρ", "q": "ԛգ", "r": "гʀ", "s": "ѕꜱ5$§", "t": "тτ7+†", "u": "υսμц", "v": "ѵν", "w": "ԝωѡш", "x": "хχ×", "y": "уүγ¥", "z": "ᴢʐ2",
}
DROP, GAP, OTHER, EITHER = 0, 32, 1, 2
EITHERS = "1!|ӏƖⅼ"
_ZERO_WIDTH = (0xAD, 0x34F, 0x61C, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF)


@lru_cache(1)
def table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: the folded byte, the same with l and i told apart, and whether the original is a letter or digit."""
    size = 0x20000
    fold, solid = np.full(size, OTHER, np.uint8), np.zeros(size, bool)
    for c in range(size):
        s = chr(c)
        if s.isspace():
            fold[c] = GAP
            continue
        if c >= 0x300 and unicodedata.combining(s):
            fold[c] = DROP
            continue
        solid[c] = s.isalnum()
        if c < 128:
            fold[c] = ord(s.lower())
        elif solid[c]:
            base = [x for x in unicodedata.normalize("NFKD", s).lower() if not unicodedata.combining(x)]
            if len(base) == 1 and base[0].isascii():
                fold[c] = ord(base[0])
    for letter, alike in _PAIRS.items():
        for s in alike:
            fold[ord(s)] = ord(letter)
            if s.upper() != s and len(s.upper()) == 1:
                fold[ord(s.upper())] = ord(letter)
    strict = fold.copy()
    for c in range(size):  # what stands for a letter that itself has a class, such as a full-width digit
        if 32 < fold[c] < 128:
            strict[c], fold[c] = fold[c], fold[fold[c]]
    strict[[ord("l"), ord("L")]] = ord("l")
    for c in range(size):
        if 32 < strict[c] < 128 and strict[c] not in b"l":
            strict[c] = fold[strict[c]]
    strict[[ord(x) for x in EITHERS]] = EITHER
    fold[list(_ZERO_WIDTH)] = DROP
    solid[list(_ZERO_WIDTH)] = False
    fold[10], fold[9], fold[13] = GAP, GAP, GAP
    return fold, strict, solid


def folded(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What table() has for the text's code points, without those to drop; beyond the table: OTHER, OTHER, False."""
    fold, strict, solid = table()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.minimum(points, len(fold) - 1)
    out, own, whole = fold[inside], strict[inside], solid[inside]
    if len(points) and points.max() >= len(fold):
        far = points >= len(fold)
        out[far], own[far], whole[far] = OTHER, OTHER, False
    if not out.all():
        kept = out != DROP
        return out[kept], own[kept], whole[kept]
    return out, own, whole


def fold_text(text: str) -> str:
    return folded(text)[0].tobytes().decode("latin-1")


def inflected(lexicon: dict[str, float]) -> dict[str, float]:
    """Adds the plain plurals of single words that lack them."""
    out = dict(lexicon)
    for w, x in lexicon.items():
        if " " not in w and w.isalpha():
            out.setdefault(w + ("es" if w.endswith(("s", "x", "sh", "ch")) else "s"), x)
    return out


@lru_cache(4)
def automaton(lexicon: tuple, exceptions: tuple):
    """Over folded patterns; the value of each is its ((pattern with l and i told apart, whether a stem), weight)s, with weight 0 for an exception."""
    import ahocorasick

    a = ahocorasick.Automaton()
    best: dict[str, dict[tuple[bytes, bool], float]] = {}
    for w, x in [*inflected(dict(lexicon)).items(), *((e, 0.0) for e in exceptions)]:
        stem = w.endswith("*") and x > 0
        w = w[:-1] if stem else w
        if f := fold_text(w):
            own = best.setdefault(f, {})
            key = folded(w)[1].tobytes(), stem
            own[key] = max(x, own.get(key, 0.0)) if x else 0.0
    for f, own in best.items():
        a.add_word(f, tuple(own.items()))
    if best:
        a.make_automaton()
    return a, bool(best)


def agrees(own: bytes, pattern: bytes) -> bool:
    return own == pattern or all(x == y or x == EITHER and y in b"il" or y == EITHER and x in b"il" for x, y in zip(own, pattern))


def matches(text: np.ndarray, own: np.ndarray, solid: np.ndarray, a) -> tuple[np.ndarray, np.ndarray]:
    """Ends and weights of the matches that count, in folded bytes that may hold many rows set apart by gaps."""
    strict = own.tobytes()
    found = [(end + 1, len(p), x, stem) for end, each in a.iter(text.tobytes().decode("latin-1")) for (p, stem), x in each if agrees(strict[end + 1 - len(p) : end + 1], p)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    ends, lengths, weights, stems = (np.array(x) for x in zip(*found))
    starts = ends - lengths
    edge = np.concatenate([[False], solid, [False]])  # edge[i]: the byte before i is part of a word
    ok = ~edge[starts] & (stems | ~edge[ends + 1])
    starts, ends, weights = starts[ok], ends[ok], weights[ok]
    cover = np.zeros(len(text) + 1, np.int32)
    free = weights == 0
    np.add.at(cover, starts[free], 1)
    np.add.at(cover, ends[free], -1)
    cover = np.cumsum(cover)
    counts = ~free & ~((cover[starts] > 0) & (cover[ends - 1] > 0))
    starts, ends, weights = starts[counts], ends[counts], weights[counts].astype(float)
    if len(ends):
        order = np.lexsort((starts, ends))
        starts, ends, weights = starts[order], ends[order], weights[order]
        longest = np.concatenate([[True], ends[1:] != ends[:-1]])
        starts, ends, weights = starts[longest], ends[longest], weights[longest]
        order = np.lexsort((-ends, starts))
        starts, ends, weights = starts[order], ends[order], weights[order]
        longest = np.concatenate([[True], starts[1:] != starts[:-1]])
        ends, weights = ends[longest], weights[longest]
        order = np.argsort(ends, kind="stable")
        ends, weights = ends[order], weights[order]
    return ends, weights


def stems(rows, lexicon: dict[str, float] | None = None) -> dict[str, float]:
    """Stems, each with `*`, and weights, from (language, toxic, text); none that begins a word of the lexicon."""
    known = [folded(w)[1].tobytes().decode("latin-1") for w in (LEXICON if lexicon is None else lexicon)]
    begun = {w[:k] for w in known for k in range(STEM[0], STEM[1] + 1)}
    n: Counter = Counter()
    has: dict[tuple, Counter] = {}
    for lang, toxic, text in rows:
        key = lang, bool(toxic)
        n[key] += 1
        words = re.findall("[a-z]+", folded(text)[1].tobytes().decode("latin-1"))
        often = Counter(w[:k] for w in words for k in range(STEM[0], min(len(w), STEM[1]) + 1))
        has.setdefault(key, Counter()).update(w for w, c in often.items() if c >= TIMES)
    out: dict[str, float] = {}
    for (lang, toxic), counts in has.items():
        bad, good, clean = n[lang, True], n[lang, False], has.get((lang, False), Counter())
        if not toxic or good < LEAST_CLEAN:
            continue
        for s, t in counts.items():
            if t >= max(LEAST_TOXIC, SHARE * bad) and s not in begun:
                odds = math.log((t + 0.5) / (bad - t + 0.5)) - math.log((clean[s] + 0.5) / (good - clean[s] + 0.5))
                if odds >= ODDS:
                    out[s + "*"] = max(out.get(s + "*", 0.0), SCALE * odds)
    return dict(sorted(out.items()))


def learned(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", sample: int = SAMPLE) -> dict[str, float]:
    """LEXICON with the stems of labelled rows: `sample` rows of each language and label at most (documented bound), those
    of least hashed key; only their texts are read."""
    where = F.col(lang) if lang in documents.columns else F.lit(None)
    own = labels.where("toxic is not null").groupBy(key).agg(F.max("toxic").alias("__toxic"))
    ids = documents.select(key, F.coalesce(where.cast("string"), F.lit("")).alias("__lang")).join(own, key).dropDuplicates([key])
    rank = F.row_number().over(W.partitionBy("__lang", "__toxic").orderBy(F.xxhash64(key), key))
    chosen = ids.withColumn("__rank", rank).where(F.col("__rank") <= sample).drop("__rank")
    texts = documents.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")).join(F.broadcast(chosen), key)
    texts = texts.groupBy(key).agg(F.min(F.struct("__lang", "__toxic", "__text")).alias("r")).select("r.*")
    return LEXICON | stems(texts.toLocalIterator())


TYPE = "struct<words:int,hits:int,score:double>"


def scorer(lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None, min_words: int = MIN_WORDS):
    """An Arrow UDF from text to words, hits and score."""
    lex, exc = tuple((LEXICON if lexicon is None else lexicon).items()), tuple(EXCEPTIONS if exceptions is None else exceptions)

    def score(column: pa.Array) -> pa.Array:
        a, any_pattern = automaton(lex, exc)
        data, off = utf8(column)
        n = len(off) - 1
        words, hits, score = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
        for i, j, d, o in parts(data, off):
            # rows are set apart by " \n " in the folded bytes, so no match or word spans two
            raw = d.tobytes()
            pieces = [folded(raw[o[k] : o[k + 1]].decode("utf-8", "replace")) for k in range(j - i)]
            gap, none = np.full(1, 10, np.uint8), np.zeros(1, bool)
            text = np.concatenate([x for t, _, _ in pieces for x in (t, gap)])
            own = np.concatenate([x for _, t, _ in pieces for x in (t, gap)])
            solid = np.concatenate([x for _, _, s in pieces for x in (s, none)])
            at = np.concatenate([[0], np.cumsum([len(t) + 1 for t, _, _ in pieces])])
            full = (text != GAP) & (text != 10)
            first = full.copy()
            first[1:] &= ~full[:-1]
            words[i:j] = np.add.reduceat(first, at[:-1], dtype=np.int64)
            if any_pattern:
                ends, weights = matches(text, own, solid, a)
                rows = np.searchsorted(at, ends, "left") - 1
                hits[i:j] = np.bincount(rows, minlength=j - i)
                score[i:j] = np.bincount(rows, weights, minlength=j - i)
        score = 100.0 * score / np.maximum(words, min_words)
        return pa.StructArray.from_arrays([pa.array(words), pa.array(hits), pa.array(score)], names=["words", "hits", "score"])

    return F.arrow_udf(lean(score), TYPE)


def toxicity(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """df with toxic_words, toxic_hits, toxic_score and toxic; one narrow stage, no shuffle."""
    small_batches(df.sparkSession)
    name = hidden(df, "t")
    scored = df.withColumn(name, scorer(**options)(F.col(text).cast("string")))
    t = F.col(name)
    return scored.withColumns({"toxic_words": t["words"], "toxic_hits": t["hits"], "toxic_score": F.round(t["score"], 6), "toxic": t["score"] >= F.lit(threshold)}).drop(name)


def is_toxic(text: str | Column = "text", threshold: float = THRESHOLD, **options) -> Column:
    """The decision alone, for filters."""
    return scorer(**options)(text)["score"] >= F.lit(threshold)
