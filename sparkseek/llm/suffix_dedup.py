"""Removal of repeated passages by a sparse suffix array, sorted by a distributed merge that knows common prefixes.

A window of WINDOW consecutive words is *removable* where the same words occur earlier: in an earlier document, or in the
same one at least WINDOW words before.  All words of removable windows are removed; the first occurrence stays.

Only suffixes at anchors are sorted.  An anchor is the place of the least hash among the WINDOW - GRAM + 1 GRAM-word runs of
some window, so that equal windows have an anchor at the same offset; anchors whose GRAM words occur once in the corpus
cannot be part of a repetition and go first.  Each task sorts the suffixes at its anchors (WINDOW words, and the up to
WINDOW - GRAM words before them) into runs in which equal contexts are one entry with a list of places, cuts the runs by sampled splitters, and sends
them front-coded; each range merges its runs by a loser tree and reads the repeated windows off the common prefixes of
neighbours.

Defined results: documents are ordered by (doc_id, hash of text), null ids last; doc_id is an integer; rows that repeat both id and text are
one document, and each gets its result; null, empty and short texts have no windows and stay as they are; words are
set apart by ASCII white space, the amount of which doesn't matter; texts of any length are read whole; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import front_code, front_decode, merge, pack, spans, unpack
from .shared import durable, hidden, small_batches
from .text import gram_hashes, lean, mix, parts, release, utf8, word_bounds, word_hashes

WINDOW, GRAM = 50, 25
RUN_BYTES, RANGE_ENTRIES = 12 << 20, 60_000
_PLACE = np.uint64((1 << 28) - 1)
NO_ID = (1 << 63) - 1


def anchors(words: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in `words`) of all anchors, and the hashes of their grams."""
    n, span = len(words), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(words, gram)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inside = np.arange(len(least)) + window <= rows[1:][row[: len(least)]]
    at = (least[inside] & _PLACE).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
    at = np.unique(at)
    return at, grams[at]


def _anchor_udf(window: int, gram: int):
    def find(column: pa.Array) -> pa.Array:
        data, off = utf8(column)
        hashes, places, heads, counts = [], [], [], np.zeros(len(off), np.int32)
        for i, j, d, o in parts(data, off):
            words, starts, _, rows = word_hashes(d, o)
            at, h = anchors(words, rows, window, gram)
            row = np.searchsorted(rows, at, "right") - 1
            hashes.append(h.view(np.int64))
            places.append((at - rows[row]).astype(np.int32))
            wide = np.concatenate([d, np.full(8, 32, np.uint8)])
            head = np.zeros(len(at), np.int64)
            for k in range(7):
                head = head << 8 | wide[starts[at] + k].astype(np.int64)
            heads.append(head)
            counts[i + 1 : j + 1] = np.bincount(row, minlength=j - i)
        flat = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.int64), (places, np.int32), (heads, np.int64))]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["h", "p", "head"]))

    return F.arrow_udf(lean(find), "array<struct<h:bigint,p:int,head:bigint>>")


def contexts(key: int, x: int, text: bytes, places: list[int], window: int, gram: int, into: dict) -> int:
    """Adds each place to the entry of its (suffix, words before); the bytes that this takes."""
    words, size = text.split(), 0
    for p in places:
        suffix = b" ".join(words[p : p + window]) + b" "
        before = b" ".join(words[max(0, p - window + gram) : p])
        into.setdefault((suffix, before), []).append((key, x, p))
        size += len(suffix) + len(before) + 200
    return size


def coded_run(entries: dict, cuts: list[int]) -> list[tuple[int, bytes]]:
    """The sorted, front-coded run, cut by ranges."""
    order = sorted(entries)
    out = []
    for target, i, j in spans([s for s, _ in order], cuts):
        shared, rests, lengths = front_code([s for s, _ in order[i:j]])
        members = [sorted(entries[e]) for e in order[i:j]]
        counts = [len(m) for m in members]
        flat = np.array([v for m in members for v in m], np.int64).reshape(-1, 3)
        left = b"\n".join(b for _, b in order[i:j])
        ints = [np.array(v, np.uint32).tobytes() for v in (shared, lengths, counts)]
        out.append((target, pack(*ints, rests, left, flat[:, 0].tobytes(), flat[:, 1].tobytes(), flat[:, 2].astype(np.int32).tobytes())))
    return out


def merged(blocks: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """All entries of a range in order: words shared with the entry before, words in front, number of words in the suffix, and (entry, key, x, place) of all members."""
    runs, lefts, counts, keys = [], [], [], []
    for block in blocks:
        shared, lengths, count, rests, left, *ids = unpack(block)
        shared, lengths = (np.frombuffer(v, np.uint32).tolist() for v in (shared, lengths))
        runs.append((shared, front_decode(shared, rests, lengths)))
        lefts.append(left.split(b"\n"))
        count = np.frombuffer(count, np.uint32).astype(np.int64)
        counts.append(np.concatenate([[0], np.cumsum(count)]))
        keys.append(tuple(np.frombuffer(v, t).astype(np.int64) for v, t in zip(ids, (np.int64, np.int64, np.int32))))
    common, left, size, source, place = [], [], [], [], []
    for known, run, at in merge(runs):
        suffix = runs[run][1][at]
        common.append(suffix.count(b" ", 0, known))
        size.append(suffix.count(b" "))
        left.append(lefts[run][at])
        source.append(run)
        place.append(at)
    if not source:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros((4, 0), np.int64)
    base = np.cumsum([0, *(len(k[0]) for k in keys)])
    ends = np.concatenate([c + b for c, b in zip(counts, base)])  # where the members of each run's entries end
    entry = np.cumsum([0, *map(len, counts)])[np.array(source)] + np.array(place)
    n = ends[entry + 1] - ends[entry]
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - ends[entry], n)
    members = np.stack([np.repeat(np.arange(len(n)), n), *(np.concatenate(k)[which] for k in zip(*keys))])
    return np.array(common, np.int64), left, np.array(size, np.int64), members


def left_chain(left: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(most + 1, entries) hashes of the last 0..most words before each entry, and how many there are."""
    data, off = utf8(pa.array(left, pa.binary()))
    words, _, _, rows = word_hashes(data, off)
    n = np.diff(rows)
    chain = np.zeros((most + 1, len(left)), np.uint64)
    for j in range(1, most + 1):
        some = n >= j
        chain[j, some] = mix(chain[j - 1, some] * np.uint64(0x2545F4914F6CDD1D) + words[rows[1:][some] - j])
    return chain, n


def repeated(common: np.ndarray, left: list[bytes], size: np.ndarray, members: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, x, first word, end word, key of the first document that holds it) of the removable stretches around the members."""
    most = window - gram
    entry, key, x, place = members
    n = len(entry)
    out = np.zeros((n, most + 3), bool)
    source = np.zeros((n, most + 1), np.int64)
    order = np.lexsort((place, x, key))  # rank by document and place, for the least of a group
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = np.full(len(common), n, np.int64)
    np.minimum.at(least, entry, rank)
    for j, group in families(common, left, size, window, gram):
        first = np.full(len(common), n, np.int64)
        has = group >= 0
        np.minimum.at(first, group[has], least[has])
        f = np.where(has, first[np.maximum(group, 0)], -1)[entry]
        has = f >= 0
        m = order[np.maximum(f, 0)]
        same = (key[m] == key) & (x[m] == x)
        out[:, j + 1] = has & (~same | (place[m] + window <= place))
        source[:, j] = key[m]
    row, first_word, end_word, high = stretches_of(out, place, window)
    return key[row], x[row], first_word, end_word, source[row, high]


def families(common: np.ndarray, left: list[bytes], size: np.ndarray, window: int, gram: int):
    """For each j, the number of words before the anchor, in turn: a group number for each entry, the same for those whose
    windows from j words before the anchor on are equal; -1 where there is no such window."""
    chain, before = left_chain(left, window - gram)
    for j in range(window - gram + 1):
        own = np.flatnonzero((before >= j) & (size >= window - j))
        if not len(own):
            continue
        cluster = np.cumsum(common < window - j)
        own = own[np.lexsort((chain[j, own], cluster[own]))]
        new = np.concatenate([[True], (cluster[own][1:] != cluster[own][:-1]) | (chain[j, own][1:] != chain[j, own][:-1])])
        group = np.full(len(common), -1, np.int64)
        group[own] = np.cumsum(new) - 1
        yield j, group


def stretches_of(out: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """From flags by member and j + 1: member, first and end word, and greatest j of each stretch of flagged windows."""
    begin = out[:, 1:-1] & ~out[:, :-2]  # least j of a stretch: its end
    stop = out[:, 1:-1] & ~out[:, 2:]  # greatest j: its start
    (row, low), (_, high) = np.nonzero(begin), np.nonzero(stop)
    return row, place[row] - high, place[row] - low + window, high


def _documents(df: DataFrame, text: str, key: str) -> DataFrame:
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(value).alias("x"), value.alias("text"))


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, x, first_word, end_word, source): the maximal removable stretches of each document, and a document that holds
    the start of the stretch first."""
    if not 0 < gram <= window:
        raise ValueError("0 < gram <= window")
    small_batches(df.sparkSession)
    docs = _documents(df, text, key)
    found = docs.select("key", "x", F.explode(_anchor_udf(window, gram)("text")).alias("a")).select("key", "x", "a.*")
    often = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    kept = durable(found.join(often, "h", "left_semi").select("key", "x", "p", "head"))
    total = kept.count()
    ranges = max(1, -(-total // RANGE_ENTRIES))
    cuts: list[int] = []
    if ranges > 1:
        q = [i / ranges for i in range(1, ranges)]
        cuts = sorted({int(c) << 8 for c in kept.agg(F.percentile_approx("head", q, 10 * ranges)).first()[0]})
    # rows that repeat id and text give the same anchors; one of each stays
    places = kept.groupBy("key", "x").agg(F.sort_array(F.collect_set("p")).alias("places"))
    texts = docs.join(places, ["key", "x"]).groupBy("key", "x").agg(F.first("text").alias("text"), F.first("places").alias("places"))

    def to_runs(batches):
        entries: dict = {}
        held = 0
        for b in batches:
            columns = [b.column(i) for i in range(4)]
            data, off = utf8(columns[2])
            raw, at = data.tobytes(), off.tolist()
            for i, (k, x, p) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[3].to_pylist())):
                for some in range(0, len(p), 1000):
                    held += contexts(k, x, raw[at[i] : at[i + 1]], p[some : some + 1000], window, gram, entries)
                    if held >= RUN_BYTES:
                        yield from _blocks(coded_run(entries, cuts))
                        entries, held = {}, 0
        yield from _blocks(coded_run(entries, cuts))
        entries.clear()
        release()

    def from_runs(table: pa.Table) -> pa.Table:
        got = repeated(*merged(table.column("block").to_pylist()), window, gram)
        names = ["key", "x", "first_word", "end_word", "source"]
        out = pa.table([pa.array(v.astype(np.int64)) for v in got], names=names)
        release()
        return out

    schema = "key long, x long, first_word long, end_word long, source long"
    stretches = texts.mapInArrow(to_runs, "target int, block binary").groupBy("target").applyInArrow(from_runs, schema)
    w = W.partitionBy("key", "x").orderBy("first_word", F.col("end_word").desc(), "source")
    reach = F.max("end_word").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = stretches.withColumn("new", F.coalesce((F.col("first_word") > reach).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("key", "x", "island").agg(F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.min(F.struct("first_word", "source")).alias("s")).select("key", "x", "first_word", "end_word", F.col("s.source").alias("source"))


def _blocks(blocks: list[tuple[int, bytes]]):
    if blocks:
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], names=["target", "block"])


def duplicate_spans(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per removable stretch: doc_id, first_word, end_word, n_words, and first_doc_id, which keeps it."""
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    got = repeated_spans(df, text, key, **options)
    return got.select(real("key").alias(key), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"), real("source").alias(f"first_{key}"))


def without(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without words [first, end) of each cut; white space around the words that stay is left as it is."""
    data = np.frombuffer(text, np.uint8)
    starts, _, _ = word_bounds(data, np.array([0, len(data)]))
    at = np.append(starts, len(data))
    out, done = [], 0
    for first, end in sorted(cuts):
        out.append(text[done : at[first]])
        done = int(at[end])
    out.append(text[done:])
    return b"".join(out)


def suffix_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """df with the removable stretches cut out of `text`; rows of which no word is left go."""
    own, x, new = (hidden(df, c) for c in ("key", "x", "new"))
    spans_ = repeated_spans(df, text, key, **options).select(F.col("key").alias(own), F.col("x").alias(x), "first_word", "end_word")
    cuts = spans_.groupBy(own, x).agg(F.collect_list(F.struct("first_word", "end_word")).alias(new + "c"))
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = df.withColumns({own: F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), x: F.xxhash64(value)})

    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([without(t.encode(), [(c["first_word"], c["end_word"]) for c in cs]).decode() if cs else t for t, cs in zip(texts.to_pylist(), lists.to_pylist())], pa.string())

    joined = named.join(cuts, [own, x], "left")
    gone = F.col(new + "c").isNotNull()
    done = joined.withColumn(new, F.when(gone, F.arrow_udf(lean(cut), "string")(F.col(text).cast("string"), new + "c")))
    return done.where(~gone | F.col(new).rlike(r"\S")).withColumn(text, F.coalesce(new, text)).select(*df.columns)
