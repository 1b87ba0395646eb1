"""Hierarchical packing of documents into windows of several context sizes.

Each document is routed to the least tier that holds it; one longer than the largest tier is cut into full windows of that tier and a rest,
which is routed like a document.  Within shards of about SHARD_TOKENS tokens, from the largest tier down: best-fit decreasing packs the tier's
pieces, then the gaps take, least gap first, the longest pieces that fit from the smaller tiers.  Windows of a tier are put
into step groups of GROUP_TOKENS tokens of capacity, always the fullest left into the emptiest group; windows that fill
no group in their shard are grouped again over FAN shards at a time, level by level, so only the last group of a tier can be short.

A length is the number of tokens plus one for the end of the document: with `lexicon` (of bpe.prepare) the ids of byte-pair
encoding, of which a piece is the range from piece_start on; else words; `length` takes another Column. Only document ids and lengths
are shuffled.  Defined results: null, empty and blank texts (length 0 or null) aren't packed; rows that repeat are packed each;
a text of any length is covered by its pieces without gap or overlap; null ids stay null; an empty table gives an empty result; columns beside id and text aren't read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import counter
from .shared import durable, small_batches
from .text import lean, parts, utf8, word_bounds

TIERS, SHARD_TOKENS, GROUP_TOKENS, FAN = (512, 2048, 8192), 1 << 21, 1 << 16, 64
SCHEMA = "key long, piece int, piece_start long, n_tokens int, tier int, window_id long, window_offset int, window_tokens int, step_group string, shard long"


def _count_words(column: pa.Array) -> pa.Array:
    data, off = utf8(column)
    out = np.zeros(len(off) - 1, np.int64)
    for i, j, d, o in parts(data, off):
        out[i:j] = np.diff(word_bounds(d, o)[2])
    return pa.array(out)


def n_tokens(text: Column) -> Column:
    """Words and one for the end; 0 without words."""
    n = F.arrow_udf(lean(_count_words), "bigint")(text.cast("string"))
    return F.when(n > 0, n + 1).otherwise(F.lit(0))


def n_ids(text: Column, lexicon: str) -> Column:
    """Ids of byte-pair encoding and one for the end; 0 for a blank text."""
    return F.when(text.cast("string").rlike(r"\S"), counter(lexicon)(text.cast("string")) + 1).otherwise(F.lit(0))


def cut(length: int, tiers: tuple[int, ...]) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    top = tiers[-1]
    full = [(s, top) for s in range(0, length - top + 1, top)]
    at = len(full) * top
    return full + ([(at, length - at)] if at < length else [])


def pack(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """(tier, pieces in order) of each window, for pieces given longest first."""
    route = [tiers[bisect_left(tiers, n)] for n in lengths]
    by_length: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by_length.setdefault(lengths[i], []).append(i)  # the first given is taken first
    left = sorted(by_length)

    def take(n: int) -> int:
        own = by_length[n]
        i = own.pop()
        if not own:
            left.pop(bisect_left(left, n))
        return i

    windows: list[tuple[int, list[int]]] = []
    for t in reversed(range(len(tiers))):
        tier, below = tiers[t], tiers[t - 1] if t else 0
        room: list[tuple[int, int]] = []  # (gap, window), sorted
        while left and left[-1] > below:
            n = left[-1]
            i = take(n)
            at = bisect_left(room, (n, -1))
            if at < len(room):
                gap, w = room.pop(at)
                windows[w][1].append(i)
            else:
                gap, w = tier, len(windows)
                windows.append((tier, [i]))
            if gap > n:
                insort(room, (gap - n, w))
        for gap, w in room:
            while left:
                at = bisect_right(left, gap) - 1
                if at < 0:
                    break
                n = left[at]
                windows[w][1].append(take(n))
                gap -= n
    assert sum(len(p) for _, p in windows) == len(route)
    return windows


def balance(fills: list[int], size: int) -> list[int]:
    """A group for each window, of `size` windows each; -1 for those beyond the last full group, the emptiest. The fullest
    window goes into the group with the fewest tokens that still has a place."""
    order = sorted(range(len(fills)), key=lambda i: (-fills[i], i))
    groups = len(fills) // size
    out = [-1] * len(fills)
    heap = [(0, g, size) for g in range(groups)]
    for i in order[: groups * size]:
        tokens, g, places = heapq.heappop(heap)
        out[i] = g
        if places > 1:
            heapq.heappush(heap, (tokens + fills[i], g, places - 1))
    return out


def _pack_shard(tiers: tuple[int, ...], group_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        t = table.sort_by([("n_tokens", "descending"), ("key", "ascending"), ("x", "ascending"), ("piece", "ascending")])
        lengths = t.column("n_tokens").to_pylist()
        windows = pack(lengths, tiers)
        fills = [sum(lengths[i] for i in p) for _, p in windows]
        group: list[str | None] = [None] * len(windows)
        for tier in tiers:
            own = [w for w, (at, _) in enumerate(windows) if at == tier]
            for w, g in zip(own, balance([fills[w] for w in own], max(1, group_tokens // tier))):
                group[w] = f"{tier}/0/{shard}/{g}" if g >= 0 else None
        rows, tier_of, window, offset, fill, step = [], [], [], [], [], []
        for w, (tier, pieces) in enumerate(windows):
            at = 0
            for i in pieces:
                rows.append(i)
                tier_of.append(tier)
                window.append(shard << 24 | w)
                offset.append(at)
                fill.append(fills[w])
                step.append(group[w])
                at += lengths[i]
        t = t.take(pa.array(rows, pa.int64()))
        own = [t.column(c) for c in ("key", "piece", "piece_start", "n_tokens")]
        own += [pa.array(tier_of, pa.int32()), pa.array(window, pa.int64()), pa.array(offset, pa.int32()), pa.array(fill, pa.int32()), pa.array(step, pa.string()), t.column("shard")]
        return pa.table(own, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def _regroup(level: int, last: bool, group_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("window_id")
        tier, shard = t.column("tier")[0].as_py(), t.column("shard")[0].as_py()
        got = balance(t.column("window_tokens").to_pylist(), max(1, group_tokens // tier))
        names = [f"{tier}/{level}/{shard}/{g}" if g >= 0 else f"{tier}/{level}/{shard}/rest" if last else None for g in got]
        return t.select(["window_id", "tier", "window_tokens", "shard"]).append_column("step_group", pa.array(names, pa.string()))

    return run


def packing(df: DataFrame, text: str = "text", key: str = "doc_id", length: Column | None = None, lexicon: str | None = None, tiers: tuple[int, ...] = TIERS, shard_tokens: int = SHARD_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id, piece, piece_start, n_tokens, tier, window_id, window_offset, window_tokens, step_group."""
    tiers = tuple(sorted(tiers))
    if not tiers or tiers[0] < 1:
        raise ValueError("tiers must be positive")
    small_batches(df.sparkSession)
    n = length if length is not None else n_tokens(F.col(text)) if lexicon is None else n_ids(F.col(text), lexicon)
    docs = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("x"), F.coalesce(n.cast("long"), F.lit(0)).alias("n"))
    docs = durable(docs).where("n > 0")  # behind the checkpoint, or else the filter would take the lengths a second time
    total = docs.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    top = tiers[-1]
    starts = F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / top).cast("long"))
    pieces = docs.select("*", F.explode(starts).alias("k"))
    pieces = pieces.select(F.pmod(F.xxhash64("key", "x", "k"), F.lit(shards)).alias("shard"), "key", "x", F.col("k").cast("int").alias("piece"), (F.col("k") * top).alias("piece_start"), F.least(F.col("n") - F.col("k") * top, F.lit(top)).cast("int").alias("n_tokens"))
    packed = durable(pieces.groupBy("shard").applyInArrow(_pack_shard(tiers, group_tokens), SCHEMA))
    done = packed.where("step_group is not null")
    open_pieces = packed.where("step_group is null").drop("step_group")
    rest = open_pieces.select("window_id", "tier", "window_tokens", "shard").distinct()
    named, level, width = None, 0, shards
    while True:
        level, width = level + 1, -(-width // FAN)
        schema = "window_id long, tier int, window_tokens int, shard long, step_group string"
        got = durable(rest.withColumn("shard", F.floor(F.col("shard") / FAN)).groupBy("tier", "shard").applyInArrow(_regroup(level, width == 1, group_tokens), schema))
        own = got.where("step_group is not null").select("window_id", "step_group")
        named = own if named is None else named.unionByName(own)
        if width == 1:
            break
        rest = got.where("step_group is null").drop("step_group")
    columns = [F.col("key").alias(key), "piece", "piece_start", "n_tokens", "tier", "window_id", "window_offset", "window_tokens", "step_group"]
    return done.select(*columns).unionByName(open_pieces.join(named, "window_id").select(*columns))
