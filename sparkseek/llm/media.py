"""Media columns: payloads cut by content, chunks deduplicated by digest, media rebuilt from ordered chunk lists.

A rolling gear hash over the last 32 bytes cuts a payload where its top bits are zero, so that an insertion moves only the cuts
around it; chunks have MIN to MAX bytes, AVERAGE or so.  Payloads are known by their digest, and so are chunks.  Each chunk is
stored once, with its *home*, the least (payload digest, place) that holds it.  Digests, not bytes, travel to find the homes; then one
exchange by payload digest brings each payload to its chunk list, only chunks that other payloads share leave their home, and
every payload is rebuilt from chunks alone and held against its digest.

Defined results: a null payload has no chunks and null digest, size and verification; an empty one has no chunks and is verified; payloads
of any length are cut whole; rows with the same payload share its chunks and each gets its result; an empty table gives an empty
result; other columns are kept and columns of the operator's names are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Codec, dictionary
from .shared import small_batches, written
from .text import lean, mix, utf8

MIN, AVERAGE, MAX = 512, 2048, 16384
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
SPAN, PART = 32, 1 << 20
SAMPLED, SAMPLED_BYTES = 300, 1 << 14  # payloads, and bytes of each, that the dictionary of frames is learned from
CHUNKS = "array<struct<ord:int,start:bigint,size:int,digest:binary>>"


def digest(raw: bytes | memoryview) -> bytes:
    return hashlib.blake2b(raw, digest_size=20).digest()


def gear(data: np.ndarray) -> np.ndarray:
    """The hash after each byte, of the up to 32 bytes that end there: the sum of GEAR[byte] << distance."""
    h = GEAR[data]
    width = 1
    while width < SPAN:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(data: np.ndarray, least: int = MIN, average: int = AVERAGE, most: int = MAX) -> list[int]:
    """Ends of a payload's chunks."""
    bits = max(1, int(average - least).bit_length() - 1)
    out, at, n = [], 0, len(data)
    found = [np.zeros(0, np.int64)]
    for i in range(0, n, PART):  # each part begins with the 32 bytes before it, whose own hashes don't count again
        before = min(i, SPAN)
        h = gear(data[i - before : i + PART])[before:]
        found.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + i)
    found = np.concatenate(found)
    marks = found + 1
    while at < n:
        k = int(np.searchsorted(marks, at + least))
        end = int(marks[k]) if k < len(marks) and marks[k] <= at + most else at + most
        at = min(end, n)
        out.append(at)
    return out


def _chunks(least: int, average: int, most: int):
    def run(column: pa.Array) -> pa.Array:
        data, off = utf8(column)
        raw = memoryview(data)
        counts, orders, starts, sizes, digests = [0], [], [], [], []
        for i in range(len(off) - 1):
            a = int(off[i])
            ends = cuts(data[a : off[i + 1]], least, average, most)
            begin = [0, *ends][: len(ends)]
            counts.append(len(ends))
            orders += range(len(ends))
            starts += begin
            sizes += [e - b for b, e in zip(begin, ends)]
            digests += [digest(raw[a + b : a + e]) for b, e in zip(begin, ends)]
        own = pa.StructArray.from_arrays([pa.array(orders, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], names=["ord", "start", "size", "digest"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), own)

    return F.arrow_udf(lean(run), CHUNKS)


def _digests(column: pa.Array) -> pa.Array:
    return pa.array([None if v is None else digest(v) for v in column.to_pylist()], pa.binary())


def digests(name: str) -> Column:
    return F.arrow_udf(lean(_digests), "binary")(F.col(name))


def _joined(column: pa.Array) -> pa.Array:
    return pa.array([None if any(c["bytes"] is None for c in p) else b"".join(c["bytes"] for c in p) for p in column.to_pylist()], pa.binary())


def _served(codec: Codec):
    """The chunks at these places of each payload."""

    def run(z: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for raw, own in zip(codec.unpack(z), places.to_pylist()):
            out.append([{"digest": p["digest"], "bytes": raw[p["start"] : p["start"] + p["size"]]} for p in own or ()])
        return pa.array(out, pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])))

    return run


def _rebuilt(codec: Codec):
    """Digest of the payload that the ordered chunks make, those whose home it is and those brought from others; null where
    one is missing or isn't what its digest says."""
    served = _served(codec)

    def run(z: pa.Array, places: pa.Array, order: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for want, mine, theirs in zip(order.to_pylist(), served(z, places).to_pylist(), others.to_pylist()):
            have = {c["digest"]: c["bytes"] for c in (*mine, *(theirs or ()))}
            whole = b"".join(have.get(w, b"") for w in want)
            out.append(digest(whole) if all(w in have for w in want) and all(digest(b) == w for w, b in have.items()) else None)
        return pa.array(out, pa.binary())

    return run


def chunk_lists(payloads: DataFrame, least: int = MIN, average: int = AVERAGE, most: int = MAX) -> DataFrame:
    """Of payloads (media, payload): media, ord, start, size, digest, home (the payload that stores it), stored (here),
    shared (another payload has it). Homes are found by an aggregation that begins before the exchange, and come back by a join
    that can be split, so that a chunk may be in any share of the payloads. Rows that repeat a payload repeat its list."""
    rows = payloads.select("media", F.explode(_chunks(least, average, most)("payload")).alias("c")).select("media", "c.*")
    homes = rows.groupBy("digest").agg(F.min(F.struct("media", "ord")).alias("least"), F.max("media").alias("most"))
    found = rows.join(homes, "digest")
    stored = (F.col("media") == F.col("least.media")) & (F.col("ord") == F.col("least.ord"))
    return found.select("media", "ord", "start", "size", "digest", F.col("least.media").alias("home"), stored.alias("stored"), (F.col("least.media") != F.col("most")).alias("shared"))


def media(df: DataFrame, payload: str, least: int = MIN, average: int = AVERAGE, most: int = MAX) -> DataFrame:
    """df without the payload, with media (its digest), n_bytes, chunks (ordered digests), n_new and new_bytes (the chunks that are stored
    for it), and verified."""
    if not SPAN <= least <= average <= most:
        raise ValueError(f"{SPAN} <= least <= average <= most")
    small_batches(df.sparkSession)
    names = ("media", "n_bytes", "chunks", "n_new", "new_bytes", "verified")
    others = [c for c in df.columns if c != payload and c not in names]
    value = F.col(payload).cast("binary")
    own = F.struct(*others).alias("about") if others else F.lit(None).alias("about")  # a struct, so that no name clashes
    rows = df.select(own, value.alias("payload")).withColumn("media", digests("payload"))
    full = rows.where("media is not null").select("media", "payload")
    codec = Codec(dictionary(bytes(r[0])[:SAMPLED_BYTES] for r in full.select("payload").limit(SAMPLED).toLocalIterator()), 3)
    lists = written(chunk_lists(full, least, average, most), "chunk-lists")
    place = F.struct("ord", "start", "size", "digest", "shared")
    plans = lists.groupBy("media").agg(F.sort_array(F.collect_set(F.struct("ord", "digest"))).alias("o"), F.collect_set(F.when(F.col("stored"), place)).alias("own"))
    plans = plans.select("media", "own", F.col("o.digest").alias("chunks"), F.size("own").cast("bigint").alias("n_new"), F.aggregate("own", F.lit(0).cast("bigint"), lambda s, c: s + c["size"]).alias("new_bytes"))
    # one exchange of payloads, which both branches reuse; Python functions come last in each, as nothing is known of partitions behind them
    deflated = F.arrow_udf(lean(lambda column: codec.pack(column.to_pylist())), "binary")
    homes = full.withColumn("z", deflated("payload")).select("media", "z").dropDuplicates(["media"]).join(plans, "media")
    served = homes.select(F.explode(F.arrow_udf(lean(_served(codec)), "array<struct<digest:binary,bytes:binary>>")("z", F.filter("own", lambda c: c["shared"]))).alias("c")).select("c.digest", "c.bytes")
    asked = lists.where("home <> media").select("digest", "media").distinct()
    brought = asked.join(served, "digest").groupBy("media").agg(F.collect_list(F.struct("digest", "bytes")).alias("others"))
    about = rows.select("about", "media", F.octet_length("payload").alias("n_bytes"))
    again = F.arrow_udf(lean(_rebuilt(codec)), "binary")("z", "own", "chunks", "others")
    columns = [F.col("about").getField(c).alias(c) for c in others]
    done = homes.join(brought, "media", "left").join(about.where("n_bytes > 0"), "media").select(*columns, "media", "n_bytes", "chunks", "n_new", "new_bytes", again.eqNullSafe(F.col("media")).alias("verified"))
    empty = F.col("media").isNotNull()
    rest = about.where("media is null or n_bytes = 0").select(*columns, "media", "n_bytes", F.when(empty, F.array().cast("array<binary>")).alias("chunks"), *(F.when(empty, F.lit(0)).cast("bigint").alias(c) for c in ("n_new", "new_bytes")), F.when(empty, F.lit(True)).alias("verified"))
    return done.unionByName(rest)


def rebuild(lists: DataFrame, store: DataFrame) -> DataFrame:
    """(media, payload, verified) from chunk lists (media, ord, digest) and a store (digest, bytes), by a join."""
    parts = lists.select("media", "ord", "digest").join(store.select("digest", "bytes"), "digest", "left")
    whole = parts.groupBy("media").agg(F.sort_array(F.collect_list(F.struct("ord", "bytes"))).alias("p"))
    return whole.select("media", F.arrow_udf(lean(_joined), "binary")("p").alias("payload")).withColumn("verified", digests("payload").eqNullSafe(F.col("media")))
