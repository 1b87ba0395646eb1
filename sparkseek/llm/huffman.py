"""Token ids as binary blocks: canonical, length-limited Huffman codes from the ids' counts over the whole corpus.

Package-merge gives the best code lengths of at most LIMIT bits; canonical codes need no more than the lengths to be
shared (one byte an id of the vocabulary).  Each text's ids are cut into blocks of BLOCK ids, which are decoded independently: a
block has its bits and, for every CHECK-th id, the bit where its code begins.  Decoding goes through a table of 2**LIMIT
entries, at all checkpoints of a batch side by side.  Ids come as arrays, or packed: binary, little-endian numbers of
`width` bytes each.  A corpus of more than 2**LIMIT distinct ids gets the least limit that holds them.

Defined results: null and empty lists of ids give one block without ids, and decode to an empty list; lists of any
length are coded whole; repeated rows each get their blocks, and as many rows back from them; an id that was not counted, or a negative one, raises; with one distinct id its code has
one bit; an empty table gives an empty result; other columns are kept and columns of the operator's names are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import hidden, small_batches
from .text import release

LIMIT, BLOCK, CHECK = 18, 4096, 64
AT_ONCE = 1 << 17  # ids that a task codes at once, to bound its memory


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Package-merge: the lengths, at most `limit`, that give the fewest bits in all; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("too many ids for this limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels = []  # for each level, whether the merged items are packages
    packages = np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at >= n)
        both = both[at]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1 : len(both) // 2 * 2 : 2]
    length = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_package in reversed(levels):
        chosen = is_package[:take]
        length[: take - int(chosen.sum())] += 1
        take = 2 * int(chosen.sum())
    out[order] = length
    return out


@dataclass(frozen=True)
class Book:
    """The codes of ids, given by their lengths."""

    lengths: np.ndarray
    limit: int = LIMIT

    @cached_property
    def order(self) -> np.ndarray:
        used = np.flatnonzero(self.lengths)
        return used[np.argsort(self.lengths[used], kind="stable")]

    @cached_property
    def codes(self) -> np.ndarray:
        """Canonical: by length, then by id, each one more than the one before."""
        out = np.zeros(len(self.lengths), np.uint64)
        step = np.uint64(1) << (np.uint64(self.limit) - self.lengths[self.order].astype(np.uint64))
        first = np.concatenate([[0], np.cumsum(step)[:-1]]).astype(np.uint64) if len(step) else step
        out[self.order] = first // step if len(step) else first
        return out

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the code length for each window of `limit` bits."""
        span = 1 << (self.limit - self.lengths[self.order].astype(np.int64))
        ids, size = np.zeros(1 << self.limit, np.int32), np.zeros(1 << self.limit, np.int64)
        total = int(span.sum())
        ids[:total] = np.repeat(self.order, span)
        size[:total] = np.repeat(self.lengths[self.order], span)
        return ids, size

    def encode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For blocks ids[off[i]:off[i+1]]: 32-bit words, each block's offset into them, and the bit, in its block, of each id."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id that was not counted")
        n = self.lengths[ids].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        bits = total[off[1:]] - total[off[:-1]]
        begin = np.concatenate([[0], np.cumsum((bits + 31) // 32)])
        inside = total[:-1] - np.repeat(total[off[:-1]], np.diff(off))
        at = inside + np.repeat(begin[:-1] * 32, np.diff(off))
        value = self.codes[ids] << (np.uint64(64) - n.astype(np.uint64) - (at & 31).astype(np.uint64))
        out = np.zeros(int(begin[-1]) + 1, np.uint64)
        word = at >> 5
        if len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] = np.add.reduceat(value >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out[:-1].astype(np.uint32), begin, inside

    def decode(self, data: np.ndarray, begin: np.ndarray, n: np.ndarray, checks: np.ndarray, per: np.ndarray, step: int = CHECK) -> np.ndarray:
        """All ids of blocks: bytes, each block's first byte, number of ids, checkpoints, and how many each block has."""
        ids, size = self.table
        block = np.repeat(np.arange(len(n)), per)
        bit = checks + begin[block] * 8
        start = np.concatenate([[0], np.cumsum(n)])
        rank = np.arange(len(block)) - np.repeat(np.cumsum(per) - per, per)
        at = start[block] + rank * step
        left = np.minimum(n[block] - rank * step, step)
        raw = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        wide = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        out = np.zeros(int(start[-1]), np.int32)
        lanes = np.argsort(-left, kind="stable")
        bit, at, left = bit[lanes], at[lanes], left[lanes]
        for k in range(step):
            live = int(np.searchsorted(-left, -k, "left"))  # lanes with more than k ids
            if not live:
                break
            b = bit[:live]
            window = (wide[b >> 3] << (b & 7).astype(np.uint32)) >> np.uint32(32 - self.limit)
            out[at[:live] + k] = ids[window]
            bit[:live] += size[window]
        return out


def flat_ids(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of arrays or packed ids, and the rows' offsets into them; nulls have none."""
    if pa.types.is_binary(column.type):
        column = column.fill_null(b"") if column.null_count else column
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        return raw.view(f"<u{width}"), (off - off[0]) // width
    column = column.fill_null([]) if column.null_count else column
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def _column(df: DataFrame, ids: str):
    return F.col(ids) if dict(df.dtypes)[ids] == "binary" else F.col(ids).cast("array<int>")


def id_counts(df: DataFrame, ids: str = "token_ids", width: int = 4) -> DataFrame:
    """(id, n) over all rows."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for b in batches:
            flat, _ = flat_ids(b.column(0), width)
            own = np.bincount(flat, minlength=len(total))
            own[: len(total)] += total
            total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    small_batches(df.sparkSession)
    return df.select(_column(df, ids)).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def codebook(df: DataFrame, ids: str = "token_ids", limit: int = LIMIT, width: int = 4) -> Book:
    """One count per id of the vocabulary reaches the driver."""
    got = id_counts(df, ids, width).toPandas()
    counts = np.zeros(int(got["id"].max()) + 1 if len(got) else 0, np.int64)
    counts[got["id"].to_numpy()] = got["n"].to_numpy()
    limit = max(limit, (len(got) - 1).bit_length())
    if limit > 24:
        raise ValueError("a vocabulary beyond 2**24 ids has no decoding table here")
    return Book(code_lengths(counts, limit), limit)


def _portions(n: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about AT_ONCE ids; at least one, maybe empty."""
    cuts = [int(i) for i in np.flatnonzero(np.diff(np.cumsum(n.astype(np.int64)) // AT_ONCE)) + 1]
    return list(zip([0, *cuts], [*cuts, len(n)]))


def _sums(ids: np.ndarray, off: np.ndarray) -> list[int]:
    raw = memoryview(np.ascontiguousarray(ids, np.int32)).cast("B")
    cuts = (4 * off).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])]


def checksums():
    """An Arrow UDF from ids to their CRC-32."""

    def run(column: pa.Array) -> pa.Array:
        n = column.value_lengths().to_numpy(zero_copy_only=False)
        return pa.array(_sums(column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)), pa.int64())

    return F.arrow_udf(run, "bigint")


NAMES = ["block", "n_ids", "n_bits", "payload", "checkpoints", "checksum"]
BLOCKS = "array<struct<block:int,n_ids:int,n_bits:bigint,payload:binary,checkpoints:array<int>,checksum:bigint>>"


def _coder(shared, block: int, step: int, width: int, verify: bool):
    def code(column: pa.Array) -> pa.Array:
        ids, off = flat_ids(column, width)
        out = pa.concat_arrays([some(ids[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in _portions(np.diff(off))])
        release()
        return out

    def some(ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        n = np.diff(rows)
        per = np.maximum(1, -(-n // block))
        row = np.repeat(np.arange(len(n)), per)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        size = np.clip(n[row] - rank * block, 0, block)
        off = np.concatenate([[0], np.cumsum(size)])
        words, begin, bit = shared.value.encode(ids, off)
        ends = np.zeros(len(size), np.int64)
        full = size > 0
        ends[full] = bit[off[1:][full] - 1] + shared.value.lengths[ids[off[1:][full] - 1]]
        raw = words.astype(">u4").tobytes()
        payload = [raw[4 * b : 4 * b + (e + 7) // 8] for b, e in zip(begin[:-1].tolist(), ends.tolist())]
        marks = -(-size // step)
        inner = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
        checks = bit[np.repeat(off[:-1], marks) + inner * step] if len(inner) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(marks)]).astype(np.int32)), pa.array(checks.astype(np.int32)))
        sums = _sums(ids, off)
        columns = [pa.array(rank.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(ends), pa.array(payload, pa.binary()), lists, pa.array(sums, pa.int64())]
        if verify:  # from the blocks alone, as a reader would
            back = shared.value.decode(np.frombuffer(b"".join(payload), np.uint8), np.cumsum([0, *map(len, payload)])[:-1].astype(np.int64), size, checks, marks, step)
            columns.append(pa.array(np.array(_sums(back, off)) == np.array(sums)))
        own = pa.StructArray.from_arrays(columns, names=[*NAMES, "exact"][: len(columns)])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), own)

    return F.arrow_udf(code, BLOCKS.replace(">>", ",exact:boolean>>") if verify else BLOCKS)


def huffman_encode(df: DataFrame, book: Book, ids: str = "token_ids", block: int = BLOCK, step: int = CHECK, width: int = 4, verify: bool = False) -> DataFrame:
    """A row per block: df's other columns, block, n_ids, n_bits, payload, checkpoints, checksum (CRC-32 of its ids), and with
    `verify` exact, whether the block decodes to its ids; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(book)  # its size is bounded by the vocabulary
    small_batches(df.sparkSession)
    names = [*NAMES, "exact"] if verify else NAMES
    others = [c for c in df.columns if c not in (*names, ids)]
    inner = hidden(df, "block")
    rows = df.select(*others, F.explode(_coder(shared, block, step, width, verify)(_column(df, ids))).alias(inner))
    return rows.select(*others, *(F.col(inner)[n].alias(n) for n in names))


def block_ids(book: Book, spark, check: int = CHECK):
    """An Arrow UDF from (payload, n_ids, checkpoints) to ids; each block on its own."""
    shared = spark.sparkContext.broadcast(book)

    def read(payload: pa.Array, n: pa.Array, checks: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(payload[a:b], n[a:b], checks[a:b]) for a, b in _portions(n.to_numpy(zero_copy_only=False))])

    def some(payload: pa.Array, n: pa.Array, checks: pa.Array) -> pa.Array:
        size = n.to_numpy(zero_copy_only=False).astype(np.int64)
        raw = payload.to_pylist()
        begin = np.cumsum([0, *map(len, raw)])[:-1].astype(np.int64)
        per = checks.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = checks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids = shared.value.decode(np.frombuffer(b"".join(raw), np.uint8), begin, size, flat, per, check)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(ids))

    return F.arrow_udf(read, "array<int>")


def huffman_decode(blocks: DataFrame, book: Book, key: str = "doc_id", ids: str = "token_ids", step: int = CHECK) -> DataFrame:
    """(key, ids) from the blocks of each key. Equal blocks are copies of repeated rows, and each copy gives a row; of rows that
    share a key but not their ids, nothing tells the blocks apart: they need another key."""
    small_batches(blocks.sparkSession)
    own = blocks.select(F.col(key).alias("key"), "block", block_ids(book, blocks.sparkSession, step)("payload", "n_ids", "checkpoints").alias("ids"))
    own = own.withColumn("copy", F.row_number().over(W.partitionBy("key", "block").orderBy("ids")))
    lists = own.groupBy("key", "copy").agg(F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("b"))
    return lists.select(F.col("key").alias(key), F.flatten(F.transform("b", lambda b: b["ids"])).alias(ids))
