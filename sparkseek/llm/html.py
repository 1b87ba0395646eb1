"""Text of web pages without what their hosts repeat: a suffix array over each host's token streams.

A page becomes a stream of tokens: the words of its text and its block tags, without head, scripts, styles and comments.  A
window of WINDOW tokens that occurs on at least PAGES distinct pages of one host is boilerplate; all its occurrences go,
and the words of the unique runs between stay, lines broken where blocks were.  What one address serves is one page: rows
whose urls differ in scheme, fragment, trailing slash, session or tracking parameters only don't make each other boilerplate.

Only suffixes at anchors (least hash of the GRAM-token runs of a window) are sorted, and of these only those whose GRAM tokens occur in
another row of the host; the exchange that finds out packs shortened hashes into blocks, of which a false agreement does no
harm, as contexts are compared later.  Suffixes begin with their host.  Tasks sort the contexts of those anchors into
front-coded runs, equal contexts being one entry; each partition, by host and the anchor's GRAM tokens, merges its runs by a loser tree
into a piece of the hosts' suffix arrays, and common prefixes of neighbours give the repeated windows.  A large host is spread over
partitions like small ones together.  Streams are exchanged once, compressed by a dictionary of at most SAMPLED pages' streams.

Defined results: rows that repeat id, url and html are alike, and each gets its text; null html gives null text, empty html
empty text; a page all of whose windows are boilerplate may have empty text; pages with null or unusable urls form one host, on which each id and html is a page;
an id with one html under two hosts has two texts; pages of any length are read whole; other columns are kept and columns of the operator's names are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html as H
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import Codec, raw_dictionary
from .runs import front_code, pack, unpack
from .shared import small_batches
from .suffix_dedup import anchors, families, merged, stretches_of
from .text import lean, mix, parts, release, utf8, word_hashes

WINDOW, GRAM, PAGES = 8, 4, 2
RUN_BYTES, BLOCK_ANCHORS = 64 << 20, 1 << 20  # bytes of a run, anchors that a task sends at once
LEVEL = 12  # of compression, as streams and runs are most of what is exchanged
SAMPLED = 200  # pages that the dictionary of frames is learned from
TARGET_BYTES, TARGETS = 16 << 20, 1 << 17  # bytes of pages for each target; targets at most
_TRACKING = r"(?i)(?<=[?&])(?:utm_[^=&#]*|gclid|fbclid|msclkid|mc_cid|mc_eid|ref|ref_src|sessionid|phpsessid|jsessionid|sid)=[^&#]*&?"
BREAK = "\x02"  # begins the token of a block tag
_BLOCKS = "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()


@lru_cache(1)
def _lexer():
    return re.compile(
        r"<!--.*?(?:-->|\Z)|<(script|style|head|template|noscript|svg|iframe|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>?|[^<]+|<",
        re.S | re.I,
    )


def tokens(page: str) -> list[str]:
    """Words and block tags in order."""
    out, text, blocks = [], [], frozenset(_BLOCKS)

    def flush():
        if text:
            out.extend(H.unescape("".join(text)).replace(BREAK, " ").split())
            text.clear()

    for m in _lexer().finditer(page):
        s = m[0]
        if s[0] != "<" or s == "<":
            text.append(s)
        elif m[3] and (tag := m[3].lower()) in blocks:
            flush()
            out.append(f"{BREAK}{m[2]}{tag}")
    flush()
    return out


def readable(stream: list[str]) -> str:
    """Words of the stream, a line for each block that has some."""
    lines: list[list[str]] = [[]]
    for t in stream:
        if t[0] == BREAK:
            if lines[-1]:
                lines.append([])
        else:
            lines[-1].append(t)
    return "\n".join(" ".join(x) for x in lines if x)


def _stream(page: str) -> bytes:
    return " ".join(tokens(page)).encode("utf-8", "surrogatepass")


def _streams(codec: Codec):
    def run(column: pa.Array) -> pa.Array:
        return codec.pack(map(_stream, column.to_pylist()))

    return lean(run)


def _learned(df: DataFrame, html: str) -> bytes:
    return raw_dictionary(_stream(r[0]) for r in df.select(F.col(html).cast("string")).where(F.col(html).isNotNull()).limit(SAMPLED).toLocalIterator())


def _narrow(values: np.ndarray) -> bytes:
    """Numbers of 1, 2 or 4 bytes, after a byte that tells which."""
    most = int(values.max()) if len(values) else 0
    kind = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    return bytes([kind().itemsize]) + values.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _shortened(h: np.ndarray, width: int) -> bytes:
    """The low `width` half-bytes of each hash."""
    raw = h.view(np.uint8).reshape(-1, 8)
    half = np.append(raw[:, width // 2] & 15, 0)[: (len(raw) + 1) // 2 * 2] if width % 2 else np.zeros(0, np.uint8)
    return raw[:, : width // 2].tobytes() + (half[::2] | half[1::2] << 4).astype(np.uint8).tobytes()


def _lengthened(raw: bytes, n: int, width: int) -> np.ndarray:
    out, whole = np.zeros((n, 8), np.uint8), width // 2
    out[:, :whole] = np.frombuffer(raw, np.uint8, n * whole).reshape(-1, whole)
    if width % 2:
        half = np.frombuffer(raw, np.uint8, offset=n * whole)
        out[::2, whole], out[1::2, whole] = half[: (n + 1) // 2] & 15, half[: n // 2] >> 4
    return out.view(np.uint64)[:, 0]


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^35 in bytes of seven bits, the low ones first, all but the last marked; the numbers' offsets into them."""
    n = 1 + sum((values >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    off = np.concatenate([[0], np.cumsum(n)])
    shift = np.arange(off[-1]) - np.repeat(off[:-1], n)
    return (np.repeat(values, n) >> 7 * shift & 127 | np.where(shift < np.repeat(n, n) - 1, 128, 0)).astype(np.uint8), off


def _numbers(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of _varints and the end byte of each."""
    ends = np.flatnonzero(raw < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64), ends
    starts = np.append(0, ends[:-1])
    shift = np.arange(len(raw)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * shift, starts), ends


def _cuts(page: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each page once, with its stretches, those that meet in one, as varints of (first, length)."""
    order = np.lexsort((first, page))
    page, first, end = page[order], first[order], end[order]
    before = np.cumsum(np.diff(page, prepend=page[:1]) != 0) << 33
    reach = np.maximum.accumulate(before + end)
    new = np.flatnonzero(np.append(True, (before + first)[1:] > reach[:-1])[: len(page)])
    last = np.append(new[1:], len(page))[: len(new)] - 1
    page, first, size = page[new], first[new], (reach - before)[last] - first[new]
    raw, off = _varints(np.stack([first, size], 1).ravel())
    own = np.flatnonzero(np.append(True, page[1:] != page[:-1])[: len(page)])
    cut = off[2 * np.append(own, len(page))].astype(np.int32)
    return page[own], pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cut), pa.py_buffer(raw)])


def _anchors(codec: Codec, b: pa.RecordBatch, window: int, gram: int):
    """Of a batch (pid, host, address, z, ...): its streams, and of all anchors hash, row and place."""
    hosts = b.column(1).to_numpy(zero_copy_only=False)
    streams = codec.unpack(b.column(3))
    data, off = utf8(pa.array(streams, pa.binary()))
    got = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, _, d, o in parts(data, off):
        words, _, _, rows = word_hashes(d, o)
        at, h = anchors(words, rows, window, gram)
        row = np.searchsorted(rows, at, "right") - 1
        got.append((mix(h ^ hosts[i + row].view(np.uint64)), i + row, at - rows[row]))
    return streams, *(np.concatenate(x) for x in zip(*got))


def _packed(codec: Codec, window: int, gram: int, targets: int, width: int):
    """Anchors of many pages, in a block for each target: `width` half-bytes of each hash, by page, and the pages' ids and counts."""

    def blocks(held: list[tuple]):
        h, page, ids = (np.concatenate(x) for x in zip(*held))
        target = (h >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)
        order = np.argsort(target, kind="stable")
        h, page = h[order], page[order]
        cut = np.searchsorted(target[order], np.arange(targets + 1, dtype=np.uint64))
        out, where = [], np.flatnonzero(np.diff(cut)).tolist()
        for t in where:
            p = page[cut[t] : cut[t + 1]]
            new = np.flatnonzero(np.diff(p, prepend=-1))
            out.append(pack(ids[p[new]].tobytes(), _narrow(np.diff(np.append(new, len(p)))), _shortened(h[cut[t] : cut[t + 1]], width)))
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(out, pa.binary())], names=["target", "block"])

    def run(batches):
        held, size, before = [], 0, 0
        for b in batches:
            _, h, row, _ = _anchors(codec, b, window, gram)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            once = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]  # of those that a page repeats
            h, row = h[once], row[once]
            held.append((h, before + row, b.column(0).to_numpy(zero_copy_only=False)))
            size, before = size + len(h), before + b.num_rows
            if size >= BLOCK_ANCHORS:
                yield blocks(held)
                held, size, before = [], 0, 0
        if size:
            yield blocks(held)
        release()

    return run


def _often(least: int, width: int):
    """Of a target's blocks: the shortened hashes that `least` rows or more have, and the rows' ids."""

    def run(table: pa.Table) -> pa.Table:
        got, before = [], 0
        for block in table.column("block").to_pylist():
            ids, counts, short = unpack(block)
            ids, counts = np.frombuffer(ids, np.int64), _wide(counts)
            got.append((_lengthened(short, int(counts.sum()), width), np.repeat(before + np.arange(len(ids)), counts), np.repeat(ids, counts)))
            before += len(ids)
        h, row, page = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(h, kind="stable")  # rows stay in order
        h, row, page = h[order], row[order], page[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        fresh = new | np.concatenate([[True], row[1:] != row[:-1]])
        group = np.cumsum(new) - 1
        keep = fresh & (np.bincount(group, fresh)[group] >= least)
        out = pa.table([pa.array(page[keep]), pa.array(h[keep].astype(np.int32 if width < 8 else np.int64))], names=["pid", "h"])
        release()
        return out

    return run


def boilerplate(common, left, size, members, window: int, gram: int, least: int) -> tuple[np.ndarray, ...]:
    """(page, first token, end token) of the stretches, around the members, of windows that `least` addresses have. The first
    word of each suffix is its host."""
    entry, page, address, place = members
    out = np.zeros((len(entry), window - gram + 3), bool)
    for j, group in families(common - 1, left, size - 1, window, gram):
        own = group[entry]
        rows = np.flatnonzero(own >= 0)
        order = rows[np.lexsort((address[rows], own[rows]))]
        g, p = own[order], address[order]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        fresh = new | np.concatenate([[True], p[1:] != p[:-1]])
        number = np.cumsum(new) - 1
        out[order, j + 1] = np.bincount(number, fresh)[number] >= least
    row, first, end, _ = stretches_of(out, place, window)
    return page[row], first, end


def _contexts(pid: int, address: int, host: bytes, stream: bytes, places: list[int], window: int, gram: int, into: dict) -> int:
    """Adds each place to the entry of its (host and suffix, words before); about the bytes that this takes. A place that false
    agreement made up does no harm."""
    words, size = stream.split(b" "), 0
    for p in places:
        entry = b"%s %s " % (host, b" ".join(words[p : p + window])), b" ".join(words[max(0, p - window + gram) : p])
        if entry not in into:
            into[entry] = []
            size += len(entry[0]) + len(entry[1]) + 250
        into[entry].append((pid, address, p))
    return size + 130 * len(places)


def _to_runs(codec: Codec, window: int, gram: int, targets: int, width: int):
    def flushed(entries: dict):
        by: dict[int, list] = {}
        for e in entries:
            at = -1
            for _ in range(gram + 1):
                at = e[0].index(b" ", at + 1)
            by.setdefault(zlib.crc32(e[0][:at]) % targets, []).append(e)
        out = []
        for own in by.values():
            own.sort()
            shared, rests, lengths = front_code([s for s, _ in own])
            lists = [entries[e] for e in own]
            flat = np.array([v for m in lists for v in m], np.int64).reshape(-1, 3)
            ints = [np.array(v, np.uint32).tobytes() for v in (shared, lengths, [len(m) for m in lists])]
            out.append(pack(*ints, rests, b"\n".join(b for _, b in own), flat[:, 0].tobytes(), flat[:, 1].tobytes(), flat[:, 2].astype(np.int32).tobytes(), level=LEVEL))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array(out, pa.binary())], names=["target", "block"])

    def run(batches):
        entries: dict = {}
        held, bits = 0, np.uint64(4 * width)
        for b in batches:
            streams, h, row, place = _anchors(codec, b, window, gram)
            often = b.column(4)
            wanted = np.repeat(np.arange(b.num_rows, dtype=np.uint64), often.value_lengths().to_numpy(zero_copy_only=False)) << bits
            wanted |= often.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            mine = np.isin(row.astype(np.uint64) << bits | h & np.uint64((1 << int(bits)) - 1), wanted)
            cut = np.searchsorted(row[mine], np.arange(b.num_rows + 1)).tolist()
            place = place[mine].tolist()
            for i, (pid, host, address, stream) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), streams)):
                for some in range(cut[i], cut[i + 1], 5000):
                    held += _contexts(pid, address, b"%016x" % (host % (1 << 64)), stream, place[some : min(some + 5000, cut[i + 1])], window, gram, entries)
                    if held >= RUN_BYTES:
                        yield from flushed(entries)
                        entries, held = {}, 0
        yield from flushed(entries)
        entries.clear()
        release()

    return run


def address_of(url: Column) -> Column:
    """The url without scheme, fragment, trailing slash, session and tracking parameters; its host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")
    return F.regexp_replace(F.regexp_replace(rest, _TRACKING, ""), r"[/?&]+$", "")


def extract(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", window: int = WINDOW, gram: int = GRAM, pages: int = PAGES) -> DataFrame:
    """df without html, with text, n_words (kept) and n_removed (words that went)."""
    if not 0 < gram <= window or pages < 2:
        raise ValueError("0 < gram <= window, pages >= 2")
    small_batches(df.sparkSession)
    names = ("text", "n_words", "n_removed")
    others = [c for c in df.columns if c != html and c not in names]
    value = F.col(html).cast("string")
    link = F.col(url).cast("string")
    name = F.nullif(F.lower(F.try_parse_url(link, F.lit("HOST"))), F.lit(""))
    content = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0")), value)
    host = F.xxhash64(F.coalesce(name, F.lit("")))
    address = F.when(name.isNotNull(), F.xxhash64(name, address_of(link))).otherwise(content)
    ids = F.when(value.isNotNull(), F.xxhash64(content, host, address))
    codec = Codec(_learned(df, html), LEVEL)
    full = df.select(ids.alias("pid"), host.alias("host"), address.alias("address"), value.alias("html")).where("pid is not null")
    full = full.select("pid", "host", "address", F.arrow_udf(_streams(codec), "binary")("html").alias("z"))
    about = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    about = about if about < 1 << 60 else df.rdd.getNumPartitions() * 4 * TARGET_BYTES  # unknown
    targets = int(min(TARGETS, max(8, about // TARGET_BYTES)))
    width = 7 if about // targets <= 2 * TARGET_BYTES else 10  # half-bytes, so that few agree by chance
    held = full.dropDuplicates(["pid"])  # rows that are alike go before the one exchange, which is reused below
    found = held.mapInArrow(_packed(codec, window, gram, targets, width), "target int, block binary").groupBy("target").applyInArrow(_often(pages, width), f"pid long, h {'int' if width < 8 else 'long'}")
    often = found.groupBy("pid").agg(F.collect_list("h").alias("often"))

    def from_runs(table: pa.Table) -> pa.Table:
        got = boilerplate(*merged(table.column("block").to_pylist()), window, gram, pages)
        pid, own = _cuts(*(x.astype(np.int64) for x in got))
        out = pa.table([pa.array(pid), own], names=["pid", "cuts"])
        release()
        return out

    runs = held.join(often, "pid").select("pid", "host", "address", "z", "often").mapInArrow(_to_runs(codec, window, gram, targets, width), "target int, block binary")
    cuts = runs.groupBy("target").applyInArrow(from_runs, "pid long, cuts binary")
    # a page's cuts are bounded by its tokens
    cuts = cuts.repartition(F.col("pid")).groupBy("pid").agg(F.collect_list("cuts").alias("cuts"))

    def keep(z: pa.Array, lists: pa.Array, _: pa.Array, __: pa.Array) -> pa.Array:
        texts, kept, removed = [], [], []
        data, off = utf8(lists.flatten())
        values, ends = _numbers(data)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(ends, off[np.concatenate([[0], np.cumsum(n)])], "right").tolist()
        for stream, a, b in zip(codec.unpack(z), at, at[1:]):
            words = stream.decode("utf-8", "surrogatepass").split(" ") if stream else []
            gone = np.zeros(len(words) + 1, np.int32)
            np.add.at(gone, values[a:b:2], 1)
            np.subtract.at(gone, values[a:b:2] + values[a + 1 : b : 2], 1)
            gone = np.cumsum(gone)[:-1] > 0
            left = [w if not g else BREAK for w, g in zip(words, gone.tolist())]
            texts.append(readable(left))
            kept.append(sum(w[0] != BREAK for w in left))
            removed.append(sum(w[0] != BREAK for w in words) - kept[-1])
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(kept, pa.int32()), pa.array(removed, pa.int32())], names=list(names))

    # rows join before the function, behind which nothing is known of partitions; it takes host and address for the exchange to be the same as above
    rows = df.select(F.struct(*others).alias("own"), ids.alias("pid"))  # a struct, so that no name clashes
    whole = held.join(cuts, "pid", "left").join(rows, "pid")
    done = whole.select("own", F.arrow_udf(lean(keep), "struct<text:string,n_words:int,n_removed:int>")("z", "cuts", "host", "address").alias("result"))
    none = rows.where("pid is null").select("own", F.lit(None).cast("struct<text:string,n_words:int,n_removed:int>").alias("result"))
    return done.unionByName(none).select(*(F.col("own").getField(c).alias(c) for c in others), *(F.col("result")[n].alias(n) for n in names))
