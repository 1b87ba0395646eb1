"""Byte-pair encoding and decoding with a minimal acyclic transducer of frequent words.

Words are counted over all texts; those that make up at least FREQUENT of all word occurrences (so at most 1 / FREQUENT
words, whatever the corpus) are merged once and compiled into a minimal acyclic automaton with shared suffixes.  Its arcs
carry numbers; their sum along a word's path is the word's place in a table of ids.  Automaton, table and vocabulary are
one file that Spark brings to the executors, where workers map it into memory and walk it for all words at once that they
don't remember from before.  Words it doesn't hold are merged exactly, side by side, very long ones by a heap in O(n log n).

The result is that of the plain encoder, whatever words are frequent.  The vocabulary is a file of "base64 rank" lines;
its path is a parameter.  Defined results: null gives null, empty text no ids; texts of any length are encoded whole;
repeated rows each get their ids; decoding a null gives null; an id beyond the vocabulary raises; other columns are
kept and columns of the operator's names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_file, small_batches, written
from .text import parts, ragged, release, span_hashes, utf8

VOCABULARY, FREQUENT = "/opt/tokenizers/byte_bpe_50k.tiktoken", 5e-6
LONG, DECODED = 64, 1 << 18  # bytes of a word that is merged by itself, ids that are decoded at once
SIDE, AT_ONCE = (16, 32, LONG), 1 << 13  # bytes of words that are merged side by side, such words at once
COUNTED, REMEMBERED = 1 << 17, 1 << 19  # words that a task counts before it sends them, that a worker remembers at most
NEVER, NONE = np.int64(1 << 60), np.int64((1 << 31) - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other."""
    import regex

    every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    out = np.full(0x110000, 3, np.uint8)
    for kind, pattern in ((0, r"\s+"), (1, r"\p{L}+"), (2, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out[0xD800:0xE000] = 3
    return out


def _kinds(data: np.ndarray) -> np.ndarray:
    """By byte: the class of the character that it belongs to; a byte that is no UTF-8 is other."""
    out = classes()[:256][data]
    high = np.flatnonzero(data >= 0x80)
    if not len(high):
        return out
    try:
        points = np.frombuffer(data[high].tobytes().decode().encode("utf-32-le"), np.uint32)
        width = 2 + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        last = np.cumsum(width) - 1
        if np.array_equal(high[last] - high[last - width + 1], width - 1):  # no character is torn
            out[high] = np.repeat(classes()[points], width)
            return out
    except UnicodeDecodeError:
        pass
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[(points >= 0xDC80) & (points < 0xDD00)] = 1
    return np.repeat(classes()[points], width)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte of each word, and each row's offset into the words; words cover their rows. They are those of
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space before white space or the end|white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _kinds(data)
    row = np.zeros(n + 1, bool)
    row[off] = True
    row[0] = row[n] = True
    first = row[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    begin = first.copy()
    after = np.flatnonzero(first & (kind != 0) & ~row[:n])  # words that something precedes
    after = after[kind[after - 1] == 0]
    space = after - 1
    while len(inner := np.flatnonzero(data[space] & 0xC0 == 0x80)):
        space[inner] -= 1
    begin[space] = True
    begin[after[data[space] == 32]] = False
    q = np.flatnonzero((data == 39) & begin & first)
    q = q[~row[q + 1]]
    q = q[kind[q + 1] == 1]
    if len(q):
        one = np.isin(data[q + 1], [ord(c) for c in "stmd"])
        third = np.where(row[q + 2], 0, data[np.minimum(q + 2, n - 1)])
        pair = data[q + 1].astype(np.int64) << 8 | third
        two = np.isin(pair, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        begin[q[one | two] + 1] = False
        cut = np.concatenate([q[one] + 2, q[two] + 3])
        begin[cut[cut < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, off)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word: always the leftmost of the pairs with the least rank is merged next."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the symbol that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def read_vocabulary(path: str) -> list[bytes]:
    """Token bytes by rank; ranks without a token are empty."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (1 + max((int(r) for _, r in pairs), default=-1))
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def compiled(lexicon: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct words: arc keys (state << 8 | byte), sorted, targets, numbers, and whether states are final.
    State 0 is the start; a word's place among the words is the sum of its path's numbers."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []
    size: list[int] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if (s := register.get(key)) is None:
            s = register[key] = len(states)
            states.append(key)
            size.append(final + sum(size[t] for _, t in arcs))
        return s

    path: list[list] = [[False, []]]  # final, arcs settled so far; of each prefix of the word before
    before = b""
    for w in [*lexicon, None]:
        keep = 0
        if w is not None:
            while keep < min(len(w), len(before)) and w[keep] == before[keep]:
                keep += 1
        while len(path) - 1 > keep:
            final, arcs = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(final, arcs)))
        if w is None:
            break
        path += [[False, []] for _ in range(len(w) - keep)]
        path[-1][0] = True
        before = w
    start = settle(*path[0])
    swap = {start: 0, 0: start}
    keys, targets, numbers = [], [], []
    for s, (final, arcs) in enumerate(states):
        seen = int(final)
        for byte, t in arcs:
            keys.append(swap.get(s, s) << 8 | byte)
            targets.append(swap.get(t, t))
            numbers.append(seen)
            seen += size[t]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    finals = np.zeros(len(states), np.uint8)
    finals[[swap.get(s, s) for s, (final, _) in enumerate(states) if final]] = 1
    return np.array(keys, np.int64)[order], np.array(targets, np.int32)[order], np.array(numbers, np.int32)[order], finals


def slots(keys: np.ndarray) -> np.ndarray:
    """An open-addressed table of distinct keys: the place of a key, or -1, in each slot."""
    out = np.full(1 << max(3, (3 * len(keys)).bit_length()), -1, np.int32)
    at, left = _slot(keys, len(out)), np.arange(len(keys))
    while len(left):
        free = left[out[at[left]] < 0]
        out[at[free][::-1]] = free[::-1]  # of those that want one slot, the first gets it
        left = left[out[at[left]] != left]
        at[left] = (at[left] + 1) & (len(out) - 1)
    return out


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys.astype(np.uint64) * _SPREAD >> np.uint64(65 - size.bit_length())).astype(np.int64)


def lookup(table: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place in keys of each wanted key, -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = _slot(wanted, len(table))
    out = table[at].astype(np.int64)
    left = np.flatnonzero((out >= 0) & (keys[out] != wanted))
    while len(left):
        at[left] = (at[left] + 1) & (len(table) - 1)
        out[left] = table[at[left]]
        left = left[(out[left] >= 0) & (keys[out[left]] != wanted[left])]
    return out


_KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32, np.int64, np.uint8, np.int64, np.int64, np.int32, np.int32)


def pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (left id << 32 | right id) of all pairs of tokens that make a token, and its id."""
    found = [(a << 32 | b, r) for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None]
    found.sort()
    return np.array([k for k, _ in found], np.int64), np.array([r for _, r in found], np.int64)


def packed(vocabulary: list[bytes], lexicon: list[bytes]) -> bytes:
    """The file: sizes, then arc keys, targets, numbers, finals, offsets and ids of the words, offsets and bytes of the tokens,
    pairs, and tables to find arcs and pairs. The tokens are words too."""
    ranks = {t: i for i, t in enumerate(vocabulary) if t}
    lexicon = sorted({*lexicon, *ranks})
    ids = [merged(w, ranks) for w in lexicon]
    arcs, two = compiled(lexicon), pairs(ranks)
    sections = [*arcs, np.cumsum([0, *map(len, ids)]), np.array([i for x in ids for i in x]), np.cumsum([0, *map(len, vocabulary)]), np.frombuffer(b"".join(vocabulary), np.uint8), *two, slots(arcs[0]), slots(two[0])]
    head, body = [], []
    for x, kind in zip(sections, _KINDS):
        raw = np.asarray(x, kind).tobytes()
        head.append(len(raw))
        body.append(raw + b"\0" * (-len(raw) % 8))
    return np.array(head, np.int64).tobytes() + b"".join(body)


class Remembered:
    """The ids of words met before, by the words' hashes; one that is full begins anew."""

    def __init__(self, most: int = REMEMBERED):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.n, self.ids = 0, np.zeros(1 << 12, np.int32)
        self.used = 0
        self.keys, self.table = np.zeros(self.most, np.uint64), np.full(4 * self.most, -1, np.int32)
        self.begin, self.size = np.zeros(self.most, np.int64), np.zeros(self.most, np.int32)

    def add(self, keys: np.ndarray, ids: np.ndarray, off: np.ndarray) -> None:
        """New distinct keys; those beyond the bound aren't kept."""
        if self.n + len(keys) > self.most:
            self.clear()
        keys = keys[: self.most]
        new = np.arange(self.n, self.n + len(keys))
        self.keys[new], self.size[new], self.begin[new] = keys, np.diff(off)[: len(keys)], off[: len(keys)] + self.used
        end = self.used + int(off[len(keys)])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * end - self.used, np.int32)])
        self.ids[self.used : end] = ids[: off[len(keys)]]
        at, left = _slot(keys, len(self.table)), np.arange(len(keys))
        while len(left):
            free = left[self.table[at[left]] < 0]
            self.table[at[free][::-1]] = new[free[::-1]]
            left = left[self.table[at[left]] != new[left]]
            at[left] = (at[left] + 1) & (len(self.table) - 1)
        self.n, self.used = self.n + len(keys), end


class Encoder:
    """A mapped file."""

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        sizes = raw[: 8 * len(_KINDS)].view(np.int64)
        at, got = 8 * len(_KINDS), []
        for n, kind in zip(sizes.tolist(), _KINDS):
            got.append(raw[at : at + n].view(kind))
            at += n + -n % 8
        self.keys, self.targets, self.numbers, self.finals, self.offsets, self.ids, self.token_offsets, self.tokens, self.pair_keys, self.pair_ranks, self.arc_slots, self.pair_slots = got
        raw, at = self.tokens.tobytes(), self.token_offsets.tolist()
        self.ranks = {raw[at[i] : at[i + 1]]: i for i in range(len(at) - 1) if at[i + 1] > at[i]}
        self.single = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        self.byte_pairs = self.ranked(self.single.repeat(256), np.tile(self.single, 256)).reshape(256, 256)
        self.remembered = Remembered()

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word in the table, -1 for those that the automaton doesn't hold."""
        state, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        left, step = np.arange(len(starts)), 0
        out = np.full(len(starts), -1, np.int64)
        while len(left):
            done = starts[left] + step == ends[left]
            over = left[done]
            out[over] = np.where(self.finals[state[over]] == 1, place[over], -1)
            left = left[~done]
            key = state[left] << 8 | data[starts[left] + step]
            arc = lookup(self.arc_slots, self.keys, key)
            left, arc = left[arc >= 0], arc[arc >= 0]
            state[left] = self.targets[arc]
            place[left] += self.numbers[arc]
            step += 1
        return out

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, NEVER where it doesn't."""
        at = lookup(self.pair_slots, self.pair_keys, left << 32 | right)
        return np.where(at >= 0, self.pair_ranks[at], NEVER) if len(self.pair_keys) else np.full(len(left), NEVER)

    def merge_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merged() of many words side by side: in each round, every word's leftmost pair of least rank. Longer words go one by one."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their lengths, ids
        size = ends - starts
        for w in np.flatnonzero(size > LONG).tolist():
            ids = merged(data[starts[w] : ends[w]].tobytes(), self.ranks)
            out.append((np.array([w]), np.array([len(ids)]), np.array(ids, np.int64)))
        for below, most in zip((-1, *SIDE), SIDE):
            own = np.flatnonzero((size > below) & (size <= most))
            for some in np.array_split(own, -(-len(own) // AT_ONCE)) if len(own) else ():
                out.append((some, *self._merge_side(data, starts[some], size[some])))
        if not out:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        words_, sizes, ids = (np.concatenate(x) for x in zip(*out))
        flat, at = ragged(ids, np.concatenate([[0], np.cumsum(sizes)]), np.argsort(words_))
        return flat.astype(np.int32), at

    def _merge_side(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and all ids of words. A column is a word, a line a place of it, with a line before and one behind
        where no pair begins; a pair's key is its rank, then its place."""
        n, most = len(size), int(size.max())
        end = most + 1
        line = np.arange(most)[:, None]
        inside = line < size
        raw = data[np.where(inside, starts + line, starts)]
        symbol = np.full((end + 1, n), NONE)
        np.copyto(symbol[1:end], self.single[raw], where=inside)
        key = np.full((end + 1, n), NEVER)
        if most > 1:
            pair = self.byte_pairs[raw[:-1], raw[1:]]
            np.copyto(key[1:most], pair << 8 | line[1:], where=inside[1:] & (pair < NEVER))
        after = np.repeat(np.minimum(np.arange(end + 1) + 1, end), n)
        before = np.repeat(np.maximum(np.arange(end + 1) - 1, 0), n)
        column = np.arange(n)
        after[size * n + column] = end
        symbols, keys = symbol.ravel(), key.ravel()
        while True:
            least = (key if len(column) == n else key[:, column]).min(axis=0)
            live = least < NEVER
            column, least = column[live], least[live]
            if not len(column):
                break
            place = least & 255
            at = place * n + column
            gone = after[at] * n + column
            behind, front = after[gone], before[at]
            right, left = behind * n + column, front * n + column
            symbols[at], symbols[gone] = least >> 8, NONE
            after[at], before[right], keys[gone] = behind, place, NEVER
            both = np.concatenate([left, at])
            got = self.ranked(symbols[both], symbols[np.concatenate([at, right])])
            keys[both] = np.where(got < NEVER, got << 8 | np.concatenate([front, place]), NEVER)
        by_word = symbol.T
        used = by_word != NONE
        return used.sum(1), by_word[used]

    def known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, and the words' offsets into them: by the automaton, or merged."""
        place = self.places(data, starts, ends)
        new = np.flatnonzero(place < 0)
        extra, at = self.merge_all(data, starts[new], ends[new])
        place[new] = np.arange(len(new))
        held, size = place.copy(), np.empty(len(place), np.int64)
        mine = np.ones(len(place), bool)
        mine[new] = False
        size[mine] = self.offsets[place[mine] + 1] - self.offsets[place[mine]]
        size[new] = np.diff(at)
        held[mine] = self.offsets[place[mine]]
        held[new] = at[:-1] + len(self.ids)
        off = np.concatenate([[0], np.cumsum(size)])
        which = np.arange(off[-1]) - np.repeat(off[:-1] - held, size)
        out = np.empty(len(which), np.int32)
        inside = which < len(self.ids)
        out[inside], out[~inside] = self.ids[which[inside]], extra[which[~inside] - len(self.ids)]
        return out, off

    def encode_part(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these rows, and the rows' offsets into them."""
        starts, rows = words(data, off)
        ends = np.append(starts[1:], len(data))
        h, own = span_hashes(data, starts, ends), self.remembered
        at = lookup(own.table, own.keys, h)
        begin, size = own.begin[at], own.size[at]
        table = own.ids
        new = np.flatnonzero(at < 0)
        if len(new):
            keys, which, back = np.unique(h[new], return_index=True, return_inverse=True)
            ids, o = self.known(data, starts[new[which]], ends[new[which]])
            begin[new], size[new] = o[back] + own.used, np.diff(o)[back]
            table = np.concatenate([own.ids[: own.used], ids])
            own.add(keys, ids, o)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return table[np.arange(total[-1]) - np.repeat(total[:-1] - begin, size)], total[rows]

    def encode(self, column: pa.Array, verify: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the rows' offsets into them, and with `verify` whether each row's ids decode to it."""
        data, off = utf8(column)
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        exact = np.ones(len(off) - 1, bool)
        for i, j, d, o in parts(data, off):
            ids, at = self.encode_part(d, o)
            flat.append(ids)
            counts.append(np.diff(at))
            if verify:
                back, cuts = ragged(self.tokens, self.token_offsets, ids)
                if not (np.array_equal(cuts[at], o) and np.array_equal(back, d)):
                    exact[i:j] = [np.array_equal(back[cuts[at[k]] : cuts[at[k + 1]]], d[o[k] : o[k + 1]]) for k in range(j - i)]
        return np.concatenate(flat), np.cumsum(np.concatenate(counts)), exact

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[bytes]:
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_offsets) - 1):
            raise ValueError("an id beyond the vocabulary")
        out: list[bytes] = []
        for _, _, own, o in parts(ids, off, DECODED):
            raw, at = ragged(self.tokens, self.token_offsets, own)
            raw, cuts = raw.tobytes(), at[o].tolist()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out


@lru_cache(2)
def mapped(name: str) -> Encoder:
    return Encoder(SparkFiles.get(name))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts. A task adds up what it counts, COUNTED words at a time."""

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # hashes, counts, words
        size = 0

        def together():
            h, n, w = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held])
            h, which, back = np.unique(h, return_index=True, return_inverse=True)
            return h, np.bincount(back, n).astype(np.int64), w.take(pa.array(which))

        for b in batches:
            data, off = utf8(b.column(0))
            for _, _, d, o in parts(data, off):
                starts, _ = words(d, o)
                ends = np.append(starts[1:], len(d))
                h, which, n = np.unique(span_hashes(d, starts, ends), return_index=True, return_counts=True)
                flat, at = ragged(d, np.append(starts, len(d)), which)
                held.append((h, n, pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])))
                size += len(h)
                if size >= COUNTED:
                    held = [together()]
                    size = len(held[0][0])
                    if size >= COUNTED // 2:
                        yield pa.RecordBatch.from_arrays([held[0][2], pa.array(held[0][1])], names=["word", "n"])
                        held, size = [], 0
        if held:
            _, n, w = together()
            yield pa.RecordBatch.from_arrays([w, pa.array(n)], names=["word", "n"])
        release()

    small_batches(df.sparkSession)
    rows = df.select(F.col(text).cast("string").alias("text")).where("text is not null")
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, text: str = "text", frequent: float = FREQUENT) -> list[bytes]:
    """The frequent words: at most 1 / frequent of them, by definition."""
    counts = written(word_counts(df, text), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [bytes(r.word) for r in counts.where(F.col("n") >= frequent * total).select("word").collect()]


def prepare(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, frequent: float = FREQUENT) -> str:
    """Counts, compiles and shares; the name of the file."""
    return shared_file(df.sparkSession, packed(read_vocabulary(vocabulary), lexicon(df, text, frequent)), "lexicon")


def ids_width(vocabulary: str = VOCABULARY) -> int:
    """Bytes of an id in packed form."""
    return 2 if len(read_vocabulary(vocabulary)) <= 1 << 16 else 4


def _lists(ids: np.ndarray, off: np.ndarray, column: pa.Array) -> pa.Array:
    """Lists of ids, null where the column is."""
    missing = np.append(column.is_null().to_numpy(zero_copy_only=False), False) if column.null_count else None
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32), mask=missing), pa.array(ids))


def encoder(name: str):
    """An Arrow UDF from text to ids."""

    def encode(column: pa.Array) -> pa.Array:
        ids, off, _ = mapped(name).encode(column)
        out = _lists(ids, off, column)
        release()
        return out

    return F.arrow_udf(encode, "array<int>")


def verified_encoder(name: str):
    """An Arrow UDF from text to (ids, whether they decode to the text); in one pass over the text."""

    def encode(column: pa.Array) -> pa.Array:
        ids, off, exact = mapped(name).encode(column, True)
        out = pa.StructArray.from_arrays([_lists(ids, off, column), pa.array(exact)], names=["ids", "exact"])
        release()
        return out

    return F.arrow_udf(encode, "struct<ids:array<int>,exact:boolean>")


def packed_encoder(name: str, width: int):
    """An Arrow UDF from text to its ids as little-endian numbers of `width` bytes, a compact column to write; null for null."""

    def encode(column: pa.Array) -> pa.Array:
        ids, off, _ = mapped(name).encode(column)
        raw = pa.py_buffer(ids.astype(f"<u{width}"))
        mask = pa.array(~column.is_null().to_numpy(zero_copy_only=False)).buffers()[1] if column.null_count else None
        out = pa.Array.from_buffers(pa.binary(), len(column), [mask, pa.py_buffer((off * width).astype(np.int32)), raw], column.null_count)
        release()
        return out

    return F.arrow_udf(encode, "binary")


def counter(name: str):
    """An Arrow UDF from text to its number of ids; null for null."""

    def count(column: pa.Array) -> pa.Array:
        _, off, _ = mapped(name).encode(column)
        out = pa.array(np.diff(off), mask=column.is_null().to_numpy(zero_copy_only=False))
        release()
        return out

    return F.arrow_udf(count, "bigint")


def decoder(name: str):
    """An Arrow UDF from ids to the bytes of the text."""

    def decode(column: pa.Array) -> pa.Array:
        filled = column.fill_null([]) if column.null_count else column
        flat, n = filled.flatten(), filled.value_lengths().to_numpy(zero_copy_only=False)
        got = mapped(name).decode(flat.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)]).astype(np.int64))
        return pa.array(got, pa.binary(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(decode, "binary")


def bpe_encode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, frequent: float = FREQUENT, name: str | None = None) -> DataFrame:
    """df with token_ids; one narrow stage after the count."""
    name = name or prepare(df, text, vocabulary, frequent)
    small_batches(df.sparkSession)
    return df.withColumn("token_ids", encoder(name)(F.col(text).cast("string")))


def bpe_decode(df: DataFrame, name: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded, the text of its ids."""
    return df.withColumn("decoded", decoder(name)(F.col(ids).cast("array<int>")).cast("string"))
