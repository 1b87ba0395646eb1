"""Sorted runs of byte strings: front coding, and merging by a loser tree that knows common prefixes.

The tree keeps for each run's head the length of its common prefix with the last string given out.  Of two heads the one
with the longer such prefix is the lesser; only at equal lengths are bytes compared, and only from there on, so no byte of a
known prefix is looked at again (Bingmann, Eberle and Sanders, 2017).
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np


def pack(*value, level: int = 3) -> bytes:
    """A block for an exchange."""
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, 5))


def unpack(block: bytes) -> tuple:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(block))


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, given that they agree before `at`."""
    n = min(len(a), len(b))
    step = 32
    while at < n:
        if a[at : at + step] == b[at : at + step]:
            at += step
            step *= 4
        elif step <= 8:
            while at < n and a[at] == b[at]:
                at += 1
            return at
        else:
            step = step // 4
    return min(at, n)


def front_code(strings: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """Of sorted strings: common prefix with the one before, the rests in one piece, and the rests' lengths."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = common_prefix(before, s)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return shared, b"".join(rests), [len(r) for r in rests]


def front_decode(shared: list[int], rests: bytes, lengths: list[int]) -> list[bytes]:
    out, before, at = [], b"", 0
    for n, size in zip(shared, lengths):
        before = before[:n] + rests[at : at + size]
        at += size
        out.append(before)
    return out


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """Merges runs of (prefixes shared with the string before, sorted strings). Yields in order (prefix shared with the
    string given out before, run, place in the run); of equal strings the one of the earlier run comes first."""
    width = 1
    while width < len(runs):
        width *= 2
    shared = [r[0] for r in runs] + [[]] * (width - len(runs))
    strings = [r[1] for r in runs] + [[]] * (width - len(runs))
    sizes = [len(s) for s in strings]
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    known, place = [0] * width, [0] * width

    def lesser(a: int, b: int) -> bool:
        """Whether a's head comes first; leaves in `known` of the other its prefix with that head."""
        x, y = head[a], head[b]
        if y is None:
            return x is not None or a < b
        if x is None:
            return False
        p, q = known[a], known[b]
        if p != q:
            return p > q
        n = common_prefix(x, y, p)
        if n == len(x) and n == len(y):
            first = a < b
        else:
            first = n == len(x) or n < len(y) and x[n] < y[n]
        known[b if first else a] = n
        return first

    tree, winners = [0] * width, list(range(width))
    level = width
    while level > 1:
        level //= 2
        won = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            first = lesser(a, b)
            tree[level + i] = b if first else a
            won.append(a if first else b)
        winners = won
    top = winners[0]
    while head[top] is not None:
        at = place[top]
        yield known[top], top, at
        at += 1
        place[top] = at
        if at < sizes[top]:
            head[top], known[top] = strings[top][at], shared[top][at]
        else:
            head[top] = None
        node = (width + top) // 2
        while node:
            other = tree[node]
            if not lesser(top, other):
                tree[node], top = top, other
            node //= 2


def splits(keys: np.ndarray, cuts: list[int]) -> np.ndarray:
    """The range, 0 to len(cuts), of each key."""
    return np.searchsorted(np.array(cuts, np.uint64), keys, "right")


def heads(strings: list[bytes]) -> np.ndarray:
    """The first eight bytes of each string as a number that sorts like them."""
    return np.frombuffer(b"".join(s[:8].ljust(8, b"\0") for s in strings), ">u8").astype(np.uint64)


def spans(strings: list[bytes], cuts: list[int]) -> list[tuple[int, int, int]]:
    """(range, first, end) of each range that occurs in sorted strings."""
    which = splits(heads(strings), cuts).tolist()
    out, at = [], 0
    while at < len(which):
        end = bisect_left(which, which[at] + 1, at)
        out.append((which[at], at, end))
        at = end
    return out
