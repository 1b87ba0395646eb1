"""Edit distance of word sequences within a band, many pairs at a time."""

from __future__ import annotations

import numpy as np

BATCH_CELLS = 1 << 15
FAR = 1 << 28


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the multiset intersection."""
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(cx[i], cy[j]).sum())


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common prefix and suffix, which no best alignment needs to touch."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    p = int(differ[0]) if len(differ) else n
    a, b, n = a[p:], b[p:], n - p
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    s = int(differ[0]) if len(differ) else n
    return a[: len(a) - s], b[: len(b) - s]


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], widths: np.ndarray) -> np.ndarray:
    """For each pair the least cost of the alignments within `width` of the main diagonal: an upper bound of the
    edit distance, and the edit distance itself where it is at most the width."""
    out = np.full(len(pairs), FAR, np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (widths[i], len(pairs[i][0])))
    at = 0
    while at < len(order):
        w = int(widths[order[at]])
        size = 2 * w + 1
        count = max(1, BATCH_CELLS // size)
        own = [i for i in order[at : at + count] if widths[i] == w]
        at += len(own)
        n = np.array([len(pairs[i][0]) for i in own])
        m = np.array([len(pairs[i][1]) for i in own])
        rows, cols = int(n.max()), int(max(n.max(), m.max()))
        a = np.zeros((len(own), max(rows, 1)), np.uint64)
        b = np.ones((len(own), cols + 2 * w + 2), np.uint64)
        inside = np.zeros((len(own), cols + 2 * w + 2), bool)
        for r, i in enumerate(own):
            a[r, : n[r]] = pairs[i][0]
            b[r, w + 1 : w + 1 + m[r]] = pairs[i][1]
            inside[r, w : w + 1 + m[r]] = True
        d = np.arange(size, dtype=np.int32)
        # cell d of row i stands for column i + d - w
        row = np.where(inside[:, :size], np.maximum(d - w, 0), FAR).astype(np.int32)
        row[:, :w] = FAR
        last = m - n + w
        reach = (last >= 0) & (last < size)
        ended = np.flatnonzero((n == 0) & reach)
        out[[own[r] for r in ended]] = row[ended, last[ended]]
        by_end = np.argsort(n, kind="stable")
        done = int(np.searchsorted(n[by_end], 0, "right"))
        for i in range(1, rows + 1):
            step = row + (a[:, i - 1 : i] != b[:, i : i + size])
            step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + 1)
            step[~inside[:, i : i + size]] = FAR
            step -= d
            np.minimum.accumulate(step, axis=1, out=step)
            step += d
            row = step
            while done < len(own) and n[by_end[done]] == i:
                r = by_end[done]
                if reach[r]:
                    out[own[r]] = row[r, last[r]]
                done += 1
    return out


def within(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float, narrow: int = 24) -> np.ndarray:
    """Whether 1 - distance / longer length >= similarity, for each pair of word sequences. Exact: a narrow band accepts,
    only bounds that always hold and the full band reject."""
    ok = np.zeros(len(pairs), bool)
    most = np.array([int(np.floor((1 - similarity) * max(len(a), len(b)) + 1e-9)) for a, b in pairs])
    left: list[int] = []
    cut: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most[i]:
            continue
        x, y = trimmed(a, b)
        if max(len(x), len(y)) <= most[i]:
            ok[i] = True
        elif max(len(x), len(y)) - common(x, y) <= most[i]:
            left.append(i)
            cut[i] = (x, y)
    for full in (False, True):
        if not left:
            break
        gaps = np.array([abs(len(cut[i][0]) - len(cut[i][1])) for i in left])
        limit = most[left]
        widths = limit if full else np.minimum(limit, -(-(gaps + narrow) // narrow) * narrow)
        found = banded([cut[i] for i in left], widths) <= limit
        ok[np.array(left)[found]] = True
        settled = found | (widths >= limit)
        left = [i for i, s in zip(left, settled) if not s]
    return ok
