"""Scores of blocks of vectors against blocks of queries, and the best of them: 32-bit sums, folded in element order like those of functions.vectors.

A tile's scores come from one matrix product, whose sums are in another order. Its error is bounded, so a product that falls short of the
query's k-th best score by more than that can't be a result; only the others are folded in order, and have the bits of the expressions. Tiles to
which the bound doesn't apply (NaN, infinite or tiny values), or of which too many remain, are folded as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sparkseek.config import Metric, Quantization

ROWS, QUERIES, PAIRS = 2048, 512, 8192  # of a tile; pairs that are folded at once

ONE, U = np.float32(1), 2.0**-24
LEAST, NAN = np.int32(-0x7F800000), np.int32(0x7FFFFFFF)  # places of negative infinity and of NaN in the order of scores


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """(rows, dimensions) 32-bit floats; a row of another length raises."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    other = np.flatnonzero(sizes != dimensions)
    if len(other):
        raise ValueError(f"expected {dimensions} components, got {sizes[other[0]]}")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a component is null")
    return flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), dimensions)


def order(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of 32-bit scores: NaN is greatest, both zeros are one."""
    b = (s + np.float32(0)).view(np.int32)
    return np.where(np.isnan(s), NAN, np.where(b < 0, -(b & NAN), b)).astype(np.int32)


def value(o: np.ndarray) -> np.ndarray:
    """The score of a place in the order."""
    b = o.astype(np.int32)
    return np.where(b < 0, -b | np.int32(-0x80000000), b).astype(np.int32).view(np.float32)


def fold(terms: np.ndarray) -> np.ndarray:
    """Sums along the first axis, in its order."""
    out = np.zeros(terms.shape[1:], np.float32)
    for t in terms:
        np.add(out, t, out=out)
    return out


def lengths(v: np.ndarray) -> np.ndarray:
    """32-bit lengths, as the expressions have them."""
    return np.sqrt(fold(np.ascontiguousarray((v * v).T)).astype(np.float64)).astype(np.float32)


@dataclass(frozen=True)
class Form:
    """How pairs are scored: prepared vectors by metric and quantization, or, exact, vectors as they are."""

    metric: Metric
    quantization: Quantization = Quantization.NONE
    exact: bool = False

    @property
    def ratio(self) -> bool:
        return self.exact and self.metric is Metric.COSINE

    def ended(self, out: np.ndarray, dimensions: int, scale, ql, vl) -> np.ndarray:
        """Scores of folded sums."""
        if self.metric is Metric.EUCLIDEAN:
            return -np.sqrt(out.astype(np.float64)).astype(np.float32)
        if self.quantization is Quantization.INT8:
            out = out * scale
        if self.ratio:
            n = ql * vl
            return np.where(n == 0, np.float32(0), (out.astype(np.float64) / np.where(n == 0, ONE, n)).astype(np.float32))
        if self.metric is Metric.COSINE:
            if self.quantization is Quantization.BINARY:
                out = out * np.float32(1.0 / np.sqrt(dimensions))
            out = ONE - (ONE - out)
        return out


class Side:
    """Queries, or vectors, with what products and bounds need. linear: rows whose products are scores, or for Euclidean distance half of
    the queries' squares less half of the squared distance."""

    def __init__(self, form: Form, v: np.ndarray, scale: np.ndarray | None = None, query: bool = False):
        with np.errstate(all="ignore"):
            if scale is not None and form.metric is Metric.EUCLIDEAN:
                v = v * scale[:, None]
            self.v, self.scale = v, scale
            self.lengths = lengths(v) if form.ratio else None
            norm = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
            if form.ratio:
                linear = v * (1 / np.where(norm == 0, 1, norm)).astype(np.float32)[:, None]
            elif form.metric is Metric.EUCLIDEAN:
                linear = np.concatenate([v, np.ones((len(v), 1), np.float32) if query else (-norm * norm / 2)[:, None].astype(np.float32)], axis=1)
            elif query or form.quantization is Quantization.NONE:
                linear = v
            elif form.quantization is Quantization.INT8:
                linear = v * scale[:, None]
                norm = norm * scale
            else:
                linear = v
                if form.metric is Metric.COSINE:
                    linear = v * np.float32(1.0 / np.sqrt(v.shape[1]))
                    norm = norm / np.sqrt(v.shape[1])
            self.linear, self.norm = linear, norm
            # of vectors as they are, the expressions' own lengths must be sound
            self.sound = np.isfinite(norm) & (norm < 1e15) & ((norm == 0) | (norm > 1e-12) | (not form.ratio))

    def __len__(self):
        return len(self.v)


def _dense(form: Form, q: Side, rows, v: Side, lo: int, hi: int) -> np.ndarray:
    """(rows, hi - lo) scores, all folded in order."""
    a, b = np.ascontiguousarray(q.v[rows].T), np.ascontiguousarray(v.v[lo:hi].T)
    out = np.zeros((a.shape[1], hi - lo), np.float32)
    step = np.empty_like(out)
    for x, y in zip(a, b):
        if form.metric is Metric.EUCLIDEAN:
            np.subtract(x[:, None], y, out=step)
            np.multiply(step, step, out=step)
        else:
            np.multiply(x[:, None], y, out=step)
        np.add(out, step, out=out)
    scale = None if v.scale is None else v.scale[None, lo:hi]
    return form.ended(out, len(a), scale, *((q.lengths[rows][:, None], v.lengths[None, lo:hi]) if form.ratio else (None, None)))


def pairs(form: Form, q: Side, r: np.ndarray, v: Side, c: np.ndarray) -> np.ndarray:
    """Scores of queries r with vectors c, folded in order."""
    out = np.empty(len(r), np.float32)
    with np.errstate(all="ignore"):
        for at in range(0, len(r), PAIRS):
            i, j = r[at : at + PAIRS], c[at : at + PAIRS]
            t = q.v[i]
            if form.metric is Metric.EUCLIDEAN:
                t -= v.v[j]
                t *= t
            else:
                t *= v.v[j]
            scale = None if v.scale is None else v.scale[j]
            out[at : at + PAIRS] = form.ended(fold(np.ascontiguousarray(t.T)), t.shape[1], scale, *((q.lengths[i], v.lengths[j]) if form.ratio else (None, None)))
    return out


def _bounds(form: Form, q: Side, rows, v: Side, lo: int, hi: int) -> np.ndarray | None:
    """How far a product may be from the score in its order, per query; None where there is no such bound."""
    norms = v.norm[lo:hi]
    if not (v.sound[lo:hi].all() and q.sound[rows].all()):
        return None
    d, a, b = q.v.shape[1], q.norm[rows], norms.max(initial=0)
    if form.ratio:
        return np.full(len(a), 16 * (d + 8) * U)
    if form.metric is Metric.EUCLIDEAN:
        return 4 * (d + 8) * U * (a + b) ** 2 + 1e-37
    return 4 * (d + 8) * U * a * b + (8 * U * (1 + a * b) if form.metric is Metric.COSINE else 0) + 1e-37


def _needed(form: Form, q: Side, rows, least: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Products under these are no scores of at least least."""
    s = least.astype(np.float64)
    if form.metric is Metric.EUCLIDEAN:
        s = (q.norm[rows] ** 2 - s * s) / 2
    return np.nextafter((s - bound).astype(np.float32), np.float32(-np.inf))


def candidates(form: Form, q: Side, rows: np.ndarray, v: Side, lo: int, hi: int, least: np.ndarray, k: int | None, before: np.ndarray | None = None):
    """(i, c, scores), queries rows[i], in their order and vectors lo <= c < hi in theirs: all scores that are at least least (in the order of
    scores), but, if k is given, maybe none but the k best of a query. before: c is less than before[i]."""
    cut = None if before is None or (before >= hi).all() else np.arange(lo, hi)[None, :] < before[:, None]
    with np.errstate(all="ignore"):
        bound = _bounds(form, q, rows, v, lo, hi)
        if bound is not None:
            s = q.linear[rows] @ v.linear[lo:hi].T
            need = _needed(form, q, rows, value(least), bound)
            if k is not None and (least == LEAST).any():
                if k < hi - lo:
                    t = s if cut is None else np.where(cut, s, np.float32(-np.inf))
                    kth = np.partition(t, hi - lo - k, axis=1)[:, hi - lo - k]
                    need = np.maximum(need, np.nextafter((kth.astype(np.float64) - 2 * bound).astype(np.float32), np.float32(-np.inf)))
            keep = s >= need[:, None]
            if cut is not None:
                keep &= cut
            at = np.flatnonzero(keep)
            if len(at) <= s.size // 8:
                i, c = np.divmod(at, hi - lo)
                found = pairs(form, q, rows[i], v, c + lo)
                keep = order(found) >= least[i]
                return i[keep], c[keep] + lo, found[keep]
        s = _dense(form, q, rows, v, lo, hi)
    keep = order(s) >= least[:, None]
    if cut is not None:
        keep &= cut
    i, c = np.nonzero(keep)
    return i, c + lo, s[i, c]


class Pool:
    """The k best of each of n queries: the greatest scores, of equal ones the first that are offered. floor: order of scores under which none counts."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.place, self.score = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
        self.floor = np.full(n, LEAST, np.int32) if floor is None else floor.copy()
        self.waiting: list[tuple] = []
        self.size = 0

    def offer(self, rows: np.ndarray, places: np.ndarray, scores: np.ndarray) -> None:
        """Places of a query must ascend from offer to offer."""
        self.waiting.append((rows, places, scores))
        self.size += len(rows)
        if self.size > max(self.k * len(self.floor) // 2, 1024):
            self.merge()

    def merge(self) -> None:
        if not self.size:
            self.waiting = []
            return
        n, k = len(self.floor), self.k
        had = np.arange(k)[None, :] < self.count[:, None]
        r = np.concatenate([np.nonzero(had)[0], *(w[0] for w in self.waiting)])
        c = np.concatenate([self.place[had], *(w[1] for w in self.waiting)])
        s = np.concatenate([self.score[had], *(w[2] for w in self.waiting)])
        self.waiting, self.size = [], 0
        at = np.argsort((r.astype(np.int64) << 32) + (int(NAN) - order(s).astype(np.int64)), kind="stable")
        r, c, s = r[at], c[at], s[at]
        counts = np.bincount(r, minlength=n)
        rank = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = rank < k
        r, rank = r[keep], rank[keep]
        self.place[r, rank], self.score[r, rank] = c[keep], s[keep]
        self.count = np.minimum(counts, k)
        full = self.count == k
        # another of the same score comes later, so that it isn't wanted
        last = order(self.score[full, k - 1])
        self.floor[full] = np.maximum(self.floor[full], last + (last < NAN))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score), the best first."""
        self.merge()
        had = np.arange(self.k)[None, :] < self.count[:, None]
        return np.nonzero(had)[0], self.place[had], self.score[had]


def _scan(pool: Pool, form: Form, q: Side, rows: np.ndarray, v: Side, lo: int, hi: int, before: np.ndarray | None, nan: bool) -> None:
    """Offers the pool, whose rows are those of rows, the vectors lo to hi for these queries."""
    own = np.arange(len(rows))
    for at in range(lo, hi, ROWS):
        end = min(at + ROWS, hi)
        if before is not None:
            own = np.flatnonzero(before > at)
        if not len(own):
            break
        i, c, s = candidates(form, q, rows[own], v, at, end, pool.floor[own], pool.k, None if before is None else before[own])
        if not nan and (bad := np.isnan(s)).any():
            i, c, s = i[~bad], c[~bad], s[~bad]
        pool.offer(own[i], c, s)


def ranked(held: list[pa.Table], k: int, ties: list[str]) -> pa.Table:
    """The k best rows of each q, by score, then ties, in this order, with their rank."""
    t = pa.concat_tables(held)
    t = t.append_column("order", pa.array(order(t["score"].to_numpy())))
    t = t.sort_by([("q", "ascending"), ("order", "descending"), *((c, "ascending") for c in ties)])
    q = t["q"].to_numpy()
    start = np.maximum.accumulate(np.where(np.diff(q, prepend=-1) != 0, np.arange(len(q)), 0)) if len(q) else q
    rank = np.arange(len(q)) - start
    return t.append_column("rank", pa.array(rank + 1, pa.int32())).filter(pa.array(rank < k)).drop_columns("order")


def floors(t: pa.Table, n: int, k: int) -> np.ndarray:
    """Of ranked rows, the order of each q's k-th score; LEAST where there are fewer."""
    out = np.full(n, LEAST, np.int32)
    last = t["rank"].to_numpy() == k
    out[t["q"].to_numpy()[last]] = order(t["score"].to_numpy()[last])
    return out


def taken(shared):
    """A broadcast's value, that the worker doesn't keep for later tasks."""
    out = shared.value
    if getattr(shared, "_path", None):
        shared.__dict__.pop("_value", None)
    return out


@dataclass(frozen=True)
class Search:
    """The k best vectors of each query of a task, as it meets one block of vectors after the other.

    Queries are (qid, q[, raw][, lists]), vectors (key, v[, scale][, raw][, list_id][, pos][, copy]). lists: only vectors of one of the query's lists
    count, those of the same copy once, at its least pos. before: only keys under the qid. again: the k best are scored by this form on raw, of which `kept` stay.
    Scores of equal order are told apart by ties. nan: NaN is the greatest score, not left out.
    """

    form: Form
    k: int
    dimensions: int
    ties: tuple[str, ...] = ("key",)
    lists: bool = False
    before: bool = False
    again: Form | None = None
    kept: int = 0
    nan: bool = False

    def _tiles(self, asked: pa.Table, block: pa.Table, at: int, end: int):
        """(queries, first and last vector, of each query the first vector that doesn't count)."""
        rows = np.arange(at, end)
        if self.lists:
            own = block["list_id"].combine_chunks().to_numpy(zero_copy_only=False)
            wanted = asked["lists"].slice(at, end - at).combine_chunks()
            who = np.repeat(rows, wanted.value_lengths().to_numpy(zero_copy_only=False))
            which = wanted.flatten().to_numpy(zero_copy_only=False)
            for x in np.unique(which):
                lo, hi = np.searchsorted(own, x), np.searchsorted(own, x, "right")
                if lo < hi:
                    yield who[which == x], int(lo), int(hi), None
        elif self.before:
            keys, qids = (c.to_numpy(zero_copy_only=False) for c in (block["key"].combine_chunks(), asked["qid"].slice(at, end - at).combine_chunks()))
            yield rows, 0, len(block), np.searchsorted(keys, qids)
        else:
            yield rows, 0, len(block), None

    def _side(self, t: pa.Table, column: str, form: Form, query: bool) -> Side:
        scale = t["scale"].to_numpy().astype(np.float32) if "scale" in t.column_names and column == "v" else None
        return Side(form, matrix(t[column].combine_chunks(), self.dimensions), scale, query)

    def sorted(self, block: pa.Table) -> pa.Table:
        return block.sort_by([(c, "ascending") for c in (("list_id",) if self.lists else ()) + self.ties]).combine_chunks()

    def found(self, asked: pa.Table, block: pa.Table, floor: np.ndarray) -> pa.Table:
        """(q, ties, score[, exact]) of a sorted block; floor: of each query, the order of scores under which none counts."""
        v, floor, rows, places, scores = self._side(block, "v", self.form, False), floor.copy(), [], [], []
        copies = block["copy"].to_numpy() if "copy" in block.column_names else None
        once = copies is None or len(np.unique(copies)) == len(copies)
        for at in range(0, len(asked), QUERIES):
            end = min(at + QUERIES, len(asked))
            q = self._side(asked.slice(at, end - at), "q", self.form, True)
            for who, lo, hi, before in self._tiles(asked, block, at, end):
                pool = Pool(len(who), self.k, floor[who])
                # the pool's rows are those of who, the side's those from at
                _scan(pool, self.form, q, who - at, v, lo, hi, before, self.nan)
                i, c, s = pool.rows()
                full = pool.count == self.k
                floor[who[full]] = np.maximum(floor[who[full]], order(pool.score[full, self.k - 1]))
                rows.append(who[i])
                places.append(c)
                scores.append(s)
        r, c, s = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (places, np.int64), (scores, np.float32)))
        if not once:
            position = block["pos"].to_numpy()[c] if "pos" in block.column_names else c
            at = np.lexsort((position, copies[c], r))
            at = at[(np.diff(r[at], prepend=-1) != 0) | (np.diff(copies[c[at]], prepend=-1) != 0)]
            r, c, s = r[at], c[at], s[at]
        out = {"q": asked["q#"].to_numpy()[r], **{n: block[n].take(pa.array(c)) for n in dict.fromkeys((*self.ties, "key"))}, "score": pa.array(s, pa.float32())}
        if self.again:
            one, other = self._side(asked, "raw", self.again, True), self._side(block, "raw", self.again, False)
            out["exact"] = pa.array(pairs(self.again, one, r, other, c), pa.float32())
        return pa.table(out)

    def _numbered(self, asked: pa.Table) -> tuple[pa.Table, pa.Array]:
        """Queries with a number of their qid, and the qids of the numbers."""
        own = asked["qid"].combine_chunks().dictionary_encode("encode")
        return asked.append_column("q#", own.indices.cast(pa.int64())), own.dictionary

    def by_queries(self, blocks: list):
        """For mapInArrow over all queries of a qid: (qid, key, score, rank), done. blocks: broadcasts of sorted blocks."""

        def run(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            asked, qids = self._numbered(pa.Table.from_batches(held).combine_chunks())
            number, floor, t = asked["q#"].to_numpy(), np.full(len(asked), LEAST, np.int32), None
            for shared in blocks:
                found = self.found(asked, taken(shared), floor)
                t = ranked([found] if t is None else [t.drop_columns("rank"), found], self.k, list(self.ties))
                floor = floors(t, len(qids), self.k)[number]
            if self.again:
                t = t.rename_columns([{"score": "code", "exact": "score", "rank": "pos"}.get(c, c) for c in t.column_names])
                t = ranked([t], self.kept, ["pos"])
            yield from pa.table({"qid": qids.take(t["q"].combine_chunks()), "key": t["key"], "score": t["score"], "rank": t["rank"]}).to_batches()

        return run

    def by_vectors(self, queries):
        """For mapInArrow over vectors: (qid, key, score[, exact]), the k best of each query in the task. queries: a broadcast of all."""

        def run(batches):
            asked, qids = self._numbered(queries.value)
            number, floor, t = asked["q#"].to_numpy(), np.full(len(asked), LEAST, np.int32), None
            for b in batches:
                found = self.found(asked, self.sorted(pa.Table.from_batches([b])), floor)
                t = ranked([found] if t is None else [t.drop_columns("rank"), found], self.k, list(self.ties))
                floor = floors(t, len(qids), self.k)[number]
            if t is not None:
                yield from pa.table({"qid": qids.take(t["q"].combine_chunks()), **{c: t[c] for c in ("key", "score", "exact") if c in t.column_names}}).to_batches()

        return run


def above(form: Form, dimensions: int, least: float, blocks: list):
    """For mapInArrow over (qid, q): (key, other, score) of all keys under other, the qid, with a score of at least least; NaN is. blocks: as in Search."""
    search = Search(form, 1, dimensions, before=True)

    def run(batches):
        for b in batches:
            asked = pa.Table.from_batches([b])
            for shared in blocks:
                block = taken(shared)
                v = search._side(block, "v", form, False)
                for at in range(0, len(asked), QUERIES):
                    end = min(at + QUERIES, len(asked))
                    q = search._side(asked.slice(at, end - at), "q", form, True)
                    for who, lo, hi, before in search._tiles(asked, block, at, end):
                        for j in range(lo, hi, ROWS):
                            if not (open_ := before > j).any():
                                break
                            rows = who[open_]
                            i, c, s = candidates(form, q, rows - at, v, j, min(j + ROWS, hi), np.full(len(rows), order(np.float32([least]))[0]), None, before[open_])
                            if len(i):
                                yield from pa.table({"key": block["key"].take(pa.array(c)), "other": asked["qid"].take(pa.array(rows[i])), "score": pa.array(s, pa.float32())}).to_batches()

    return run
