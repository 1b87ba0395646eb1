"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

Features of a text, each hashed into 2**BITS buckets and counted as a share of its kind within the text:
character 3-grams and 4-grams, words, and pairs of neighbouring words.  A pair is hashed by the *difference* of its words,
so that an immediate repetition falls into one bucket whatever the word is.

Training reads at most `max_rows` labelled documents, those with the least hash of their id (a documented bound; all
else covers all rows), and fits an L2-regularised logistic regression by full-batch Adam; a fifth of those rows is kept back for
Platt scaling.  Scoring is a narrow Arrow stage: hash, look up weights, sum by row.

Defined results: null, empty and blank texts have probability 0 and are rejected; a text of any length is scored whole;
a doc_id labelled more than once counts with its least label, and one that occurs on several rows trains with each distinct text; with no
labels of both classes the model keeps every text that has a word (probability 1); repeated rows each get their own, equal result;
other columns are kept and columns of the operator's names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hidden, small_batches
from .text import lean, mix, parts, release, segment_sums, utf8, word_hashes

BITS, MAX_ROWS, KEEP = 16, 3000, 0.5
KINDS = 4
AT_ONCE = 1 << 18  # features that training works on at once


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each UTF-8 character as one number, and the rows' offsets into them."""
    first = (data & 0xC0) != 0x80
    first[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(first)
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    code, more = data[at].astype(np.uint32), np.ones(len(at), bool)
    if len(at) < len(data):
        size = np.diff(np.append(at, len(data)))
        for k in (1, 2, 3):
            more = size > k
            code[more] |= wide[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return code, np.concatenate([[0], np.cumsum(first)])[off]


def features(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the buckets of all its n-grams in row order, and the rows' offsets into them."""
    out = []
    code, at = characters(data, off)
    n = len(code)
    c = np.concatenate([code, np.zeros(3, np.uint32)])
    three = c[:n] * np.uint32(0x85EBCA6B) + c[1 : n + 1] * np.uint32(0x9E3779B1) + c[2 : n + 2] * np.uint32(0xC2B2AE35)
    for size, h in ((3, three), (4, three + c[3 : n + 3] * np.uint32(0x27D4EB2F))):
        # the n-grams that would leave their row fall into bucket 0 of their kind
        h ^= h >> np.uint32(15)
        bucket = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        for k in range(1, size):
            last = at[1:] - k
            bucket[last[last >= at[:-1]]] = 0
        out.append((bucket, at))
    words, _, _, rows = word_hashes(data, off)
    shift = np.uint64(64 - BITS)
    out.append(((words >> shift).astype(np.uint32), rows))
    pair = (mix(words[1:] - words[:-1]) >> shift).astype(np.uint32) if len(words) else np.zeros(0, np.uint32)
    pair = np.append(pair, np.uint32(0)) if len(words) else pair
    last = rows[1:][rows[1:] > rows[:-1]] - 1
    pair[last] = 0
    out.append((pair, rows))
    return out


@dataclass(frozen=True)
class Model:
    """Weights by kind and bucket, intercept, and the calibration p = sigmoid(a * z + b)."""

    weights: np.ndarray
    intercept: float
    a: float = 1.0
    b: float = 0.0
    trained: int = 0

    def margins(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The linear score of each row, and whether it has a word."""
        data, off = utf8(column)
        z, some = np.full(len(off) - 1, self.intercept), np.zeros(len(off) - 1, bool)
        for i, j, d, o in parts(data, off, 1 << 18):
            for kind, (bucket, rows) in enumerate(features(d, o)):
                n = np.diff(rows)
                z[i:j] += segment_sums(self.weights[kind][bucket], rows) / np.maximum(n, 1)
                some[i:j] = n > 0  # the last kind goes by words
        return z, some

    def probabilities(self, column: pa.Array) -> np.ndarray:
        z, some = self.margins(column)
        return np.where(some, _sigmoid(self.a * z + self.b), 0.0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _sparse(column: pa.Array) -> pa.Array:
    """Distinct features of each row (kind and bucket in one number) and their shares."""
    data, off = utf8(column)
    keys, shares = [], []
    for _, _, d, o in parts(data, off):
        every = features(d, o)
        for r in range(len(o) - 1):
            ks, vs = [], []
            for kind, (bucket, rows) in enumerate(every):
                own = bucket[rows[r] : rows[r + 1]]
                if len(own):
                    k, c = np.unique(own, return_counts=True)
                    ks.append(k.astype(np.int32) + (kind << BITS))
                    vs.append((c / len(own)).astype(np.float32))
            keys.append(np.concatenate(ks) if ks else np.zeros(0, np.int32))
            shares.append(np.concatenate(vs) if vs else np.zeros(0, np.float32))
    return pa.StructArray.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["k", "v"])


def fit(keys: np.ndarray, shares: np.ndarray, off: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.05, l2: float = 1e-6) -> Model:
    """Full-batch Adam on the training four fifths of `rows`, Platt scaling on the rest; rows in a fixed order give a fixed model.
    The features of row i are keys[off[i]:off[i + 1]]; y is by place in rows. Gradients are summed AT_ONCE features at a time."""
    size = KINDS << BITS
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((KINDS, 1 << BITS)), 0.0, 0.0, 40.0, len(y))
    back = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[back])) < 2 or len(np.unique(y[~back])) < 2:
        back[:] = False

    def portions(which: np.ndarray) -> list[tuple]:
        """(features, shares, first feature of each row, places in which) by rows that have some."""
        own = rows[which]
        n = off[own + 1] - off[own]
        cut = np.flatnonzero(np.diff(np.cumsum(n) // AT_ONCE)) + 1
        out = []
        for part in np.split(np.arange(len(own)), cut):
            part = part[n[part] > 0]
            if len(part):
                at = [slice(off[i], off[i + 1]) for i in own[part]]
                out.append((np.concatenate([keys[a] for a in at]), np.concatenate([shares[a] for a in at]).astype(np.float32), np.cumsum(n[part]) - n[part], n[part], part))
        return out

    train, target = portions(~back), y[~back]
    squares = np.zeros(size)
    for k, v, _, _, _ in train:
        squares += np.bincount(k, v.astype(np.float64) ** 2, size)
    scale = 1e-3 / (np.sqrt(squares / len(target)) + 1e-3)  # features that vary little learn slowly
    for k, v, _, _, _ in train:
        v /= scale[k].astype(np.float32)
    w, c = np.zeros(size), 0.0
    m, s, mc, sc = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-9), 0.5 / max(1 - target.mean(), 1e-9))
    for t in range(1, rounds + 1):
        gw, gc, narrow = l2 * w, 0.0, w.astype(np.float32)
        for k, v, first, n, part in train:
            p = _sigmoid(np.add.reduceat(v * narrow[k], first, dtype=np.float64) + c)
            g = weight[part] * (p - target[part]) / len(target)
            gw += np.bincount(k, v * np.repeat(g.astype(np.float32), n), size)
            gc += g.sum()
        m, s, mc, sc = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw**2, 0.9 * mc + 0.1 * gc, 0.99 * sc + 0.01 * gc**2
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / fix) / (np.sqrt(s / fix2) + 1e-9)
        c -= rate * (mc / fix) / (np.sqrt(sc / fix2) + 1e-9)
    w /= scale
    del train
    a, b = 1.0, 0.0
    if back.any():
        z = np.full(int(back.sum()), c)
        for k, v, first, _, part in portions(back):
            z[part] += np.add.reduceat(v * w[k], first)
        a, b = platt(z, y[back])
    return Model(w.reshape(KINDS, -1), c, a, b, len(y))


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Newton's method for a and b, with Platt's smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    target, scale = np.where(y == 1, hi, lo), float(np.std(z)) or 1.0
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(rounds):
        p = _sigmoid(a * x + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * x).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return a / scale, b


def train(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS, **options) -> Model:
    """The ids are chosen among the labels alone; at most max_rows of them reach the driver and filter the documents' scan."""
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("y"))
    own = own.withColumn("h", F.xxhash64(F.col(key).cast("string"))).orderBy("h", key).limit(max_rows)
    chosen = {r[key]: r["y"] for r in own.collect()}
    if not chosen:
        return fit(*(np.zeros(0, int) for _ in range(5)))
    spark = documents.sparkSession
    small_batches(spark)
    ids = spark.createDataFrame(list(chosen.items()), f"`{key}` {dict(labels.dtypes)[key]}, y int")
    texts = documents.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), key).where(F.length(F.trim("text")) > 0).withColumn("f", F.arrow_udf(lean(_sparse), "struct<k:array<int>,v:array<float>>")("text"))
    got = rows.select(F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).alias("key"), F.xxhash64("text").alias("x"), "y", "f.k", "f.v").toArrow()
    order = pa.table({"h": got["h"], "key": got["key"], "x": got["x"], "i": pa.array(np.arange(len(got)))}).sort_by([("h", "ascending"), ("key", "ascending"), ("x", "ascending")])
    h, x, i, y = order["h"].to_numpy(), order["x"].to_numpy(), order["i"].to_numpy(), got["y"].to_numpy()
    once = i[(np.diff(h, prepend=h[:1] - 1) != 0) | (np.diff(x, prepend=x[:1] - 1) != 0)] if len(i) else i
    keys, shares = got["k"].combine_chunks(), got["v"].combine_chunks()
    del got
    release()
    model = fit(keys.values.to_numpy(), shares.values.to_numpy(), keys.offsets.to_numpy().astype(np.int64), once, y[once].astype(float), **options)
    del keys, shares
    release()
    return model


def quality(df: DataFrame, model: Model, text: str = "text", keep: float = KEEP) -> DataFrame:
    """df with quality_score, the calibrated probability of good quality, and quality_keep; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS

    def score(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.probabilities(column))

    small_batches(df.sparkSession)
    name = hidden(df, "p")
    p = df.withColumn(name, F.arrow_udf(lean(score), "double")(F.col(text).cast("string")))
    return p.withColumns({"quality_score": F.round(name, 6), "quality_keep": F.col(name) >= F.lit(keep)}).drop(name)
