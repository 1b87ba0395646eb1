import random

import numpy as np
import pyarrow as pa
import pytest

from sparkseek.llm import quality as Q


def naive(text, model):
    """One text at a time, n-gram by n-gram."""
    from sparkseek.llm.text import mix, word_hashes

    raw, codes = text.encode(), [int.from_bytes(c.encode(), "little") for c in text]
    z = model.intercept
    for kind, n in ((0, 3), (1, 4)):
        sums = [sum(c * m for c, m in zip(codes[i : i + n], (0x85EBCA6B, 0x9E3779B1, 0xC2B2AE35, 0x27D4EB2F))) % 2**32 for i in range(len(codes))]
        buckets = [((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> (32 - Q.BITS) if i + n <= len(codes) else 0 for i, h in enumerate(sums)]
        if buckets:
            z += np.mean([model.weights[kind][b] for b in buckets])
    words = [word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0] for w in raw.split()]
    if words:
        z += np.mean([model.weights[2][int(w) >> (64 - Q.BITS)] for w in words])
        pairs = [int(mix(np.array([(int(b) - int(a)) % 2**64], np.uint64))[0]) >> (64 - Q.BITS) for a, b in zip(words, words[1:])] + [0]
        z += np.mean([model.weights[3][p] for p in pairs])
    return 1 / (1 + np.exp(-(model.a * z + model.b))) if words else 0.0


def test_scoring_against_brute_force():
    rng = random.Random(3)
    model = Q.Model(np.random.default_rng(0).normal(size=(Q.KINDS, 1 << Q.BITS)), 0.3, 1.5, -0.2)
    texts = ["", "a", " ", "ab c", "é", None, *(" ".join(rng.choices(["the", "of", "été", "x!", "\n", "zz", "日本🙂"], k=rng.randint(1, 60))) for _ in range(60))]
    got = model.probabilities(pa.array(texts, pa.string()))
    assert got == pytest.approx([naive(t or "", model) for t in texts], abs=1e-9)
    assert got[10:] == pytest.approx(model.probabilities(pa.array(texts, pa.string())[10:]), abs=1e-12)


def test_held_out_accuracy(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = l.where("doc_id % 10 < 7")
    model = Q.train(d, train)
    got = Q.quality(d.join(l.where("doc_id % 10 >= 7"), "doc_id"), model).select("quality", "quality_keep", "quality_score").toPandas()
    good = got[got.quality == 1]
    assert good.quality_keep.mean() > 0.985
    assert (got.quality_keep == (got.quality == 1)).mean() > 0.96
    brier = ((got.quality_score - got.quality) ** 2).mean()
    assert brier < 0.05
    again = Q.train(d, train)
    assert np.array_equal(model.weights, again.weights)


def test_edges(spark):
    d = spark.createDataFrame([(1, None, 1), (1, "good words here", 1), (None, "x y", 0), (2, "", 0), (3, "bad!!! bad!!! " * 20_000, 0), (3, "bad!!! bad!!! " * 20_000, 0)], "doc_id long, text string, quality_score int")
    l = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(d, l)
    assert model.trained == 2  # doc 1's empty row and doc 3's repeat add nothing
    got = Q.quality(d, model)
    assert got.columns == ["doc_id", "text", "quality_score", "quality_keep"] and got.count() == 6
    by = {(r.doc_id, r.text and r.text[:1]): r for r in got.collect()}
    assert not by[1, None].quality_keep and not by[2, ""].quality_keep
    empty = Q.train(d, l.limit(0))
    assert Q.quality(d, empty).where("quality_keep").count() == 4
    assert Q.quality(d.limit(0), empty).count() == 0
    assert Q.train(d.limit(0), l).trained == 0
