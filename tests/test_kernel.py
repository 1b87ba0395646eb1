"""Bounded products, blocks of vectors and what they exchange."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.config import Metric, Quantization
from sparkseek.operators import kernel, knn

F32 = np.float32
FORMS = [kernel.Form(m, q) for m in Metric for q in Quantization] + [kernel.Form(m, exact=True) for m in Metric]


def sides(form, q, v):
    scale = np.linspace(0.5, 2, len(v)).astype(F32) if form.quantization is Quantization.INT8 else None
    v = np.sign(v) if form.quantization is Quantization.BINARY else np.round(v * 50) if scale is not None else v
    if form.metric is Metric.COSINE and not form.exact:
        q = q / np.linalg.norm(q, axis=1)[:, None]
        v = v / np.linalg.norm(v, axis=1)[:, None] if form.quantization is Quantization.NONE else v
    return kernel.Side(form, q.astype(F32), query=True), kernel.Side(form, v.astype(F32), scale)


@pytest.mark.parametrize("form", FORMS)
def test_few_pairs_are_folded_and_none_is_lost(form, monkeypatch):
    rng = np.random.default_rng(3)
    q, v = sides(form, rng.normal(size=(40, 64)), np.tile(rng.normal(size=(2500, 64)), (2, 1)))
    s = kernel._dense(form, q, np.arange(40), v, 0, 5000)
    want = [np.lexsort((np.arange(5000), -x))[:7].tolist() for x in s]
    folded, pairs = [], kernel.pairs
    monkeypatch.setattr(kernel, "pairs", lambda f, a, r, b, c: folded.append(len(r)) or pairs(f, a, r, b, c))
    pool = kernel.Pool(40, 7)
    kernel._scan(pool, form, q, np.arange(40), v, 0, 5000, None, False)
    r, c, got = pool.rows()
    assert [c[r == i].tolist() for i in range(40)] == want and got.tobytes() == np.take_along_axis(s, np.array(want), 1).tobytes()
    assert sum(folded) < 40 * 5000 / 50


@pytest.mark.parametrize("form", [kernel.Form(Metric.DOT), kernel.Form(Metric.EUCLIDEAN), kernel.Form(Metric.COSINE, exact=True)])
def test_values_without_a_bound(form):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8)).astype(F32)
    v[::7] *= F32(1e-22)
    v[3], v[5, 0], v[8, 1], v[11] = 0, np.nan, np.inf, 1e30
    a, b = kernel.Side(form, v[:50], query=True), kernel.Side(form, v)
    with np.errstate(all="ignore"):
        s = kernel._dense(form, a, np.arange(50), b, 0, 300)
    for nan in (False, True):
        pool = kernel.Pool(50, 5)
        kernel._scan(pool, form, a, np.arange(50), b, 0, 300, None, nan)
        r, c, _ = pool.rows()
        for i in range(50):
            o = kernel.order(s[i])
            keep = np.flatnonzero(nan | ~np.isnan(s[i]))
            assert c[r == i].tolist() == keep[np.lexsort((keep, -o[keep].astype(np.int64)))][:5].tolist()


def test_many_queries_exchange_no_results(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 16)))], "key int, vector array<float>").repartition(4)  # the other exchange
    q = v.select(F.col("key").alias("qid"), F.col("vector").alias("query"))
    few = [knn.nearest(v, q, 9).collect(), knn.two_phase(v, q, 5, 40).collect()]
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", 50)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 5000)
    many = [knn.nearest(v, q, 9), knn.two_phase(v, q, 5, 40)]
    for a, b in zip(few, many):
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 2 and "hashpartitioning" not in plan and "Window" not in plan and "Join" not in plan
        assert sorted(a) == sorted(b.select(*a[0].__fields__).collect())
