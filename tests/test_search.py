"""Vectors, text, fusion and their predicates against brute force and known cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.config import Bm25Config, GraphConfig, Metric, Quantization
from sparkseek.functions import analyze as A
from sparkseek.functions import vectors as V
from sparkseek.functions.filters import attr_eq, attr_in, attr_ne
from sparkseek.operators import ann, bm25, fusion, knn

F32 = np.float32


def clustered(dim, jitter, seed, clusters=20, size=75, queries=40):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-1, 1, (clusters, dim))
    data = (np.repeat(centers, size, axis=0) + rng.uniform(-jitter, jitter, (clusters * size, dim))).astype(F32)
    asked = (centers[rng.integers(0, clusters, queries)] + rng.uniform(-jitter, jitter, (queries, dim))).astype(F32)
    return data, asked


def frames(spark, data, asked):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(data)], "key int, vector array<float>")
    return v.repartition(4), spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "qid int, query array<float>")


def hits(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.key)
    return out


def recall(got, exact):
    return sum(len(set(got.get(q, [])) & set(e)) for q, e in exact.items()) / sum(map(len, exact.values()))


def exact_keys(data, asked, k, metric=Metric.COSINE):
    if metric is Metric.COSINE:
        s = (asked / np.linalg.norm(asked, axis=1)[:, None]) @ (data / np.linalg.norm(data, axis=1)[:, None]).T
    elif metric is Metric.DOT:
        s = asked @ data.T
    else:
        s = -np.linalg.norm(asked[:, None] - data[None], axis=2)
    return {i: np.argsort(-s[i], kind="stable")[:k].tolist() for i in range(len(asked))}


@pytest.mark.parametrize("metric", list(Metric))
def test_nearest_is_exact(spark, metric):
    data, asked = clustered(16, 0.3, 1, 10, 20, 15)
    v, q = frames(spark, data, asked)
    assert recall(hits(knn.nearest(v, q, 10, metric)), exact_keys(data, asked, 10, metric)) == 1
    one = [r.key for r in knn.search(v, asked[0].tolist(), 5, metric).collect()]
    assert one == exact_keys(data, asked, 5, metric)[0]


def test_quantized_and_two_phase_recall(spark):
    data, asked = clustered(48, 0.12, 3, queries=300)  # int8 codes have a recall of 0.82 or so here, less noise of few queries
    v, q = frames(spark, data, asked)
    exact = exact_keys(data, asked, 10)
    assert recall(hits(knn.nearest(v, q, 10, quantization=Quantization.INT8)), exact) >= 0.8
    plain = recall(hits(knn.nearest(v, q, 10, quantization=Quantization.BINARY)), exact)
    both = recall(hits(knn.two_phase(v, q, 10, 100)), exact)
    assert both >= 0.9 and both > plain + 0.2


def test_approximate_recall(spark):
    data, asked = clustered(48, 0.12, 3, queries=30)
    v, q = frames(spark, data, asked)
    exact = exact_keys(data, asked, 10)
    centers = ann.centroids(v, 16)
    assert recall(hits(ann.ivf_search(ann.ivf_index(v, centers), centers, q, 10, 4)), exact) >= 0.9
    assert recall(hits(ann.ivf_search(ann.ivf_index(v, centers), centers, q, 10, 16)), exact) == 1
    got = hits(ann.graph_search(v, q, 10, shards=2, ef=128))
    assert recall(got, exact) >= 0.9
    assert got == hits(ann.graph_search(v, q, 10, shards=2, ef=128))
    even = hits(ann.graph_search(v.withColumn("ok", F.col("key") % 2 == 0), q, 10, shards=2, accept="ok"))
    assert all(len(k) == 10 and all(x % 2 == 0 for x in k) for k in even.values())


def test_scores_by_hand(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    r = rows.select(V.normalized(a), V.normalized(z), V.exact_score(a, b, Metric.COSINE), V.exact_score(a, z, Metric.COSINE), V.score(a, b, Metric.EUCLIDEAN), V.score(a, b, Metric.DOT)).first()
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0, 0]
    assert [r[2], r[3], r[4], r[5]] == pytest.approx([0.6, 0, -math.sqrt(20), 3])


def test_codes(spark):
    v = [1.0, -0.5, 0.5 / 127, -0.5 / 127, 0.0]
    r = spark.createDataFrame([(v, [0.0, 0.0])], "v array<float>, z array<float>").select(V.int8_codes(F.col("v")), V.int8_scale(F.col("v")), V.int8_codes(F.col("z")), V.int8_scale(F.col("z"))).first()
    assert r[0][:2] == [127, -63] and r[2] == [0, 0] and r[3] == 1 and r[1] == pytest.approx(1 / 127)
    rng = np.random.default_rng(5)
    data = rng.uniform(-1, 1, (20, 70)).astype(F32)
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(data, data[::-1])], "a array<float>, b array<float>")
    bits = [V.bits(F.col(c), 70) for c in "ab"]
    got = df.select(V.hamming(*bits), V.binary_code_score(*bits, 70, Metric.DOT), V.binary_code_score(*bits, 70, Metric.COSINE), V.binary_code_score(*bits, 70, Metric.EUCLIDEAN)).collect()
    for (x, y), r in zip(zip(data, data[::-1]), got):
        h = int(((x >= 0) != (y >= 0)).sum())
        assert list(r) == pytest.approx([h, 70 - 2 * h, 1 - 2 * h / 70, -math.sqrt(4 * h)], abs=1e-6)
    assert [V.vector_bytes(512, q) for q in Quantization] == [2048, 516, 64]


def test_filters_fill_k_and_are_never_null(spark):
    rows = [(i, [math.cos(i), math.sin(i)], {"type": "ab"[i % 2]} if i % 5 else None) for i in range(60)]
    v = spark.createDataFrame(rows, "key int, vector array<float>, attributes map<string,string>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, query array<float>")
    got = knn.nearest(v, q, 10, where=attr_eq("type", "a")).collect()
    assert len(got) == 10 and all(r.key % 2 == 0 and r.key % 5 for r in got)
    assert knn.nearest(v, q, 100, where=attr_ne("type", "a")).count() == 36 and v.where(~attr_in("type", ["a", "b"])).count() == 12


def test_rerank(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.9, 0.1, 0.0])], "key string, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "qid int, query array<float>")
    ask = lambda keys: spark.createDataFrame([(0, k, i) for i, k in enumerate(keys)], "qid int, key string, pos int")
    rows = knn.rerank(ask(["b", "c", "a"]), v, q, 3).orderBy("rank").collect()
    assert [r.key for r in rows] == ["a", "c", "b"] and [r.score for r in rows] == pytest.approx([1, 0.9938837, 0])
    assert hits(knn.rerank(ask(["a", "a", "missing", "b"]), v, q, 9)) == {0: ["a", "b"]}
    with pytest.raises(Exception, match="length"):
        knn.rerank(ask(["a"]), v, q.withColumn("query", F.array(F.lit(1.0).cast("float"))), 1).collect()


def test_validation(spark):
    v = spark.createDataFrame([(1, [1.0])], "key int, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "qid int, query array<float>")
    for bad in (lambda: knn.nearest(v, q, 0), lambda: knn.search(v, [1.0], 0), lambda: GraphConfig(m=1), lambda: Bm25Config(b=2), lambda: Bm25Config(k1=-1), lambda: fusion.fuse(v, 0), lambda: fusion.fuse(v, 1, 0), lambda: A.ngrams(0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="expected 2"):
        knn.search(v, [1.0, 2.0], 1).collect()


def terms(spark, analyzer, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(analyzer(F.col("text"))).collect()]


def test_analyzers(spark):
    words = "cats boxes studies walked quickly run ties classes houses churches running string needs glass fixings"
    assert terms(spark, A.standard(stemmer=A.light_stem), words)[0] == "cat box study walk quick run tie class hous church runn str need glass fix".split()
    assert terms(spark, A.standard(A.ENGLISH), "the cat and the dog", "", None) == [["cat", "dog"], [], []]
    assert terms(spark, A.standard(min_length=3), "a bc def") == [["def"]]
    assert terms(spark, A.ngrams(3), "hello", "ab", "x abcd") == [["hel", "ell", "llo"], ["ab"], ["x", "abc", "bcd"]]
    assert terms(spark, A.ngrams(2), "本語") == [["本語"]]
    assert terms(spark, A.standard(), "İΣ ΟΔΟΣ a🙂b 𝐀b") == [["iσ", "οδοσ", "a", "b", "b"]]
    assert terms(spark, A.basic_tokens, "Hello, world.") == [["hello", ",", "world", "."]]


def searched(spark, docs, text, k=10, **options):
    d = spark.createDataFrame(docs, "key int, text string")
    q = spark.createDataFrame([(0, text)], "qid int, text string")
    return bm25.text_search(d, q, k, **options).orderBy("rank").collect()


def test_bm25(spark):
    docs = [(1, "data data processing"), (2, "data science and big pipelines"), (3, "data coroutines")]
    got = searched(spark, docs, "data coroutines unknown data")
    tokens = {k: t.split() for k, t in docs}
    avg = sum(map(len, tokens.values())) / 3

    def plain(k):
        total = 0
        for t in ("coroutines", "data"):
            df, tf = sum(t in x for x in tokens.values()), tokens[k].count(t)
            total += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1) / (tf + 1.2 * (0.25 + 0.75 * len(tokens[k]) / avg))
        return total

    assert got[0].key == 3 and {r.key: r.score for r in got} == {k: pytest.approx(plain(k), rel=1e-6) for k in tokens}
    for text in ("   ??? ", "absent", ""):
        assert searched(spark, docs, text) == []
    assert searched(spark, [], "data") == []
    assert [r.key for r in searched(spark, [(1, "日本語"), (2, "中国語")], "本語", analyzer=A.ngrams(2))] == [1]


def test_fusion(spark):
    def fuse(*lists, limit=10):
        rows = [(0, i, r + 1, k) for i, x in enumerate(lists) for r, k in enumerate(x)]
        return fusion.fuse(spark.createDataFrame(rows, "qid int, list_idx int, rank int, key string"), limit).orderBy("rank").collect()

    got = fuse("abc", "xby")
    assert got[0].key == "b" and got[0].score == F32(F32(1 / 62) + F32(1 / 62))
    assert [r.key for r in fuse("312")] == list("312") and len(fuse("abc", limit=2)) == 2 and [r.key for r in fuse("a", "b")] == ["a", "b"]


def test_hybrid(spark):
    rows = [("semantic", [1.0, 0.0, 0.0, 0.0], "nothing here", {}), ("keyword", [0.0, 1.0, 0.0, 0.0], "kotlin guide", {}), ("far", [0.0, 0.0, 1.0, 0.0], "cooking", {}), ("x", [0.0, 0.0, 0.0, 1.0], "garden", {})]
    df = spark.createDataFrame(rows, "key string, vector array<float>, text string, attributes map<string,string>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0], "kotlin")], "qid int, query array<float>, text string")
    assert {r.key for r in fusion.hybrid_search(df, q, 2).collect()} == {"semantic", "keyword"}
    assert [r.key for r in fusion.hybrid_search(df, q, 4, where=F.col("key") == "far").collect()] == ["far"]
    blank = q.withColumn("text", F.lit("?"))
    assert hits(fusion.hybrid_search(df, blank, 4)) == hits(knn.nearest(df, q, 4))


def test_wordpiece_query_has_whole_texts(spark):
    from sparkseek.plans import queries

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id as key", "text").join(queries.QUERIES["wordpiece"](spark, "/root/testdata/sf0.001"), "key").collect()
    assert rows and all(len(r.input_ids) - 2 >= len(r.text.split()) for r in rows)
    assert max(len(r.input_ids) for r in rows) > 256


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("quantization", list(Quantization))
def test_kernel_has_the_bits_of_the_expressions(spark, metric, quantization):
    rng = np.random.default_rng(6)
    data, asked = rng.uniform(-1, 1, (60, 64)).astype(F32), rng.uniform(-1, 1, (5, 64)).astype(F32)
    data[7] = data[8]
    v, q = frames(spark, data, asked)
    both = v.select("key", V.prepared(F.col("vector"), metric).alias("v")).crossJoin(q.select("qid", V.prepared(F.col("query"), metric).alias("q")))
    score = {
        Quantization.NONE: V.score(F.col("q"), F.col("v"), metric),
        Quantization.INT8: V.int8_score(F.col("q"), V.int8_codes(F.col("v")), V.int8_scale(F.col("v")), metric),
        Quantization.BINARY: V.binary_score(F.col("q"), V.signs(F.col("v")), 64, metric),
    }[quantization]
    plain = {(r.qid, r.key, r.score, r.rank) for r in knn.best(both.select("qid", "key", score.alias("score")), 9).collect()}
    assert {(r.qid, r.key, r.score, r.rank) for r in knn.nearest(v, q, 9, metric, quantization=quantization).collect()} == plain


def test_nearest_defines_nulls_nan_lengths_and_blocks(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "key int, vector array<float>").withColumns({"v": F.lit(1), "scale": F.lit("x")})
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)] + [(99, None)], "qid int, query array<float>")
    got = knn.nearest(v, q, 9)
    assert hits(got)[0] == [1, 5, 5, 2] and set(hits(got)) == set(range(40))
    monkeypatch.setattr(knn, "BROADCAST_QUERIES", 7)
    assert sorted(got.collect()) == sorted(knn.nearest(v, q, 9).collect())
    assert knn.nearest(v, q.limit(0), 9).count() == 0 == knn.nearest(v.limit(0), q, 9).count()
    with pytest.raises(Exception, match="expected 2"):
        knn.nearest(v.unionByName(v.limit(1).withColumn("vector", F.array(F.lit(1.0).cast("float")))), q, 1).collect()


def test_graph_search_takes_any_number_of_queries(spark, monkeypatch):
    data, asked = clustered(16, 0.2, 8, 10, 30, 60)
    v, q = frames(spark, data, asked)
    few = ann.graph_search(v, q, 5, shards=3).collect()
    monkeypatch.setattr(ann, "TASK_QUERIES", 7)
    monkeypatch.setattr(ann, "PIECE", 1000)
    assert sorted(few) == sorted(ann.graph_search(v, q, 5, shards=3).collect()) and len(few) == 300
    monkeypatch.undo()
    many = spark.range(20_100).select(F.col("id").alias("qid"), F.lit(asked[0].tolist()).cast("array<float>").alias("query"))
    assert ann.graph_search(v.where("key < 2"), many, 1, shards=2).count() == 20_100


def test_bm25_of_repeated_keys_and_queries_against_sql(spark, tmp_path):
    import duckdb
    from test_queries import plain

    from sparkseek.plans import queries

    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    rows = [(1, "a b b c"), (1, "a b b c"), (1, "c a"), (2, "b d d"), (3, "a c e"), (4, ""), (5, None), (6, "x y z b"), (7, "d a a b c e")]
    c.executemany("insert into documents values (?, ?, 'en', 's')", rows)
    c.execute("create table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into benchmark values (?, ?)", [(10, "a b a"), (10, "b c"), (11, "d e"), (12, ""), (13, "unknown x")])
    for t in ("documents", "benchmark"):
        c.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    for name in ("bm25_search", "bm25_filtered"):
        df, other = queries.QUERIES[name](spark, str(tmp_path)), c.sql(queries.SQL[name])
        assert df.count() > 5 and plain(df.collect(), df.columns) == plain(other.fetchall(), list(other.columns))


def test_bm25_exchanges_no_terms(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("if(id < 0, null, id) key", "concat_ws(' ', transform(sequence(0, 60), x -> concat('w', (x * x + id) % 97))) text").repartition(4)
    asked = docs.where("key < 90").selectExpr("key qid", "text")
    df = bm25.text_search(docs, asked, 5)
    got = sorted(df.collect())
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert len(got) == 450 and "SortMergeJoin" not in final and final.count("ReusedExchange")
    own = bm25.text_search(docs, asked, 5, where=docs.where("key % 2 = 0"))
    assert all(r.key % 2 == 0 for r in own.collect())
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Initial Plan")].count("concat_ws") == final.count("concat_ws") == 1
    for name, value in (("BLOCK_QUERIES", 40), ("TOKENS", 200), ("CELLS", 999)):
        monkeypatch.setattr(bm25, name, value)
    assert sorted(bm25.text_search(docs, asked, 5).collect()) == got


def test_wordpieces_of_a_batch_by_slices_without_objects(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from sparkseek.operators import embed

    t = embed.WordPiece({w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", *"abcd", *(f"##{c}" for c in "abcd"), "ab"])})
    rng = random.Random(2)
    lists = [None, [], *(["".join(rng.choices("abcde", k=rng.randrange(1, 6))) for _ in range(rng.randrange(40))] for _ in range(60)), ["abc"] * 500]
    words = pa.array(lists, pa.list_(pa.string()))
    for size in (1 << 17, 50, 1):
        monkeypatch.setattr(embed, "WORDS", size)
        for most in (None, 2, 9, 256):
            assert t.encode_all(words, most).to_pylist() == [t.encode(w or [], most) for w in lists]
    assert len(t.encode_all(words.slice(3, 20), None)) == 20 and len(t.encode_all(words[:0], None)) == 0
    monkeypatch.undo()
    many = pa.array([[f"{'abcd' * 3}{i % 7}a" for i in range(1000)]] * 1000)
    tracemalloc.start()
    try:
        embed.wordpiece.__globals__["WordPiece"].encode_all(t, many, None)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20  # a million words as objects take more
    finally:
        tracemalloc.stop()


def test_hybrid_search_neither_explodes_texts_nor_sums_pairs(spark):
    data, asked = clustered(16, 0.3, 9, 10, 30, 12)
    v, q = frames(spark, data, asked)
    v = v.selectExpr("key", "vector", "concat('all w', key % 7, ' x', key) text", "map('source', if(key % 3 = 0, 'src0', 'src1')) attributes")
    q = q.selectExpr("qid", "query", "concat('all w', qid % 7) text")
    df = fusion.hybrid_search(v, q, 5, where=attr_ne("source", "src0"))
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 60 and all(r.key % 3 for r in rows)
    assert "sum(part" not in plan and "Generate explode(concat(terms" not in plan and "[term" not in plan
