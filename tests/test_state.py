"""Corpus changes, reconciliation, storage and embedding."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import corpus, embed
from sparkseek.operators.bm25 import term_frequencies
from sparkseek.sources import storage
from sparkseek.streaming import sync


def test_corpus(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b")], "key int, text string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "key int, text string, seq int")
    got = corpus.upsert(c, new, "seq")
    assert {r.key: r.text for r in got.collect()} == {1: "a", 2: "y", 3: "z"} and got.count() == 3
    assert [r.key for r in corpus.delete(got, c).collect()] == [3]
    assert {r.key: r.present for r in corpus.contains(c, new).collect()} == {2: True, 3: False}
    ids = spark.createDataFrame([(i,) for i in (0, 1, -1, 2**31 - 1, -(2**31))], "k int")
    assert [bytes(r[1]) for r in ids.select("k", corpus.encode_key("k", "int")).collect()] == [i.to_bytes(4, "big", signed=True) for i in (0, 1, -1, 2**31 - 1, -(2**31))]


def simulated(snapshots):
    """Entry by entry."""
    log, tracked = [], {}
    for i, entries in enumerate(snapshots, 1):
        for pos, (k, v) in enumerate(entries):
            if k not in tracked or tracked[k] != v:
                log.append((i, pos, "upsert", k))
            tracked[k] = v
        for k in [k for k in tracked if k not in {e[0] for e in entries}]:
            del tracked[k]
            log.append((i, None, "remove", k))
    return sorted(log, key=repr), set(tracked)


def test_reconcile(spark):
    rng = random.Random(1)
    cases = [[[("a", 1), ("b", 1)], [("a", 2), ("c", 1)], [("a", 2)]], [[("a", None)], [("a", None), ("b", 1), ("b", 2)], [], [("a", None)]]]
    cases += [[[(rng.choice("abcd"), rng.choice([1, 2, None])) for _ in range(rng.randint(0, 5))] for _ in range(8)] for _ in range(2)]
    for snapshots in cases:
        rows = [(s, p, k, v) for s, x in enumerate(snapshots) for p, (k, v) in enumerate(x)]
        e = spark.createDataFrame(rows, "snapshot_id int, pos int, key string, version int")
        ops = sync.reconcile(e, spark.createDataFrame([(s,) for s in range(len(snapshots))], "snapshot_id int"))
        log, left = simulated(snapshots)
        assert sorted((tuple(r) for r in ops.select("i", "pos", "op", "key").collect()), key=repr) == log
        assert {r.key for r in sync.final_state(ops).collect()} == left


def test_streamed_snapshots(spark, tmp_path):
    schema = "snapshot_id int, pos int, key string, version int"
    seen = []

    def embedded(rows):
        seen.append(sorted(r.key for r in rows.collect()))
        return rows.withColumn("vector", F.array(F.lit(1.0).cast("float")))

    synced = sync.Synced(spark, str(tmp_path / "table"), embedded)
    assert synced.read() is None
    for rows in ([(1, 0, "a", 1), (1, 1, "b", 1)], [(2, 0, "a", 2), (2, 1, "c", 1), (3, 0, "a", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        synced.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint")).awaitTermination()
    assert [(r.key, r.version) for r in synced.read().collect()] == [("a", 2)]
    assert [s for s in seen if s] == [["a", "b"], ["a", "c"]]
    synced.apply(spark.createDataFrame([(2, 0, "late", 1)], schema))  # a replay changes nothing
    assert synced.read().count() == 1


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([(i, [0.1 * i, -0.0], f"text number {i % 3}", {"g": str(i % 4)}) for i in range(20)], "key int, vector array<float>, text string, attributes map<string,string>")
    assert storage.load_vectors(spark, str(tmp_path / "none")) is None
    storage.save_hybrid(rows, str(tmp_path / "h"), model="m")
    v, tf, meta = storage.load_hybrid(spark, str(tmp_path / "h"))
    assert meta["rrf_k"] == 60 and sorted(v.collect()) == sorted(rows.drop("text").collect())
    assert sorted(tf.collect()) == sorted(term_frequencies(rows).collect())
    with pytest.raises(ValueError):
        storage.load_text(spark, str(tmp_path / "h"))


VOCABULARY = embed.parse_vocabulary("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "kotlin", "search", "engine", "##s", "world", ".", "un", "##aff", "##able", "hello", ","]))


def fake():
    class Fake:
        def run(self, ids, mask, types):
            return np.array([[i + 1.0] * 4 for i in range(len(ids))], np.float32)

        def close(self):
            pass

    return Fake


def test_wordpiece(spark):
    t = embed.WordPiece(VOCABULARY)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(["Kotlin search", "kotlins", "unaffable", "hello, world.", "qwxyz", "x" * 101])], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(embed.wordpiece(F.col("text"), t)).collect()]
    assert [g.input_ids for g in got] == [[2, 4, 5, 3], [2, 4, 7, 3], [2, 10, 11, 12, 3], [2, 13, 14, 8, 9, 3], [2, 1, 3], [2, 1, 3]]
    assert got[0].attention_mask == [1] * 4 and got[0].token_type_ids == [0] * 4
    assert t.encode(["kotlin", "search", "engine"], 4) == [2, 4, 5, 3]
    assert embed.parse_vocabulary("\n\n[UNK]\na\r\na\n") == {"[UNK]": 0, "a": 2, "": 3}
    with pytest.raises(ValueError):
        embed.WordPiece({"a": 0})


def test_embedding(spark):
    Fake = fake()
    t = embed.WordPiece(VOCABULARY)
    df = spark.createDataFrame([("kotlin search",), (None,)], "text string")
    mean = [r.vector for r in embed.embed(df, t, Fake, embed.EmbedderConfig(normalize=False)).collect()]
    assert mean == [[2.5] * 4, [1.5] * 4]
    assert embed.embed(df, t, Fake, embed.EmbedderConfig(pooling="cls", normalize=False)).first().vector == [1.0] * 4
    assert embed.embed(df, t, lambda: embed.CallbackSession(lambda ids, mask, types: np.array([[1.0] * 4 for _ in ids], np.float32))).first().vector == pytest.approx([0.5] * 4)
    pooled = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<float>>, m array<int>").select(embed.mean_pool(F.col("t"), F.col("m")), embed.cls_pool(F.col("t"))).first()
    assert pooled[0] == [2.0, 3.0] and pooled[1] == [1.0, 2.0]
    with pytest.raises(ValueError):
        embed.EmbedderConfig(max_tokens=1)
