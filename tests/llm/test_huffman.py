import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import huffman as H


def plain_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    return cost


def test_lengths_are_the_best():
    rng = random.Random(2)
    for _ in range(60):
        counts = np.array([rng.choice([0, 1, 2, 7, rng.randint(1, 3000)]) for _ in range(rng.randint(2, 60))])
        used = counts > 0
        if used.sum() < 2:
            continue
        free = H.code_lengths(counts, 40).astype(int)
        assert (counts * free).sum() == plain_cost(counts.tolist())
        assert sum(2.0**-n for n in free[used]) == 1
    fib = [1, 1]
    while len(fib) < 20:
        fib.append(fib[-1] + fib[-2])
    tight = H.code_lengths(np.array(fib), 5).astype(int)
    assert tight.max() == 5 and sum(2.0**-n for n in tight) <= 1
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(40, int), 5)


def test_limited_lengths_against_every_choice():
    import itertools

    for counts in ([1, 2, 4, 8, 16, 32], [1, 1, 1, 5, 9, 100], [3, 3, 3, 3, 3]):
        for limit in (3, 4):
            best = min(sum(c * n for c, n in zip(counts, ns)) for ns in itertools.product(range(1, limit + 1), repeat=len(counts)) if sum(2.0**-n for n in ns) <= 1)
            assert int((np.array(counts) * H.code_lengths(np.array(counts), limit)).sum()) == best


def test_codes_are_canonical_and_free_of_prefixes():
    book = H.Book(H.code_lengths(np.array([5, 0, 1, 1, 9, 30, 2])))
    codes = sorted((int(n), i, format(int(book.codes[i]), f"0{n}b")) for i, n in enumerate(book.lengths) if n)
    bits = [c for _, _, c in codes]
    assert not any(a != b and b.startswith(a) for a in bits for b in bits)
    assert bits == sorted(bits)


def rows(seed=3):
    rng = random.Random(seed)
    out = [(i, [min(int(rng.expovariate(0.02)), 5000) for _ in range(rng.choice([0, 1, 63, 64, 65, 128, 300, 1000]))], 0) for i in range(60)]
    return [*out, (60, None, 0), (61, [7] * 20_000, 0), (61, [7] * 20_000, 0), (None, [49999, 0], 0)]


def test_round_trip_and_independent_blocks(spark):
    df = spark.createDataFrame(rows(), "doc_id long, token_ids array<int>, block int").repartition(3)
    book = H.codebook(df)
    blocks = H.huffman_encode(df, book, block=256)
    assert blocks.columns == ["doc_id", "block", "n_ids", "n_bits", "payload", "checkpoints", "checksum"]
    got = H.huffman_decode(blocks, book)
    assert sorted((repr(r.doc_id), r.token_ids) for r in got.collect()) == sorted((repr(d), ids or []) for d, ids, _ in rows())
    checked = H.huffman_encode(df, book, block=256, verify=True)
    assert checked.columns[-1] == "exact" and checked.where("exact").count() == blocks.count()
    packed = [(d, None if ids is None else np.array(ids, "<u2").tobytes()) for d, ids, _ in rows()]
    other = spark.createDataFrame(packed, "doc_id long, token_ids binary").repartition(3)
    assert H.codebook(other, width=2).lengths.tolist() == book.lengths.tolist()
    assert sorted(map(repr, H.huffman_encode(other, book, block=256, width=2).collect())) == sorted(map(repr, blocks.collect()))
    some = blocks.where("block = 1").withColumn("ids", H.block_ids(book, spark)("payload", "n_ids", "checkpoints")).collect()
    plain = {d: ids for d, ids, _ in rows()}
    assert some and all(r.ids == plain[r.doc_id][256:512] for r in some)
    for r in blocks.collect():
        assert len(r.payload) == (r.n_bits + 7) // 8 and len(r.checkpoints) == -(-r.n_ids // H.CHECK)
    assert blocks.where(H.checksums()(H.block_ids(book, spark)("payload", "n_ids", "checkpoints")) != F.col("checksum")).count() == 0
    naive = {d: "".join(format(int(book.codes[i]), f"0{book.lengths[i]}b") for i in (ids or [])[:256]) for d, ids, _ in rows()}
    for r in blocks.where("block = 0").collect():
        assert "".join(format(b, "08b") for b in r.payload)[: r.n_bits] == naive[r.doc_id]


def test_edges(spark):
    df = spark.createDataFrame(rows(), "doc_id long, token_ids array<int>, block int")
    book = H.codebook(df.where("doc_id = 61"))
    assert book.lengths.tolist() == [0] * 7 + [1]
    with pytest.raises(Exception, match="not counted"):
        H.huffman_encode(df, book).collect()
    twice = spark.createDataFrame([(1, [7, 8])] * 2, "doc_id long, token_ids array<int>")
    own = H.codebook(twice)
    assert [r.token_ids for r in H.huffman_decode(H.huffman_encode(twice, own), own).collect()] == [[7, 8]] * 2
    wide = spark.createDataFrame([(1, list(range(40)))], "doc_id long, token_ids array<int>")
    assert H.codebook(wide, limit=5).limit == 6
    none = H.codebook(df.limit(0))
    assert H.huffman_encode(df.limit(0), none).count() == 0
    assert [(r.n_ids, r.n_bits) for r in H.huffman_encode(df.where("doc_id = 60"), none).collect()] == [(0, 0)]
