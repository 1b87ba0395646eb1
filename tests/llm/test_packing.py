import random
from collections import defaultdict

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import packing as P

TIERS = (8, 32, 128)


def naive_pack(lengths, tiers):
    """The rule, step by step, by linear search."""
    left, windows = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), []
    for t in reversed(range(len(tiers))):
        own = [i for i in left if lengths[i] > (tiers[t - 1] if t else 0)]
        left = [i for i in left if i not in own]
        mine = []
        for i in own:
            fits = [w for w in mine if w[0] - sum(lengths[j] for j in w[1]) >= lengths[i]]
            if fits:
                min(fits, key=lambda w: (w[0] - sum(lengths[j] for j in w[1]), mine.index(w)))[1].append(i)
            else:
                mine.append((tiers[t], [i]))
        for w in sorted(mine, key=lambda w: (w[0] - sum(lengths[j] for j in w[1]), mine.index(w))):
            while fits := [i for i in left if lengths[i] <= w[0] - sum(lengths[j] for j in w[1])]:
                w[1].append(fits[0])
                left.remove(fits[0])
        windows += mine
    return windows


def test_pack_against_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 5, 40, 150):
        lengths = sorted((rng.choice([rng.randint(1, 8), rng.randint(1, 128), 128, 32, 8, 1]) for _ in range(n)), reverse=True)
        assert P.pack(lengths, TIERS) == naive_pack(lengths, TIERS)


def test_balance():
    rng = random.Random(2)
    fills = [rng.randint(50, 128) for _ in range(83)]
    got = P.balance(fills, 8)
    groups = defaultdict(list)
    for f, g in zip(fills, got):
        groups[g].append(f)
    assert len(groups.pop(-1)) == 3 and all(len(g) == 8 for g in groups.values())
    sums = [sum(g) for g in groups.values()]
    assert max(sums) - min(sums) <= max(fills)
    assert P.balance([], 4) == [] and P.balance([5], 4) == [-1] and P.balance([5, 6], 1) == [1, 0]


def checked(rows, docs, tiers, group_tokens):
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece_start, r.n_tokens))
        windows[r.window_id].append(r)
    assert {d: sum(n for _, n in p) for d, p in pieces.items()} == {d: n for d, n in docs.items() if n}
    for own in pieces.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
    groups = defaultdict(list)
    for own in windows.values():
        own.sort(key=lambda r: r.window_offset)
        at = 0
        for r in own:
            assert r.window_offset == at and r.n_tokens <= r.tier
            at += r.n_tokens
        assert at == own[0].window_tokens <= own[0].tier and len({(r.tier, r.step_group) for r in own}) == 1
        groups[own[0].step_group].append(own[0])
    for name, own in groups.items():
        assert len({w.tier for w in own}) == 1
        assert name.endswith("rest") or len(own) == max(1, group_tokens // own[0].tier)
    assert sum(g.endswith("rest") for g in groups) <= len(tiers)
    return windows


@pytest.mark.parametrize("shard_tokens", [200, 4000, 10**9])
def test_whole(spark, shard_tokens):
    rng = random.Random(3)
    docs = {i: rng.choice([0, rng.randint(1, 10), rng.randint(1, 100), rng.randint(100, 700)]) for i in range(250)}
    df = spark.createDataFrame([(i, " ".join(["w"] * (n - 1)) if n else None) for i, n in docs.items()], "doc_id long, text string").repartition(3)
    docs = {i: n if n > 1 else 0 for i, n in docs.items()}
    got = P.packing(df, tiers=TIERS, shard_tokens=shard_tokens, group_tokens=256)
    rows = got.collect()
    windows = checked(rows, docs, TIERS, 256)
    again = P.packing(df.repartition(5), tiers=TIERS, shard_tokens=shard_tokens, group_tokens=256)
    assert sorted(map(str, rows)) == sorted(map(str, again.collect()))
    if shard_tokens == 10**9:
        lengths = sorted((n for d in docs.values() if d for _, n in P.cut(d, TIERS)), reverse=True)
        assert sorted(w[0].window_tokens for w in windows.values()) == sorted(sum(lengths[i] for i in p) for _, p in naive_pack(lengths, TIERS))


def test_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \n ", 9), (None, "a b", 9), (None, "a b", 9), (4, "x " * 100_000, 9), (4, "x " * 100_000, 9), (5, "one", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = P.packing(df)
    assert got.columns == ["doc_id", "piece", "piece_start", "n_tokens", "tier", "window_id", "window_offset", "window_tokens", "step_group"]
    by = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert by == {None: 6, 4: 200_002, 5: 2}
    assert P.packing(df.limit(0)).count() == 0
    assert P.packing(df, length=F.col("n_tokens")).agg(F.sum("n_tokens")).first()[0] == 72
    with pytest.raises(ValueError):
        P.packing(df, tiers=())


def test_lengths_are_taken_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def length(column):
        seen.add(len(column))
        return pc.binary_length(column)

    df = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(100)], "doc_id long, text string")
    got = P.packing(df, length=F.arrow_udf(length, "int")("text"))
    assert seen.value == 100 and got.count() == 80
