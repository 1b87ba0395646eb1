import random

import numpy as np

from sparkseek.llm import near_dedup as N
from sparkseek.llm.align import FAR, banded, within
from sparkseek.llm.components import components


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, words, vocabulary, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(rng.choice(vocabulary) if x < 2 * share / 3 else w)
        if x > 1 - share / 3:
            out.append(rng.choice(vocabulary))
    return out


def corpus(seed, bases=25, length=(10, 120), share=0.12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for b in range(bases):
        words = rng.choices(vocabulary, k=rng.randint(*length))
        docs.append(words)
        docs += [edited(rng, words, vocabulary, rng.random() * share) for _ in range(b % 4)]
    return docs


def test_banded_alignment_is_exact():
    docs = [np.array([hash(w) % 2**63 for w in d], np.uint64) for d in corpus(1, length=(0, 40), share=0.6)]
    pairs = [(a, b) for a in docs for b in docs[:25]]
    exact = np.array([levenshtein(a.tolist(), b.tolist()) for a, b in pairs])
    for w in (0, 3, 10, 60):
        got = banded(pairs, np.full(len(pairs), w))
        assert (got >= exact).all()
        assert (got[exact <= w] == exact[exact <= w]).all()
        assert (got[[abs(len(a) - len(b)) > w for a, b in pairs]] == FAR).all()
    for t in (0.5, 0.8, 0.95, 1.0):
        assert within(pairs, t, narrow=4).tolist() == [bool(1 - d / max(len(a), len(b), 1) >= t - 1e-12) for (a, b), d in zip(pairs, exact)]


def test_kmers_carry_occurrences():
    words = np.array([5, 6, 7, 5, 6, 7, 5, 6, 7, 9], np.uint64)
    labelled, off = N.kmers(words, np.array([0, 9, 9, 10]), 3)
    assert off.tolist() == [0, 7, 7, 8]
    assert len(set(labelled.tolist())) == 8  # a repeated k-mer has another label each time
    again, _ = N.kmers(words[3:], np.array([0, 6, 7]), 3)
    assert again[0] == labelled[0] and again[3] == labelled[3]


def test_order_matters():
    rng = random.Random(2)
    words = np.array([rng.getrandbits(60) for _ in range(200)], np.uint64)
    swapped = np.concatenate([words[100:], words[:100]])  # nearly the same k-mers, another order
    near = words.copy()
    near[[20, 90, 150]] = 1
    s = N.sketches(np.concatenate([words, swapped, near]), np.array([0, 200, 400, 600]))
    assert (s[0] == s[1]).mean() < 0.8 < (s[0] == s[2]).mean() + 0.25


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recall_against_brute_force(spark):
    docs = corpus(7, bases=60)
    texts = [" ".join(d) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in N.near_duplicates(df).collect()}
    near = [(i, j) for i in range(len(docs)) for j in range(i) if min(len(docs[i]), len(docs[j])) >= 0.8 * max(len(docs[i]), len(docs[j])) and 1 - levenshtein(docs[i], docs[j]) / max(len(docs[i]), len(docs[j])) >= 0.8]
    assert len(near) > 40
    assert sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    parent = list(range(len(docs)))
    for i, j in near:  # groups never go beyond the components of the exact relation
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert all(parent[i] == parent[g] for i, g in got.items())


def test_edges(spark):
    same, long = "one two three four five", " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None, 0), (1, None, 0), (2, "", 0), (3, " \n", 0), (5, same, 0), (4, same, 0), (4, same, 0), (None, same, 0), (6, "hi", 0), (7, "hi", 0), (8, long, 0), (9, long + " end", 0), (None, "alone here", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    kept = N.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "-")[:5]) for r in kept.collect()) == [(0, "alone"), (1, "-"), (1, "-"), (2, "-"), (3, " \n"), (4, "one t"), (6, "hi"), (8, "v0 v1")]
    groups = N.near_duplicates(df).collect()
    assert len(groups) == len(rows) and sum(r.kept for r in groups) == 8
    assert {r.group_id for r in groups if r.group_size == 4} == {4}
    assert {r.group_id for r in groups if r.doc_id in (8, 9)} == {8}
    assert N.near_dedup(df.limit(0)).count() == 0 and N.near_duplicates(df.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    base = rng.choices(vocabulary, k=80)
    texts = [" ".join(edited(rng, base, vocabulary, 0.05)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.group_id for r in N.near_duplicates(df).collect()} == {0}


def test_star_family_against_brute_force(spark):
    """Copies that are near to their base but not to each other."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for _ in range(2):
        base = rng.choices(vocabulary, k=80)
        docs.append(base)
        for _ in range(120):
            at = set(rng.sample(range(80), 11))
            docs.append([rng.choice(vocabulary) if i in at else w for i, w in enumerate(base)])
    number = {w: i for i, w in enumerate(vocabulary)}
    rows = [np.array([number[w] for w in d], np.uint64) for d in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i)]
    near = [p for p, ok in zip(pairs, within([(rows[i], rows[j]) for i, j in pairs], 0.8)) if ok]
    assert len(near) < 0.2 * len(pairs)
    parent = list(range(len(docs)))
    for i, j in near:
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    assert [r.group_id for r in N.near_duplicates(df).orderBy("doc_id").collect()] == parent == [0] * 121 + [121] * 121


def test_word_counts_never_part_similar_texts():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(300):
        a = rng.choices(vocabulary, k=rng.randint(1, 400))
        b = edited(rng, a, vocabulary, rng.choice([0.05, 0.2, 0.4])) if rng.random() < 0.7 else rng.choices(vocabulary, k=len(a))
        words = [np.array([hash(w) & (1 << 63) - 1 for w in t], np.uint64) for t in (a, b)]
        x, y = (np.frombuffer(N.bags_of(w, np.array([0, len(w)]))[0], np.uint8).astype(int) for w in words)
        assert np.abs(x - y).sum() <= 2 * levenshtein(a, b)
