import random

import numpy as np
import pyarrow as pa
import pytest

from sparkseek.llm import runs as R
from sparkseek.llm import suffix_dedup as S

L, G = 10, 5


def brute(docs, window):
    """docs: (doc_id, words) in order. Words of removable windows, by document."""
    seen, gone = {}, {}
    for d, words in docs:
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w not in seen:
                seen[w] = (d, s)
            elif seen[w][0] != d or seen[w][1] + window <= s:
                gone.setdefault(d, set()).update(range(s, s + window))
    return gone


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=rng.randint(L - 2, 4 * L)) for _ in range(8)]
    docs = []
    for d in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choices(vocabulary, k=rng.randint(0, 15))
            words += rng.choice([[], [], rng.choice(passages), rng.choice(passages)[2:], ["run"] * rng.randint(1, 3 * L), ["a", "b"] * rng.randint(1, 2 * L)])
        if d % 9 == 4:
            words = list(docs[-1][1])
        docs.append((d, words))
    return docs


def spans_of(gone):
    out = []
    for d, places in gone.items():
        for p in sorted(places):
            if p - 1 not in places:
                out.append([d, p, p])
            out[-1][2] = p + 1
    return sorted(map(tuple, out))


@pytest.mark.parametrize("entries", [7, 100_000])
def test_against_brute_force(spark, monkeypatch, entries):
    for seed in (1, 2):
        docs = corpus(seed)
        monkeypatch.setattr(S, "RUN_BYTES", 300 * entries)
        monkeypatch.setattr(S, "RANGE_ENTRIES", 3 * entries)
        df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(5)
        got = S.duplicate_spans(df, window=L, gram=G).collect()
        expected = brute(docs, L)
        assert sorted((r.doc_id, r.first_word, r.end_word) for r in got) == spans_of(expected)
        texts = {d: " ".join(w) for d, w in docs}
        for r in got:
            assert r.n_words == r.end_word - r.first_word and r.first_doc_id <= r.doc_id
            assert " ".join(texts[r.doc_id].split()[r.first_word : r.first_word + L]) in texts[r.first_doc_id]
        left = {r.doc_id: r.text.split() for r in S.suffix_dedup(df, window=L, gram=G).collect()}
        for d, words in docs:
            stays = [w for i, w in enumerate(words) if i not in expected.get(d, ())]
            assert left.get(d, []) == stays if stays or not words else d not in left


def test_loser_tree_merges_like_sort():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 8):
        lists = [sorted("".join(rng.choices("ab", k=rng.randint(0, 90))).encode() for _ in range(rng.randint(0, 60))) for _ in range(k)]
        runs = []
        for strings in lists:
            shared, rests, lengths = R.front_code(strings)
            assert R.front_decode(shared, rests, lengths) == strings
            runs.append((shared, strings))
        before, out = b"", []
        for known, run, at in R.merge(runs) if k else []:
            s = lists[run][at]
            assert known == R.common_prefix(before, s)
            before = s
            out.append(s)
        assert out == sorted(x for s in lists for x in s)


def test_loser_tree_compares_no_known_byte(monkeypatch):
    compared = []
    plain = R.common_prefix
    monkeypatch.setattr(R, "common_prefix", lambda a, b, at=0: compared.append(plain(a, b, at) - at + 1) or plain(a, b, at))
    strings = [b"x" * 1000 + bytes([65 + i % 26, 97 + i // 26]) for i in range(400)]
    lists = [sorted(strings[i::8]) for i in range(8)]
    runs = [(R.front_code(s)[0], s) for s in lists]
    compared.clear()
    assert len(list(R.merge(runs))) == 400
    assert sum(compared) < 20 * 1000  # the long prefix is read once a run, not once a comparison


def test_edges(spark):
    long = " ".join(f"u{i}" for i in range(30_000))
    rows = [(1, None, "k"), (1, "", "k"), (2, "  ", "k"), (3, "too short", "k"), (5, long, "k"), (4, long + "\n\nend", "k"), (4, long + "\n\nend", "k"), (None, "  " + long.replace(" ", "\t \n"), "k"), (6, "same " * 25, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((r.doc_id or -1, r.first_word, r.end_word, r.first_doc_id) for r in S.duplicate_spans(df, window=L, gram=G).collect())
    assert got == [(-1, 0, 30_000, 4), (5, 0, 30_000, 4), (6, 10, 25, 6)]
    out = S.suffix_dedup(df, window=L, gram=G)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, len(r.text.split())) for r in out.collect() if r.text is not None) == [(1, 0), (2, 0), (3, 2), (4, 30_001), (4, 30_001), (6, 10)]
    assert S.suffix_dedup(df.limit(0), window=L, gram=G).count() == 0
    with pytest.raises(ValueError):
        S.repeated_spans(df, window=5, gram=6)


def test_anchors_agree_between_copies():
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 2**62, 60).astype(np.uint64)
    for k in range(20):
        a = np.concatenate([rng.integers(1, 2**62, k).astype(np.uint64), shared])
        at, _ = S.anchors(a, np.array([0, len(a)]), 50, 25)
        inside = {int(p) - k for p in at if k <= p and p + 25 <= k + 60}
        at0, _ = S.anchors(shared, np.array([0, 60]), 50, 25)
        assert set(at0.tolist()) <= inside


def test_pa_nulls():
    assert S._anchor_udf(5, 2).func(pa.array([None, "", "a b"])).to_pylist() == [[], [], []]
