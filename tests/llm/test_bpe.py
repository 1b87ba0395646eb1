import base64
import random

import numpy as np
import pyarrow as pa
import pytest
import regex
import tiktoken

from sparkseek.llm import bpe as B

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
HARD = ["it's we'll I'M 'sa 'tis !'s x 's\n's don't'", " \n  a\n\n b  ", "'", "'l", "a'l", "''re", "naïve  ÉTÉ 東京12³ ½x\t\t", " nbsp  em", "🙂🙂 ok 🙂", "é ​ z", "", " ", "'re", "x're", "x'rex'v", "\r\n\r\n x"]


def strings(n, seed=5):
    rng = random.Random(seed)
    return HARD + ["".join(rng.choices("ab'strelvmd  \n\t1é!?東🙂", k=rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def plain():
    ranks = {t: i for i, t in enumerate(B.read_vocabulary(B.VOCABULARY)) if t}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_are_those_of_the_pattern():
    texts, pattern = strings(3000), regex.compile(PATTERN)
    data, off = B.utf8(pa.array(texts))
    starts, rows = B.words(data, off)
    raw, ends = data.tobytes(), np.append(starts[1:], len(data))
    for i, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])] == pattern.findall(t)


def test_automaton_is_minimal_and_numbers_its_words():
    rng = random.Random(1)
    lexicon = sorted({"".join(rng.choices("abc", k=rng.randint(0, 6))).encode() + rng.choice([b"", b"ing", b"ed"]) for _ in range(500)})
    keys, targets, numbers, finals = B.compiled(lexicon)
    arcs = {int(k): (int(t), int(n)) for k, t, n in zip(keys, targets, numbers)}

    def walk(w):
        s = total = 0
        for c in w:
            if s << 8 | c not in arcs:
                return None
            s, n = arcs[s << 8 | c]
            total += n
        return total if finals[s] else None

    assert [walk(w) for w in lexicon] == list(range(len(lexicon)))
    right = {}  # the words that lead from each state to an end; no two states have the same

    def language(s):
        if s not in right:
            right[s] = frozenset({b""} if finals[s] else set()) | {bytes([k & 255]) + r for k in arcs if k >> 8 == s for r in language(arcs[k][0])}
        return right[s]

    language(0)
    assert len(right) == len(finals) == len(set(right.values()))
    assert len(B.compiled([])[0]) == 0 and B.compiled([b""])[3].tolist() == [1]


def test_same_ids_as_the_plain_encoder(spark, plain):
    texts = strings(300) + ["x" * 30_000, "word " * 20_000, "ab" * 5000 + "é" * 5000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 1), (1, texts[1], 2)], "doc_id long, text string, token_ids int")
    for frequent in (0.5, 1e-4):
        name = B.prepare(df, frequent=frequent)
        got = B.bpe_decode(B.bpe_encode(df, name=name), name)
        assert got.columns == ["doc_id", "text", "token_ids", "decoded"]
        for r in got.collect():
            assert r.decoded == r.text
            assert r.token_ids == (None if r.text is None else plain.encode_ordinary(r.text))
        packed = df.select("text", B.packed_encoder(name, 2)("text").alias("p"), B.verified_encoder(name)("text").alias("v"), B.counter(name)("text").alias("n"))
        for r in packed.collect():
            ids = None if r.text is None else plain.encode_ordinary(r.text)
            assert (None if r.p is None else np.frombuffer(r.p, "<u2").tolist()) == ids == r.v.ids and r.n == (None if ids is None else len(ids)) and r.v.exact
    assert B.bpe_encode(df.limit(0)).count() == 0


def test_remembered_words_and_tables():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = B.slots(keys)
    assert B.lookup(table, keys, keys).tolist() == list(range(len(keys))) and (B.lookup(table, keys, keys + 1) >= 0).sum() == np.isin(keys + 1, keys).sum()
    own = B.Remembered(100)
    for n in (60, 60, 250):
        h = rng.integers(1, 1 << 60, n).astype(np.uint64)
        size = rng.integers(0, 5, n)
        off = np.concatenate([[0], np.cumsum(size)])
        ids = rng.integers(0, 9, off[-1]).astype(np.int32)
        own.add(h, ids, off)
        at = B.lookup(own.table, own.keys, h)
        assert own.n <= 100 and (at[: min(n, 100)] >= 0).all()
        for i in np.flatnonzero(at >= 0):
            assert own.ids[own.begin[at[i]] :][: own.size[at[i]]].tolist() == ids[off[i] : off[i + 1]].tolist()


def test_counts_cover_all_texts(spark):
    df = spark.createDataFrame([(" the the",), (None,), ("a the",), ("a the",)], "text string").repartition(3)
    assert {bytes(r.word): r.n for r in B.word_counts(df).collect()} == {b" the": 4, b"a": 2}
    assert sorted(B.lexicon(df, frequent=0.5)) == [b" the"]


def test_vocabulary_file(tmp_path):
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ((b"a", 0), (b"ab", 3))))
    assert B.read_vocabulary(str(tmp_path / "v")) == [b"a", b"", b"", b"ab"]


def test_words_of_torn_characters_stay_in_their_rows():
    rows = [b"a \xc3", b"\xa9 b", "　 x".encode(), b"\xe3\x80", b" \xff's"]
    data, off = B.utf8(pa.array(rows, pa.binary()))
    starts, at = B.words(data, off)
    raw, ends = data.tobytes(), np.append(starts[1:], len(data))
    own = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(at, at[1:])]
    assert [b"".join(x) for x in own] == rows
    assert own[2] == ["　".encode(), " ".encode(), b"x"] and own[4] == [b" \xff'", b"s"]


def test_many_words_met_again_are_not_merged_again(tmp_path, plain):
    (tmp_path / "f").write_bytes(B.packed(B.read_vocabulary(B.VOCABULARY), []))
    encoder, seen = B.Encoder(str(tmp_path / "f")), []
    known = encoder.known
    encoder.known = lambda *a: seen.append(len(a[1])) or known(*a)
    text = "".join(f" {'qxz'[i % 3]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(300_000))
    first = encoder.encode(pa.array([text]))[0]
    assert sum(seen) > 1 << 18 and first.tolist() == plain.encode_ordinary(text)
    seen.clear()
    assert np.array_equal(encoder.encode(pa.array([text]))[0], first) and not seen
