import random

import numpy as np
import pytest

from sparkseek.llm import media as M

SIZES = dict(least=64, average=256, most=1024)


def slow_cuts(raw, least, average, most):
    """Byte by byte."""
    bits = max(1, (average - least).bit_length() - 1)
    out, at, h = [], 0, 0
    for i, b in enumerate(raw):
        h = (h * 2 + int(M.GEAR[b])) % 2**32
        n = i + 1 - at
        if n >= least and h >> (32 - bits) == 0 or n == most:
            out.append(i + 1)
            at = i + 1
    return out + ([len(raw)] if at < len(raw) else [])


def test_cuts_against_byte_by_byte(monkeypatch):
    rng = random.Random(1)
    for part in (1 << 22, 100):
        monkeypatch.setattr(M, "PART", part)
        for n in (0, 1, 63, 64, 65, 1024, 1025, 20_000):
            raw = rng.choice([rng.randbytes(n), bytes(n), rng.randbytes(7) * (n // 7)])
            assert M.cuts(np.frombuffer(raw, np.uint8), **SIZES) == slow_cuts(raw, **SIZES)


def test_an_insertion_moves_few_cuts():
    raw = random.Random(2).randbytes(60_000)

    def pieces(b):
        ends = M.cuts(np.frombuffer(b, np.uint8), **SIZES)
        return {b[i:j] for i, j in zip([0, *ends], ends)}

    old, new = pieces(raw), pieces(raw[:30_000] + b"!" + raw[30_000:])
    assert len(new - old) <= 6 < 100 < len(old)


def rows():
    rng = random.Random(3)
    base = [rng.randbytes(n) for n in (5000, 900, 30_000)]
    out = [(i, base[i % 3][: rng.randint(0, 30_000)] + rng.randbytes(rng.choice([0, 40, 3000])), 0) for i in range(40)]
    return [*out, (40, None, 1), (41, b"", 1), (42, b"", 1), (None, base[0], 2), (3, out[3][1], 2), (3, out[3][1], 2), (50, base[2] * 40, 3), (51, b"\0" * 5000, 3)]


def test_media_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, blob binary, n_bytes int").repartition(3)
    got = M.media(df, "blob", **SIZES)
    assert got.columns == ["doc_id", "media", "n_bytes", "chunks", "n_new", "new_bytes", "verified"]
    got = got.collect()
    assert len(got) == len(rows())
    store, of = {}, {}
    for _, raw, _ in rows():
        if raw is not None:
            ends = slow_cuts(raw, **SIZES)
            of[M.digest(raw)] = [M.digest(raw[a:b]) for a, b in zip([0, *ends], ends)]
            store |= {M.digest(raw[a:b]): raw[a:b] for a, b in zip([0, *ends], ends)}
    for r in got:
        if r.media is None:
            assert (r.doc_id, r.chunks, r.verified, r.n_bytes) == (40, None, None, None)
        else:
            assert r.verified is True and [bytes(c) for c in r.chunks] == of[bytes(r.media)]
            assert b"".join(store[bytes(c)] for c in r.chunks) in {x for _, x, _ in rows()}
    new = {bytes(r.media): (r.n_new, r.new_bytes) for r in got if r.media is not None}
    assert sum(n for n, _ in new.values()) == len(store) and sum(n for _, n in new.values()) == sum(map(len, store.values()))
    assert M.media(df.limit(0), "blob").count() == 0
    with pytest.raises(ValueError):
        M.media(df, "blob", least=8)


def test_rebuild_finds_what_is_wrong(spark):
    raw = random.Random(4).randbytes(4000)
    full = spark.createDataFrame([(M.digest(raw), raw)], "media binary, payload binary")
    lists = M.chunk_lists(full, **SIZES)
    pieces = [(bytes(r.digest), raw[r.start : r.start + r.size]) for r in lists.collect()]
    back = M.rebuild(lists, spark.createDataFrame(pieces, "digest binary, bytes binary")).first()
    assert back.verified and bytes(back.payload) == raw
    for wrong in (pieces[1:], [(pieces[0][0], b"x"), *pieces[1:]]):
        assert not M.rebuild(lists, spark.createDataFrame(wrong, "digest binary, bytes binary")).first().verified
