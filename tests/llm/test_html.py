import random
from collections import defaultdict
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import html as X

WINDOW, GRAM = 8, 4


def address(page):
    i, url, html = page
    parts = urlsplit(url or "")
    return (parts.hostname, parts.path.rstrip("/"), parts.query) if parts.hostname else (i, html)


def brute(pages, window=WINDOW, least=2):
    """pages: distinct (id, url, html), each url without anything but host, path and query. Text and number of removed words of each."""
    on = defaultdict(set)
    streams = [(i, urlsplit(u or "").hostname or "", X.tokens(h)) for i, (_, u, h) in enumerate(pages)]
    for i, host, s in streams:
        for p in range(len(s) - window + 1):
            on[host, tuple(s[p : p + window])].add(address(pages[i]))
    out = []
    for _, host, s in streams:
        gone = set()
        for p in range(len(s) - window + 1):
            if len(on[host, tuple(s[p : p + window])]) >= least:
                gone.update(range(p, p + window))
        out.append((X.readable([X.BREAK if k in gone else t for k, t in enumerate(s)]), sum(t[0] != X.BREAK for k, t in enumerate(s) if k in gone)))
    return out


def pages(seed=2, n=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)] + ["&eacute;t&eacute;", "a&amp;b"]
    words = lambda a, b: " ".join(rng.choices(vocabulary, k=rng.randint(a, b)))
    navs = ["<nav><ul>" + "".join(f"<li><a href='/{i}'>{words(1, 2)}</a></li>" for i in range(6)) + "</ul></nav>" for _ in range(4)]
    foots = [f"<footer>{words(9, 15)}</footer>" for _ in range(4)]
    shared, out = words(30, 40), []
    for i in range(n):
        h = rng.choice([0, 0, 0, 1, 2, 3])
        body = "".join(f"<p>{words(0, 30)} <b>{words(1, 3)}</b>x" for _ in range(rng.randint(0, 5)))
        if i % 7 == 0:
            body += f"<p>{words(1, 5)} {shared} {words(1, 5)}</p>"
        out.append((i, rng.choice([f"http://h{h}.example.com/{i}", f"https://H{h}.example.com:80/?q={i}"]), f"<html><head><title>t</title></head><body><script>x</script>{navs[h]}<!-- c -->{body}{foots[h]}</body>"))
    return out


def test_shortened_hashes():
    h = np.random.default_rng(1).integers(0, 1 << 63, 101).astype(np.uint64)
    for width in (6, 7, 10):
        for n in (0, 1, 2, 101):
            assert (X._lengthened(X._shortened(h[:n], width), n, width) == h[:n] & np.uint64((1 << 4 * width) - 1)).all()


def test_cuts_of_a_page_are_united():
    rng = np.random.default_rng(2)
    page, first = rng.integers(-5, 5, 400) << 40, rng.choice([0, 1, 127, 128, 300, 16_384, 1 << 22, 1 << 31], 400) + rng.integers(0, 60, 400)
    end = first + rng.integers(1, 200, 400)
    for n in (0, 1, 400):
        pid, cuts = X._cuts(page[:n], first[:n], end[:n])
        got = {}
        for p, raw in zip(pid.tolist(), cuts.to_pylist()):
            values, ends = X._numbers(np.frombuffer(raw, np.uint8))
            assert ends[-1] == len(raw) and p not in got
            spans = list(zip(values[::2].tolist(), (values[::2] + values[1::2]).tolist()))
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))
            got[p] = {k for a, b in spans for k in range(a, b)}
        expected = defaultdict(set)
        for p, a, b in zip(page[:n].tolist(), first[:n].tolist(), end[:n].tolist()):
            expected[p].update(range(a, b))
        assert got == expected


def test_an_anchor_that_a_page_repeats_is_sent_once():
    codec = X.Codec()
    streams = [b" ".join([b"a b c d e f g h"] * 50), b"a b c d e f g h i j", b""]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array([1, 1, 1]), pa.array([2, 3, 4]), codec.pack(streams)], names=["pid", "host", "address", "z"])
    _, h, row, _ = X._anchors(codec, batch, WINDOW, GRAM)
    sent = [X.unpack(r["block"]) for out in X._packed(codec, WINDOW, GRAM, 3, 7)([batch]) for r in out.to_pylist()]
    assert sum(int(X._wide(counts).sum()) for _, counts, _ in sent) == len(set(zip(h.tolist(), row.tolist()))) < len(h)


def test_tokens():
    t = X.tokens("<!DOCTYPE html><head><title>no</title></head><style>p{}</style><p class='a>b'>x&lt;y <b>z</b>w<br/>1 < 2</P><script>var t='</p>';</script><!-- <p> -->é\x02")
    assert t == ["\x02p", "x<y", "zw", "\x02br", "1", "<", "2", "\x02/p", "é"]
    assert X.tokens("") == X.tokens("<!-- open") == X.tokens("<script>open") == [] and X.tokens("<") == ["<"]
    assert X.readable(t) == "x<y zw\n1 < 2\né"
    assert X.tokens("<a href=\"open>text") == ["text"] or X.tokens("<a href=\"open>text") == []


@pytest.mark.parametrize("entries", [50, 100_000])
def test_against_brute_force(spark, monkeypatch, entries):
    monkeypatch.setattr(X, "RUN_BYTES", 500 * entries)
    own = pages()
    df = spark.createDataFrame(own, "page_id long, url string, html string").repartition(4)
    for least in (2, 4):
        got = {r.page_id: (r.text, r.n_removed) for r in X.extract(df, window=WINDOW, gram=GRAM, pages=least).collect()}
        expected = brute(own, least=least)
        assert sum(n for _, n in expected) > 200
        for (i, _, _), e in zip(own, expected):
            assert got[i] == e


def test_edges(spark):
    foot = "<p>" + " ".join(f"w{i}" for i in range(20)) + "</p>"
    long = " ".join(f"u{i}" for i in range(40_000))
    rows = [(1, None, None, 0), (2, None, "", 0), (3, "http://a/", foot, 0), (3, "http://a/", foot, 0), (4, "http://b/", foot + "mine", 0), (5, "not a url", foot + "own", 0), (None, None, foot + "other", 0), (6, "http://c/x", long, 0), (7, "http://c/", long + " tail", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = X.extract(df, window=WINDOW, gram=GRAM)
    assert out.columns == ["page_id", "url", "text", "n_words", "n_removed"]
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == {1: None, 2: "", 3: " ".join(f"w{i}" for i in range(20)), 4: " ".join(f"w{i}" for i in range(20)) + "\nmine", 5: "own", None: "other", 6: "", 7: "tail"}
    assert X.extract(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        X.extract(df, window=4, gram=5)


def test_variants_of_an_address_and_two_hosts(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(30))
    urls = ["http://h.org/a/b/", "https://H.org/a/b?utm_source=x", "https://h.org/a/b#part", "https://h.org/a/b?ref=1&utm_medium=2"]
    rows = [(i, u, f"<p>{words('w')}</p>") for i, u in enumerate(urls)]
    rows += [(10, "http://h.org/a/b?page=2", f"<p>{words('x')}</p>"), (11, "http://h.org/a/b?page=3", f"<p>{words('x')}</p>")]
    rows += [(20, "http://one.org/", f"<p>{words('y')}</p>"), (20, "http://two.org/", f"<p>{words('y')}</p>"), (21, "http://two.org/z", f"<p>{words('y')}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"pid": F.lit(1), "host": F.lit("h"), "z": F.lit(2.0)})
    out = X.extract(df)
    assert out.columns == ["page_id", "url", "pid", "host", "z", "text", "n_words", "n_removed"]
    got = {(r.page_id, r.url): r.text for r in out.collect()}
    assert all(got[i, u] == words("w") for i, u in enumerate(urls))
    assert got[10, rows[4][1]] == got[11, rows[5][1]] == "" == got[20, "http://two.org/"] == got[21, "http://two.org/z"]
    assert got[20, "http://one.org/"] == words("y")


def test_short_footer_with_production_parameters(spark):
    article = lambda i: "".join(f"<p>{' '.join(f'a{i}x{j}x{k}' for k in range(30))}</p>" for j in range(3))
    own = [(i, f"http://d.example.com/{i}", f"<body>{article(i)}<footer>(c) d.example.com . one two three four</footer></body>") for i in range(6)]
    df = spark.createDataFrame(own, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_removed) for r in X.extract(df).collect()}
    assert got == {i: (X.readable(X.tokens(article(i))), 7) for i in range(6)}
    assert [got[i] for i in range(6)] == brute(own, X.WINDOW)
