import random

import pytest

from sparkseek.llm import toxicity as T


def brute(text, lexicon, exceptions=()):
    """Each place and pattern compared letter by letter; for texts in ASCII."""
    same = {"1": "il", "!": "il", "|": "il", "0": "o", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t"}
    fits = lambda c, p: c.lower() == p or p in same.get(c, "") or c.isspace() and p == " "

    def places(p):
        n = len(p)
        return [i for i in range(len(text) - n + 1) if all(map(fits, text[i : i + n], p)) and not (i and text[i - 1].isalnum()) and not (i + n < len(text) and text[i + n].isalnum())]

    covers = [(i, i + len(e)) for e in exceptions for i in places(e)]
    hits = [(i, i + len(p), x) for p, x in T.inflected(lexicon).items() for i in places(p)]
    hits = [h for h in hits if not (any(a <= h[0] < b for a, b in covers) and any(a < h[1] <= b for a, b in covers))]
    hits = [h for h in hits if not any(o[1] == h[1] and o[0] < h[0] for o in hits)]
    hits = [h for h in hits if not any(o[0] == h[0] and o[1] > h[1] for o in hits)]
    return len(hits), sum(h[2] for h in hits)


def test_against_brute_force(spark):
    rng = random.Random(5)
    lexicon, exceptions = {"idiot": 1.5, "scum": 1.0, "clown": 1.0, "drop dead": 2.0, "liar": 1.0}, ("class clown", "pond scum")
    words = ["idiot", "1d10t", "IDIOT!!", "scum", "5cum", "pond", "class", "clown", "c1own", "clowns", "drop", "dead", "llar", "liar", "l1ar", "the", "scumble", "idiot's", "clown$$$", "re", "\n"]
    texts = ["", " ", "idiot", *(rng.choice([" ", "\n", ", "]).join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(150))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in T.toxicity(df, lexicon=lexicon, exceptions=exceptions).collect()}
    for i, t in enumerate(texts):
        hits, weight = brute(t, lexicon, exceptions)
        assert got[i].toxic_hits == hits, t
        assert got[i].toxic_score == pytest.approx(100 * weight / max(got[i].toxic_words, T.MIN_WORDS), abs=1e-5)


def test_homoglyphs_and_marks():
    a, _ = T.automaton(tuple(T.LEXICON.items()), T.EXCEPTIONS)
    for s in ["іdіоt", "ｉｄｉｏｔ", "id́iot", "mo​ron", "𝐢𝐝𝐢𝐨𝐭", "tr@5h", "WORTHLE55", "c|own"]:
        assert len(T.matches(*T.folded(s), a)[0]) == 1, s
    for s in ["llar", "mormoron", "scumble", "trash can", "idio t", "日本語", "😀"]:
        assert len(T.matches(*T.folded(s), a)[0]) == 0, s


def test_edges(spark):
    long = "word " * 60_000 + "idiot " * 3000
    rows = [(1, None, "x"), (1, None, "x"), (None, "you idiot", "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (4, "clean text here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    got = T.toxicity(df).collect()
    assert len(got) == 7
    by = {r.doc_id: r for r in got}
    assert (by[1].toxic, by[1].toxic_score, by[1].toxic_words) == (False, 0.0, 0)
    assert by[None].toxic and not by[2].toxic and not by[4].toxic
    assert by[3].toxic_hits == 3000 and by[3].toxic
    assert T.toxicity(df.limit(0)).count() == 0
    assert T.toxicity(df, lexicon={}, exceptions=()).where("toxic").count() == 0
    assert T.toxicity(df.withColumn("__other", df.text)).columns == ["doc_id", "text", "toxic", "__other", "toxic_words", "toxic_hits", "toxic_score"]


def test_planted(spark):
    got = T.toxicity(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("toxic", "label"), "doc_id")
    assert got.where("toxic and label = 0").count() <= 3
    assert got.where("toxic and label = 1").count() >= 25


def test_stems():
    a, _ = T.automaton((("boment*", 1.0), ("bomen", 2.0)), ())
    assert [T.matches(*T.folded(s), a)[1].tolist() for s in ("bomen", "bomenta", "bómentaré boment!", "abomenta", "bomens", "bomer")] == [[2.0], [1.0], [1.0, 1.0], [], [2.0], []]


def test_recall_by_language_on_rows_not_learned_from(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lexicon = T.learned(documents, labels.where("doc_id % 2 = 0"))
    got = T.toxicity(documents.where("doc_id % 2 = 1"), lexicon=lexicon).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    rates = {r.lang: r for r in got.groupBy("lang").agg(*(T.F.expr(f"avg(case when label = {y} then int(toxic) end) r{y}") for y in (0, 1))).collect()}
    assert set(rates) == {"en", "de", "fr", "es"}
    for r in rates.values():
        assert r.r1 >= 0.85 and r.r0 <= 0.035, r
