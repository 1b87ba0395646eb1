import math
import random

from sparkseek.llm import licenses as L


def brute(text, templates, rare=L.RARE, share=L.SHARE, slack=L.SLACK):
    """Every template against every place."""
    words, out = L.split(text), []
    own = L.Index(tuple(templates.items()), rare)
    for i, (name, (body, phrases)) in enumerate(templates.items()):
        body = L.split(body)
        chosen = sorted(set(body), key=lambda w: (-own.idf[w], w))[:rare]
        places = [q for q, w in enumerate(body) if w in chosen]
        found = []
        for b in range(-len(body), len(words)):
            near = {q for q in places for s in range(-slack, slack + 1) if 0 <= b + q + s < len(words) and words[b + q + s] == body[q]}
            exact = any(0 <= b + q < len(words) and words[b + q] == body[q] for q in places)
            if exact and len(near) >= math.ceil(share * len(places) - 1e-9):
                found.append((-len(near), b))
        taken = []
        for votes, b in sorted(found):
            stretch = " ".join(["", *words[max(b - slack, 0) : b + len(body) + slack], ""])
            if all(abs(b - c) >= len(body) for c in taken) and all(f" {' '.join(L.split(p))} " in stretch for p in phrases):
                taken.append(b)
                out.append((name, max(b, 0), -votes))
    return sorted(out, key=lambda f: (f[1], f[0]))


def texts(seed=4, n=80):
    rng = random.Random(seed)
    common = [w for t, _ in L.TEMPLATES.values() for w in L.split(t)] + ["été", "x1"]
    out = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(0, 60))
        for _ in range(i % 3):
            own = rng.choice(list(L.TEMPLATES.values()))[0].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                k = rng.randrange(len(own))
                own = rng.choice([own[:k] + own[k + 1 :], own[:k] + ["new"] + own[k:], own[:k] + ["New"] + own[k + 1 :]])
            words += own + rng.choices(common, k=rng.randint(0, 9))
        out.append(rng.choice([" ", ", ", "\n* "]).join(words))
    return out


def test_against_brute_force(spark):
    own = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string").repartition(3)
    got = {}
    for r in L.licenses(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.first_word, r.votes))
    assert sum(map(len, got.values())) > 40
    for i, t in enumerate(own):
        assert sorted(got.get(i, []), key=lambda f: (f[1], f[0])) == brute(t, L.TEMPLATES), t


def test_every_template_finds_itself_and_tells_versions(spark):
    df = spark.createDataFrame([(n, f"header words here {t}.") for n, (t, _) in L.TEMPLATES.items()], "name string, text string")
    found = {}
    for r in L.licenses(df).collect():
        found.setdefault(r.name, set()).add(r.license)
    assert all(n in found[n] for n in L.TEMPLATES)
    assert "GPL-2.0" not in found["GPL-3.0"] and "GPL-3.0-notice" not in found["GPL-2.0-notice"] and "GPL-3.0" not in found["AGPL-3.0"]
    assert found["CC-BY-NC-4.0-notice"] == {"CC-BY-NC-4.0-notice"}


def test_edges(spark):
    mit = "Released under the MIT License."
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (4, mit, 0), (4, mit, 0), (None, mit + " x" * 50_000 + " " + mit, 0), (5, "the mit license of released", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes int")
    out = L.licenses(df)
    assert out.columns == ["doc_id", "license", "first_word", "votes", "rare_words"]
    assert sorted((r.doc_id or 0, r.license, r.first_word) for r in out.collect()) == [(0, "MIT-notice", 0), (0, "MIT-notice", 50_005), (4, "MIT-notice", 0), (4, "MIT-notice", 0)]
    assert L.licenses(df.limit(0)).count() == 0 and L.licenses(df, templates={}).count() == 0
