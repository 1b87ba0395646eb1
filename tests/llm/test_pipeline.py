import random
from collections import defaultdict

import corpus_pipeline as C
import tiktoken
from test_bpe import PATTERN
from test_near_dedup import edited, levenshtein
from test_packing import naive_pack
from test_suffix_dedup import brute

from sparkseek.llm import bpe as B
from sparkseek.llm import packing as P


def fixture(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "er", "on", "st") for b in ("in", "an", "ou", "re", "ti") for c in ("", "ed", "ly", "ing", "ea")]
    passages = [rng.choices(vocabulary, k=60) for _ in range(3)]
    docs, labels = [], []
    for i in range(160):
        words = rng.choices(vocabulary, k=rng.randint(30, 200))
        kind = i % 8
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = [w + "$$$" for w in words]
        elif kind == 3:
            at = rng.randrange(len(words))
            words[at:at] = passages[i % 3]
        elif kind == 4:
            words = [rng.choice(["idiot", "m0ron", "sсum"]) if rng.random() < 0.05 else w for w in words] + ["idiot", "stupid"]
        elif kind == 5 and i > 8:
            words = edited(rng, docs[i - 5][1].split(), vocabulary, 0.05)
        elif kind == 6 and i > 8:
            words = docs[i - 6][1].split()
        docs.append((i, " ".join(words), "en", "src0", 0))
        labels.append((i, int(kind not in (1, 2)), int(kind == 4)))
    docs.append((None, None, None, None, None))
    return docs, labels


def brute_pipeline(docs):
    """Quality and toxicity by what the fixture planted, the rest by exhaustive search."""
    own = [(d, t.split()) for d, t, *_ in docs if d is not None and d % 8 not in (1, 2, 4)]
    group = {}
    for d, words in own:
        near = {group[e] for e, other in own if e < d and min(len(words), len(other)) >= 0.8 * max(len(words), len(other)) and 1 - levenshtein(words, other) / max(len(words), len(other)) >= 0.8}
        group[d] = min(near | {d})
        group = {e: group[d] if g in near else g for e, g in group.items()}
    own = [(d, w) for d, w in own if group[d] == d]
    gone = brute(own, 50)
    own = {d: [w for i, w in enumerate(words) if i not in gone.get(d, ())] for d, words in own}
    return {d: w for d, w in own.items() if w}


def test_run_against_brute_force(spark, tmp_path):
    docs, labels = fixture()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, after = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = seen.columns
    for name, stage in C.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == columns, name
        after.append({r.doc_id for r in seen.collect()})
    assert after[0] == {i for i in range(160) if i % 8 not in (1, 2)}
    assert after[1] == {i for i in after[0] if i % 8 != 4}
    expected = brute_pipeline(docs)
    assert after[3] == set(expected)
    assert {r.doc_id: r.text.split() for r in seen.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in seen.collect())
    rows = C.run(spark, str(tmp_path)).collect()
    windows = defaultdict(int)
    for r in rows:
        windows[r.window_id] += r.n_tokens
    ranks = {t: i for i, t in enumerate(B.read_vocabulary(B.VOCABULARY)) if t}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = sorted((n for r in seen.collect() for _, n in P.cut(len(plain.encode_ordinary(r.text)) + 1, P.TIERS)), reverse=True)
    assert sorted(windows.values()) == sorted(sum(lengths[i] for i in p) for _, p in naive_pack(lengths, P.TIERS))
    assert {r.doc_id for r in rows} == set(expected)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    docs, labels = fixture()
    rng = random.Random(9)
    whole = {d: t for d, t, *_ in docs}
    long = " ".join(rng.choice(whole[8 * i].split()) for i in range(20) for _ in range(3000))
    more = [(1000, long, "en", None, None), (None, whole[8], None, None, None), (8, whole[8], "en", "src0", 0), (2000, "", "en", "s", 0), (2001, " \n ", None, "s", 0), (2002, None, "en", "s", 0), (None, long[:2000], None, None, None)]
    rows = [(*r, f"k{i}", i, None) for i, r in enumerate([*docs, *more])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, __digest int, n string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes, name
    got = seen.collect()
    assert all(r.key == f"k{r['__digest']}" for r in got) and not {2000, 2001, 2002} & {r.doc_id for r in got}
    assert sum(r.doc_id == 8 for r in got) == 1 and sum(r.doc_id is None for r in got) == 1
    assert len(next(r.text for r in got if r.doc_id == 1000).split()) > 50_000
    packed = C.STAGES[-1][1](spark, seen, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in got}
