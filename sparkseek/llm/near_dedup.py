"""Near-duplicates by Order MinHash: sketches that keep the text order of several minimum occurrence-labelled k-mers.

Each of M hash functions picks the ELL least of a text's k-mers of K words, each labelled with the number of its earlier
occurrences, and keeps them in text order (Marcais et al., 2019); texts that share a sketch share a bucket.  Pairs in a bucket
are verified by banded alignment of their words: similar means 1 - edit distance / longer length >= SIMILARITY.

Exact copies are one node from the start.  In each bucket all nodes are first held against one of them, so a bucket of n
copies costs n alignments.  While a bucket has several components, more of its nodes, in an order that all buckets share, are held
against all nodes of other components: about LEADERS of them, then GROWTH times as many each round, or all at once where few
pairs are left.  Of these, pairs whose word counts alone tell them apart (COUNTERS counts of hashed words, half the sum of whose differences the edit
distance can't be below) need no alignment.  So every pair that shares a bucket is verified or connected by others, and no bucket is capped or
skipped.  Groups are the connected components.

Nothing gathers a bucket, a group or the copies of a text in one task: what is known of each comes from an aggregation that begins
before its exchange, and goes back to the members by a join that can be split.

Defined results: of each group the row with the least (doc_id, text digest) stays (null ids count as largest), one row where rows repeat; null,
empty and blank texts aren't compared and all stay, each in its own group; texts shorter than K words have one k-mer; texts of any length are compared whole; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import within
from .components import components
from .shared import durable, small_batches, written
from .text import gram_hashes, lean, mix, parts, release, utf8, word_hashes

K, ELL, M, SIMILARITY = 3, 2, 32, 0.8
LEADERS, GROWTH, AT_ONCE, COUNTERS = 4, 8, 512, 256
_POSITION = np.uint64((1 << 24) - 1)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def kmers(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mer hashes of all rows in text order, and the rows' offsets into them."""
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(off[-1]) - off[row] + rows[row]
    grams = gram_hashes(words, k)
    own = np.zeros(len(at), np.uint64)
    whole = (n >= k)[row]
    own[whole] = grams[at[whole]]
    for r in np.flatnonzero((n > 0) & (n < k)):
        own[off[r]] = gram_hashes(words[rows[r] : rows[r + 1]], int(n[r]))[0]
    key = own ^ mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0)) if len(ranked) else np.zeros(0, np.int64)
    label = np.empty(len(own), np.uint64)
    label[order] = (np.arange(len(ranked)) - start).astype(np.uint64)
    return mix(own + label * np.uint64(0xD1B54A32D192ED03)), off


def sketches(words: np.ndarray, rows: np.ndarray, k: int = K, ell: int = ELL, m: int = M) -> np.ndarray:
    """(rows, m) sketches; those of rows without words are 0."""
    labelled, off = kmers(words, rows, k)
    out = np.zeros((len(rows) - 1, m), np.uint64)
    full = np.flatnonzero(np.diff(off) > 0)
    if not len(full):
        return out
    begin = off[:-1][full]
    counts = np.diff(off)[full]
    place = ((np.arange(len(labelled)) - np.repeat(begin, counts)).astype(np.uint64)) & _POSITION
    tame = int(counts.max()) <= int(_POSITION)
    odd = mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for j in range(m):
        h = labelled * odd[j]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        packed = (h & ~_POSITION) | place
        chosen = []
        for _ in range(ell):
            least = np.minimum.reduceat(packed, begin)
            at = begin + (least & _POSITION).astype(np.int64)
            chosen.append(np.where(least == _LAST, len(labelled), at))
            if tame:
                packed[at[least != _LAST]] = _LAST
            else:
                packed[packed == np.repeat(least, counts)] = _LAST
        order = np.sort(np.stack(chosen), axis=0)  # back into text order
        wide = np.append(labelled, np.uint64(0))
        s = np.full(len(full), odd[j], np.uint64)
        for at in order:
            s = mix(s * np.uint64(0x2545F4914F6CDD1D) + wide[at])
        out[full, j] = s
    return out


def bags_of(words: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """For each row COUNTERS counts of its words by hash, 255 standing for more; runs of zeros are left to the file's compression."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    got = np.bincount(row * COUNTERS + (words >> np.uint64(40)).astype(np.int64) % COUNTERS, minlength=n * COUNTERS)
    raw = np.minimum(got, 255).astype(np.uint8).tobytes()
    return [raw[i : i + COUNTERS] for i in range(0, n * COUNTERS, COUNTERS)]


def _apart_udf(similarity: float):
    """Whether the counts of two texts tell that they aren't similar: one edit changes the sum of differences by 2 at most."""

    def apart(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int16) for c in (a, b))
        most = np.floor((1 - similarity) * n.to_numpy(zero_copy_only=False) + 1e-9)
        return pa.array(np.abs(x - y).sum(axis=1, dtype=np.int64) > 2 * most)

    return F.arrow_udf(lean(apart), "boolean")


def _sketched(k: int, ell: int, m: int):
    """From (digest, text), one batch after the other: (digest, number of words, sketch, and, beside one sketch of each, the
    text's word counts) of its distinct texts."""

    def run(batches):
        for b in batches:
            halves = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, 2)
            _, which = np.unique(halves[:, 0] ^ mix(halves[:, 1].copy()), return_index=True)
            which = np.sort(which)
            data, off = utf8(b.column(1).take(pa.array(which)))
            own, counts, bags = np.zeros((len(which), m), np.uint64), np.zeros(len(which), np.int32), []
            for i, j, d, o in parts(data, off):
                words, _, _, rows = word_hashes(d, o)
                own[i:j] = sketches(words, rows, k, ell, m)
                counts[i:j] = np.diff(rows)
                bags += bags_of(words, rows)
            first = np.arange(len(which) * m) % m == 0
            spread = pa.array(bags, pa.binary()).take(pa.array(np.where(first, np.arange(len(which) * m) // m, 0), mask=~first))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(which, m))), pa.array(np.repeat(counts, m)), pa.array(own.reshape(-1).view(np.int64)), spread], names=["digest", "n", "sketch", "bag"])
        release()

    return run


def _similar_udf(similarity: float):
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        sides = []
        for column in (a, b):
            data, off = utf8(column)
            own: list[np.ndarray] = []
            for _, _, d, o in parts(data, off):
                words, _, _, rows = word_hashes(d, o)
                own += np.split(words, rows[1:-1])
            sides.append(own)
        return pa.array(within(list(zip(*sides)), similarity))

    return F.arrow_udf(lean(similar), "boolean")


def blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def _digest(text: Column, key: Column) -> Column:
    """16 bytes by text; blank texts, which are nobody's copies, get them by id, and spread."""
    return F.unhex(F.md5(F.when(blank(text), F.concat(F.lit("\0blank "), F.coalesce(key.cast("string"), F.lit("")))).otherwise(text)))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar. Only texts that occur in pairs travel."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    own = texts.join(needed, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    left = pairs.join(own.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(own.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b")
    return both.where(_similar_udf(similarity)("ta", "tb")).select("a", "b")


def linked(df: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, k: int = K, ell: int = ELL, m: int = M) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of text digests that hold each group together, and (node, root) of their components."""
    small_batches(df.sparkSession)
    own = df.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    own = own.where(~blank(F.col("text"))).select(_digest(F.col("text"), F.col("key")).alias("digest"), "text")
    rows = written(own.mapInArrow(_sketched(k, ell, m), "digest binary, n int, sketch long, bag binary"), "sketches")
    node = F.xxhash64("digest")
    shared = rows.groupBy("sketch").agg(F.min(node).alias("least"), F.max(node).alias("most")).where("least <> most").select("sketch", "least")
    buckets = durable(rows.drop("bag").join(shared, "sketch").dropDuplicates(["sketch", "digest"]).withColumn("leads", node == F.col("least")).drop("least"))
    fits = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - F.lit(1e-9)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    leaders = buckets.where("leads").select("sketch", F.col("digest").alias("leader"), F.col("n").alias("ln"))
    first = buckets.where("not leads").join(leaders, "sketch").where(fits("n", "ln")).select(*pair("leader", "digest")).distinct()
    edges = durable(_verified(first, own, similarity))
    tried, roots, done = first, components(edges), 0
    # of the nodes of a bucket, about the first `upto` in this order are within `upto`; sizes are the same in all rounds, as buckets stay or go as wholes
    place = F.pmod(F.xxhash64("digest"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("size")
    buckets = buckets.drop("leads")
    bags = None
    while True:
        placed = buckets.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
        alike = placed.groupBy("sketch", "root").agg(F.count("*").alias("alike"))
        apart = alike.groupBy("sketch").agg(F.sum("alike").alias("size"), F.max("alike").alias("most"), F.sum(F.col("alike") * F.col("alike")).alias("inner"))
        apart = apart.where("most < size").select("sketch", "size", (F.col("size") - F.col("inner") / F.col("size")).alias("cross"))
        buckets = durable(placed.join(apart, "sketch").withColumn("place", place))
        left = buckets.where(F.col("place") >= done)
        size, rows_, pairs = buckets.agg(F.max("size"), F.count("*"), F.sum("cross")).first()
        if not rows_ or size <= done:
            return edges, roots
        upto = size if pairs <= AT_ONCE * rows_ else max(LEADERS, GROWTH * done)
        x, y = left.where(F.col("place") < upto).alias("x"), left.alias("y")
        later = F.struct("x.place", "x.digest") < F.struct("y.place", "y.digest")
        rest = x.join(y, "sketch").where(later & F.expr("x.root <> y.root") & fits("x.n", "y.n")).select(*pair("x.digest", "y.digest")).distinct()
        rest = durable(rest.join(tried, ["a", "b"], "left_anti"))
        if bags is None:
            nodes = buckets.select("digest").distinct()
            bags = durable(rows.where("bag is not null").select("digest", "n", "bag").join(nodes, "digest", "left_semi").dropDuplicates(["digest"]))
        near = rest.join(bags.select(F.col("digest").alias("a"), F.col("n").alias("na"), F.col("bag").alias("x")), "a").join(bags.select(F.col("digest").alias("b"), F.col("n").alias("nb"), F.col("bag").alias("y")), "b")
        near = durable(near.where(~_apart_udf(similarity)("x", "y", F.greatest("na", "nb"))).select("a", "b"))
        more = durable(_verified(near, own, similarity))
        edges, tried, done = edges.unionByName(more), tried.unionByName(rest), upto
        if not more.isEmpty():
            roots = components(edges)
        if done >= size:
            return edges, roots
        buckets = buckets.select("sketch", "digest", "n")


def near_edges(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    return linked(df, text, key, **options)[0]


def near_groups(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """One row per distinct text: digest, its least key (null only if all are), the number of its rows, root of its component, the least key
    of its group, the group's number of rows, and stay, true for the digest of which a row stays."""
    own = df.select(F.col(text).cast("string").alias("text"), F.col(key).alias("key"))
    nodes = own.select("key", _digest(F.col("text"), F.col("key")).alias("digest")).groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n"))
    roots = linked(df, text, key, **options)[1]
    nodes = nodes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    groups = nodes.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("absent"), "key", "digest")).alias("least"), F.sum("n").alias("size"))
    return nodes.join(groups, "root").select("digest", "key", "n", "root", F.col("least.key").alias("group_id"), "size", (F.col("digest") == F.col("least.digest")).alias("stay"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """For every row its key, group_id (the least key of its group), group_size, and kept."""
    value = F.col(text).cast("string")
    rows = df.select(F.col(key).alias("key"), _digest(value, F.col(key)).alias("digest"), blank(value).alias("blank"))
    rows = rows.groupBy("digest", "key", "blank").agg(F.count("*").alias("copies"))
    full = rows.join(near_groups(df, text, key, **options).withColumnRenamed("key", "least"), "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("blank") | F.col("stay") & F.col("key").eqNullSafe(F.col("least")) & (F.col("copy") == 1)
    own = {"group_id": F.when(F.col("blank"), F.col("key")).otherwise(F.col("group_id")), "group_size": F.when(F.col("blank"), F.lit(1)).otherwise(F.col("size")), "kept": kept}
    return full.select(F.col("key").alias(key), *(c.alias(n) for n, c in own.items()))


def near_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of df that stay, with its columns. Of rows that repeat text and key the one with the least hash of the other columns stays."""
    stay = near_groups(df, text, key, **options).where("stay").select("digest", F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("key").isNull().alias("absent"))
    value, id_ = F.col(text).cast("string"), F.col(key)
    others = [F.col(f"`{c}`") for c in df.columns if c not in (text, key)]
    about = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    # a struct, so that no name clashes; copies of a text go to tasks by their keys
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"), _digest(value, id_).alias("digest"), F.coalesce(id_.cast("string"), F.lit("")).alias("key"), id_.isNull().alias("absent"), about.alias("about"), blank(value).alias("blank"))
    one = rows.where("not blank").join(stay, ["digest", "key", "absent"]).groupBy("digest", "key", "absent").agg(F.min_by("own", "about").alias("own"))
    both = one.select("own").unionByName(rows.where("blank").select("own"))
    return both.select(*(F.col("own").getField(c).alias(c) for c in df.columns))
