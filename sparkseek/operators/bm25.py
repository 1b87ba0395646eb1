"""BM25 over documents (key, text) for batches of text queries (qid, text).

Statistics cover all documents, whatever a filter leaves. One pass over the texts gives a row for each document, of the numbers of the query terms
that it has; these rows, without the texts, are exchanged by key, and all statistics and scores come from them. A task scores its documents
for all queries of a block and keeps k of each query; only these are exchanged. Contributions are summed as whole multiples of 1 / UNIT,
so that scores don't depend on partitioning.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.config import Bm25Config, at_least
from sparkseek.functions.analyze import Analyzer, standard
from sparkseek.operators import kernel
from sparkseek.operators.knn import best, spread

BLOCK_QUERIES, TOKENS, CELLS, UNIT = 20_000, 1 << 19, 1 << 20, float(1 << 48)


def analyzed(docs: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    return spread(docs.select("key", "text")).select("key", (analyzer or standard())(F.col("text")).alias("terms"))


def term_frequencies(docs: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """(key, term, tf, dl)."""
    rows = analyzed(docs, analyzer).select("key", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("key", "dl", "term").agg(F.count("*").alias("tf")).select("key", "term", "tf", "dl")


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """One row (n, avgdl); documents without terms count, avgdl is 1 where there are no terms at all."""
    own = analyzed(docs, analyzer).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("total"))
    return own.select("n", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(F.lit(1.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _cuts(sizes: np.ndarray, most: int, rows: int) -> list[tuple[int, int]]:
    """Ranges of rows, of `most` in size and `rows` in number at most where they have more than one row."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        end = min(max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")), at + 1), at + rows)
        out.append((at, min(end, len(sizes))))
        at = out[-1][1]
    return out


def _numbers(shared):
    """For mapInArrow over (key, terms): (key, dl, ids, tfs), the numbers of known terms and how often each is there. shared: broadcast of all terms."""

    def run(batches):
        for b in batches:
            sizes = b["terms"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, end in _cuts(sizes, TOKENS, len(sizes)):
                part, n = b.slice(at, end - at), len(shared.value)
                found = pc.index_in(part["terms"].flatten(), value_set=shared.value).fill_null(-1).to_numpy(zero_copy_only=False)
                known = found >= 0
                pairs, tfs = np.unique(np.repeat(np.arange(end - at), sizes[at:end])[known] * n + found[known], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(end - at + 1) * n), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % n, tfs)]
                yield pa.RecordBatch.from_arrays([part["key"], pa.array(sizes[at:end], pa.int32()), *lists], ["key", "dl", "ids", "tfs"])

    return run


def _searcher(shared, k: int):
    """For mapInArrow over (key, ids, parts): (qid, key, score), the k best of each query in the task. shared: broadcast (qids, ends, queries), where
    queries[ends[i] : ends[i + 1]] have term i."""

    def run(batches):
        qids, ends, which = shared.value
        n, t, floor = len(qids), None, None
        for b in batches:
            docs = pa.Table.from_batches([b]).sort_by("key").combine_chunks()
            ids, parts = docs["ids"].combine_chunks(), docs["parts"].combine_chunks()
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
            ids, parts = (x.flatten().to_numpy(zero_copy_only=False) for x in (ids, parts))
            counts, starts = (ends[ids + 1] - ends[ids]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])
            pool = kernel.Pool(n, k, floor)
            for at, end in _cuts(np.diff(np.concatenate([[0], np.cumsum(counts)])[starts]), CELLS, max(CELLS // n, 1)):
                own = slice(starts[at], starts[end])
                c = counts[own]
                where = np.arange(c.sum()) + np.repeat(ends[ids[own]] - (np.cumsum(c) - c), c)
                cell, p = np.repeat(np.repeat(np.arange(end - at), sizes[at:end]), c) * n + which[where], np.repeat(parts[own], c)
                # 64-bit floats add whole numbers of this size exactly
                high, low = (np.bincount(cell, x, (end - at) * n).astype(np.int64) for x in (p >> 24, p & 0xFFFFFF))
                score = (((high << 24) + low) / UNIT).astype(np.float32)
                seen = np.bincount(cell, minlength=(end - at) * n) > 0
                i = np.flatnonzero(seen & (kernel.order(score).reshape(-1, n) >= pool.floor).ravel())
                pool.offer(i % n, i // n + at, score[i])
            q, c, s = pool.rows()
            found = pa.table({"q": q, "key": docs["key"].take(pa.array(c)), "score": pa.array(s, pa.float32())})
            t = kernel.ranked([found] if t is None else [t.drop_columns("rank"), found], k, ["key"])
            floor = kernel.floors(t, n, k)
        if t is not None:
            yield from pa.table({"qid": qids.take(t["q"].combine_chunks()), "key": t["key"], "score": t["score"]}).to_batches()

    return run


def text_search(docs: DataFrame, queries: DataFrame, k: int, analyzer: Analyzer | None = None, config: Bm25Config = Bm25Config(), where: DataFrame | None = None) -> DataFrame:
    """(qid, key, score, rank); a query without terms, or of unknown ones, has no rows. where: the keys that may be results. Queries come to the
    driver, all of the same qid count as one."""
    at_least("k", k)
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("key", docs.schema["key"].dataType), T.StructField("score", T.FloatType())])
    asked = queries.select(F.col("qid"), (analyzer or standard())(F.col("text")).alias("terms")).select("qid", F.explode("terms").alias("term")).distinct().toArrow().combine_chunks()
    if not len(asked):
        return best(spark.createDataFrame([], schema), k)
    qids, terms = (asked[c].combine_chunks().dictionary_encode("encode") for c in ("qid", "term"))
    number, term = (x.indices.to_numpy().astype(np.int64) for x in (qids, terms))
    n = len(terms.dictionary)

    kind = T.StructType([docs.select("key").schema[0], *(T.StructField(c, t) for c, t in (("dl", T.IntegerType()), ("ids", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.IntegerType()))))])
    rows = analyzed(docs, analyzer).mapInArrow(_numbers(spark.sparkContext.broadcast(terms.dictionary)), kind).withColumn("id", F.struct("key")).repartition("id")
    # texts of one key: those of the same number of terms are one text of copies
    def merged(d: Column, dl: Column) -> Column:
        own = F.filter(d, lambda x: x["dl"] == dl)
        ids, tfs = F.flatten(F.transform(own, lambda x: x["ids"])), F.flatten(F.transform(own, lambda x: x["tfs"]))
        count = lambda i: F.aggregate(F.zip_with(ids, tfs, lambda x, y: F.when(x == i, y).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return F.struct(dl.alias("dl"), F.size(own).alias("copies"), F.array_distinct(ids).alias("ids"), F.transform(F.array_distinct(ids), count).alias("tfs"))

    d = F.col("d")
    rows = rows.groupBy("id").agg(F.collect_list(F.struct("dl", F.lit(1).alias("copies"), "ids", "tfs")).alias("d"))
    rows = rows.select("id", F.when(F.size(d) == 1, d).otherwise(F.transform(F.array_distinct(F.transform(d, lambda x: x["dl"])), lambda dl: merged(d, dl))).alias("d"))

    # -1 is a term that all documents have
    counted = rows.select(F.explode("d").alias("d")).select("d.dl", "d.copies", F.explode(F.concat("d.ids", F.array(F.lit(-1)))).alias("id"))
    counted = counted.groupBy("id").agg(F.sum(F.when(F.col("id") < 0, F.col("copies")).otherwise(1)).alias("df"), F.sum(F.col("dl").cast("bigint") * F.col("copies")).alias("length"))
    every = lambda c: F.max(F.when(F.col("id") < 0, F.col(c)))
    every = counted.agg(every("df").alias("n"), every("length").alias("total"))
    every = every.select("n", F.when(F.col("total") > 0, F.col("total") / F.col("n")).otherwise(F.lit(1.0)).alias("avgdl"))
    stats = spark.range(n).select(F.col("id").cast("int").alias("id")).join(counted, "id", "left").crossJoin(F.broadcast(every))  # one row
    stats = stats.select("avgdl", F.struct("id", idf(F.col("n"), F.coalesce("df", F.lit(0))).alias("idf")).alias("idf")).groupBy("avgdl").agg(F.sort_array(F.collect_list("idf"))["idf"].alias("idf"))

    k1, b = F.lit(config.k1), F.lit(config.b)
    part = lambda dl, i, tf: F.get(F.col("idf"), i) * (tf * (k1 + 1.0)) / (tf + k1 * (F.lit(1.0) - b + b * dl / F.col("avgdl")))
    parts = lambda x: F.zip_with(x["ids"], x["tfs"], lambda i, tf: F.round(part(x["dl"], i, tf) * F.lit(UNIT)).cast("bigint"))
    # no semi-join and no key that may be null: either would be filtered below the exchange, so that the texts were read for it again
    own = rows if where is None else rows.join(where.select(F.struct("key").alias("id")).distinct(), "id")
    own = own.crossJoin(F.broadcast(stats)).select("id.key", F.flatten(F.transform(d, lambda x: x["ids"])).alias("ids"), F.flatten(F.transform(d, parts)).alias("parts"))
    found = []
    for at in range(0, len(qids.dictionary), BLOCK_QUERIES):
        mine = (number >= at) & (number < at + BLOCK_QUERIES)
        order = np.argsort(term[mine], kind="stable")
        shared = spark.sparkContext.broadcast((qids.dictionary.slice(at, BLOCK_QUERIES), np.searchsorted(term[mine][order], np.arange(n + 1)), number[mine][order] - at))
        found.append(own.mapInArrow(_searcher(shared, k), schema))
    return best(reduce(DataFrame.unionByName, found), k)
