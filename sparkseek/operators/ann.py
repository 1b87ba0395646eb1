"""Approximate nearest neighbours: inverted lists by k-means, and layered graphs in shards.

Both return (qid, key, score, rank) with scores of prepared vectors, so for cosine and dot product larger is closer. A
query's result is merged over lists or shards; with `probes` of all lists, or one shard of few vectors, it is exact.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.config import GraphConfig, Metric, at_least
from sparkseek.functions import vectors as V
from sparkseek.operators import kernel
from sparkseek.operators.knn import TASK_QUERIES, best, search_by_queries


def centroids(vectors: DataFrame, lists: int, metric: Metric = Metric.COSINE, seed: int = 42) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    own = vectors.select(array_to_vector(V.prepared(F.col("vector"), metric).cast("array<double>")).alias("features"))
    return np.array(KMeans(k=at_least("lists", lists), seed=seed, maxIter=10).fit(own).clusterCenters(), np.float32)


def _lists(df: DataFrame, centers: np.ndarray, column: str, probes: int) -> DataFrame:
    """df with the nearest lists of each row; rows without a vector are left out."""
    shared = df.sparkSession.sparkContext.broadcast(centers)  # lists x dimensions floats

    def near(column: pa.Array) -> pa.Array:
        c = shared.value
        v = kernel.matrix(column, c.shape[1])
        d = (c * c).sum(axis=1)[None, :] - 2 * v @ c.T
        return pa.array(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)), pa.list_(pa.int32()))

    return df.where(F.col(column).isNotNull()).withColumn("lists", F.arrow_udf(near, "array<int>")(column))


def ivf_index(vectors: DataFrame, centers: np.ndarray, metric: Metric = Metric.COSINE) -> DataFrame:
    """(key, v, list_id); written with partitionBy("list_id"), a search reads the probed lists only."""
    return _lists(vectors.select("key", V.prepared(F.col("vector"), metric).alias("v")), centers, "v", 1).select("key", "v", F.col("lists")[0].alias("list_id"))


def ivf_search(index: DataFrame, centers: np.ndarray, queries: DataFrame, k: int, probes: int, metric: Metric = Metric.COSINE) -> DataFrame:
    """As knn.nearest for many queries, of whose pairs only those in the probed lists are scored."""
    asked = _lists(queries.select("qid", V.prepared(F.col("query"), metric).alias("q")), centers, "q", at_least("probes", probes))
    return search_by_queries(index, asked, queries.count(), kernel.Search(kernel.Form(metric), at_least("k", k), centers.shape[1], lists=True))


class Graph:
    """Layers of links between near vectors; inserts and searches descend from the top."""

    def __init__(self, dimensions: int, metric: Metric, config: GraphConfig):
        self.metric, self.config = metric, config
        self.random = np.random.default_rng(config.seed)
        self.data, self.links, self.top, self.entry = np.zeros((0, dimensions), np.float32), [], -1, -1
        self.count = 0

    def far(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        v = self.data[ids]
        return np.sqrt(((v - q) ** 2).sum(axis=1)) if self.metric is Metric.EUCLIDEAN else -(v @ q)

    def beam(self, q: np.ndarray, start: list[int], ef: int, layer: int, accept=None) -> list[tuple[float, int]]:
        """The ef nearest acceptable nodes that are found, nearest first; others are passed through."""
        seen = set(start)
        frontier = list(zip(self.far(q, start).tolist(), start))
        heapq.heapify(frontier)
        found = [(-d, i) for d, i in frontier if accept is None or accept[i]]
        heapq.heapify(found)
        while frontier:
            d, i = heapq.heappop(frontier)
            if len(found) >= ef and d > -found[0][0]:
                break
            new = [j for j in self.links[i][layer] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for dj, j in zip(self.far(q, new).tolist(), new):
                if len(found) < ef or dj < -found[0][0]:
                    heapq.heappush(frontier, (dj, j))
                    if accept is None or accept[j]:
                        heapq.heappush(found, (-dj, j))
                        if len(found) > ef:
                            heapq.heappop(found)
        return sorted((-d, i) for d, i in found)

    def spread(self, near: list[tuple[float, int]], m: int) -> list[int]:
        """Up to m of these: first those nearer to the base than to any chosen, then the nearest of the rest."""
        chosen: list[int] = []
        rest = []
        for d, i in near:
            if len(chosen) >= m:
                break
            if not chosen or d < self.far(self.data[i], chosen).min():
                chosen.append(i)
            else:
                rest.append(i)
        return chosen + rest[: m - len(chosen)]

    def add_all(self, data: np.ndarray) -> None:
        self.data = data
        for i in range(len(data)):
            level = int(-math.log(1.0 - self.random.random()) / math.log(self.config.m))
            self.links.append([[] for _ in range(level + 1)])
            if self.entry < 0:
                self.entry, self.top = i, level
                continue
            at = [self.entry]
            for layer in range(self.top, level, -1):
                at = [self.beam(data[i], at, 1, layer)[0][1]]
            for layer in range(min(level, self.top), -1, -1):
                near = self.beam(data[i], at, self.config.ef_construction, layer)
                self.links[i][layer] = self.spread(near, self.config.m)
                for j in self.links[i][layer]:
                    own = self.links[j][layer]
                    own.append(i)
                    most = self.config.m * (1 if layer else 2)
                    if len(own) > most:
                        self.links[j][layer] = self.spread(sorted(zip(self.far(data[j], own).tolist(), own)), most)
                at = [n for _, n in near]
            if level > self.top:
                self.entry, self.top = i, level

    def search(self, q: np.ndarray, k: int, ef: int, accept=None) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(self.top, 0, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        return self.beam(q, at, max(ef, k), 0, accept)[:k]


PIECE = 32 << 20  # bytes of a graph in a row


def graph_search(vectors: DataFrame, queries: DataFrame, k: int, shards: int = 8, metric: Metric = Metric.COSINE, config: GraphConfig = GraphConfig(), ef: int | None = None, accept: str | None = None) -> DataFrame:
    """A graph per shard of keys, inserted in key order; every shard answers every query. accept: a boolean column of vectors; the others stay in
    the graph as ways only. A shard's graph is built once and goes to the groups of queries, each of which has a task per shard."""
    at_least("k", k)
    at_least("shards", shards)
    asked = queries.where("query is not null").select("qid", V.prepared(F.col("query"), metric).alias("q"))
    groups = max(-(-2 * vectors.sparkSession.sparkContext.defaultParallelism // shards), -(-asked.count() // TASK_QUERIES))
    own = vectors.where("vector is not null").select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", V.prepared(F.col("vector"), metric).alias("v"), (F.lit(True) if accept is None else F.coalesce(F.col(accept), F.lit(False))).alias("ok"))

    def build(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by("key").combine_chunks()
        v = t["v"].combine_chunks()
        g = Graph(len(v[0]), metric, config)
        g.add_all(kernel.matrix(v, len(v[0])))
        whole = pickle.dumps((g, t["key"].combine_chunks(), t["ok"].to_pylist()))
        for i, at in enumerate(range(0, len(whole), PIECE)):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "number": pa.array([i], pa.int32()), "piece": pa.array([whole[at : at + PIECE]], pa.binary())})

    def answer(batches):
        pieces, rows = [], []
        for b in batches:
            t = pa.Table.from_batches([b])
            pieces += zip(t["number"].drop_null().to_pylist(), t["piece"].drop_null().to_pylist())
            rows.append(t.filter(pa.compute.is_null(t["number"])).select(["qid", "q"]))
        if not pieces:
            return
        g, keys, ok = pickle.loads(b"".join(p for _, p in sorted(pieces)))
        asked = pa.concat_tables(rows).combine_chunks()
        if not len(asked):
            return
        found = [(i, j, -d) for i, q in enumerate(kernel.matrix(asked["q"].combine_chunks(), g.data.shape[1])) for d, j in g.search(q, k, ef or config.ef_search, ok)]
        i, j, s = zip(*found) if found else ((), (), ())
        yield from pa.table({"qid": asked["qid"].take(pa.array(i, pa.int64())), "key": keys.take(pa.array(j, pa.int64())), "score": pa.array(s, pa.float32())}).to_batches()

    graphs = own.repartitionById(shards, F.col("shard")).mapInArrow(build, "shard int, number int, piece binary")
    graphs = graphs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "number", "piece")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("group"), "qid", "q")
    both = graphs.unionByName(asked, allowMissingColumns=True).repartitionById(shards * groups, F.col("shard") * groups + F.col("group"))
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("key", vectors.schema["key"].dataType), T.StructField("score", T.FloatType())])
    return best(both.mapInArrow(answer, schema), k)
