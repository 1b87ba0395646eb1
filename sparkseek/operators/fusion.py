"""Reciprocal rank fusion, and hybrid search by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.config import Metric, at_least
from sparkseek.functions.analyze import Analyzer
from sparkseek.operators.bm25 import text_search
from sparkseek.operators.knn import best, nearest

RRF_K = 60


def fuse(rankings: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Rankings (qid, list_idx, rank, key): each occurrence adds 1 / (k + rank), in 32 bits and list order; ties go to what is seen first."""
    at_least("limit", limit)
    at_least("k", k)
    seen = F.sort_array(F.collect_list(F.struct("list_idx", "rank")))
    total = F.aggregate("seen", F.lit(0).cast("float"), lambda s, x: s + (F.lit(1.0) / (F.lit(k) + x["rank"])).cast("float"))
    rows = rankings.groupBy("qid", "key").agg(seen.alias("seen")).select("qid", "key", total.alias("score"), F.col("seen")[0].alias("first"))
    return best(rows, limit, F.col("first")).drop("first")


def hybrid_search(rows: DataFrame, queries: DataFrame, k: int, candidates: int | None = None, metric: Metric = Metric.COSINE, analyzer: Analyzer | None = None, where: Column | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """rows (key, vector, text, ...), queries (qid, query, text): both searches under one filter, vector hits first in the fusion."""
    at_least("k", k)
    n = max(4 * k, 50) if candidates is None else at_least("candidates", candidates)
    allowed = None if where is None else rows.where(F.coalesce(where, F.lit(False)))
    near = nearest(rows, queries, n, metric, where)
    found = text_search(rows, queries, n, analyzer, where=allowed)
    lists = [r.select("qid", F.lit(i).alias("list_idx"), "rank", "key") for i, r in enumerate((near, found))]
    return fuse(reduce(DataFrame.unionByName, lists), k, rrf_k)
