"""Keyed tables: upsert, delete, membership. A new DataFrame for each change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, seq: str = "seq", key: str = "key") -> DataFrame:
    """Of each key the row written last."""
    w = W.partitionBy(key).orderBy(F.desc(seq))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(corpus: DataFrame, rows: DataFrame, seq: str | None = None, key: str = "key") -> DataFrame:
    """rows replace those of the same key, the last of a key by `seq` wins."""
    new = rows.dropDuplicates([key]) if seq is None else latest(rows, seq, key).drop(seq)
    return corpus.join(new.select(key), key, "left_anti").unionByName(new)


def delete(corpus: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return corpus.join(keys.select(key), key, "left_anti")


def contains(corpus: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """keys with `present`."""
    own = corpus.select(key).distinct().withColumn("present", F.lit(True))
    return keys.select(key).distinct().join(own, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def encode_key(column: str, kind: str):
    """Keys as bytes: UTF-8, or 4 or 8 bytes, big-endian."""
    if kind == "string":
        return F.encode(column, "utf-8")
    digits = {"int": 8, "long": 16}[kind]
    return F.unhex(F.lpad(F.right(F.hex(F.col(column).cast("long")), F.lit(digits)), digits, "0"))
