"""Saving and loading searchable tables: Parquet, and JSON for what describes it; the JSON is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.analyze import Analyzer
from sparkseek.operators.bm25 import corpus_stats, term_frequencies

VERSION = 1


class Folder:
    """Paths of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._read = jvm.org.apache.commons.io.IOUtils.toString

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def json(self, name: str) -> dict | None:
        path = self._path(self.at(f"{name}.json"))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._read(stream, "UTF-8"))
        finally:
            stream.close()

    def put_json(self, name: str, value: dict) -> None:
        """Written beside and moved, so that readers see the old or the new."""
        new, old = self._path(self.at(f"{name}.json.new")), self._path(self.at(f"{name}.json"))
        out = self._fs.create(new, True)
        out.write(json.dumps(value).encode())
        out.close()
        if self._fs.exists(old):
            self._fs.delete(old, False)
        if not self._fs.rename(new, old):
            raise OSError(f"can't write {old}")


def _open(spark: SparkSession, path: str, kind: str) -> tuple[Folder, dict] | None:
    folder = Folder(spark, path)
    meta = folder.json("metadata")
    if meta is None:
        return None
    if meta["version"] != VERSION or meta["kind"] != kind:
        raise ValueError(f"{path} holds {meta['kind']} of format {meta['version']}")
    return folder, meta


def save_vectors(vectors: DataFrame, path: str, **meta) -> None:
    """(key, vector, attributes...) with its metric, dimensions, model and the like."""
    vectors.write.mode("overwrite").parquet(Folder(vectors.sparkSession, path).at("vectors"))
    Folder(vectors.sparkSession, path).put_json("metadata", {"version": VERSION, "kind": "vectors"} | meta)


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict] | None:
    """None where there is nothing."""
    got = _open(spark, path, "vectors")
    return got and (spark.read.parquet(got[0].at("vectors")), got[1])


def save_text(docs: DataFrame, path: str, analyzer: Analyzer | None = None, **meta) -> None:
    """Postings sorted by term within files, so that a query's terms select row groups; documents without their text; statistics."""
    folder = Folder(docs.sparkSession, path)
    tf = term_frequencies(docs, analyzer)
    tf.repartitionByRange(F.col("term")).sortWithinPartitions("term", "key").write.mode("overwrite").parquet(folder.at("terms"))
    docs.drop("text").write.mode("overwrite").parquet(folder.at("docs"))
    stats = corpus_stats(docs, analyzer).first()
    folder.put_json("metadata", {"version": VERSION, "kind": "text", "n": stats.n, "avgdl": stats.avgdl} | meta)


def load_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict] | None:
    """Postings (key, term, tf, dl), documents, and what describes them."""
    got = _open(spark, path, "text")
    return got and (spark.read.parquet(got[0].at("terms")), spark.read.parquet(got[0].at("docs")), got[1])


def save_hybrid(rows: DataFrame, path: str, analyzer: Analyzer | None = None, rrf_k: int = 60, **meta) -> None:
    folder = Folder(rows.sparkSession, path)
    save_vectors(rows.drop("text"), folder.at("vector-part"), **meta)
    save_text(rows.select("key", "text"), folder.at("text-part"), analyzer)
    folder.put_json("metadata", {"version": VERSION, "kind": "hybrid", "rrf_k": rrf_k} | meta)


def load_hybrid(spark: SparkSession, path: str):
    """(vectors, postings, metadata)."""
    got = _open(spark, path, "hybrid")
    if got is None:
        return None
    folder, meta = got
    return load_vectors(spark, folder.at("vector-part"))[0], load_text(spark, folder.at("text-part"))[0], meta
