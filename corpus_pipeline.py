"""A training corpus from raw documents: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
run() writes what a stage returns to the shared folder as Parquet and reads it again as the next stage's docs.

Defined results: rows with null, empty or blank text are rejected by the first stage; rows with a null doc_id are judged like others, are the
last of their group of near duplicates and of the owners of a passage, and are packed with a null id; of rows that repeat, whatever their ids, one stays;
texts of any length are judged, compared and cut whole; a document of which no word is left goes; columns beside those of documents are kept up
to packing, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.bpe import prepare
from sparkseek.llm.near_dedup import near_dedup
from sparkseek.llm.packing import packing
from sparkseek.llm.quality import quality, train
from sparkseek.llm.shared import checkpoint_dir
from sparkseek.llm.suffix_dedup import suffix_dedup
from sparkseek.llm.toxicity import learned, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects; it is trained on the labelled rows that are still here."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality(docs, model).where("quality_keep").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic texts; stems are learned from the labelled rows that are still here."""
    lexicon = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs, lexicon=lexicon).where("not toxic").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; n_chars follows."""
    cut = suffix_dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of ids of byte-pair encoding."""
    return packing(docs, lexicon=prepare(docs))


STAGES = [("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", near_stage), ("suffix-array dedup", passage_stage), ("packing", packing_stage)]

#: No stage of these can be expressed in SQL as a whole; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
