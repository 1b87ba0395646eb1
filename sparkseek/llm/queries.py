"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learned, toxicity

    documents = _table(spark, sf_dir, "documents")
    lexicon = learned(documents, _table(spark, sf_dir, "labels"))
    return toxicity(documents.select("doc_id", "text"), lexicon=lexicon).drop("text")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality, train

    documents = _table(spark, sf_dir, "documents")
    model = train(documents, _table(spark, sf_dir, "labels"))
    return quality(documents.select("doc_id", "text"), model).drop("text")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import duplicate_spans

    return duplicate_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ids of byte-pair encoding."""
    from .bpe import prepare
    from .packing import packing

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing(documents, lexicon=prepare(documents))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lists of every page's raw bytes, rebuilt from deduplicated chunks and verified."""
    from .media import media

    return media(_table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("payload")), "payload")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    from .bpe import prepare, verified_encoder

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    own = documents.select("doc_id", verified_encoder(prepare(documents))("text").alias("r"))
    return own.select("doc_id", F.col("r.ids").alias("token_ids"), F.size("r.ids").alias("n_tokens"), "r.exact")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import licenses

    return licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every text's ids, and whether they decode to them."""
    from .bpe import ids_width, packed_encoder, prepare
    from .huffman import codebook, huffman_encode
    from .shared import written

    documents, width = _table(spark, sf_dir, "documents").select("doc_id", "text"), ids_width()
    ids = written(documents.select("doc_id", packed_encoder(prepare(documents), width)("text").alias("token_ids")), "ids")
    return huffman_encode(ids, codebook(ids, width=width), width=width, verify=True)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_toxicity": op1_toxicity, "op2_quality": op2_quality, "op3_suffix_dedup": op3_suffix_dedup, "op4_packing": op4_packing, "op5_media": op5_media, "op6_bpe": op6_bpe, "op7_licenses": op7_licenses, "op8_huffman": op8_huffman, "op9_html": op9_html, "op10_near_dedup": op10_near_dedup}
SQL: dict[str, str] = {}
