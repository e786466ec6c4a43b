"""A training-data pipeline over ``documents``: the stages in order, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import byte_bpe, common, decontaminate, jaccard_join, line_dedup, quality
from quarry.session import materialize

#: Bytes of an Arrow batch: executors still hold what the stages before took, so a stage gets along with less.
BATCH = 2 << 20


def _through(docs: DataFrame, operator) -> DataFrame:
    """The rows that ``operator`` gives, with the columns of ``docs``; columns besides id and text pass by under other
    names, so that none is mistaken for an output of the operator."""
    common.bounded_batches(docs.sparkSession, BATCH)
    aside = {c: c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)}
    out = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in aside.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in aside.items()])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects (score below 0.3) go; learns as the query of the operator does."""
    scorer = quality.fit(docs, common.table(spark, sf_dir, "labels"), common.remainder("id", 5) != 0)
    return _through(docs, lambda d: quality.score(d, scorer).where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines found in ten documents or more go; the documents stay with their other lines."""
    return _through(docs, lambda d: line_dedup.drop_repeated_lines(d).withColumn("text", F.col("kept_text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: of each group of documents that share at least 80 % of their five-word shingles, directly or over
    others, the one with the smallest id stays. Documents without words or id stay."""
    common.bounded_batches(spark, BATCH)
    found = jaccard_join.similar_components(docs, size=5, percent=80)
    return docs.join(found.where("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a ten-word window of a test item go."""
    items = common.table(spark, sf_dir, "benchmark")
    return _through(docs, lambda d: decontaminate.remove_leaks(decontaminate.find_leaks(d, items)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ``ids`` of each text, and the text as decoded from them."""
    common.bounded_batches(spark, BATCH)
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = byte_bpe.encode(docs, vocabulary, pattern, decoded="decoded")
    return decoded.withColumn("text", F.col("decoded").cast("string")).withColumn("n_tokens", F.size("ids").cast("long")).drop("decoded")


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("byte_bpe", tokens)]
#: A classifier trained by descent has no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
