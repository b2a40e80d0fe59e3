"""The corpus pipeline: from raw documents to packed token windows.

Each stage reads what the one before kept, as a written table, and its decisions
take effect: low-quality documents go, boilerplate lines stay once, one document of
each near-duplicate group stays, secrets are masked, and the rest is packed. All
stages but the last return the columns of ``documents`` (``n_chars`` follows the text).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.llm import line_dedup, ngram_join, packing, quality, secrets
from tallyman.llm.common import pick, read, stored


def _with_text(docs: DataFrame, rows: DataFrame, text, others) -> DataFrame:
    """``rows`` with the columns of ``docs``: a new text, its length, and ``others`` (by name)."""
    rows = rows.withColumn("new_text", text)  # a name of its own: an alias "text" would shadow the column in lambdas
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return rows.select(*[(new[c] if c in new else others(c)).alias(c) for c in docs.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from ``labels``, doesn't reject."""
    labels = pick(read(spark, sf_dir, "labels"), doc_id="doc_id", label="quality")
    return quality.accepted(docs, quality.learn(pick(docs, doc_id="doc_id", text="text"), labels))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many sites share, but for each line's first occurrence."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    named = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cleaned = line_dedup.dedup_lines(named, keep=["row"])
    return _with_text(docs, cleaned, F.col("text"), lambda c: F.col(f"row.`{c}`") if c in others else F.col(c))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates."""
    return ngram_join.without_near_duplicates(docs)


def secret_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; a null text stays null."""
    found = secrets.scan(docs, keep=docs.columns)
    masked = F.when(F.col("row.text").isNotNull(), secrets.redacted(F.col("text"), F.col("spans")))
    return _with_text(docs, found, masked, lambda c: F.col(f"row.`{c}`"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("ngram_join", near_duplicate_filter),
    ("secrets", secret_filter),
    ("packing", pack_documents),
]

#: Learned rules, site sketches, character models and token ids are beyond SQL; tests
#: compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
