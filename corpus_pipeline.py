"""Documents to packed training sequences: each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, jaccard_join, packing, quality, secrets
from riskweave.session import ensure_checkpoint_dir

#: Near duplicates share 80 of 100 five-word shingles.
SHINGLE_WORDS = 5
SIMILARITY = 80


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality.filter_quality(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return jaccard_join.keep_first(docs, SHINGLE_WORDS, SIMILARITY)


def benchmark_free(spark, docs, sf_dir):
    """Documents with ten words in a row of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark, docs, sf_dir):
    """Secrets are replaced; documents stay."""
    return secrets.redact(docs, F.concat_ws("/", "source", "lang"))


def packed(spark, docs, sf_dir):
    """Pieces of documents in sequences, with a checksum of their ids."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Tokenizers and forests aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
