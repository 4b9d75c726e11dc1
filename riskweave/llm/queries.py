"""One query per operator, over whole tables, with the settings meant for production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality, warc
from .backoff import score_documents
from .common import stored, table
from .conversations import repair_conversations
from .periodic import periodic_runs
from .decontaminate import contaminated, find_items
from .jaccard_join import groups
from .licenses import scan_licenses
from .packing import pack
from .repeats import remove_repeats
from .secrets import find_secrets
from .token_counts import count_tokens

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
#: Words that may stand between those of a window, in proximity matches.
PROXIMITY_SLOP = 5


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        REGISTRY[name] = f
        return f

    return register


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


@query("op1_lm_scores")
def op1_lm_scores(spark, sf_dir):
    scores = score_documents(_documents(spark, sf_dir, "text"))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


@query("op1_lm_scores_order5")
def op1_lm_scores_order5(spark, sf_dir):
    """The usual order. Documents are scored under counts that hold themselves, so an n-gram seen once is their own and backs off."""
    scores = score_documents(_documents(spark, sf_dir, "text"), order=5, min_count=2)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(mean, 6).alias("mean_log_score"))


@query("op2_decontamination")
def op2_decontamination(spark, sf_dir):
    found = contaminated(_documents(spark, sf_dir, "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op2_proximity_matches")
def op2_proximity_matches(spark, sf_dir):
    """Documents with an item's window of words close together, in any order: a row per document and item."""
    found = find_items(_documents(spark, sf_dir, "text"), table(spark, sf_dir, "benchmark"), slop=PROXIMITY_SLOP)
    return found.where("start is not null").groupBy("shard", "doc", "item_id").agg(
        F.max("doc_id").alias("doc_id"), F.countDistinct("start", "length").alias("n_spans"), F.min("start").alias("first_start")
    ).select("doc_id", "item_id", "n_spans", "first_start")


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    """The table has no paths: a document lies in its source and the hundred of its number."""
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan_licenses(_documents(spark, sf_dir, path.alias("path"), "text"))


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    docs = _documents(spark, sf_dir, F.concat_ws("/", "source", "lang").alias("path"), "text")
    found = find_secrets(docs)
    return found.select("doc_id", "start", "end", F.round("probability", 6).alias("probability"), "is_secret")


@query("op5_ngram_jaccard_join")
def op5_ngram_jaccard_join(spark, sf_dir):
    return groups(_documents(spark, sf_dir, "text"), n=4, percent=85)


@query("op6_packing")
def op6_packing(spark, sf_dir):
    pieces = pack(_documents(spark, sf_dir, "source", "text"), public_tokenizers.path(TOKENIZER))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_suffix_array_dedup")
def op7_suffix_array_dedup(spark, sf_dir):
    found = remove_repeats(_documents(spark, sf_dir, "text"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_pii")
def op8_pii(spark, sf_dir):
    found = pii.find_pii(_documents(spark, sf_dir, "text"))
    count = [pii.count_of("base", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select(
        "doc_id", *count, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    counts = count_tokens(_documents(spark, sf_dir, "text"), public_tokenizers.path(TOKENIZER))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    signals = stored(quality.with_signals(_documents(spark, sf_dir, "text", "lang", "source")).drop("text"))
    verdicts = quality.judged(signals, stored(quality.limits(quality.sketches(signals))))
    return verdicts.select(
        "doc_id",
        *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        "kept",
    )


@query("op11_warc_capture_index")
def op11_warc_capture_index(spark, sf_dir):
    """Every page written as a WARC record and read back through the capture index."""
    got = warc.archive(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    """Every conversation, damaged by the contract's rule, repaired by the cheapest edits."""
    got = repair_conversations(table(spark, sf_dir, "conversations"))
    return got.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    """Runs of words in every whole document, with the contract's planted repetition."""
    got = periodic_runs(_documents(spark, sf_dir, "text"))
    return got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
