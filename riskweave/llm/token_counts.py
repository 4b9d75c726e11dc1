"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where both agree.

A text of up to ``chunk`` characters is encoded as it is. A longer one is cut into chunks that reach ``overlap``
characters into the next, and the chunks are spread over the cluster. Each chunk reports its tokens up to its
*stable* places in both overlaps: a space that follows a non-space, which no token reaches over and which a chunk
sees by two characters alone. Neighbours are spliced at the first place both report. Where they share none (a run
without spaces), the text is cut again with an overlap four times as wide, at last as wide as the text.

Results: a null or empty text has 0 tokens; repeated rows are counted each; other columns pass through. Equal
long texts are encoded once. Tokenizer files without provable places (any that isn't a byte-level BPE, sentencepiece
models among them) are encoded text by text with their own library."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_by_value, shuffle_width
from .common import stored
from .encode import encoded, is_byte_bpe, pieces, space_before

CHUNK = 1 << 16
OVERLAP = 1 << 8

send_by_value(__name__)


@cache
def library(path: str):
    """The file's own library, as a function from texts to numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def stable(path: str) -> bool:
    """Whether texts of this tokenizer may be cut at spaces."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        return is_byte_bpe(json.load(f))


def whole_texts(path: str, cut: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.num_columns - 1)
            if cut:
                n = [c for _, _, c, _ in encoded(path, text, ids=False)]
                n = np.concatenate(n) if n else np.empty(0, np.int64)
            else:
                n = np.array(library(path)(["" if t is None else t for t in text.to_pylist()]), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*b.schema.names[:-1], "n_tokens"])

    return count


def reported(memory, text: str, first: int, zones: list[tuple[int, int]]) -> tuple[int, list[list[dict]]]:
    """Tokens of a chunk that starts at character ``first`` of its text, and in each zone of places (of the text)
    the stable ones with the tokens before them."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    space = np.flatnonzero(data == 32)
    space = space[space > 0]
    space = space[~space_before(data, space)]
    at = np.concatenate([np.zeros(1, np.int64), space])
    _, size = memory.all(data, at, np.append(space, len(data)))
    before = np.cumsum(size) - size
    place = first + np.cumsum((data & 0xC0) != 0x80)[space] - 1
    keep = [(place >= low) & (place < high) for low, high in zones]
    return int(size.sum()), [[{"at": int(p), "tokens": int(n)} for p, n in zip(place[k], before[1:][k], strict=True)] for k in keep]


def chunk_counts(path: str, chunk: int, overlap: int):
    place = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = pieces(path)
        for b in batches:
            out = []
            for k, text in zip(b.column("k").to_pylist(), b.column("part").to_pylist(), strict=True):
                head, tail = k * chunk, (k + 1) * chunk
                out.append(reported(memory, text, head, [(head + 1, head + overlap), (tail + 1, tail + overlap)]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("digest"), b.column("k"), b.column("last"),
                    pa.array([n for n, _ in out], pa.int64()),
                    pa.array([z[0] for _, z in out], place),
                    pa.array([z[1] for _, z in out], place),
                ],
                ["digest", "k", "last", "tokens", "head", "tail"],
            )

    return count


def spliced(chunks: DataFrame) -> DataFrame:
    """Tokens per text; null where two neighbours share no stable place."""
    nxt = chunks.select("digest", (F.col("k") - 1).alias("k"), F.col("head").alias("next_head"))
    both = chunks.join(nxt, ["digest", "k"], "left")
    at = F.array_min(F.array_intersect("tail.at", "next_head.at"))
    both = both.withColumn("cut", at)

    def tokens_at(zone: str):
        return F.get(F.filter(zone, lambda p: p.at == F.col("cut")), F.lit(0)).tokens

    # a chunk gives what it has up to the cut at its end; what the next one has before that cut was counted already
    own = F.when(F.col("k") == F.col("last"), F.col("tokens")).otherwise(tokens_at("tail") - tokens_at("next_head"))
    return both.select("digest", own.alias("own")).groupBy("digest").agg(
        F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens")
    )


def long_texts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of distinct long texts (digest, text)."""
    spark, done = texts.sparkSession, []
    while True:
        size = F.length("text")
        cut = (
            texts.withColumn("last", F.greatest(F.ceil(size / chunk) - 1, F.lit(0)))
            .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
            .select("digest", "k", "last", F.substring("text", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("part"))
            .repartition(shuffle_width(spark), "digest", "k")
        )
        schema = "digest binary, k long, last long, tokens long, head array<struct<at: long, tokens: long>>, tail array<struct<at: long, tokens: long>>"
        found = stored(spliced(cut.mapInArrow(chunk_counts(path, chunk, overlap), schema)))
        done.append(found.where("n_tokens is not null"))
        missing = found.where("n_tokens is null").select("digest")
        if missing.isEmpty():
            break
        texts = texts.join(missing, "digest", "left_semi")
        overlap *= 4
        chunk = max(chunk, overlap)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def count_tokens(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    rows = docs.select(*kept, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema if f.name != 'text')}{', ' if rows.columns[:-1] else ''}n_tokens long"
    cut = stable(path)
    if not cut:
        return rows.mapInArrow(whole_texts(path, False), schema)
    # octets are known without counting characters; a text of at most ``chunk`` octets has no more characters
    short = rows.where(F.col("n_bytes") <= chunk).mapInArrow(whole_texts(path, True), schema)
    long = rows.where(F.col("n_bytes") > chunk).withColumn("digest", F.unhex(F.sha2("text", 256)))
    found = long_texts(long.select("digest", "text").dropDuplicates(["digest"]), path, chunk, overlap)
    return short.unionByName(long.drop("text").join(found, "digest").drop("digest"))
