"""What the text operators share: tables in the shared folder, texts as byte buffers, words as hashes.

Words are compared by 64-bit hashes. Two different words of one table of a billion words meet with
a chance below one in thirty; nothing else here is approximate."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, remove_folder, send_by_value, shuffle_width

#: Texts are worked on in slices of about this many bytes, so that a worker's memory doesn't follow the batch.
SLICE_BYTES = 1 << 22
#: Keys up to which a list of them is sent to all tasks (some tens of MB); longer lists are met in a shuffle.
SMALL_KEYS = 1_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

send_by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables that the innermost ``scratch`` removes.
_folders: ContextVar[list[str] | None] = ContextVar("folders", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end, except those stored with ``keep``, from which alone results may read."""
    folders: list[str] = []
    token = _folders.set(folders)
    try:
        yield
    finally:
        _folders.reset(token)
        for path in folders:
            remove_folder(spark, path)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows written once to the shared checkpoint folder: compressed, columnar, whole after a lost executor."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    folders = _folders.get()
    if folders is not None and not keep:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(keys: DataFrame) -> DataFrame:
    """The keys, marked for broadcast if a count shows that they are few."""
    return F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys


#: Rows of one key from which ``balanced_lookup`` spreads them, at the least.
HOT_FLOOR = 64


def balanced_lookup(left: DataFrame, right: DataFrame, key: str, rows: str, spread: list[str]) -> DataFrame:
    """Left join of ``left`` to ``right``, which has one row per key and in ``rows`` the number of left rows of that key.

    A key is hot from ``max(HOT_FLOOR, all rows / shuffle partitions)`` rows on: there are at most as many hot keys as
    shuffle partitions, and the sum of their parts (rows / that floor, rounded up) is at most twice as large, so that
    short list is broadcast. Left rows of a hot key are dealt over its parts by a hash of ``spread`` (a recomputed row
    goes where it went before); its right row is repeated once per part. Left rows without a key are spread as well."""
    spark = left.sparkSession
    width = shuffle_width(spark)
    total = right.agg(F.sum(rows)).first()[0] or 0
    floor = max(HOT_FLOOR, -(-total // width))
    parts, salt = f"__parts_{uuid.uuid4().hex[:8]}", f"__salt_{uuid.uuid4().hex[:8]}"
    hot = F.broadcast(right.where(F.col(rows) >= floor).select(key, F.ceil(F.col(rows) / floor).cast("int").alias(parts)))
    spread_hash = F.xxhash64(*spread)
    marked = left.join(hot, key, "left")
    marked = marked.withColumn(
        salt, F.when(F.col(key).isNull(), F.pmod(spread_hash, F.lit(width))).otherwise(F.pmod(spread_hash, F.coalesce(parts, F.lit(1))))
    ).drop(parts)
    copies = right.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
    return marked.join(copies.drop(parts), [key, salt], "left").drop(salt)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes + 1) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=False)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by a line feed, and where each starts (one more than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    closed = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(closed, pa.ChunkedArray):
        closed = closed.combine_chunks()
    _, offsets, data = closed.cast(pa.large_string()).buffers()
    starts = np.frombuffer(offsets, np.int64)[closed.offset : closed.offset + len(closed) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


@cache
def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


#: Powers are kept up to this exponent and for its multiples, so that a worker keeps no table as long as a slice.
_STEP = 1 << 16


def power(base: int, at: np.ndarray) -> np.ndarray:
    """The base to each exponent."""
    far = _powers(1 << (int(at.max(initial=0)) // _STEP).bit_length(), pow(base, _STEP, 1 << 64))
    with np.errstate(over="ignore"):
        out = _powers(_STEP, base)[at % _STEP]
        out *= far[at // _STEP]
        return out


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """The sum of all bytes before each place, each plus one and times the power of its place."""
    near, far = _powers(_STEP, _BASE), power(_BASE, np.arange(0, len(data) or 1, _STEP))
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k, x in zip(range(0, len(data), _STEP), far, strict=False):
            part = total[k + 1 : k + 1 + _STEP]
            part += data[k : k + _STEP]
            part += np.uint64(1)
            part *= near[: len(part)]
            part *= x
            np.cumsum(part, out=part)
            part += total[k]
    return total


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they lie."""
    if not len(start):
        return np.empty(0, np.uint64)
    total = prefix_sums(data)
    with np.errstate(over="ignore"):
        h = total[end]
        h -= total[start]
        h *= power(_INVERSE, start)
        return mix(h)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def owner(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each place lies in."""
    return np.searchsorted(starts, at, side="right") - 1


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(_BASE) + words[k : k + n]
    return mix(out)
