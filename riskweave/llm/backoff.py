"""Stupid-backoff scores of documents under n-gram counts of all documents.

A word's score after its history is the n-gram's count over the history's where the n-gram was seen at least
``min_count`` times, else ``alpha`` times its score after the history without the first word; a single word has its share
of all words. A document's score is the sum of the logarithms.

Documents lie in batches of bounded size, by hash. A batch explodes its n-grams, adds up equal ones and sends them to the
count tables, which are partitioned by n-gram hash: one row per batch, part and order, with sorted hashes as byte
planes, which shuffles compress. A part sums the counts and answers each batch in the order of its question. The batch
meets its answers in a co-grouped join and sums scores per document, so text is shuffled once, by batch, and no n-gram
meets another one's documents. A word or copy that a third of all rows share is one entry per batch.

N-grams are compared by 64-bit hashes. Words are runs of anything but ASCII white space and stay as they are; n-grams don't
reach over a document's start. Defined results: a null or empty text has no words and score 0; repeated rows are counted
and scored each; other columns are not carried. The numbers of batches and parts follow the bytes of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_by_value, shuffle_width
from .common import buffer, grams, hashes, runs, slices

#: N-grams up to this many words. Three or more cost disk for each order, some two bytes per byte of text.
ORDER = 2
ALPHA = 0.4
MIN_COUNT = 2
BATCH_BYTES = 1 << 23
PART_BYTES = 1 << 24
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

send_by_value(__name__)


def planes(values: np.ndarray) -> bytes:
    """Rising 64-bit numbers as steps, all lowest bytes first."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(rows.T).view("<u8").ravel(), dtype=np.uint64)


def document_grams(texts: pa.Array, order: int):
    """For each order: hashes of all n-grams and their document; n-grams of one place end at the same word."""
    out = [[] for _ in range(order)]
    doc = [[] for _ in range(order)]
    size = np.zeros(len(texts), np.int64)
    for first, last in slices(texts):
        data, starts = buffer(texts.slice(first, last - first))
        start, end = runs(~_SPACE[data])
        h = hashes(data, start, end)
        at = np.searchsorted(start, starts)
        own = np.repeat(np.arange(first, last), np.diff(at))
        size[first:last] = np.diff(at)
        for n in range(1, order + 1):
            # an n-gram belongs to the document of its last word and must begin there too
            g = grams(h, n)
            inside = own[n - 1 :] == own[: len(own) - n + 1] if len(g) else np.empty(0, bool)
            out[n - 1].append(g[inside])
            doc[n - 1].append(own[n - 1 :][inside] if len(g) else np.empty(0, np.int64))
    empty = np.empty(0, np.uint64)
    return [np.concatenate([empty, *x]) for x in out], [np.concatenate([np.empty(0, np.int64), *x]) for x in doc], size


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of sorted hashes: equal ranges of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def counted(order: int, parts: int):
    """A batch's documents to its n-grams with counts, one row per part and order."""

    def count(key: tuple, batch: pa.Table) -> pa.Table:
        found, _, _ = document_grams(batch.column("text").combine_chunks(), order)
        part, kind, grams_, counts = [], [], [], []
        for n, g in enumerate(found, 1):
            if not len(g):
                continue
            u, c = np.unique(g, return_counts=True)
            own = part_of(u, parts).astype(np.int64)
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(u)], strict=True):
                part.append(int(own[low]))
                kind.append(n)
                grams_.append(planes(u[low:high]))
                counts.append(c[low:high].astype("<u4").tobytes())
        batch_of = pa.array(np.full(len(part), key[0].as_py(), np.int64))
        return pa.table([batch_of, pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(grams_, pa.binary()), pa.array(counts, pa.binary())], ["batch", "part", "n", "grams", "counts"])

    return count


def totals(key: tuple, part: pa.Table) -> pa.Table:
    """Counts of a part over all batches, sent back to each batch in its own order."""
    batch, kind = part.column("batch").to_pylist(), part.column("n").to_pylist()
    found = [from_planes(x) for x in part.column("grams").to_pylist()]
    counts = [np.frombuffer(x, "<u4").astype(np.int64) for x in part.column("counts").to_pylist()]
    answers: list[bytes] = [b""] * len(batch)
    for n in set(kind):
        own = [k for k, x in enumerate(kind) if x == n]
        u, back = np.unique(np.concatenate([found[k] for k in own]), return_inverse=True)
        sums = np.zeros(len(u), np.int64)
        np.add.at(sums, back, np.concatenate([counts[k] for k in own]))
        at = np.cumsum([0, *[len(found[k]) for k in own]])
        for i, k in enumerate(own):
            answers[k] = np.ascontiguousarray(sums[back[at[i] : at[i + 1]]].astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return pa.table(
        [pa.array(batch, pa.int64()), pa.array([key[0].as_py()] * len(batch), pa.int64()), pa.array(kind, pa.int32()), pa.array(answers, pa.binary())],
        ["batch", "part", "n", "totals"],
    )


def scored(order: int, alpha: float, min_count: int, words: int):
    """A batch's documents and its answers to scores."""

    def score(documents: pa.Table, answers: pa.Table) -> pa.Table:
        found, doc, size = document_grams(documents.column("text").combine_chunks(), order)
        rows = sorted(zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        table = {}
        for n in range(1, order + 1):
            own = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel() for k, _, x in rows if k == n]
            u, back = np.unique(found[n - 1], return_inverse=True)
            table[n] = np.concatenate([np.empty(0, np.uint64), *own]).astype(np.float64)[back]
        ends = [doc_ends(d, size, n) for n, d in enumerate(doc, 1)]
        value = np.log(table[1] / max(words, 1))
        for n in range(2, order + 1):
            # the n-gram's place among words, and the history that ends a word earlier
            at = ends[n - 1]
            history = np.searchsorted(ends[n - 2], at - 1)
            seen = table[n] >= min_count
            lower = value[at] + np.log(alpha)
            value[at] = np.where(seen, np.log(table[n] / table[n - 1][history]), lower)
        total = np.bincount(doc[0], value, documents.num_rows)
        return pa.table([documents.column("doc_id"), pa.array(size), pa.array(total, pa.float64())], ["doc_id", "n_words", "log_score"])

    return score


def doc_ends(doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """For n-grams in order: the number of their last word among all words."""
    first = np.cumsum(size) - size
    per = np.maximum(size - n + 1, 0)
    return first[doc] + (n - 1) + np.arange(len(doc)) - (np.cumsum(per) - per)[doc]


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score) per document of (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text)), F.sum(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()
    octets, words = (x or 0 for x in size)
    batches, parts = -(-octets // BATCH_BYTES) or 1, -(-octets // PART_BYTES) or 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text.alias("text"))
    # longer texts than a batch are batches of their own as far as their hash goes; rows spread by content and id
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches))).repartition(shuffle_width(spark), "batch")
    asked = rows.groupBy("batch").applyInArrow(counted(order, parts), "batch long, part long, n int, grams binary, counts binary")
    told = asked.groupBy("part").applyInArrow(totals, "batch long, part long, n int, totals binary")
    return rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        scored(order, alpha, min_count, words), f"doc_id {kind}, n_words long, log_score double"
    )
