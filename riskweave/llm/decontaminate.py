"""Benchmark items found in documents through a positional inverted index.

The index holds, per shard of documents, the word positions of every term that a benchmark item has: one row per shard
and term, and one row with where each document begins. Shards are as large as a batch of texts allows and lie in a
table in the shared folder, which serves any number of searches. A search takes the items' windows of ``size`` words
(shorter items whole). In each shard it starts from a window's rarest term, moves its positions back by the term's
place in the window, and keeps those that are also among the next rarer term's moved positions, up to the commonest;
what is left are exact phrases. With ``slop`` it keeps places where every term lies within the window's length plus
``slop`` words of the rarest one instead (proximity matches, reported as spans). Items are taken in blocks of bounded
size, each of which is sent to all tasks.

Words are runs of ASCII letters and digits and of anything outside ASCII, A-Z lower-cased, compared by 64-bit hashes.
Defined results: a null or empty text or item has no words and matches nothing; equal items match each; repeated
rows are searched each; other columns are not carried. No item gives no match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_by_value
from .common import buffer, hashes, owner, runs, scratch, slices, small, stored

WINDOW = 10
#: Bytes of text in a shard.
SHARD_BYTES = 1 << 24
#: Items in a block sent to the tasks: with a megabyte of text each, one block stays below a gigabyte.
BLOCK_ITEMS = 1_000
BLOCK_BYTES = 1 << 25
#: The term number of the row that says where documents begin.
DOCUMENTS = -1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

send_by_value(__name__)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words begin (one more than texts)."""
    data, starts = buffer(texts)
    data = _LOWER[data]
    start, end = runs(_IN_WORD[data])
    return hashes(data, start, end), np.searchsorted(start, starts)


def item_words(items: list[str | None]) -> list[np.ndarray]:
    h, at = word_hashes(pa.array(items, pa.string()))
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def packed(values: np.ndarray) -> bytes:
    """Rising numbers as four-byte steps."""
    return np.diff(values, prepend=0).astype("<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4").astype(np.int64))


def postings(terms: np.ndarray):
    """(doc_id, text) to index rows (shard, term, places, ids). ``terms``: sorted hashes; a term's number is its place."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            ids, text = b.column(0), b.column(1)
            for first, last in slices(text, SHARD_BYTES):
                number, begin, done = [], [0], 0
                for low, high in slices(text.slice(first, last - first)):
                    h, at = word_hashes(text.slice(first + low, high - low))
                    k = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
                    number.append(np.where(terms[k] == h, k, -1) if len(terms) else np.full(len(h), -1))
                    begin.extend((at[1:] + done).tolist())
                    done += len(h)
                number = np.concatenate(number) if number else np.empty(0, np.int64)
                place = np.flatnonzero(number >= 0)
                order = np.argsort(number[place].astype(np.int32), kind="stable")
                place, number = place[order], number[place][order]
                cut = np.flatnonzero(np.diff(number, prepend=-1))
                rows = [packed(np.array(begin)), *[packed(x) for x in np.split(place, cut[1:]) if len(x)]]
                kind = pa.list_(ids.type)
                none = pa.nulls(len(rows) - 1, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), shard)),
                        pa.array(np.concatenate([[DOCUMENTS], number[cut]]).astype(np.int64)),
                        pa.array(rows, pa.binary()),
                        pa.concat_arrays([pa.array([ids.slice(first, last - first).to_pylist()], kind), none]),
                    ],
                    ["shard", "term", "places", "ids"],
                )
                shard += 1

    return index


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The positional index of (doc_id, text) for the given sorted word hashes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(postings(terms), f"shard long, term long, places binary, ids array<{kind}>"))


def phrase(lists: dict[int, np.ndarray], terms: np.ndarray) -> np.ndarray:
    """Where the terms stand one after another, from the rarest one on."""
    order = sorted(range(len(terms)), key=lambda k: len(lists.get(terms[k], ())))
    found = None
    for k in order:
        at = lists.get(terms[k])
        if at is None:
            return np.empty(0, np.int64)
        if found is None:
            found = at - k
        else:
            want = found + k
            found = found[at[np.minimum(np.searchsorted(at, want), len(at) - 1)] == want]
        if not len(found):
            break
    return found


def near(lists: dict[int, np.ndarray], terms: np.ndarray, reach: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans around the rarest term that have every term within ``reach`` words of it, in its own document.

    ``begin``: where each document begins, one more than documents."""
    wanted = sorted(set(terms.tolist()), key=lambda t: len(lists.get(t, ())))
    if any(t not in lists for t in wanted):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = lists[wanted[0]]
    high, rare = low, low
    doc = owner(begin, rare)
    first, last = begin[doc], begin[doc + 1]
    for t in wanted[1:]:
        at = lists[t]
        k = np.searchsorted(at, rare)
        before, after = at[np.maximum(k - 1, 0)], at[np.minimum(k, len(at) - 1)]
        # a place of another document is as far as can be
        back = np.where((k > 0) & (before >= first), rare - before, reach + 1)
        ahead = np.where((k < len(at)) & (after < last), after - rare, reach + 1)
        best = np.where(back < ahead, before, after)
        keep = np.minimum(back, ahead) <= reach
        rare, low, high = rare[keep], np.minimum(low, best)[keep], np.maximum(high, best)[keep]
        first, last = first[keep], last[keep]
    return low, high


def search(items: list, windows: list[tuple[int, np.ndarray]], slop: int | None):
    """Rows of one shard to matches (shard, doc, doc_id, item, start, length) and the documents' sizes (item null)."""

    def shard_matches(key: tuple, shard: pa.Table) -> pa.Table:
        terms = shard.column("term").to_pylist()
        lists = {t: unpacked(p) for t, p in zip(terms, shard.column("places").to_pylist(), strict=True)}
        begin = lists.pop(DOCUMENTS)
        ids = shard.column("ids").filter(pa.array([t == DOCUMENTS for t in terms])).combine_chunks().flatten()
        docs, item, start, length = [], [], [], []
        for k, w in windows:
            if slop is None:
                low = phrase(lists, w)
                high = low + len(w) - 1
            else:
                low, high = near(lists, w, len(w) + slop, begin)
            if not len(low):
                continue
            doc = owner(begin, low)
            whole = (low >= 0) & (doc == owner(begin, high)) & (low >= begin[0])
            docs.append(doc[whole])
            start.append((low - begin[doc])[whole])
            length.append((high - low + 1)[whole])
            item.append(np.full(int(whole.sum()), k))
        n = len(begin) - 1
        doc = np.concatenate([np.arange(n), *docs]).astype(np.int64)
        none = pa.nulls(n, pa.int64())
        values = [pa.concat_arrays([none, pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64))]) for x in (item, start)]
        size = pa.array(np.concatenate([np.diff(begin), *length]).astype(np.int64))
        shards = pa.array(np.full(len(doc), key[0].as_py()))
        return pa.table([shards, pa.array(doc), ids.take(pa.array(doc)), *values, size], ["shard", "doc", "doc_id", "item", "start", "length"])

    return shard_matches


def item_blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items in blocks of bounded size, one block at a time on the driver."""
    block, size = [], 0
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text or "")
        if len(block) == BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """(shard, doc) number a document row; (doc_id, item_id, start, length) are matches in words.

    A row with a null ``start`` stands for each document and has its number of words as ``length``. A search without
    items still gives these rows."""
    spark, parts = docs.sparkSession, []
    kind = docs.schema["doc_id"].dataType.simpleString()
    benchmark_kind = benchmark.schema["item_id"].dataType.simpleString()
    index_of = None
    blocks = item_blocks(benchmark)
    for number, block in enumerate([[]] if benchmark.isEmpty() else blocks):
        words = item_words([t for _, t in block])
        terms = np.unique(np.concatenate([np.empty(0, np.uint64), *words]))
        index_of = build_index(docs, terms)
        seen: dict[tuple, None] = {}
        for k, w in enumerate(words):
            t = np.searchsorted(terms, w)
            for at in range(max(len(t) - size, 0) + 1 if len(t) else 0):
                seen[(k, *t[at : at + size].tolist())] = None
        windows = [(x[0], np.array(x[1:])) for x in seen]
        schema = f"shard long, doc long, doc_id {kind}, item long, start long, length long"
        found = index_of.groupBy("shard").applyInArrow(search(block, windows, slop), schema)
        if number:
            found = found.where("item is not null")
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item long, item_id {benchmark_kind}")
        parts.append(found.join(F.broadcast(names), "item", "left").drop("item"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit (words within a match), item_ids (sorted strings), contaminated."""
    found = find_items(docs, benchmark, size)
    spans = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", F.col("length").alias("size")))))
    items = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.col("item_id").cast("string"))))
    rows = found.groupBy("shard", "doc").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(F.col("start").isNull(), F.col("length"))).alias("n_words"),
        spans.alias("spans"),
        items.alias("item_ids"),
    )
    # windows of one length each; longest first at one start, so the running end decides what a span adds
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a.hit + F.greatest(s.start + s["size"] - F.greatest(a.end, s.start), F.lit(0).cast("long"))).alias("hit"),
            F.greatest(a.end, s.start + s["size"]).alias("end"),
        ),
    )
    out = rows.select("doc_id", "n_words", covered.hit.alias("n_hit"), "item_ids")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def text_key(text):
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without a match. Whether a text matches depends on the text alone, so texts tell rows apart."""
    keyed = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    with scratch(docs.sparkSession):
        bad = stored(contaminated(keyed, benchmark, size).where("contaminated").select(F.col("doc_id").alias("_key")).distinct(), keep=True)
    # texts are far longer than the list of those that go
    return docs.withColumn("_key", text_key(F.col("text"))).join(small(bad), "_key", "left_anti").select(*docs.columns)
