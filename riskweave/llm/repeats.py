"""Repeated passages by hashed stretches over anchored suffixes, in place of longest-previous-factor arrays.

The factors' lengths are not computed, only whether they reach ``length`` bytes.

A byte starts a repeat if the ``length`` bytes from it also start elsewhere. In suffix order such suffixes are
neighbours that share ``length`` bytes; among them a suffix has an earlier match if one with a smaller position stands before or
after it (its longest previous factor), and a later one likewise. Two answers come from this: removing later copies and
keeping the first, and removing all copies.

Sorting all suffixes of the corpus would move it ``length`` times over. Instead:

1. Every stretch of ``length`` bytes has an anchor: the leftmost of its ``seed``-byte substrings with the smallest hash.
   Equal stretches have equal anchors at equal distances. An anchor stands for the stretches it is the anchor of, which
   follow each other; together they are its context. About one place in 77 is an anchor.
2. Anchors are counted by the hash of their seed. What stands once is no repeat and goes. Of the others, equal contexts are
   counted (before the shuffle, so that copies cost little); all stretches of a context that occurs twice are repeats.
3. Of different contexts around one seed the first of each is fetched and compared. From the suffix order
   at the anchor the order one byte to the left follows by a stable sort on that byte, and so on over the stretches;
   in each order, runs of suffixes that share ``length`` bytes give the earlier and later matches.
   A seed with very many contexts (a passage in very many places) is not brought together: its stretches are counted
   one by one, by hash.
4. Each document joins the stretches found for its anchors and gives its removed bytes.

Hashes are 64-bit. A document is known by a 64-bit hash of its id and text, positions are ordered by that hash and the
place. Defined results: a null text is empty; matches don't cross documents; a text shorter than ``length`` has no repeat;
equal rows (id and text) are one document as far as the first copy goes; other columns are not carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import send_by_value, shuffle_width
from .common import _BASE, _INVERSE, _powers, buffer, mix, slices, stored

LENGTH = 200
SEED = 48
#: Contexts of one seed that are compared in one place (some 10 MB).
TOGETHER = 5_000
#: What a stretch is: alone, the first of its copies, or a later copy.
ALONE, FIRST, LATER = 0, 1, 2

send_by_value(__name__)


def slid(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) value of each run of ``width`` values."""
    pick = np.minimum if least else np.maximum
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return pick(values[:-rest], values[rest:]) if rest else values


def prefix(data: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        room = max(1 << 16, 1 << int(len(data)).bit_length())
        total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(room, _BASE)[: len(data)], dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), total])


def between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        room = max(1 << 16, 1 << int(len(total) - 1).bit_length())
        return mix((total[end] - total[start]) * _powers(room, _INVERSE)[start])


def anchors(data: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: places, the stretches (first and last bytes before the place), seed hashes and context hashes."""
    none = np.empty(0, np.int64)
    n, width = len(data), length - seed + 1
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    total = prefix(data)
    at = np.arange(n - seed + 1)
    h = between(total, at, at + seed)
    low = slid(h, width, True)  # of each stretch
    # the leftmost place of the smallest hash: the last equal or smaller one before it bounds its stretches
    stretch = np.arange(len(low))
    first = np.full(len(low), -1, np.int64)
    # candidates are places that are smallest in some stretch
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(len(h) - len(low), np.uint64)])
    best = slid(padded, width, False)
    place = np.flatnonzero(h == best[: len(h)])
    # each stretch's anchor: the first candidate from its start on with the stretch's smallest hash
    k = np.searchsorted(place, stretch)
    open_ = stretch
    while len(open_):
        now = place[k[open_]]
        hit = h[now] == low[open_]
        first[open_[hit]] = now[hit]
        open_ = open_[~hit]
        k[open_] += 1
    cut = np.flatnonzero(np.diff(first, prepend=-1))
    last = np.append(cut[1:], len(first)) - 1
    p = first[cut]
    with np.errstate(over="ignore"):
        shape = mix(((p - cut).astype(np.uint64) << np.uint64(20)) + (p - last).astype(np.uint64))
    return p, p - cut, p - last, h[p], mix(between(total, cut, last + length) ^ shape)


def anchor_rows(length: int, seed: int):
    """(row, text) to anchors (row, at, most, least, seed, context)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in slices(b.column(1)):
                data, starts = buffer(b.column(1).slice(low, high - low))
                parts = [anchors(data[x : y - 1], length, seed) for x, y in zip(starts[:-1], starts[1:], strict=True)]
                count = np.array([len(p[0]) for p in parts])
                joined = [np.concatenate([p[k] for p in parts]) for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(low, high - low).take(pa.array(np.repeat(np.arange(high - low), count))),
                        pa.array(joined[0].astype(np.int32)),
                        pa.array(joined[1].astype(np.int16)),
                        pa.array(joined[2].astype(np.int16)),
                        pa.array(joined[3].view(np.int64)),
                        pa.array(joined[4].view(np.int64)),
                    ],
                    ["row", "at", "most", "least", "seed", "context"],
                )

    return rows


ANCHOR = "row long, at int, most short, least short, seed long, context long"


def fetched(length: int):
    """(text, wanted anchors) to contexts with their bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                data = text.encode("utf-8")
                for w in wanted:
                    out.append({**w, "bytes": data[w["at"] - w["most"] : w["at"] - w["least"] + length]})
            schema = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("most", pa.int16()), ("least", pa.int16()), ("seed", pa.int64()), ("context", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows


def aligned(most: np.ndarray, texts: list[bytes], width: int, length: int) -> np.ndarray:
    """Contexts as rows of bytes with their anchors in one column."""
    out = np.zeros((len(texts), width + length), np.uint8)
    for k, (m, t) in enumerate(zip(most.tolist(), texts, strict=True)):
        out[k, width - m : width - m + len(t)] = np.frombuffer(t, np.uint8)
    return out


def factors(group: np.ndarray, position: np.ndarray, most: np.ndarray, least: np.ndarray, n: np.ndarray, texts: list[bytes], length: int, seed: int) -> np.ndarray:
    """The state of each context's stretches, by bytes before the anchor.

    ``position`` orders first occurrences; ``n`` says how often the context occurs."""
    width = length - seed
    x = aligned(most, texts, width, length)
    state = np.zeros((len(group), width + 1), np.uint8)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros((len(x), 1), np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers(1 << 16, _BASE)[: x.shape[1]], axis=1, dtype=np.uint64)], axis=1)
    # suffix order at the anchor, within each group; then, byte by byte, one place further left
    order = np.lexsort((np.ascontiguousarray(x[:, width:]).view(f"S{length}").ravel(), group))
    for t in range(width + 1):
        if t:
            key = group[order].astype(np.int64) * 256 + x[order, width - t]
            order = order[np.argsort(key, kind="stable")]
        own = order[(least[order] <= t) & (t <= most[order])]
        if not len(own):
            continue
        with np.errstate(over="ignore"):
            h = mix((total[own, width - t + length] - total[own, width - t]) * _powers(1 << 16, _INVERSE)[width - t])
        new = np.ones(len(own), bool)
        new[1:] = (h[1:] != h[:-1]) | (group[own[1:]] != group[own[:-1]])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        size = np.add.reduceat(n[own], start)[run]
        smallest = np.minimum.reduceat(position[own], start)[run]
        state[own, t] = np.where(size < 2, ALONE, np.where(position[own] == smallest, FIRST, LATER))
    return state


def compare(length: int, seed: int):
    """Contexts sorted by seed to (seed, context, states)."""

    def states(x: pa.Table) -> pa.RecordBatch:
        col = lambda c: x.column(c).to_numpy()
        group = np.cumsum(np.diff(col("seed"), prepend=col("seed")[:1]) != 0)
        position = np.empty(x.num_rows, np.int64)
        position[np.lexsort((col("at"), col("row")))] = np.arange(x.num_rows)
        out = factors(group, position, col("most").astype(np.int64), col("least").astype(np.int64), col("n"), x.column("bytes").to_pylist(), length, seed)
        return pa.RecordBatch.from_arrays([pa.array(col("seed")), pa.array(col("context")), pa.array([s.tobytes() for s in out], pa.binary())], ["seed", "context", "states"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            if rest.num_rows < TOGETHER:
                continue
            cut = np.flatnonzero(np.diff(rest.column("seed").to_numpy())) + 1
            if len(cut):
                yield states(rest.slice(0, int(cut[-1])))
                rest = rest.slice(int(cut[-1])).combine_chunks()
        if rest is not None and rest.num_rows:
            yield states(rest)

    return run


def stretches(length: int):
    """Contexts to their single stretches (seed, context, t, stretch, row, at, n)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, t, h = [], [], []
            for k, (most, least, data) in enumerate(zip(b.column("most").to_pylist(), b.column("least").to_pylist(), b.column("bytes").to_pylist(), strict=True)):
                start = np.arange(most - least + 1)
                take.append(np.full(len(start), k))
                t.append(most - start)
                h.append(between(prefix(np.frombuffer(data, np.uint8)), start, start + length))
            index = pa.array(np.concatenate([np.empty(0, np.int64), *take]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("seed").take(index), b.column("context").take(index), b.column("n").take(index), b.column("row").take(index), b.column("at").take(index),
                    pa.array(np.concatenate([np.empty(0, np.int64), *t]).astype(np.int32)),
                    pa.array(np.concatenate([np.empty(0, np.uint64), *h]).view(np.int64)),
                ],
                ["seed", "context", "n", "row", "at", "t", "stretch"],
            )

    return rows


def one_by_one(contexts: DataFrame, length: int, seed: int) -> DataFrame:
    """States of contexts whose seed has very many: stretches are counted by hash."""
    each = contexts.mapInArrow(stretches(length), "seed long, context long, n long, row long, at int, t int, stretch long")
    sums = each.groupBy("seed", "t", "stretch").agg(F.sum("n").alias("all"), F.min(F.struct("row", "at")).alias("low"))
    met = each.join(sums, ["seed", "t", "stretch"])
    state = F.when(F.col("all") < 2, ALONE).when(F.struct("row", "at") == F.col("low"), FIRST).otherwise(LATER)
    marks = met.groupBy("seed", "context").agg(F.map_from_entries(F.collect_list(F.struct("t", state.alias("s")))).alias("m"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(length - seed)), lambda t: F.concat(F.lit("0"), F.coalesce(F.col("m")[t], F.lit(0)).cast("string")))
    return marks.select("seed", "context", F.unhex(F.array_join(digits, "")).alias("states"))


def find_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, text) and repeated stretches (row, at, most, least, states) by anchor."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64("doc_id", text).alias("row"), "doc_id", text.alias("text"))
    found = rows.select("row", "text").mapInArrow(anchor_rows(length, seed), ANCHOR)
    often = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("seed")
    # worked out again rather than kept: anchors are many, those that repeat few
    kept = stored(found.join(often, "seed"))
    contexts = kept.groupBy("seed", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "most", "least")).alias("low"))
    contexts = stored(contexts.select("seed", "context", "n", "low.*"))
    several = contexts.groupBy("seed").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1")
    wanted = contexts.join(several, "seed")
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("row", "at", "most", "least", "seed", "context", "n")).alias("wanted"))
    texts = rows.select("row", "text").join(by_row, "row").dropDuplicates(["row"]).select("text", "wanted")
    schema = "row long, at int, most short, least short, seed long, context long, n long, bytes binary"
    bytes_of = stored(texts.mapInArrow(fetched(length), schema).join(several, "seed"))
    few = bytes_of.where(F.col("contexts") <= TOGETHER).repartition(shuffle_width(spark), "seed").sortWithinPartitions("seed")
    states = few.mapInArrow(compare(length, seed), "seed long, context long, states binary")
    states = states.unionByName(one_by_one(bytes_of.where(F.col("contexts") > TOGETHER), length, seed))
    told = contexts.join(states, ["seed", "context"], "left").where("n > 1 or states is not null")
    told = told.select("seed", "context", "n", F.struct("row", "at").alias("first"), "states")
    met = kept.join(told, ["seed", "context"])
    own = F.struct("row", "at") == F.col("first")
    return rows, met.select("row", "at", "most", "least", (F.col("n") > 1).alias("copied"), own.alias("is_first"), "states")


def covered(length: int, keep_first: bool):
    """Anchors to the spans (row, start, end) that go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, most, least = (b.column(c).to_numpy().astype(np.int64) for c in ("at", "most", "least"))
            copied, is_first = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("copied", "is_first"))
            bare = b.column("states").is_null().to_numpy(zero_copy_only=False)
            # all stretches of a copied context go, except those of its first occurrence where that stays
            whole = copied & ~is_first if keep_first else copied | bare
            some = np.flatnonzero(~whole & ~bare)
            take, low, high = [np.flatnonzero(whole)], [(at - most)[whole]], [(at - least)[whole] + length]
            if len(some):
                states = np.frombuffer(b"".join(b.column("states").take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), -1)
                width = states.shape[1]
                t = np.arange(width)
                gone = states == LATER if keep_first else states != ALONE
                gone = (gone & (t >= least[some, None]) & (t <= most[some, None]))[:, ::-1]
                edge = np.diff(np.pad(gone.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                k, s = np.nonzero(edge == 1)
                e = np.nonzero(edge == -1)[1]
                take.append(some[k])
                low.append(at[some[k]] - (width - 1 - s))
                high.append(at[some[k]] - (width - e) + length)
            take, low, high = (np.concatenate(x) for x in (take, low, high))
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(take)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["row", "start", "end"])

    return rows


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to (doc_id, n_bytes, n_removed, n_spans, kept)."""
    for b in batches:
        sizes, gone, spans, kept = [], [], [], []
        for text, found in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            data, at, out, removed, runs = text.encode("utf-8"), 0, [], 0, 0
            end = -1
            for s in sorted((x["start"], x["end"]) for x in found or ()):
                if s[0] > end:
                    runs += 1
                    out.append(data[at : s[0]])
                    removed += s[1] - s[0]
                elif s[1] > end:
                    removed += s[1] - end
                end = at = max(end, s[1])
            out.append(data[max(at, 0) :])
            sizes.append(len(data))
            gone.append(removed)
            spans.append(runs)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, keep_first: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) per document of (doc_id, text); ``kept``: the bytes that stay.

    ``keep_first`` leaves the first copy of everything; otherwise no copy stays."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, found = find_repeats(docs, length, seed)
    spans = found.mapInArrow(covered(length, keep_first), "row long, start int, end int")
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = rows.join(by_row, "row", "left").select("doc_id", "text", "spans")
    return met.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
