"""Similarity join of documents on word n-gram sets, and the groups it links.

Two sets link when ``100 * |A and B| >= percent * |A or B|``. Equal sets are one class from the start, so a copy costs
one row. Classes meet in tiles:

1. *Size bands.* Sizes are cut into bands by a ratio; a set belongs to its own band and, if large enough, also meets
   the next one. A pair that links differs in at most ``d`` elements, ``d`` following from the band's largest size.
2. *Tiles.* Within a band elements are dealt by hash into more than ``d`` parts. The parts that hold differences are
   ``d`` at most, so a linked pair agrees on a whole part; a tile is a band, a part and its content. Sets with too many
   empty parts for this argument meet, among themselves, in tiles of their rarest-by-hash elements as well (a prefix
   filter). No linked pair is lost.
3. *First round.* In each tile everyone is compared with the tile's smallest member, by bitmaps and then exactly. What links is joined
   to components; near copies are mostly done after it, at a cost linear in the members.
4. *Second round.* Tiles that still hold several components are compared in blocks of bounded size, pairs of one
   component left out. Bitmaps of hashed elements come first: the bits of A missing in B are elements missing in B, which
   bounds the overlap from above. Pairs that stand this are intersected exactly, as sorted arrays: for small tiles
   in a join of the distinct pairs. Large tiles, which share most of their members, name links enough to join what
   stands the bitmaps into groups; a set brings its elements once to its group, not to each of its tiles (unless the
   tiles are less to lay out), and there pairs are tested on the spot, where a link joins components at once.

Elements are 64-bit hashes of n-grams, classes 64-bit hashes of sets. Defined results: a document without text or words
has an empty set and links with nothing; one with fewer words than n has its whole sequence as its only element; repeated
rows are one class; a null id is carried but names no component unless nothing else does; other columns are not carried."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import send_by_value, shuffle_width
from .common import buffer, grams, hashes, mix, runs, scratch, slices, small, stored

#: Ratio of neighbouring band borders.
BAND = 1.5
#: Members of a block in the second round.
BLOCK = 512
#: Members up to which a tile names its pairs and leaves the exact test to a join; larger tiles make it themselves.
FEW = 32
#: Bits of a bitmap per element of the band's largest set, before rounding up to a power of two.
BITS = 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

send_by_value(__name__)


def most_apart(total: int, percent: int) -> int:
    """Most elements that two linked sets of ``total`` elements together may not share."""
    return (100 - percent) * total // (100 + percent)


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


def band_end(band: int) -> int:
    """The largest size of a band."""
    n = int(BAND ** (band + 1)) + 1
    while band_of(n) > band:
        n -= 1
    return n


def parts_of(band: int, percent: int) -> tuple[int, int]:
    """Most differences of a linked pair whose larger set lies in the band, and the number of parts."""
    d = most_apart(2 * band_end(band), percent)
    return d, d + 1 + d // 16 + 2


def gram_sets(texts: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; words are runs of anything but ASCII white space."""
    for first, last in slices(texts):
        data, starts = buffer(texts.slice(first, last - first))
        data = _LOWER[data] if lower else data
        start, end = runs(~_SPACE[data])
        h = hashes(data, start, end)
        at = np.searchsorted(start, starts)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b == a:
                yield np.empty(0, np.uint64)
            else:
                yield np.unique(grams(h[a:b], min(n, b - a)))


def name_of(s: np.ndarray) -> int:
    """A set's class: a signed 64-bit hash."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        h = np.array([np.sum(mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s))], np.uint64)
        return int(mix(h).view(np.int64)[0])


def tiles(s: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the tiles a set is in."""
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    own, out = band_of(n), []
    bands = [own]
    while band_end(bands[-1]) + 1 <= n * 100 // percent:
        bands.append(bands[-1] + 1)
    with np.errstate(over="ignore"):
        for band in bands:
            d, parts = parts_of(band, percent)
            if d == 0:
                continue
            salt = np.uint64(band + 1) * np.uint64(0x9E3779B97F4A7C15)
            content = np.zeros(parts, np.uint64)
            part = (mix(s) % np.uint64(parts)).astype(np.int64)
            np.add.at(content, part, mix(s ^ salt))
            full = np.flatnonzero(np.bincount(part, minlength=parts))
            out.append(mix(content[full] + mix(full.astype(np.uint64) + salt)))
            if len(full) <= d:
                prefix = s[: n - (percent * n + 99) // 100 + 1]
                out.append(mix(prefix ^ ~salt))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def bitmap(s: np.ndarray) -> bytes:
    bits = 1 << max(int(BITS * len(s) * BAND).bit_length(), 6)
    out = np.zeros(bits // 8, np.uint8)
    at = (mix(s + np.uint64(1)) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A bitmap brought to a smaller size; bits keep their meaning modulo the size."""
    return np.bitwise_or.reduce(np.frombuffer(data, np.uint8).reshape(-1, size), axis=0)


def described(n: int):
    """(doc_id, text) to (doc_id, set, size, bits)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(name_of(s), len(s), bitmap(s)) for s in gram_sets(b.column(1), n)]
            values = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *values], ["doc_id", "set", "size", "bits"])

    return describe


def tile_rows(n: int, percent: int):
    """(text) to (tile, set), each set of a batch once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[int] = set()
            for first, last in slices(b.column(0)):
                tile, own = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for s in gram_sets(b.column(0).slice(first, last - first), n):
                    name = name_of(s)
                    if name not in seen:
                        seen.add(name)
                        tile.append(tiles(s, percent))
                        own.append(np.full(len(tile[-1]), name))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tile)), pa.array(np.concatenate(own))], ["tile", "set"])

    return rows


def bit_test(percent: int):
    """(a, b, size_a, size_b, bits_a, bits_b) to the pairs whose bitmaps allow a link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*[batch.column(c).to_pylist() for c in ("size_a", "size_b", "bits_a", "bits_b")], strict=True):
                need = -(-percent * (m + n) // (100 + percent))
                width = min(len(x), len(y))
                one, two = folded(x, width), folded(y, width)
                missing, extra = np.bitwise_count(one & ~two).sum(dtype=np.int64), np.bitwise_count(two & ~one).sum(dtype=np.int64)
                keep.append(need <= min(m, n) and m - missing >= need and n - extra >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return test


def exact(n: int, percent: int):
    """(a, b, text_a, text_b) to the pairs (a, b) that link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(gram_sets(batch.column(2), n), gram_sets(batch.column(3), n), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return test


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets link. ``texts``: (set, text), one of each class."""
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(exact(n, percent), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for all nodes of links (a, b): the smallest node reachable.

    Each round a node's links are turned to point at its smallest neighbour, and that neighbour at them."""
    marks = lambda x: x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    edges = stored(links.where("a <> b"))
    before = marks(edges)
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # what a node knows goes to its larger neighbours; then to its smaller ones
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        turned = large.unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        turned = stored(turned)
        small = turned.groupBy("a").agg(F.min("b").alias("low"))
        nxt = turned.join(small, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        nxt = stored(nxt.where("a <> b").distinct())
        after = marks(nxt)
        edges = nxt
        if before == after:
            break
        before = after
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def elements_of(n: int):
    """(set, text) to (set, elements): sorted hashes."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [s.tobytes() for s in gram_sets(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["set", "elements"])

    return take


def block_links(percent: int, want: str):
    """Rows of tiles' blocks, sorted by block, to what stands the bitmaps (a, b).

    ``pairs``: the pairs. ``members``: so many of them that they join the members of all such pairs, fewer than a block
    has members. ``links``: rows bring their elements, the pairs are intersected, and a link joins the components of
    both, so no more links come out of a block than it has members."""
    exact = want == "links"

    def tile_links(x: pa.Table) -> pa.RecordBatch:
        size = x.column("size").to_numpy()
        root = x.column("root").to_numpy().copy()
        side = x.column("side").to_numpy()
        name = x.column("set").to_numpy()
        bits = x.column("bits").to_pylist()
        if exact:
            sets = [np.frombuffer(e, np.uint64) for e in x.column("elements").to_pylist()]
            begin = np.cumsum(size) - size
            universe, rank = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(universe), bool)
        width = min(map(len, bits))
        maps = np.stack([folded(b, width) for b in bits])
        place = np.arange(len(size))
        group = np.arange(len(size))
        low, high = [], []
        for i in np.flatnonzero(side != 1).tolist():
            other = place[(side == 1) if side[i] == 0 else (place > i)]
            need = -(-percent * (size[i] + size[other]) // (100 + percent))
            open_ = (root[other] != root[i]) & (need <= np.minimum(size[i], size[other]))
            other, need = other[open_], need[open_]
            if len(other):
                missing = np.bitwise_count(maps[i] & ~maps[other]).sum(axis=1, dtype=np.int64)
                extra = np.bitwise_count(maps[other] & ~maps[i]).sum(axis=1, dtype=np.int64)
                stand = (size[i] - missing >= need) & (size[other] - extra >= need)
                other, need = other[stand], need[stand]
            if want == "members" and len(other):
                # one member of each group that isn't joined yet
                met, first = np.unique(group[other], return_index=True)
                new = other[first[met != group[i]]]
                low += np.minimum(name[i], name[new]).tolist()
                high += np.maximum(name[i], name[new]).tolist()
                group[np.isin(group, met)] = group[i]
            if want == "pairs":
                low += np.minimum(name[i], name[other]).tolist()
                high += np.maximum(name[i], name[other]).tolist()
            if not exact or not len(other):
                continue
            own = rank[begin[i] : begin[i] + size[i]]
            mark[own] = True
            common = np.add.reduceat(mark[rank], begin, dtype=np.int64)[other]
            mark[own] = False
            for j in other[common >= need].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    low.append(min(name[i], name[j]))
                    high.append(max(name[i], name[j]))
        return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key = rest.column("block").to_numpy()
            cut = np.flatnonzero(np.diff(key)) + 1
            for low, high in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=False):
                yield tile_links(rest.slice(low, high - low))
            rest = rest.slice(int(cut[-1])) if len(cut) else rest
        if rest is not None and rest.num_rows:
            yield tile_links(rest)

    return pairs


def second_round(members: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the tiles that hold several components: those of few members, and those of many."""
    own = members.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    open_ = (
        own.groupBy("tile")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("set") % (1 << 40)).alias("sum"))
        .where("low <> high")
    )
    # equal tiles (same members) are compared once
    open_ = open_.groupBy("members", "sum", "low", "high").agg(F.min("tile").alias("tile")).select("tile", "members")
    rows = stored(own.join(open_, "tile").select("tile", "members", "set", "root").join(sets.select("set", "size"), "set"))
    return rows.where(F.col("members") <= FEW), rows.where(F.col("members") > FEW)


def blocks(rows: DataFrame, fetched: DataFrame, percent: int, want: str) -> DataFrame:
    """What ``block_links`` finds in tiles. ``fetched`` has what rows bring along, by set."""
    place = Window.partitionBy("tile").orderBy("size", "set")
    # counted here: of a tile's members only some may be left, and blocks that nobody is in must not be met
    held = F.count(F.lit(1)).over(Window.partitionBy("tile"))
    rows = rows.withColumn("block", F.floor((F.row_number().over(place) - 1) / BLOCK)).withColumn("blocks", F.ceil(held / BLOCK))
    rows = rows.join(fetched, "set")
    # a block meets itself and every other one: side 0 is the lower of the two, 1 the higher, 2 both
    k, b = F.col("k"), F.col("block")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select(
        F.xxhash64("tile", F.least(k, b), F.greatest(k, b)).alias("block"),
        F.when(k == b, 2).when(b < k, 0).otherwise(1).cast("int").alias("side"),
        "tile", "set", "size", "root", *[c for c in fetched.columns if c != "set"],
    )
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "block").sortWithinPartitions("block", "side")
    return dealt.mapInArrow(block_links(percent, want), "a long, b long").distinct()


def by_group(many: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of large tiles (tile, set, size, root) whose sets are in a group (set, group), under the group as their tile.

    A group that would take more rows in its blocks than its parts of the tiles do in theirs stays in those parts."""
    laid = lambda n: n * F.ceil(n / BLOCK)
    rows = stored(many.join(grouped, "set").select("group", "tile", "set", "size", "root"))
    parts = rows.groupBy("group", "tile").agg(F.count(F.lit(1)).alias("n")).groupBy("group").agg(F.sum(laid(F.col("n"))).alias("apart"))
    whole = rows.select("group", "set").distinct().groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(parts, "group")
    whole = small(stored(whole.where(laid(F.col("n")) <= F.col("apart")).select("group", F.col("group").alias("whole"))))
    rows = rows.join(whole, "group", "left")
    return rows.select(F.coalesce("whole", F.xxhash64("group", "tile")).alias("tile"), "set", "size", "root").distinct()


def link(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, set, size) and components (node, root) of their sets, from (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    told = stored(rows.mapInArrow(described(n), f"doc_id {kind}, set long, size long, bits binary"))
    tile = Window.partitionBy("tile")
    met = rows.select("text").mapInArrow(tile_rows(n, percent), "tile long, set long")
    met = met.withColumn("first", F.min("set").over(tile)).withColumn("last", F.max("set").over(tile))
    members = stored(met.where("first <> last").select("tile", "set", "first").distinct())
    names = members.select("set").distinct().join(told, "set")
    names = stored(names.groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"), F.any_value("bits").alias("bits")))

    def texts(wanted: DataFrame) -> DataFrame:
        # ids may repeat, so the class is worked out again from the text itself
        ids = small(stored(wanted.join(names, "set").select(F.col("doc_id").alias("id"), "set")))
        found = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("id"))).select("set", "text")
        return found.mapInArrow(of_class(n), "set long, text string").dropDuplicates(["set"])

    pairs = members.where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b")).distinct()
    side = names.select("set", "size", "bits")
    tested = pairs.join(side.toDF("a", "size_a", "bits_a"), "a").join(side.toDF("b", "size_b", "bits_b"), "b")
    pairs = stored(tested.select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(bit_test(percent), "a long, b long"))
    both = stored(texts(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()))
    links = stored(verified(pairs, both, n, percent))
    roots = components(links)
    few, many = second_round(members, names, roots, percent)
    bits = names.select("set", "bits")
    near = stored(blocks(few, bits, percent, "pairs").join(pairs, ["a", "b"], "left_anti"))
    both = texts(near.select(F.explode(F.array("a", "b")).alias("set")).distinct())
    # most members of large tiles share a passage and no more; only the others bring their elements
    grouped = components(blocks(many, bits, percent, "members")).toDF("set", "group")
    many = stored(by_group(many, grouped))
    elements = texts(many.select("set").distinct()).mapInArrow(elements_of(n), "set long, elements binary")
    more = stored(verified(near, stored(both), n, percent).unionByName(blocks(many, bits.join(elements, "set"), percent, "links")))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    return told.select("doc_id", "set", "size"), roots


def of_class(n: int):
    """(set, text) rows whose text has that set."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([name_of(s) for s in gram_sets(b.column(1), n)], np.int64)
            yield b.filter(pa.array(own == b.column(0).to_numpy()))

    return check


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document."""
    told, roots = link(docs, n, percent)
    own = told.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    lowest = own.where("size > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    met = own.join(lowest, "root", "left")
    return met.select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each component: the one with the smallest id.

    Rows that share an id stay or go together, but equal rows among them are kept once."""
    with scratch(docs.sparkSession):
        rows = groups(docs, n, percent).groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"),
        )
        # most documents stay alone: those that go, and the ids that repeat, are the shorter list
        rows = stored(rows.where("n > 1 or not stays").select(F.col("doc_id").alias("_id"), "n", "stays"), keep=True)
    match = F.col("doc_id").eqNullSafe(F.col("_id"))
    once = docs.join(small(rows.select("_id")), match, "left_anti")
    return once.unionByName(docs.join(small(rows.where("stays").select("_id")), match, "left_semi").dropDuplicates())
