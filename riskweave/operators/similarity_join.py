"""All pairs of distinct texts at least as similar as a threshold, without comparing all pairs.

A pair of lengths allows at most D edits, so a pair keeps at least a known number of letters
in common and in order. Where few letters may go (``DROPS``, and at most ``SUBSEQUENCES`` ways
to choose them), both texts are turned into all their subsequences of that length and meet by
hash: texts that meet are similar, so the work follows the texts and the pairs found, however
many texts share a part. Subsequences that one text alone has are dropped after a single sort.

Other lengths are joined by pieces. The shorter text is cut into D + 1 pieces; D
edits cannot touch all of them, so one piece is found unchanged in the longer text, no
further from its place than the edits around it can move it. Joining on (both lengths,
piece number, piece text) therefore misses no pair. What it proposes too much is removed
by Spark's own bounded levenshtein first and by the exact distance last.

A piece that many texts hold ("smith") would propose all their pairs. For such a piece
the join asks for a second one: among the piece in question at most p edits lie before it
and at most D - p behind it, so one side is cut again into one more part than its edits.
What still meets under one key is measured, and a key of more pairs than a cell may hold is
laid out as a grid of cells, so no task gets more than a bounded part of it. Both steps apply
at every table size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import insert_delete_distance
from ..session import materialize, shuffle_width

#: Texts from which on a piece is joined by a second one.
COMMON_PIECE_TEXTS = 1_000
#: Rows of either side that a cell of a heavy key holds, on average.
CELL_ROWS = 4_000
#: Keys up to which a measured list is sent to all tasks; a longer one is joined by shuffle.
SMALL_LIST = 100_000
#: Most letters dropped from a text, and most ways to drop them, for lengths that are joined by common subsequences.
DROPS = 3
SUBSEQUENCES = 600
KEY = ["short", "long", "piece", "body"]


def edit_budget(total: Column, threshold: float) -> Column:
    """Most insertions and deletions a pair with that summed length may need."""
    return F.floor(total * ((100.0 - threshold) / 100.0) + 1e-9).cast("int")


def _piece_bounds(short: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    start = F.floor(i * short / pieces).cast("int")
    return start, (F.floor((i + 1) * short / pieces).cast("int") - start)


def _uncut(rows: DataFrame) -> DataFrame:
    """Too short to cut: every text of that length is a candidate."""
    return rows.where(F.col("pieces") > F.col("short")).select(
        "text", "short", "long", F.lit(-1).alias("piece"), F.lit("").alias("body"), F.lit(0).alias("at")
    )


def _ways(length: Column, drops: Column) -> Column:
    """How many choices of ``drops`` letters there are, for at most DROPS of them."""
    ways, out = F.lit(1).cast("double"), F.when(drops == 0, 1.0)
    for k in range(1, DROPS + 1):
        ways = ways * (length - (k - 1)) / k
        out = out.when(drops == k, ways)
    return out


def length_pairs(texts: DataFrame, threshold: float, most: int) -> DataFrame:
    """(short, long, budget, gap, keep, by_parts) for the lengths that occur: ``keep`` letters in common at least."""
    lengths = texts.select(F.length("text").alias("short")).where("short IS NOT NULL").distinct()
    pairs = lengths.crossJoin(lengths.withColumnRenamed("short", "long")).where("short <= long")
    pairs = pairs.withColumns({"budget": edit_budget(F.col("short") + F.col("long"), threshold), "gap": F.col("long") - F.col("short")})
    pairs = pairs.where(F.col("gap") <= F.col("budget")).withColumn(
        "keep", F.col("short") - F.least("short", F.floor((F.col("budget") - F.col("gap")) / 2).cast("int"))
    )
    drops = F.col("long") - F.col("keep")
    return pairs.withColumn("by_parts", (drops > DROPS) | (_ways(F.col("long"), drops) > most))


def _subsequences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id): hashes of the subsequences of each text, for its wanted numbers of dropped letters.

    Of a stretch of equal letters the first ones go, so that a subsequence is rarely made twice."""
    rows = texts.withColumn("size", F.length("text")).join(wanted, "size")
    last = F.lit(0)
    for k in range(1, DROPS + 1):
        # places after the text stand for letters that aren't dropped
        places = F.when(F.col("drops") >= k, F.sequence(last + 1, F.col("size") - F.col("drops") + k)).otherwise(F.array(F.col("size") + 1))
        rows = rows.withColumn(f"p{k}", F.explode(places))
        here = F.col(f"p{k}")
        first = (F.col("drops") < k) | (here == last + 1) | (F.substring("text", here, F.lit(1)) != F.substring("text", here - 1, F.lit(1)))
        rows = rows.where(first)
        last = here
    ends = [F.lit(0), *[F.col(f"p{k}") for k in range(1, DROPS + 1)], F.col("size") + 1]
    kept = [F.substring("text", a + 1, b - a - 1) for a, b in zip(ends, ends[1:], strict=False)]
    return rows.select(F.xxhash64(F.concat(*kept)).alias("key"), "id")


def _meeting(texts: DataFrame, lengths: DataFrame, cell: int) -> DataFrame:
    """(a, b) texts with a common subsequence as long as some pair of lengths asks for."""
    lengths = lengths.where(~F.col("by_parts"))
    wanted = lengths.select(F.inline(F.array(*[F.struct(F.col(c).alias("size"), (F.col(c) - F.col("keep")).alias("drops")) for c in ("short", "long")])))
    same = Window.partitionBy("key")
    rows = _subsequences(texts, _measured(wanted.distinct()))
    rows = rows.withColumns({"low": F.min("id").over(same), "high": F.max("id").over(same)}).where("low < high")
    shared = materialize(rows.select("key", "id").distinct())
    left, right = gridded(shared, shared, ["key"], cell, "id")
    left, right = left.withColumnRenamed("id", "i"), right.withColumnRenamed("id", "j")
    pairs = left.join(right, ["key", "row", "column"]).where("i < j").select("i", "j").distinct()
    one, two = texts.select(F.col("id").alias("i"), F.col("text").alias("x")), texts.select(F.col("id").alias("j"), F.col("text").alias("y"))
    turned = F.struct(F.length("x"), "x") > F.struct(F.length("y"), "y")
    met = pairs.join(one, "i").join(two, "j")
    return met.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("b"))


def _pieces(texts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Index side: the pieces of each text for every length of a longer partner."""
    rows = texts.select("text", F.length("text").alias("short")).join(lengths, "short").withColumn("pieces", F.col("budget") + 1)
    cut = rows.where(F.col("pieces") <= F.col("short")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("budget"))))
    start, size = _piece_bounds(F.col("short"), F.col("pieces"), F.col("piece"))
    cut = cut.select("text", "short", "long", "piece", F.substring("text", start + 1, size).alias("body"), start.alias("at"))
    return cut.unionByName(_uncut(rows))


def _probes(texts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Probe side: where each piece of a shorter partner may be found in the text."""
    rows = texts.select("text", F.length("text").alias("long")).join(lengths, "long").withColumn("pieces", F.col("budget") + 1)
    cut = rows.where(F.col("pieces") <= F.col("short")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("budget"))))
    # the edits before piece i are at most i, those after it at most budget - i, and
    # insertions minus deletions over the whole text are the gap
    removed = F.floor((F.col("budget") - F.col("gap")) / 2).cast("int")
    added = F.floor((F.col("budget") + F.col("gap")) / 2).cast("int")
    low = F.greatest(-F.col("piece"), F.col("gap") - (F.col("budget") - F.col("piece")), -removed)
    high = F.least(F.col("piece"), F.col("gap") + (F.col("budget") - F.col("piece")), added)
    start, size = _piece_bounds(F.col("short"), F.col("pieces"), F.col("piece"))
    cut = (
        cut.withColumns({"low": low, "high": high, "start": start, "size": size})
        .where(F.col("low") <= F.col("high"))
        .withColumn("at", F.explode(F.sequence(F.col("start") + F.col("low"), F.col("start") + F.col("high"))))
        .where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("long")))
        .select("text", "short", "long", "piece", F.substring("text", F.col("at") + 1, F.col("size")).alias("body"), "at")
    )
    return cut.unionByName(_uncut(rows))


def common_pieces(index: DataFrame, floor: int) -> DataFrame:
    """Pieces held by many texts: at most rows / floor of them, all of them."""
    counts = index.where("piece >= 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= floor).select(*KEY, F.lit(True).alias("common"))


def _measured(keys: DataFrame) -> DataFrame:
    """The keys written once, and marked for broadcast if a count shows that they are few."""
    keys = materialize(keys)
    return F.broadcast(keys) if keys.count() <= SMALL_LIST else keys


def gridded(index: DataFrame, probe: DataFrame, on: list[str], cell: int, spread: str = "text") -> tuple[DataFrame, DataFrame]:
    """Both sides with (row, column), the cell of their key's grid; each pair meets in one cell.

    The index side is dealt to rows and repeated over columns, the probe side the other way
    round. A light key has one cell. Heavy keys are at most rows / cell."""
    sides = index.select(*on, F.lit(1).alias("left")).unionByName(probe.select(*on, F.lit(0).alias("left")))
    counts = sides.groupBy(*on).agg(F.sum("left").alias("n"), F.sum(1 - F.col("left")).alias("m"))
    heavy = _measured(
        counts.where((F.col("n") > 0) & (F.col("m") > 0) & (F.greatest("n", "m") > cell)).select(
            *on, F.ceil(F.col("n") / cell).cast("int").alias("rows"), F.ceil(F.col("m") / cell).cast("int").alias("columns")
        )
    )

    def dealt(df: DataFrame, own: str, other: str, place: str, repeat: str) -> DataFrame:
        met = df.join(heavy, on, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
        met = met.withColumn(place, F.pmod(F.xxhash64(spread), F.col(own)).cast("int"))
        return met.withColumn(repeat, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop(own, other)

    return dealt(index, "rows", "columns", "row", "column"), dealt(probe, "columns", "rows", "column", "row")


def _second_pieces(df: DataFrame, common: DataFrame, threshold: float, probing: bool) -> DataFrame:
    """Add (part, mark): a second piece for rows of a common piece, a constant for all others.

    Which side is cut follows from the lengths and the piece number, so both sides of the
    join agree on it: the side whose parts come out longer."""
    short, long, piece, at = (F.col(c) for c in ("short", "long", "piece", "at"))
    budget = edit_budget(short + long, threshold)
    start, size = _piece_bounds(short, budget + 1, piece)
    tail = short - start - size
    before, behind = piece, budget - piece
    left = start * (behind + 1) >= tail * (before + 1)
    edits = F.when(left, before).otherwise(behind)
    room = F.when(left, start).otherwise(tail)
    origin = F.when(left, F.lit(0)).otherwise(start + size)
    # insertions minus deletions on the side that is cut, and the shift of its first letter
    shift = at - start
    net = F.when(left, shift).otherwise(long - short - shift)
    base = F.when(left, F.lit(0)).otherwise(shift)

    def cut(part: Column) -> tuple[Column, Column]:
        low = F.floor(part * room / (edits + 1)).cast("int")
        return low, (F.floor((part + 1) * room / (edits + 1)).cast("int") - low)

    def mark(part: Column, place: Column, width: Column) -> Column:
        return F.struct(part.alias("part"), F.substring("text", place + 1, width).alias("mark"))

    def indexed(part: Column) -> Column:
        low, width = cut(part)
        return mark(part, origin + low, width)

    def probed(part: Column) -> Column:
        low, width = cut(part)
        least = F.greatest(-part, net - (edits - part), -F.floor((edits - net) / 2).cast("int"))
        most = F.least(part, net + (edits - part), F.floor((edits + net) / 2).cast("int"))
        moves = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
        inside = F.filter(moves, lambda e: origin + low + base + e >= 0)
        return F.transform(inside, lambda e: mark(part, origin + low + base + e, width))

    parts = F.sequence(F.lit(0), edits)
    second = F.flatten(F.transform(parts, probed)) if probing else F.transform(parts, indexed)
    first_only = F.array(F.struct(F.lit(-1).alias("part"), F.lit("").alias("mark")))
    marked = df.join(common, KEY, "left")
    return marked.select("text", *KEY, F.inline(F.when(F.col("common"), second).otherwise(first_only)))


def _sharing_parts(texts: DataFrame, lengths: DataFrame, threshold: float, floor: int, cell: int) -> DataFrame:
    """(a, b) texts that share pieces as the lengths joined by them ask for, and stand the bounded levenshtein."""
    lengths = _measured(lengths.where("by_parts").select("short", "long", "budget", "gap"))
    pieces = _pieces(texts, lengths)
    common = _measured(common_pieces(pieces, floor))
    pieces = _second_pieces(pieces, common, threshold, probing=False)
    probes = _second_pieces(_probes(texts, lengths), common, threshold, probing=True)
    on = [*KEY, "part", "mark"]
    index, probe = gridded(pieces, probes, on, cell)
    index, probe = index.withColumnRenamed("text", "a"), probe.withColumnRenamed("text", "b")
    proposed = index.join(probe, [*on, "row", "column"]).where(
        (F.col("a") != F.col("b")) & ((F.col("short") < F.col("long")) | (F.col("a") < F.col("b")))
    )
    budget = edit_budget(F.col("short") + F.col("long"), threshold)
    return proposed.withColumn("budget", budget).where(F.expr("levenshtein(a, b, budget)") >= 0).select("a", "b").distinct()


def similar_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, score) of distinct texts with score >= threshold; each pair once.

    ``texts`` has one column ``text`` of distinct values. They are few bytes for the pieces
    they turn into, so they are spread by number, not by size."""
    spark = texts.sparkSession
    texts = materialize(texts.repartition(shuffle_width(spark), "text").withColumn("id", F.monotonically_increasing_id()))
    floor = int(spark.conf.get("spark.riskweave.commonPieceTexts", str(COMMON_PIECE_TEXTS)))
    cell = int(spark.conf.get("spark.riskweave.cellRows", str(CELL_ROWS)))
    most = int(spark.conf.get("spark.riskweave.subsequences", str(SUBSEQUENCES)))
    lengths = materialize(length_pairs(texts, threshold, most))
    close = _meeting(texts, lengths, cell)
    if not lengths.where("by_parts").isEmpty():
        # texts may meet by subsequences of a length that another pair of lengths asked for
        close = close.unionByName(_sharing_parts(texts, lengths, threshold, floor, cell)).distinct()
    total = F.length("a") + F.length("b")
    return (
        close.withColumn("distance", insert_delete_distance("a", "b"))
        .where(F.col("distance") <= edit_budget(total, threshold))
        .select("a", "b", (100.0 * (1.0 - F.col("distance") / total)).alias("score"))
    )
