"""Packing of tokenised documents into sequences, with the sources mixed in target proportions.

Sources are queues of tokens. A window is one round of deficit round-robin: in round r queue s may have sent
``rate(s) * r`` tokens in all, so what a round's whole tokens fall short of the quota is carried to the next
round, over every border of tasks. Documents are cut where a round's quota of their queue ends. The rounds follow
each other in one stream of tokens, queue after queue, and the stream is cut into sequences; only the last sequence
of all is not full. A queue that runs dry leaves its share to the others. Because quotas are functions of the
round's number, places in the stream need only running sums: of tokens in a queue (in two steps, blocks of rows and
rows of a block, so that one queue may hold any share of the rows) and of quotas in a round.

Ids are encoded once, into a table in the shared folder; the layout is worked out on lengths alone and meets the
ids in one join. Defined results: a null or empty text is its end token alone; repeated rows are packed each; a null
source is a queue of its own; other columns are not carried. Without targets each source's target is its share of
all tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import send_by_value
from .common import stored
from .encode import encoded, spread

SEQUENCE = 2048
#: Sequences in a window: the longer, the fewer documents are cut, and the coarser the mixture.
WINDOW = 64
END = 1
#: Rows in a block of a queue's running sum.
BLOCK_ROWS = 50_000

send_by_value(__name__)


def token_rows(path: str, end: int):
    """(doc_id, source, text) to (row_id, doc_id, source, n, ids): unsigned little-endian 32-bit ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for b in batches:
            for first, last, counts, ids in encoded(path, b.column("text")):
                size = counts + 1
                out = np.full(int(size.sum()), end, "<u4")
                out[spread(np.cumsum(size) - size, counts)] = ids
                at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size) * 4]).astype(np.int32)
                n = last - first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        b.column("doc_id").slice(first, n),
                        b.column("source").slice(first, n),
                        pa.array(size),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(out)]),
                    ],
                    ["row_id", "doc_id", "source", "n", "ids"],
                )
                row += n

    return rows


def queue_places(lengths: DataFrame) -> DataFrame:
    """(row_id, source, n) with ``first``: the queue's tokens before the document."""
    blocks = -(-lengths.count() // BLOCK_ROWS) or 1
    cut = lengths.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)))
    within = Window.partitionBy("source", "block").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("source", "block").agg(F.sum("n").alias("tokens"))
    sums = sums.select(F.col("source").alias("s"), F.col("block").alias("k"), F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("ahead"))
    cut = cut.withColumn("first", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return cut.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("k"))).select(
        "row_id", "source", "n", (F.col("first") + F.col("ahead")).alias("first")
    )


def sent(round_: Column) -> Column:
    """Tokens a queue has sent before a round."""
    return F.when(round_ >= F.col("rounds"), F.col("total")).otherwise(
        F.least(F.col("total"), F.floor(F.col("rate") * round_))
    )


def quotas(queues: DataFrame) -> DataFrame:
    """(source, rate, rounds, total) to a row per queue and round: what it sends from where in its queue, to where in the stream."""
    r, step = F.col("round"), 1 << 12
    rounds = (
        queues.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rounds") - 1) / step))))
        .withColumn("round", F.explode(F.sequence(F.col("some") * step, F.least((F.col("some") + 1) * step, F.col("rounds")) - 1)))
        .select("source", "round", sent(r).alias("from"), sent(r + 1).alias("to"))
    )
    ahead = Window.partitionBy("round").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    sums = rounds.withColumn("inside", F.coalesce(F.sum(F.col("to") - F.col("from")).over(ahead), F.lit(0)))
    # rounds start where all queues' earlier tokens end; a queue that ended earlier has no row, so sum by round and run on
    per_round = rounds.groupBy("round").agg(F.sum(F.col("to") - F.col("from")).alias("size"))
    some = F.floor(F.col("round") / step)
    blocks = per_round.groupBy(some.alias("some")).agg(F.sum("size").alias("size"))
    before = Window.orderBy("some").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("some", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("some").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        per_round.withColumn("some", some)
        .withColumn("in_block", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(blocks, "some")
        .select("round", (F.col("base") + F.col("in_block")).alias("start"))
    )
    return sums.join(starts, "round").select("source", "round", "from", "to", (F.col("start") + F.col("inside")).alias("place"))


def layout(lengths: DataFrame, sequence: int, window: int, targets: dict[str, float] | None) -> DataFrame:
    """(row_id, source, n) to pieces: (row_id, start, length, sequence_id, offset)."""
    spark = lengths.sparkSession
    queues = lengths.groupBy("source").agg(F.sum("n").alias("total"))
    everything = queues.agg(F.sum("total")).first()[0] or 0
    tokens = sequence * window
    if targets is None:
        queues = queues.withColumn("rate", F.col("total") * (tokens / everything if everything else 1.0))
        queues = queues.withColumn("rounds", F.lit(-(-everything // tokens)).cast("long"))
    else:
        shares = spark.createDataFrame([(k, float(v) / sum(targets.values()) * tokens) for k, v in targets.items()], "s string, rate double")
        queues = queues.join(F.broadcast(shares), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        # a source without a target comes last in line: one token's worth of the smallest share
        queues = queues.withColumn("rate", F.coalesce("rate", F.lit(float(tokens) / 1000)))
        queues = queues.withColumn("rounds", F.ceil(F.col("total") / F.col("rate")))
    queues = queues.select("source", "rate", "rounds", "total")
    placed = queue_places(lengths)
    own = queues.withColumnRenamed("source", "s")
    docs = placed.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    low = F.greatest(F.floor(F.col("first") / F.col("rate")) - 1, F.lit(0))
    high = F.least(F.floor((F.col("first") + F.col("n")) / F.col("rate")) + 1, F.col("rounds") - 1)
    docs = docs.withColumn("r", F.explode(F.sequence(low, F.greatest(low, high)))).select("row_id", "source", "n", "first", "r")
    turns = quotas(queues).withColumnRenamed("source", "s")
    met = docs.join(turns, F.col("source").eqNullSafe(F.col("s")) & (F.col("r") == F.col("round")))
    a, b = F.greatest("first", "from"), F.least(F.col("first") + F.col("n"), F.col("to"))
    cut = met.select("row_id", "first", a.alias("a"), b.alias("b"), (F.col("place") + a - F.col("from")).alias("at")).where("b > a")
    cut = cut.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / sequence), F.floor((F.col("at") + F.col("b") - F.col("a") - 1) / sequence))))
    begin = F.greatest(F.col("at"), F.col("sequence_id") * sequence)
    stop = F.least(F.col("at") + F.col("b") - F.col("a"), (F.col("sequence_id") + 1) * sequence)
    return cut.select(
        "row_id",
        (F.col("a") - F.col("first") + begin - F.col("at")).alias("start"),
        (stop - begin).alias("length"),
        "sequence_id",
        (begin - F.col("sequence_id") * sequence).alias("offset"),
    )


def pack(
    docs: DataFrame, path: str, sequence: int = SEQUENCE, window: int = WINDOW, end: int = END, targets: dict[str, float] | None = None
) -> DataFrame:
    """Pieces of the documents (doc_id, source, text) in their sequences, each with its ids.

    ``ids`` is binary, four bytes an id. ``targets`` gives sources' proportions in a window."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = stored(rows.mapInArrow(token_rows(path, end), f"row_id long, doc_id {kind}, source string, n long, ids binary"))
    pieces = layout(tokens.select("row_id", "source", "n"), sequence, window, targets)
    met = tokens.select("row_id", "doc_id", F.col("n").alias("doc_tokens"), "ids").join(pieces, "row_id")
    own = F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return met.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", own.alias("ids"))
