"""Isolation forest whose every draw is a whole number from an md5, so SQL can grow the same trees.

- Sample: a row stands in ``k = ceil(1.5 * sample * trees / rows)`` slots (at most one per tree). Slot j of a row goes
  to tree ``(h(seed:id) + j) % trees`` and draws ``h(seed:id:j)``; a slot stays if its draw is below
  ``share * 2^48`` (``share`` the wanted share of slots, at most 1), and each tree keeps its ``sample`` lowest draws.
  A large batch thus sends about 1.5 samples' worth of rows to each tree, never the batch.
- Split of node n (root 1, children 2n and 2n + 1) of tree t at depth d < ``depth`` with two rows or more: of the features
  whose values differ there, the ``h(seed:t:n:f) % count``-th; of that feature's distinct values, sorted, the
  ``h(seed:t:n:c) % (distinct - 1)``-th is the threshold: rows at or below it go left. No float arithmetic chooses a cut.
- A leaf of n rows at depth d has path length ``1000 d + round(1000 c(n))`` thousandths, c the average depth of an
  unsuccessful search in a binary tree of n leaves.
- Score of a row: ``-2^(-mean path / c(min(sample, rows)))`` to six decimals; the contamination percentile of the batch's
  scores is the offset, and ``ml_anomaly_score = clip((0.5 - (score - offset)) * 100, 0, 100)`` to two decimals, half even.

h(x) is the first 48 bits of md5(x) (12 hex digits). Trees grow in parallel, one task each on its sample; rows are scored
where they are against the node table (at most ``trees * 2^(depth + 1)`` entries), which is all that reaches the driver."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..config import RiskConfig
from ..functions.numeric import clip, round_half_even
from ..session import send_by_value, shuffle_width
from .features import ANOMALY_FEATURES, feature
from .isolation_forest import SCORE_UNITS, expected_depth, percentile_of

send_by_value(__name__)

NODE_SCHEMA = "tree int, node int, feature int, threshold double, path_milli long"
_HIGH = float(1 << 48)


def draw(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def draw_column(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def leaf_milli(depth: int, rows: int) -> int:
    return 1000 * depth + int(math.floor(1000 * expected_depth(rows) + 0.5))


def slots(trees: int, sample: int, rows: int) -> tuple[int, float]:
    """Slots per row and the share of slots that stay, by the same arithmetic as the SQL."""
    wanted = 1.5 * sample * trees / max(rows, 1)
    k = min(max(math.ceil(wanted), 1), trees)
    return k, min(1.0, wanted / k)


def sample_trees(df: DataFrame, names: tuple[str, ...], trees: int, rows: int, seed: int, sample: int) -> DataFrame:
    """(tree, row id, features) of each tree's sample."""
    k, share = slots(trees, sample, rows)
    ids = F.concat_ws(":", *[F.col(c).cast("string") for c in (["transaction_id"] if "transaction_id" in df.columns else names)])
    base = df.select(ids.alias("rid"), *[feature(df, n).alias(n) for n in names])
    slot = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot")
    drawn = base.select("*", slot).select(
        "rid", *names,
        F.pmod(draw_column(F.lit(str(seed)), "rid") + F.col("slot"), F.lit(trees)).cast("int").alias("tree"),
        draw_column(F.lit(str(seed)), "rid", F.col("slot").cast("string")).alias("chance"),
    ).where(F.col("chance").cast("double") < F.lit(share * _HIGH))
    drawn = drawn.repartition(min(trees, shuffle_width(df.sparkSession)), "tree")
    first = Window.partitionBy("tree").orderBy("chance", "rid")
    return drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample).drop("place", "chance")


def _grower(names: tuple[str, ...], seed: int, most: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        data = pdf[list(names)].to_numpy(dtype=float)
        nodes: list[tuple] = []
        queue = [(np.arange(len(data)), 1, 0)]
        while queue:
            rows, node, depth = queue.pop()
            values = data[rows]
            spread = [f for f in range(len(names)) if depth < most and len(rows) > 1 and values[:, f].max() > values[:, f].min()]
            if not spread:
                nodes.append((tree, node, -1, 0.0, leaf_milli(depth, len(rows))))
                continue
            f = spread[draw(f"{seed}:{tree}:{node}:f") % len(spread)]
            distinct = np.unique(values[:, f])
            cut = float(distinct[draw(f"{seed}:{tree}:{node}:c") % (len(distinct) - 1)])
            nodes.append((tree, node, f, cut, -1))
            below = values[:, f] <= cut
            queue.append((rows[below], 2 * node, depth + 1))
            queue.append((rows[~below], 2 * node + 1, depth + 1))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "path_milli"])

    return grow


@dataclass(frozen=True)
class HashedForest:
    names: tuple[str, ...]
    nodes: pd.DataFrame
    trees: int
    sample: int
    depth: int
    offset: float = -0.5

    def normality(self, df: DataFrame) -> Column:
        """-2^(-mean path / c(sample)), to six decimals."""
        width = 1 << (self.depth + 1)
        kept = sorted(self.nodes["tree"].unique())
        index = {t: k for k, t in enumerate(kept)}
        split = np.full((len(kept), width), -1, np.int64)
        cut = np.zeros((len(kept), width))
        path = np.zeros((len(kept), width), np.int64)
        for t, n, f, c, p in self.nodes[["tree", "node", "feature", "threshold", "path_milli"]].itertuples(index=False):
            split[index[t], n], cut[index[t], n], path[index[t], n] = f, c, p
        norm = max(expected_depth(self.sample), 1.0)
        count, most = len(kept), self.depth

        @pandas_udf(T.DoubleType())
        def walk(*columns: pd.Series) -> pd.Series:
            data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            out = np.empty(len(data))
            trees = np.arange(count)[None, :]
            for lo in range(0, len(data), 1024):
                block = data[lo : lo + 1024]
                at = np.ones((len(block), count), np.int64)
                rows = np.arange(len(block))[:, None]
                for _ in range(most + 1):
                    f = split[trees, at]
                    inner = f >= 0
                    go = 2 * at + (block[rows, np.maximum(f, 0)] > cut[trees, at])
                    at = np.where(inner, go, at)
                total = path[trees, at].sum(axis=1)
                out[lo : lo + 1024] = -np.exp2(-(total / count / 1000.0) / norm)
            return pd.Series(np.rint(out * SCORE_UNITS) / SCORE_UNITS)

        return walk(*[feature(df, n) for n in self.names])

    def score(self, df: DataFrame) -> DataFrame:
        raw = (F.lit(0.5) - (self.normality(df) - F.lit(self.offset))) * 100
        return df.withColumn("ml_anomaly_score", round_half_even(clip(raw, 0, 100), 2))


def fit_hashed_forest(df: DataFrame, cfg: RiskConfig, names: tuple[str, ...] = ANOMALY_FEATURES) -> HashedForest:
    rows = df.count()
    if rows == 0:
        raise ValueError("an isolation forest needs at least one row")
    sample = sample_trees(df, names, cfg.forest_trees, rows, cfg.seed, cfg.forest_sample)
    nodes = sample.groupBy("tree").applyInPandas(_grower(names, cfg.seed, cfg.forest_depth), NODE_SCHEMA).toPandas()
    forest = HashedForest(names, nodes, cfg.forest_trees, min(cfg.forest_sample, rows), cfg.forest_depth)
    known = df.select(*[feature(df, n).alias(n) for n in names])
    offset, _ = percentile_of(known.select(forest.normality(known).alias("s")), "s", cfg.contamination)
    return HashedForest(names, nodes, cfg.forest_trees, forest.sample, cfg.forest_depth, offset)


def score_hashed(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Fit on the batch and score it."""
    return fit_hashed_forest(df, cfg).score(df)
