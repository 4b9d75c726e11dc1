"""Isolation forest: trees grown in parallel on small samples, rows scored where they are.

Every tree sees about 256 sampled rows, so the sample has a fixed size whatever the batch
has; only the node table (at most 511 nodes a tree) reaches the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

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

send_by_value(__name__)

SCORE_UNITS = 1_000_000
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def expected_depth(n: float) -> float:
    """Average depth of an unsuccessful search in a binary tree of n leaves."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grower(names: tuple[str, ...], seed: int, most: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        data = pdf.sort_values("draw")[list(names)].to_numpy(dtype=float)
        nodes: list[list] = []
        queue = [(np.arange(len(data)), 0, None, None)]
        while queue:
            rows, depth, parent, side = queue.pop()
            me = len(nodes)
            if parent is not None:
                nodes[parent][side] = me
            spread = [f for f in range(len(names)) if np.ptp(data[rows, f]) > 0] if depth < most and len(rows) > 1 else []
            if not spread:
                nodes.append([tree, me, -1, 0.0, me, me, depth + expected_depth(len(rows))])
                continue
            f = int(rng.choice(spread))
            values = data[rows, f]
            cut = float(rng.uniform(values.min(), values.max()))
            nodes.append([tree, me, f, cut, me, me, 0.0])
            below = values <= cut
            queue.append((rows[below], depth + 1, me, 4))
            queue.append((rows[~below], depth + 1, me, 5))
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    return grow


def sample_trees(df: DataFrame, names: tuple[str, ...], trees: int, rows: int, seed: int, sample: int = 256) -> DataFrame:
    """(tree, draw, features): up to ``sample`` rows for each tree, chosen by hash.

    A row has ceil(1.5 * sample * trees / rows) slots, at most one per tree: one on a large
    batch, where almost every row costs one hash, more on a small one, by the same rule."""
    id_columns = ["transaction_id"] if "transaction_id" in df.columns else list(names)
    base = df.select(*[feature(df, n).alias(n) for n in names], F.xxhash64(F.lit(seed), *id_columns).alias("draw"))
    # a row stands in this many slots, each of which is drawn with the same chance and given a tree
    slots = max(1, math.ceil(1.5 * sample * trees / max(rows, 1)))
    share = min(1.0, 1.5 * sample * trees / max(rows, 1) / slots)
    slot = F.explode(F.sequence(F.lit(0), F.lit(min(slots, trees) - 1)))
    drawn = (
        base.withColumn("slot", slot)
        .withColumn("chance", F.xxhash64("draw", "slot"))
        .where(F.pmod("chance", F.lit(1 << 30)) < share * float(1 << 30))
        .withColumn("tree", F.pmod(F.xxhash64("draw") + F.col("slot"), F.lit(trees)).cast("int"))
        .withColumn("draw", F.col("chance"))
        .drop("slot", "chance")
    )
    # a few thousand rows, but a tree's worth of work each: placed by number, not by size
    drawn = drawn.repartition(min(trees, shuffle_width(df.sparkSession)), "tree")
    first = Window.partitionBy("tree").orderBy("draw", *names)
    return drawn.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample).drop("place")


@dataclass(frozen=True)
class Forest:
    names: tuple[str, ...]
    nodes: pd.DataFrame
    trees: int
    sample: int
    depth: int
    offset: float = -0.5
    lowest: float = -1.0

    def normality(self, df: DataFrame) -> Column:
        """-2^(-depth / expected depth): near -1 is isolated early. Kept to six decimals."""
        table = self.nodes.sort_values(["tree", "node"])
        start = np.searchsorted(table["tree"].to_numpy(), np.arange(self.trees))
        shift = start[table["tree"].to_numpy()]
        split = np.maximum(table["feature"].to_numpy(), 0)
        cut = table["threshold"].to_numpy()
        below = table["left"].to_numpy() + shift
        above = table["right"].to_numpy() + shift
        child = np.column_stack([below, above]).ravel()
        depth = table["depth"].to_numpy()
        norm = max(expected_depth(self.sample), 1.0)
        width, most = len(self.names), self.depth

        @pandas_udf(T.DoubleType())
        def walk(*columns: pd.Series) -> pd.Series:
            data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            out = np.empty(len(data))
            for lo in range(0, len(data), 1024):
                block = data[lo : lo + 1024]
                values, first = block.ravel(), (np.arange(len(block)) * width)[:, None]
                at = np.broadcast_to(start, (len(block), len(start)))
                for _ in range(most):
                    at = child.take(2 * at + (values.take(first + split.take(at)) > cut.take(at)))
                out[lo : lo + 1024] = -np.exp2(-depth.take(at).mean(axis=1) / norm)
            return pd.Series(np.rint(out * SCORE_UNITS) / SCORE_UNITS)

        return walk(*[feature(df, n) for n in self.names])

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ml_anomaly_score: 50 at the contamination cut-off, higher is stranger."""
        raw = (F.lit(0.5) - (self.normality(df) - F.lit(self.offset))) * 100
        return df.withColumn("ml_anomaly_score", round_half_even(clip(raw, 0, 100), 2))

    @property
    def top_score(self) -> float:
        """The batch maximum of ml_anomaly_score, known from fitting."""
        return float(np.clip(100 * (0.5 - (self.lowest - self.offset)), 0, 100))


def percentile_of(scores: DataFrame, name: str, share: float) -> tuple[float, float]:
    """Interpolated percentile and minimum of six-decimal scores in [-1, 0].

    Counts equal scores first: at most a million distinct values are ordered, however many rows."""
    counts = scores.groupBy(F.rint(F.col(name) * SCORE_UNITS).cast("long").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("q").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = counts.select(
        "q", F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("rows"), F.min("q").over(whole).alias("lowest")
    ).withColumn("place", (F.col("rows") - 1) * share)
    found = ordered.agg(
        F.min(F.when(F.col("upto") > F.floor("place"), F.col("q"))).alias("low"),
        F.min(F.when(F.col("upto") > F.ceil("place"), F.col("q"))).alias("high"),
        F.max("place").alias("place"),
        F.max("lowest").alias("lowest"),
    ).first()
    fraction = found.place - np.floor(found.place)
    return (found.low + (found.high - found.low) * fraction) / SCORE_UNITS, found.lowest / SCORE_UNITS


def fit_forest(df: DataFrame, cfg: RiskConfig, names: tuple[str, ...] = ANOMALY_FEATURES) -> Forest:
    """Fit on this batch. Splits do not depend on a feature's unit, so nothing is scaled."""
    rows = df.count()
    if rows == 0:
        raise ValueError("an isolation forest needs at least one row")
    sample = sample_trees(df, names, cfg.forest_trees, rows, cfg.seed, cfg.forest_sample)
    nodes = sample.groupBy("tree").applyInPandas(_grower(names, cfg.seed, cfg.forest_depth), NODE_SCHEMA).toPandas()
    # a tiny batch may leave some trees without rows
    grown = {t: k for k, t in enumerate(sorted(nodes["tree"].unique()))}
    nodes["tree"] = nodes["tree"].map(grown)
    forest = Forest(names, nodes, len(grown), min(cfg.forest_sample, rows), cfg.forest_depth)
    known = df.select(*[feature(df, n).alias(n) for n in names])
    offset, lowest = percentile_of(known.select(forest.normality(known).alias("s")), "s", cfg.contamination)
    return replace(forest, offset=offset, lowest=lowest)


def score_anomalies(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Fit on the batch and score it."""
    return fit_forest(df, cfg).score(df)
