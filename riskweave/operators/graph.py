"""Network features on an edge table: degrees, PageRank, short cycles, network risk.

Edges are unique (src, dst) pairs with the summed amount. Hubs are expected: joins on a
node go through ``skew_join``, and triangles are enumerated from their lowest-degree
corner, which keeps a hub from being paired with itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.numeric import clip, round_half_even
from ..schema import entity_column
from ..session import materialize, together
from .skew import heaviest, repeated, salted, skew_join


def material_rows(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Rows large enough for the network, or already carrying risk where that is known."""
    large = F.col("amount") >= cfg.min_edge_amount
    return df.where(large | (F.col("risk_score") > 0)) if "risk_score" in df.columns else df.where(large)


def graph_edges(df: DataFrame, cfg: RiskConfig, source: str | None = None, target: str = "receiver_id") -> DataFrame:
    source = source or entity_column(df)
    return (
        material_rows(df, cfg)
        .where(F.col(source).isNotNull() & F.col(target).isNotNull())
        .groupBy(F.col(source).alias("src"), F.col(target).alias("dst"))
        .agg(F.sum("amount").alias("amount"))
    )


def graph_degrees(edges: DataFrame) -> DataFrame:
    """Per node: in-degree, out-degree and their sum (a self-loop counts once in each)."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        )
    )
    return ends.groupBy("node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree")
    )


def top_degree_nodes(degrees: DataFrame, n: int) -> DataFrame:
    """The n busiest nodes; ties go by node id."""
    return degrees.select("node", "degree").orderBy(F.desc("degree"), "node").limit(n)


def degree_rank(degrees: DataFrame) -> DataFrame:
    """Average-rank percentile of the in-degree.

    Ranks the distinct degrees, not the nodes: D distinct in-degrees need D * D / 2 edges,
    so even 10 billion edges give fewer than 150,000 rows to order."""
    counts = degrees.groupBy("in_degree").agg(F.count(F.lit(1)).alias("n"))
    below = Window.orderBy("in_degree").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy("in_degree").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranks = counts.select(
        "in_degree",
        (
            (F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / F.lit(2.0)) / F.sum("n").over(everyone)
        ).alias("pct_rank"),
    )
    hot = heaviest(counts, "in_degree", "n")
    return skew_join(degrees, ranks, "in_degree", "node", "left", hot)


def degree_centrality(degrees: DataFrame) -> DataFrame:
    top = degrees.agg(F.max("in_degree").alias("top")).scalar()
    return degrees.select("node", (F.col("in_degree") / top).alias("score"))


@dataclass
class PageRankRun:
    ranks: DataFrame
    iterations: int
    converged: bool


def pagerank(
    edges: DataFrame, alpha: float = 0.85, iterations: int = 50, tolerance: float | None = 1e-6
) -> PageRankRun:
    """Amount-weighted PageRank by power iteration from the uniform vector.

    Stops once the summed change is below nodes * tolerance; tolerance None runs all
    iterations. Nodes without outgoing money spread their rank evenly. Each round is one
    join and one map-side-combined sum, written to the checkpoint folder."""
    strength = edges.groupBy("src").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("fan"))
    hot = materialize(heaviest(strength, "src", "fan"))
    # the links are shuffled once; every round moves node-sized tables only
    links = materialize(
        salted(edges, "src", "dst", hot)
        .join(repeated(strength.select("src", "total"), "src", hot), ["src", "_salt"])
        .select("src", "_salt", "dst", (F.col("amount") / F.col("total")).alias("share")),
        ["src", "_salt"],
    )
    nodes = materialize(
        graph_degrees(edges).select("node", (F.col("out_degree") == 0).alias("dangling")), ["node"]
    )
    n = nodes.count()
    if n == 0:
        return PageRankRun(nodes.select("node", F.lit(0.0).alias("score")), 0, True)
    ranks = nodes.withColumns({"score": F.lit(1.0 / n), "step": F.lit(0.0)})
    loose = nodes.where("dangling").count() / n
    done = False
    rounds = 0
    while rounds < iterations and not done:
        offered = repeated(ranks.select(F.col("node").alias("src"), "score"), "src", hot)
        received = (
            links.join(offered, ["src", "_salt"])
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("score") * F.col("share")).alias("received"))
        )
        base = F.lit((1.0 - alpha) / n + alpha * loose / n)
        ranks = materialize(
            ranks.join(received, "node", "left")
            .withColumn("new", base + alpha * F.coalesce("received", F.lit(0.0)))
            .select("node", "dangling", F.col("new").alias("score"), F.abs(F.col("new") - F.col("score")).alias("step")),
            ["node"],
        )
        totals = ranks.agg(
            F.sum("step").alias("change"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("score"))), F.lit(0.0)).alias("loose")
        ).first()
        loose = totals.loose
        rounds += 1
        done = tolerance is not None and totals.change < n * tolerance
    return PageRankRun(ranks.select("node", "score"), rounds, done or tolerance is None)


def node_importance(edges: DataFrame, degrees: DataFrame, cfg: RiskConfig) -> DataFrame:
    """PageRank or the in-degree share, as the settings say."""
    if cfg.importance == "degree":
        return degree_centrality(degrees)
    if cfg.importance != "pagerank":
        raise ValueError(f"unknown importance: {cfg.importance}")
    run = pagerank(edges, iterations=cfg.pagerank_iterations)
    if not run.converged:
        raise RuntimeError(f"PageRank did not converge in {run.iterations} iterations")
    return run.ranks


def two_hop_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a -> b -> a, self-loops included."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    mutual = edges.select("src", "dst").join(back, ["src", "dst"], "left_semi")
    return mutual.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def triangles(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """Every a -> b -> c -> a over three distinct nodes, once, as (low, out, back):
    low -> out -> back -> low where ``low`` is the corner of lowest degree.

    From a node only edges to nodes of higher degree are followed. There are at most
    sqrt(2 * edges) of those whatever the node, so a hub opens no pairs of its neighbours."""
    sizes = degrees.select("node", "degree")
    hot = heaviest(degrees, "node", "degree")
    pairs = edges.where(F.col("src") != F.col("dst")).select("src", "dst")
    for end in ("src", "dst"):
        other = "dst" if end == "src" else "src"
        named = sizes.select(F.col("node").alias(end), F.col("degree").alias(f"{end}_degree"))
        pairs = skew_join(pairs, named, end, other, "inner", hot.select(F.col("node").alias(end)))
    up = F.struct("src_degree", "src") < F.struct("dst_degree", "dst")
    outgoing = pairs.where(up).select(F.col("src").alias("low"), F.col("dst").alias("out"))
    incoming = pairs.where(~up).select(F.col("dst").alias("low"), F.col("src").alias("back"))
    wedges = outgoing.join(incoming, "low").where(F.col("out") != F.col("back")).select("low", "out", "back")
    closing = edges.select(F.col("src").alias("out"), F.col("dst").alias("back"))
    return wedges.join(closing, ["out", "back"], "left_semi").select("low", "out", "back")


def three_hop_nodes(edges: DataFrame, degrees: DataFrame, node_limit: int | None = None) -> DataFrame:
    """Nodes on a three-step cycle. A node limit keeps the cycles through the busiest nodes."""
    found = triangles(edges, degrees)
    if node_limit is not None:
        top = F.broadcast(top_degree_nodes(degrees, node_limit).select("node", F.lit(True).alias("top")))
        for corner in ("low", "out", "back"):
            mark = top.select(F.col("node").alias(corner), F.col("top").alias(f"{corner}_top"))
            found = found.join(mark, corner, "left")
        found = found.where(F.coalesce("low_top", "out_top", "back_top"))
    return found.select(F.explode(F.array("low", "out", "back")).alias("node")).distinct()


def cycle_nodes(edges: DataFrame, degrees: DataFrame) -> DataFrame:
    return two_hop_nodes(edges).unionByName(three_hop_nodes(edges, degrees)).distinct()


def network_risk(degrees: DataFrame, cycles: DataFrame) -> DataFrame:
    """Percentile of the in-degree worth 70 points, a short cycle worth 30."""
    ranked = degree_rank(degrees).join(cycles.withColumn("_cycle", F.lit(1)), "node", "left")
    in_cycle = F.coalesce("_cycle", F.lit(0))
    raw = F.col("pct_rank") * 70 + F.when(in_cycle == 1, 30.0).otherwise(0.0)
    return ranked.select(
        "node",
        F.col("in_degree").alias("network_centrality"),
        in_cycle.alias("is_in_cycle"),
        round_half_even(clip(raw, 0, 100), 2).alias("network_raw"),
    )


def features_of(edges: DataFrame, cfg: RiskConfig, key: str = "global_entity_id") -> DataFrame:
    """One row per node with all network features."""
    edges = materialize(edges)
    degrees = materialize(graph_degrees(edges))
    cycles, importance = together(
        edges.sparkSession,
        lambda: materialize(cycle_nodes(edges, degrees)),
        lambda: node_importance(edges, degrees, cfg).withColumnRenamed("score", "network_pagerank"),
    )
    risk = network_risk(degrees, cycles)
    return risk.join(importance, "node", "left").select(
        F.col("node").alias(key), "network_centrality", "network_pagerank", "is_in_cycle", "network_raw"
    )


def graph_features(df: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Network features of a batch: edges run from the entity to the receiving account."""
    key = entity_column(df)
    return features_of(graph_edges(df, cfg, key), cfg, key)
