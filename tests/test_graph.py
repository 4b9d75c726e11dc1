import random

import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.operators import graph
from tests.conftest import at, payments

CFG = RiskConfig()
T0 = at("2026-01-01 00:00:00")


def edge_table(spark, pairs):
    return spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, amount double")


def nodes(df):
    return {r.node for r in df.collect()}


def test_pruned_before_summing(spark):
    df = payments(spark, [("a", "b", 9999.99, T0)] * 2 + [("a", "c", 10000.0, T0)] * 2)
    assert [tuple(r) for r in graph.graph_edges(df, CFG).collect()] == [("a", "c", 20000.0)]
    known = df.withColumn("risk_score", F.when(F.col("receiver_id") == "b", 1).otherwise(0))
    assert graph.graph_edges(known, CFG).count() == 2


def test_rank_and_network_score(spark, skew):
    # in-degrees: w 0, x 0, y 1, z 3
    edges = edge_table(spark, [("w", "y"), ("w", "z"), ("x", "z"), ("y", "z")])
    degrees = graph.graph_degrees(edges)
    none = edges.select(F.col("src").alias("node")).limit(0)
    raw = {r.node: r.network_raw for r in graph.network_risk(degrees, none).collect()}
    assert raw == {"w": 26.25, "x": 26.25, "y": 52.5, "z": 70.0}
    ring = edges.select(F.lit("z").alias("node")).distinct()
    assert {r.node: r.network_raw for r in graph.network_risk(degrees, ring).collect()}["z"] == 100.0


def test_cycles(spark):
    pairs = [("A", "A"), ("B", "C"), ("C", "B"), ("D", "E"), ("E", "F"), ("F", "D"), ("G", "H")]
    edges = edge_table(spark, pairs)
    assert nodes(graph.cycle_nodes(edges, graph.graph_degrees(edges))) == set("ABCDEF")


def brute_triangles(pairs):
    links = set(pairs)
    return {n for a, b in links for b2, c in links if b2 == b and (c, a) in links and len({a, b, c}) == 3 for n in (a, b, c)}


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_against_brute_force(spark, skew, seed):
    rnd = random.Random(seed)
    pairs = {(f"n{rnd.randint(0, 40)}", f"n{rnd.randint(0, 40)}") for _ in range(110)}
    pairs |= {("hub", f"n{k}") for k in range(0, 40, 2)} | {(f"n{k}", "hub") for k in range(1, 40, 2)}
    edges = edge_table(spark, sorted(pairs))
    degrees = graph.graph_degrees(edges)
    assert nodes(graph.three_hop_nodes(edges, degrees)) == brute_triangles(pairs)
    top = {r.node for r in graph.top_degree_nodes(degrees, 3).collect()}
    links = set(pairs)
    through_top = {
        n
        for a in top
        for b in {d for s, d in links if s == a}
        for c in {d for s, d in links if s == b}
        if (c, a) in links and len({a, b, c}) == 3
        for n in (a, b, c)
    }
    assert nodes(graph.three_hop_nodes(edges, degrees, 3)) == through_top


def power_iteration(pairs, rounds):
    names = sorted({n for p in pairs for n in p})
    rank = dict.fromkeys(names, 1 / len(names))
    out = {n: [b for a, b in pairs if a == n] for n in names}
    for _ in range(rounds):
        loose = sum(rank[n] for n in names if not out[n])
        new = dict.fromkeys(names, 0.15 / len(names) + 0.85 * loose / len(names))
        for n in names:
            for b in out[n]:
                new[b] += 0.85 * rank[n] / len(out[n])
        rank = new
    return rank


def test_pagerank(spark, skew):
    mutual = graph.pagerank(edge_table(spark, [("a", "b"), ("b", "a")]))
    assert mutual.converged and {r.node: r.score for r in mutual.ranks.collect()} == {"a": 0.5, "b": 0.5}
    pairs = sorted({("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e"), ("e", "e"), ("a", "f")})
    run = graph.pagerank(edge_table(spark, pairs), iterations=4, tolerance=None)
    got = {r.node: r.score for r in run.ranks.collect()}
    assert got == pytest.approx(power_iteration(pairs, 4)) and sum(got.values()) == pytest.approx(1.0)


def test_empty_network(spark):
    features = graph.graph_features(payments(spark, [("a", "b", 1.0, T0)]), CFG)
    assert features.count() == 0
    assert features.columns == ["sender_id", "network_centrality", "network_pagerank", "is_in_cycle", "network_raw"]


def test_degree_may_stand_for_pagerank(spark):
    edges = edge_table(spark, [("a", "c"), ("b", "c"), ("c", "a")])
    small = CFG.with_options({"importance": "degree"})
    scores = graph.node_importance(edges, graph.graph_degrees(edges), small)
    assert {r.node: r.score for r in scores.collect()} == {"a": 0.5, "b": 0.0, "c": 1.0}
