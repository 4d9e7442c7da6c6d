import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodesieve.operators import graph as G

DAY = dt.date(2026, 6, 13)
EDGE = "id string, from_node_key string, to_node_key string, edge_type string, total_amount decimal(18,2), transaction_count int, first_seen date, last_seen date, confidence decimal(8,4)"


def exposure(spark, nodes, edges, **kw):
    from decimal import Decimal

    e = spark.createDataFrame([(str(i), a, b, t, Decimal(str(amt)), n, DAY - dt.timedelta(f), DAY - dt.timedelta(l), Decimal(str(c))) for i, (a, b, t, amt, n, f, l, c) in enumerate(edges)], EDGE)
    nd = spark.createDataFrame(nodes, "node_key string, node_type string, risk_level string, country string")
    day = F.lit(DAY)
    adj = G.adjacency(G.scored_edges(G.edge_rollup(G.plain_edges(e)), day))
    return {r.node_key: r for r in G.propagate(nd, adj, **kw).collect()}


def node(k, risk="NONE"):
    return (k, "IBAN", risk, "DE")


def test_outbound_one_hop(spark):
    got = exposure(spark, [node("C"), node("S", "SANCTIONED")], [("C", "S", "SENT_TO", 22000, 2, 18, 1, 0.97)])
    assert round(got["C"].score, 4) == 0.3679 and got["C"].depth == 1 and got["S"].score == 1.0


def test_inbound_one_hop(spark):
    got = exposure(spark, [node("R"), node("S", "SANCTIONED")], [("S", "R", "SENT_TO", 23000, 8, 35, 3, 0.94)])
    assert round(got["R"].score, 4) == 0.2886


def test_suspicious_relay_wins_over_longer_path(spark):
    got = exposure(spark, [node("S", "SANCTIONED"), node("H", "SUSPICIOUS"), node("R")], [("S", "H", "SENT_TO", 17500, 5, 60, 9, 0.88), ("H", "R", "SENT_TO", 16800, 4, 40, 6, 0.84)])
    assert round(got["R"].score, 4) == 0.1805 and got["R"].source == "H"


def test_old_tiny_edge_is_no_exposure(spark):
    got = exposure(spark, [node("S", "SANCTIONED"), node("R")], [("S", "R", "SENT_TO", 5, 1, 520, 500, 0.42)])
    assert "R" not in got


def test_hubs_receive_but_do_not_expand(spark):
    edges = [("S", "H", "SENT_TO", 42000, 6, 55, 3, 0.93)] + [(f"c{i}", "H", "SENT_TO", 1800, 2, 25, 2, 0.91) for i in range(6)]
    nodes = [node("S", "SANCTIONED"), node("H")] + [node(f"c{i}") for i in range(6)]
    got = exposure(spark, nodes, edges, hub_degree=5)
    assert "H" in got and "C0" not in got
    assert "C0" in exposure(spark, nodes, edges, hub_degree=50, min_score=0.0)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_fall_along_a_path(spark, depth):
    chain = [("N0", "N1"), ("N1", "N2"), ("N2", "N3")]
    got = exposure(spark, [node("N0", "SANCTIONED"), node("N1"), node("N2"), node("N3")], [(a, b, "OWNS", 0, 1, 9, 1, 1.0) for a, b in chain], max_depth=depth, min_score=0.0)
    scores = [got[f"N{i}"].score for i in range(depth + 1)]
    assert scores == sorted(scores, reverse=True) and f"N{depth + 1}" not in got


def test_empty_graph(spark):
    assert exposure(spark, [], []) == {}


def test_a_hub_of_a_tenth_of_all_edges_receives_but_does_not_pass_on(spark):
    """A hub beyond the degree limit gets a label from the anchor beside it; nothing behind it does, however many edges."""
    import datetime as dt

    from pyspark.sql import functions as F

    from lodesieve.operators import graph as G

    day = dt.date(2026, 6, 13)
    edge = lambda i, a, b: (str(i), a, b, "SENT_TO", 20_000.0, 3, day - dt.timedelta(40), day - dt.timedelta(2), 0.95)
    edges = [edge(0, "BAD", "HUB")] + [edge(1 + i, f"N{i}", "HUB") for i in range(300)] + [edge(1000 + i, f"P{i}", f"Q{i}") for i in range(2700)] + [edge(9000, "CLEAN", "BAD")]
    keys = {k for e in edges for k in e[1:3]}
    nodes = spark.createDataFrame([(k, "IBAN", "SANCTIONED" if k == "BAD" else "NONE") for k in keys], "node_key string, node_type string, risk_level string")
    e = spark.createDataFrame(edges, "id string, from_node_key string, to_node_key string, edge_type string, total_amount double, transaction_count int, first_seen date, last_seen date, confidence double")
    labels = G.propagate(nodes, G.adjacency(G.scored_edges(G.edge_rollup(G.plain_edges(e)), F.lit(day))))
    assert {r.node_key: r.depth for r in labels.collect()} == {"BAD": 0, "HUB": 1, "CLEAN": 1}
