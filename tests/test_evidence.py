import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodesieve.operators import evidence as V

DAY = dt.date(2026, 6, 13)
STEP = "struct<node_key:string,node_type:string,edge_type:string,amount:double,transaction_count:int,semantic_flow:string,first_seen:string,last_seen:string,risk_level:string>"


def hop(flow="outbound_to_anchor", amount=22000.0, n=8, first=200, last=3, risk=None, kind="SENT_TO", node="IBAN"):
    return ("x", node, kind, amount, n, flow, str(DAY - dt.timedelta(first)), str(DAY - dt.timedelta(last)), risk)


START = ("a", "IBAN", None, None, None, None, None, None, None)


def verdict(spark, path, level="NONE", source="SANCTIONED", country="DE"):
    x = spark.createDataFrame([("A", "S", path)], f"node_key string, source_risk_node string, best_path array<{STEP}>")
    n = spark.createDataFrame([("A", "IBAN", level, "DE"), ("S", "IBAN", source, country)], "node_key string, node_type string, risk_level string, country string")
    flags = spark.createDataFrame([], "node_key string, structuring boolean, high_concentration boolean")
    r = V.judge(V.with_context(V.path_facts(x, F.lit(DAY)), n, flags)).first()
    return r.code, round(r.risk, 2), r.verdict


@pytest.mark.parametrize(("path", "kw", "want"), [
    ([START, hop(risk="SANCTIONED")], {}, ("OUTBOUND_1_HOP_TO_SANCTIONED", 0.86, "REVIEW")),
    ([START, hop(), hop(risk="SANCTIONED")], {}, ("OUTBOUND_2_HOP_TO_SANCTIONED", 0.66, "REVIEW")),
    ([START, hop("inbound_from_anchor", risk="SANCTIONED")], {}, ("INBOUND_FROM_SANCTIONED", 0.52, "REVIEW")),
    ([START, hop("", risk="SANCTIONED")], {}, ("SHARED_INTERMEDIARY_WITH_SANCTIONED", 0.20, "NO_MATCH")),
    ([START, hop(risk="SUSPICIOUS")], {"source": "SUSPICIOUS"}, ("PROXY_ACCOUNT_BEHAVIOR", 0.44, "REVIEW")),
    ([START, hop(amount=5.0, last=500, first=520, risk="SANCTIONED")], {}, ("OLD_EXPOSURE_DISCOUNTED", 0.0, "NO_MATCH")),
    ([START], {"level": "SANCTIONED"}, ("DIRECT_SANCTIONS_MATCH", 1.0, "MATCH")),
    ([], {}, (None, 0.0, "NO_MATCH")),
    (None, {}, (None, 0.0, "NO_MATCH")),
    ([START, None, hop(risk="SANCTIONED")], {}, ("OUTBOUND_1_HOP_TO_SANCTIONED", 0.86, "REVIEW")),
    ([START, hop(risk=None)], {"source": "NONE", "country": "IR"}, ("HIGH_RISK_CORRIDOR", 0.34, "REVIEW")),
])
def test_ladder(spark, path, kw, want):
    assert verdict(spark, path, **kw) == want


# ---- from edges to verdict: the worked values of accounts around a sanctioned one

NODES = "node_key string, node_type string, risk_level string, country string"
EDGES = "id string, from_node_key string, to_node_key string, edge_type string, total_amount double, transaction_count int, first_seen date, last_seen date, confidence double"


def edge(i, a, b, amount, n=2, first=100, last=3, conf=0.97, kind="SENT_TO"):
    return (str(i), a, b, kind, amount, n, DAY - dt.timedelta(first), DAY - dt.timedelta(last), conf)


def judged(spark, nodes, edges):
    """{account: (score, depth, code, risk, verdict)} of the primary pass and of the pass over derived anchors."""
    from lodesieve.operators import graph as G

    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    rolled = G.edge_rollup(G.plain_edges(e))
    adj = G.adjacency(G.scored_edges(rolled, F.lit(DAY)))
    degrees = adj.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    labels = G.propagate(n, adj)
    paths = G.label_paths(labels, n)
    derived = G.derived_exposure(G.derived_anchors(labels, n, degrees, F.lit(DAY)), adj, n, degrees, F.lit(DAY), with_steps=True)
    flags = G.pattern_flags(G.behavior_profile(rolled))
    out = []
    for x in (paths, G.stitched_paths(derived, paths, n)):
        v = V.judge(V.with_context(V.path_facts(x, F.lit(DAY)), n, flags)).join(x.select("node_key", "exposure_score", "best_depth"), "node_key")
        out.append({r.node_key: (round(r.exposure_score, 4), r.best_depth, r.code, round(r.risk, 2), r.verdict, r.further) for r in v.collect()})
    return out


def test_sent_to_a_sanctioned_account(spark):
    got = judged(spark, [("CLEAN", "IBAN", "NONE", "DE"), ("BAD", "IBAN", "SANCTIONED", "DE")], [edge(1, "CLEAN", "BAD", 22000.0)])[0]
    assert got["CLEAN"][:5] == (0.3679, 1, "OUTBOUND_1_HOP_TO_SANCTIONED", 0.96, "REVIEW")
    assert got["BAD"][:5] == (1.0, 0, "DIRECT_SANCTIONS_MATCH", 1.0, "MATCH")


def test_received_from_a_sanctioned_account(spark):
    got = judged(spark, [("R", "IBAN", "NONE", "DE"), ("BAD", "IBAN", "SANCTIONED", "DE")], [edge(1, "BAD", "R", 23000.0, conf=0.94)])[0]
    assert got["R"][:5] == (0.2886, 1, "INBOUND_FROM_SANCTIONED", 0.62, "REVIEW")


def test_old_tiny_payment_gives_no_row(spark):
    got = judged(spark, [("C", "IBAN", "NONE", "DE"), ("BAD", "IBAN", "SANCTIONED", "DE")], [edge(1, "C", "BAD", 5.0, first=520, last=500)])[0]
    assert set(got) == {"BAD"}


def chain(amount=18500.0, last=1):
    keys = ["A", "M", "L", "BAD", *[f"F{i}" for i in range(10)]]
    nodes = [(k, "IBAN", "SANCTIONED" if k == "BAD" else "NONE", "DE") for k in keys]
    edges = [edge(1, "A", "M", amount, first=7, last=last, conf=0.96), edge(2, "M", "L", 21000.0, n=1, first=8, last=1), edge(3, "L", "BAD", 26000.0, first=9, last=1, conf=0.98)]
    return nodes, edges + [edge(10 + i, f"F{i}", "M", 1100.0 + 45 * i, n=12 + i, first=18, last=1 + i % 2, conf=0.86) for i in range(10)]


def test_funding_of_a_derived_proxy(spark):
    primary, derived = judged(spark, *chain())
    assert primary["M"][:3] == (0.0781, 2, "OUTBOUND_2_HOP_TO_SANCTIONED") and primary["M"][4] == "REVIEW" and primary["L"][0] == 0.3717
    score, depth, code, risk, verdict, further = derived["A"]
    assert (score, depth, code, risk, verdict) == (0.2002, 3, "UPSTREAM_FUNDING_OF_DERIVED_SANCTIONS_PROXY", 0.68, "REVIEW")
    assert further == "PROXY_CHAIN_FUNDING,DERIVED_RISK_ANCHOR,PROXY_ACCOUNT_BEHAVIOR,ABNORMAL_VALUE_TO_NEW_COUNTERPARTY"
    # the small feeders reach the same anchor, but are suppressed
    assert derived["F3"][2] == "DERIVED_RISK_PROPAGATION_SUPPRESSED" and derived["F3"][0] <= 0.029 and "PROXY_CHAIN" not in derived["F3"][5]


def test_labels_that_never_settle_raise(spark):
    from lodesieve.operators import graph as G

    nodes, edges = chain()
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    adj = G.adjacency(G.scored_edges(G.edge_rollup(G.plain_edges(e)), F.lit(DAY)))
    with pytest.raises(RuntimeError):
        G.propagate(n, adj, max_rounds=1)
