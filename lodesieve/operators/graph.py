"""Counterparty graph: roll-up, concentration, scored adjacency, best-path exposure by fix-point iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..session import cut, discard
from .orphan_refs import plain_key


def plain_edges(edges: DataFrame) -> DataFrame:
    """Edges with comparable keys, each id once, references that name nothing left out."""
    cols = [F.upper("edge_type").alias("edge_type"), F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0)).alias("amount"), F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"), "first_seen", "last_seen", F.col("confidence").cast("double").alias("confidence")]
    once = edges.dropDuplicates(["id"])
    return once.select("id", plain_key(F.col("from_node_key")).alias("src"), plain_key(F.col("to_node_key")).alias("dst"), *cols).where("src is not null and dst is not null")


def edge_rollup(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, edge_type): summed amount and count, first and last date, highest confidence."""
    return edges.groupBy("src", "dst", "edge_type").agg(
        F.sum("amount").alias("amount"), F.sum("transaction_count").alias("transaction_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("confidence").alias("confidence")
    )


def flow_totals(rolled: DataFrame) -> DataFrame:
    """(node_key, total_out, total_in) over SENT_TO. The long form is summed on the map side, so hubs don't skew."""
    sent = rolled.where("edge_type = 'SENT_TO'")
    long = sent.select(F.explode(F.array(F.struct(F.col("src").alias("node_key"), F.col("amount").alias("out"), F.lit(0.0).alias("inn")), F.struct(F.col("dst").alias("node_key"), F.lit(0.0).alias("out"), F.col("amount").alias("inn")))).alias("x")).select("x.*")
    return long.groupBy("node_key").agg(F.sum("out").alias("total_out"), F.sum("inn").alias("total_in"))


def with_concentration(rolled: DataFrame) -> DataFrame:
    """Adds outgoing, incoming and flow concentration (0 but for SENT_TO). Totals are aggregated and joined back: a window
    by sender would put a hub's edges into one task."""
    t = flow_totals(rolled)
    is_sent = F.col("edge_type") == "SENT_TO"
    out = rolled.join(t.select(F.col("node_key").alias("src"), "total_out"), "src", "left").join(t.select(F.col("node_key").alias("dst"), "total_in"), "dst", "left")
    share = lambda total: F.when(is_sent & (F.col(total) > 0), F.col("amount") / F.col(total)).otherwise(0.0)
    out = out.withColumn("outgoing_concentration", share("total_out")).withColumn("incoming_concentration", share("total_in"))
    return out.withColumn("flow_concentration", F.greatest("outgoing_concentration", "incoming_concentration")).drop("total_out", "total_in")


def scored_edges(rolled: DataFrame, as_of: Column) -> DataFrame:
    e = with_concentration(rolled)
    args = F.col("edge_type"), F.col("amount"), F.col("flow_concentration")
    return (
        e.withColumn("flow_materiality", S.flow_materiality(*args))
        .withColumn("edge_score", S.edge_score(*args, F.col("last_seen"), F.col("confidence"), as_of))
        .withColumn("weak", S.weak_edge(*args, F.col("last_seen"), as_of))
    )


def adjacency(scored: DataFrame, directions=S.DIRECTIONS, other=S.OTHER_DIRECTION) -> DataFrame:
    """Forward and reverse entries (node, neighbor, direction, flow, multiplier, override) of each edge, by a rule table."""

    def entry(src: str, dst: str, k: int, name: str) -> Column:
        """k: index of the direction's columns in a rule without its type."""
        pick = lambda i: _by_type({r[0]: r[1:][i] for r in directions}, other[i])
        return F.struct(pick(k).cast("boolean").alias("allowed"), F.col(src).alias("node"), F.col(dst).alias("neighbor"), F.lit(name).alias("direction"), pick(2 + k).cast("boolean").alias("override_allowed"), pick(4 + k).alias("flow"), pick(6 + k).alias("multiplier"))

    rest = [c for c in scored.columns if c not in ("src", "dst")]
    x = scored.select(F.explode(F.array(entry("src", "dst", 0, "forward"), entry("dst", "src", 1, "reverse"))).alias("e"), *rest).where("e.allowed")
    # a multiplier of 0 counts as 1, as a missing one does
    return x.select("e.node", "e.neighbor", "e.direction", "e.override_allowed", "e.flow", F.coalesce(F.nullif("e.multiplier", F.lit(0.0)), F.lit(1.0)).alias("multiplier"), *rest)


def _by_type(table: dict, otherwise: object) -> Column:
    out = F.lit(otherwise)
    for k, v in table.items():
        out = F.when(F.col("edge_type") == k, F.lit(v)).otherwise(out)
    return out


def top_edges(adj: DataFrame, k: int) -> DataFrame:
    """The k best entries of every node with its degree; ties by neighbor, type, direction. Ranks come from a window that
    Spark cuts to k rows per task before the shuffle."""
    w = W.partitionBy("node").orderBy(F.col("edge_score").desc(), "neighbor", "edge_type", "direction")
    best = adj.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    degree = adj.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return best.join(degree, "node")


def propagate(nodes: DataFrame, adj: DataFrame, max_depth: int = 2, top_k: int = 20, min_score: float = 0.03, hub_degree: int = 200, max_rounds: int = 50) -> DataFrame:
    """(node_key, score, depth, source, path, edges): the best label of every node that risk reaches.

    Every round recomputes all labels from the anchors and the labels of the round before (a label that a better one
    replaced takes what it had produced back with it), until a fingerprint of the labels stays the same. Truncation to
    the top k comes before weak edges are dropped; hubs receive but don't expand; labels below ``min_score`` stay but
    don't expand. A round is one join and one aggregation that keeps a row per node on the map side; its table cuts the
    lineage, and the table of the round before is deleted. Labels that aren't stable after ``max_rounds`` raise an error.
    """
    risk = S.source_risk(F.col("risk_level"))
    start = nodes.select(plain_key(F.col("node_key")).alias("node_key"), risk.alias("score")).where("node_key is not null and score > 0").groupBy("node_key").agg(F.max("score").alias("score"))
    useful = cut(top_edges(adj, top_k).where((F.col("degree") <= hub_degree) & ~F.col("weak")).select("node", "neighbor", "edge_score", "multiplier", _step().alias("step")))
    no_steps = F.array().cast(f"array<{useful.schema['step'].dataType.simpleString()}>")
    anchors = cut(start.select("node_key", "score", F.lit(0).alias("depth"), F.col("node_key").alias("source"), F.array("node_key").alias("path"), no_steps.alias("edges")))
    labels, seen = anchors, None
    for _ in range(max_rounds):
        ready = labels.where((F.col("depth") < max_depth) & ((F.col("score") >= min_score) | (F.col("depth") == 0)))
        nxt = ready.join(useful, ready["node_key"] == useful["node"]).where(~F.array_contains("path", F.col("neighbor")))
        reached = nxt.select(
            F.col("neighbor").alias("node_key"), (F.col("score") * F.col("edge_score") * F.col("multiplier") * S.hop_decay(F.col("depth") + 1)).alias("score"), (F.col("depth") + 1).alias("depth"), "source",
            F.concat("path", F.array("neighbor")).alias("path"), F.concat("edges", F.array("step")).alias("edges"),
        )
        # the greatest score, then the least depth; ties: the smaller source and path win
        order = F.struct((-F.round("score", 12)).alias("s"), "depth", F.concat_ws(">", "source", F.array_join("path", ">")).alias("tie"))
        before = labels
        labels = cut(anchors.unionByName(reached).groupBy("node_key").agg(F.min_by(F.struct("score", "depth", "source", "path", "edges"), order).alias("x")).select("node_key", "x.*"))
        if before is not anchors:
            discard(before)
        mark = labels.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(node_key, round(score, 12), source, path))")).first()
        if mark == seen:
            return labels
        seen = mark
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def _step() -> Column:
    """An edge as a step of a path."""
    return F.struct("edge_type", "amount", "transaction_count", "confidence", "direction", "override_allowed", "flow", "multiplier", "first_seen", "last_seen", "outgoing_concentration", "incoming_concentration", "flow_concentration", "flow_materiality")


def _element(key: Column, before: Column, step: Column) -> list[Column]:
    """A node of a path with the edge that leads to it from the node before, seen from the account."""
    back = step["direction"] == "reverse"
    text_of = lambda c: step[c].cast("string").alias(c)
    same = [step[c].alias(c) for c in ("edge_type", "amount", "transaction_count", "confidence", "override_allowed", "outgoing_concentration", "incoming_concentration", "flow_concentration")]
    return [
        key.alias("node_key"), *same, F.when(back, before).otherwise(key).alias("edge_from"), F.when(back, key).otherwise(before).alias("edge_to"), step["direction"].alias("edge_direction"), step["flow"].alias("semantic_flow"),
        step["multiplier"].alias("directional_multiplier"), step["flow_materiality"].alias("flow_materiality_weight"), text_of("first_seen"), text_of("last_seen"),
    ]


def label_paths(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_key, source_risk_node, exposure_score, best_depth, best_path): labels as exposure rows, the path from the account
    to the source with the edge, kind and risk of every element. Paths have few elements; they are exploded to look up kinds."""
    x = labels.select("node_key", "source", "score", "depth", F.reverse("path").alias("p"), F.reverse("edges").alias("e"))
    x = x.select("node_key", "source", "score", "depth", "e", "p", F.posexplode("p").alias("i", "key"))
    step = F.get("e", F.col("i") - 1)
    x = x.select(F.col("node_key").alias("account"), "source", "score", "depth", "i", *_element(F.col("key"), F.get("p", F.col("i") - 1), step))
    meta = nodes.select(plain_key(F.col("node_key")).alias("node_key"), F.upper("node_type").alias("node_type"), F.upper("risk_level").alias("risk_level")).dropDuplicates(["node_key"])
    x = x.join(meta, "node_key", "left")
    fields = ["node_key", "node_type", *[c for c in x.columns if c not in ("account", "source", "score", "depth", "i", "node_key", "node_type")]]
    # as many elements as a path has: depth + 1
    g = x.groupBy(F.col("account").alias("node_key"), F.col("source").alias("source_risk_node"), F.col("score").alias("exposure_score"), F.col("depth").alias("best_depth")).agg(F.array_sort(F.collect_list(F.struct("i", F.struct(*fields).alias("s")))).alias("s"))
    return g.select("node_key", "source_risk_node", "exposure_score", "best_depth", F.col("s.s").alias("best_path"))


def stitched_paths(derived: DataFrame, paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Exposure rows of derived exposure: the funder, the derived anchor with the funding edge and what makes it an anchor,
    then the anchor's own path to the source. ``derived`` with its steps; ``paths``: ``label_paths`` of the anchors."""
    meta = nodes.select(plain_key(F.col("node_key")).alias("node_key"), F.upper("node_type").alias("funder_type")).dropDuplicates(["node_key"])
    own = paths.select(F.col("node_key").alias("anchor"), "source_risk_node", "best_path", F.col("exposure_score").alias("original"))
    x = derived.join(own, "anchor").join(meta, "node_key", "left")
    first = F.get("best_path", F.lit(0))
    mark = [F.lit(True).alias("derived_anchor"), F.round("weight", 4).alias("derived_anchor_score"), F.col("code").alias("derived_anchor_reason_code"), F.round("original", 4).alias("derived_anchor_original_score"), F.col("anchor").alias("derived_anchor_node"), F.col("suppressed").alias("derived_suppression_reason")]
    no_mark = [F.lit(None).cast(t).alias(n) for n, t in (("derived_anchor", "boolean"), ("derived_anchor_score", "double"), ("derived_anchor_reason_code", "string"), ("derived_anchor_original_score", "double"), ("derived_anchor_node", "string"), ("derived_suppression_reason", "string"))]
    fields = [f.name for f in paths.schema["best_path"].dataType.elementType.fields]
    blank = {f.name: F.lit(None).cast(f.dataType) for f in paths.schema["best_path"].dataType.elementType.fields}

    def row(**known: Column) -> list[Column]:
        return [known.get(n, blank[n]).cast(blank_type).alias(n) for n, blank_type in ((f.name, f.dataType) for f in paths.schema["best_path"].dataType.elementType.fields)]

    start = F.struct(*row(node_key=F.col("node_key"), node_type=F.col("funder_type")), *no_mark)
    step = F.struct(*_element(F.col("anchor"), F.col("node_key"), F.col("step")))
    edge = {n: step[n] for n in fields if n not in ("node_type", "risk_level")}
    second = F.struct(*row(**edge, node_type=first["node_type"], risk_level=first["risk_level"]), *mark)
    rest = F.transform(F.slice("best_path", 2, F.greatest(F.size("best_path") - 1, F.lit(0))), lambda s: F.struct(*[s[n].alias(n) for n in fields], *no_mark))
    return x.select("node_key", "source_risk_node", F.col("score").alias("exposure_score"), F.col("depth").alias("best_depth"), F.concat(F.array(start, second), rest).alias("best_path"))


def derived_anchors(labels: DataFrame, nodes: DataFrame, degrees: DataFrame, as_of: Column, hub_degree: int = 200) -> DataFrame:
    """(node_key, code, weight) of labels strong enough to seed a second pass, with what the pass needs of them."""
    meta = nodes.select(plain_key(F.col("node_key")).alias("node_key"), F.upper("node_type").alias("node_type"), F.upper("risk_level").alias("risk_level")).dropDuplicates(["node_key"])
    x = labels.where("depth > 0").join(meta.select("node_key", "node_type"), "node_key").join(meta.select(F.col("node_key").alias("source"), F.col("risk_level").alias("source_level")), "source").join(degrees, labels["node_key"] == degrees["node"], "left")
    flows = lambda f: F.forall("edges", lambda e: e["flow"] == f)
    recent = F.exists("edges", lambda e: (e["amount"] >= 1000) & (S.time_decay(e["last_seen"], as_of) >= 0.8))
    dense = F.exists("edges", lambda e: e["flow_concentration"] >= 0.7)
    proxy = (F.size("edges") >= 2) | F.exists("edges", lambda e: e["edge_type"].isin("USES_ACCOUNT", "OWNS"))
    fits = (F.col("node_type") != "BANK") & (F.coalesce("degree", F.lit(0)) <= hub_degree) & (F.col("source_level") == "SANCTIONED") & ~F.exists("edges", lambda e: e["edge_type"] == "SHARED_IDENTIFIER")
    kind = (
        F.when(flows("outbound_to_anchor") & (F.col("depth") == 1), F.struct(F.lit("OUTBOUND_1_HOP_TO_SANCTIONED").alias("code"), F.lit(0.70).alias("weight")))
        .when(flows("outbound_to_anchor") & (F.col("depth") == 2), F.struct(F.lit("OUTBOUND_2_HOP_TO_SANCTIONED").alias("code"), F.lit(0.55).alias("weight")))
        .when(flows("inbound_from_anchor") & recent, F.struct(F.lit("INBOUND_FROM_SANCTIONED").alias("code"), F.lit(0.55).alias("weight")))
        .when(recent & proxy & dense, F.struct(F.lit("PROXY_ACCOUNT_BEHAVIOR").alias("code"), F.lit(0.35).alias("weight")))
    )
    return x.where(fits).withColumn("k", kind).where("k is not null").select("node_key", "k.code", "k.weight", "source", "path", "depth")


def derived_exposure(anchors: DataFrame, adj: DataFrame, nodes: DataFrame, degrees: DataFrame, as_of: Column, hub_degree: int = 200, with_steps: bool = False) -> DataFrame:
    """(node_key, score, depth, source, anchor, code, suppressed[, weight, step]): direct funders of derived anchors. The first reason
    that applies suppresses a row, whose score is then at most .029."""
    back = adj.where("edge_type = 'SENT_TO' and direction = 'reverse'").select(F.col("node").alias("anchor"), F.col("neighbor").alias("funder"), "amount", "transaction_count", "last_seen", "incoming_concentration", "edge_score", "multiplier", _step().alias("step"))
    meta = nodes.select(plain_key(F.col("node_key")).alias("funder"), F.upper("node_type").alias("funder_type")).dropDuplicates(["funder"])
    x = anchors.withColumnRenamed("node_key", "anchor").join(back, "anchor").where(~F.array_contains("path", F.col("funder"))).join(meta, "funder").join(degrees.withColumnRenamed("node", "funder"), "funder", "left")
    why = (
        F.when(F.col("funder_type") == "BANK", "BANK_HUB_BOUNDARY")
        .when(F.coalesce("degree", F.lit(0)) > hub_degree, "HUB_DEGREE_SUPPRESSION")
        .when((F.col("amount") < 1000) | (S.time_decay(F.col("last_seen"), as_of) < 0.8), "LOW_MATERIALITY_OR_STALE")
        .when((F.col("incoming_concentration") < 0.5) & (F.col("transaction_count") < 100), "LOW_CONCENTRATION")
        .when(F.col("weight") < 0.55, "WEAK_DERIVED_ANCHOR")
    )
    raw = F.col("weight") * F.col("edge_score") * F.col("multiplier") * 0.7
    x = x.withColumn("suppressed", why).withColumn("score", F.when(why.isNull(), raw).otherwise(F.least(raw, F.lit(0.029))))
    more = ("weight", "step") if with_steps else ()
    best = F.min_by(F.struct("score", (F.size("path")).alias("depth"), "source", "anchor", "code", "suppressed", *more), F.struct(-F.round("score", 12), "anchor")).alias("b")
    return x.groupBy(F.col("funder").alias("node_key")).agg(best).select("node_key", "b.*")


def merge_exposure(labels: DataFrame, derived: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_key, score, depth, source, origin): a primary row of depth 2 or less from a sanctioned source stays, else
    the larger score wins."""
    level = nodes.select(plain_key(F.col("node_key")).alias("source"), F.upper("risk_level").alias("level")).dropDuplicates(["source"])
    p = labels.select("node_key", "score", "depth", "source").join(level, "source", "left")
    d = derived.select("node_key", F.col("score").alias("d_score"), F.col("depth").alias("d_depth"), F.col("source").alias("d_source"))
    j = p.join(d, "node_key", "full")
    keep = F.col("score").isNotNull() & (F.col("d_score").isNull() | ((F.col("depth") <= 2) & (F.coalesce("level", F.lit("")) == "SANCTIONED")) | (F.col("score") >= F.col("d_score")))
    pick = lambda a, b: F.when(keep, F.col(a)).otherwise(F.col(b))
    return j.select("node_key", pick("score", "d_score").alias("score"), pick("depth", "d_depth").alias("depth"), pick("source", "d_source").alias("source"), F.when(keep, "primary").otherwise("derived").alias("origin"))


def incident(edges: DataFrame) -> DataFrame:
    """Edges seen from either end (node, other, is_from): a union of two projections, so that a lookup by node is one
    equi-join."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    x = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("is_from")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("is_from")))).alias("x")
    return edges.select(x, *rest).select("x.*", *rest)


def behavior_profile(rolled: DataFrame) -> DataFrame:
    """Per node: flows both ways, counterparties, largest edges, concentrations, small inbound flows, control edges."""
    e = incident(with_concentration(rolled))
    sent, out = F.col("edge_type") == "SENT_TO", F.col("is_from")
    per = F.when(F.col("transaction_count") > 0, F.col("amount") / F.col("transaction_count")).otherwise(F.col("amount"))
    small = sent & ~out & (per <= 150) & (F.col("amount") <= 2000)
    control = ~out & F.col("edge_type").isin("USES_ACCOUNT", "OWNS")
    total = lambda c, v="amount": F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    p = e.groupBy(F.col("node").alias("node_key")).agg(
        total(sent & out).alias("total_outgoing"), total(sent & ~out).alias("total_incoming"), total(sent & out, "transaction_count").alias("outgoing_tx"), total(sent & ~out, "transaction_count").alias("incoming_tx"),
        F.count_distinct(F.when(sent & out, F.col("other"))).alias("outgoing_counterparties"), F.count_distinct(F.when(sent & ~out, F.col("other"))).alias("incoming_counterparties"),
        F.coalesce(F.max(F.when(sent & out, F.col("amount"))), F.lit(0.0)).alias("largest_outgoing"), F.coalesce(F.max(F.when(sent & ~out, F.col("amount"))), F.lit(0.0)).alias("largest_incoming"),
        F.coalesce(F.max(F.when(sent & out, F.col("outgoing_concentration"))), F.lit(0.0)).alias("max_outgoing_concentration"), F.coalesce(F.max(F.when(sent & ~out, F.col("incoming_concentration"))), F.lit(0.0)).alias("max_incoming_concentration"),
        F.count_distinct(F.when(small, F.col("other"))).alias("small_inbound_counterparties"), total(small).alias("small_inbound_amount"), total(small, "transaction_count").alias("small_inbound_tx"),
        F.datediff(F.max(F.when(small, F.col("last_seen"))), F.min(F.when(small, F.col("first_seen")))).alias("small_inbound_days"), F.count(F.when(control, 1)).alias("control_count"), F.min(F.when(control, F.col("first_seen"))).alias("owned_since"),
    )
    return p.withColumn("pass_through_ratio", F.when(F.col("total_incoming") > 0, F.col("total_outgoing") / F.col("total_incoming")).otherwise(0.0))


def pattern_flags(profile: DataFrame) -> DataFrame:
    structuring = (F.col("small_inbound_counterparties") >= 8) & (F.col("small_inbound_amount") >= 10_000) & (F.col("small_inbound_tx") >= 100) & (F.col("largest_outgoing") >= 10_000) & (F.col("pass_through_ratio") >= 0.7)
    dense = (F.col("max_outgoing_concentration") >= 0.7) & (F.col("largest_outgoing") >= 10_000) | (F.col("max_incoming_concentration") >= 0.7) & (F.col("largest_incoming") >= 10_000)
    return profile.select("node_key", structuring.alias("structuring"), dense.alias("high_concentration"), "pass_through_ratio")


def top_counterparties(rolled: DataFrame, k: int = 8) -> DataFrame:
    """(node_key, way, rank, other, amount): the largest counterparties of every node, each way."""
    e = incident(rolled.where("edge_type = 'SENT_TO'"))
    w = W.partitionBy("node", "is_from").orderBy(F.col("amount").desc(), "other")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("node").alias("node_key"), F.when(F.col("is_from"), "sent").otherwise("received").alias("way"), "rank", "other", "amount")


def path_steps(exposure: DataFrame) -> DataFrame:
    """(node_key, step, step_key, step_type, role, edge_type, amount): the stored paths as rows, with the role of a step."""
    x = exposure.select("node_key", F.size("best_path").alias("n"), F.posexplode("best_path").alias("step", "s"))
    role = F.when(F.col("step") == 0, "account").when(F.col("step") == F.col("n") - 1, "source").otherwise("hop")
    return x.select("node_key", "step", F.col("s.node_key").alias("step_key"), F.col("s.node_type").alias("step_type"), role.alias("role"), F.col("s.edge_type").alias("edge_type"), F.col("s.amount").cast("double").alias("amount"))


def related_edges(rolled: DataFrame, targets: DataFrame, k: int = 12) -> DataFrame:
    """(target, rank, src, dst, edge_type, amount): the k largest edges within two hops of each target (column ``target``).

    Two rounds of the same equi-join by node; an edge is counted once per target."""
    e = incident(rolled.select("src", "dst", "edge_type", "amount").withColumns({"a": F.col("src"), "b": F.col("dst")}))
    near = targets.join(e.select(F.col("node").alias("target"), "other"), "target").select("target", F.explode(F.array("target", "other")).alias("node")).distinct()
    near = near.unionByName(targets.select("target", F.col("target").alias("node"))).distinct()
    found = near.join(e.select("node", "a", "b", "edge_type", "amount"), "node").select("target", "a", "b", "edge_type", "amount").distinct()
    w = W.partitionBy("target").orderBy(F.col("amount").desc(), "edge_type", "a", "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("target", "rank", F.col("a").alias("src"), F.col("b").alias("dst"), "edge_type", "amount")


def edge_math(exposure: DataFrame, as_of: Column) -> DataFrame:
    """(node_key, step, edge_type, flow, amount, materiality, concentration, time_decay, multiplier) of every edge of a stored path."""
    x = exposure.select("node_key", F.posexplode("best_path").alias("step", "s")).where("step > 0 and s is not null")
    # rounded as decimals, so that a half is a half
    four = lambda c: F.round(F.coalesce(c.cast("decimal(20,8)"), F.lit(0)), 4).cast("double")
    seen = F.col("s.last_seen").cast("string").try_cast("date")
    multiplier = F.coalesce(F.nullif(F.col("s.directional_multiplier").cast("double"), F.lit(0.0)), F.lit(1.0))
    return x.select(
        "node_key", "step", F.col("s.edge_type").alias("edge_type"), F.col("s.semantic_flow").alias("flow"), four(F.col("s.amount")).alias("amount"), four(F.col("s.flow_materiality_weight")).alias("materiality"),
        four(F.col("s.flow_concentration")).alias("concentration"), F.round(S.time_decay(seen, as_of), 4).alias("time_decay"), four(multiplier).alias("multiplier"),
    )


def reason_of(exposure: DataFrame, nodes: DataFrame, review: float = 0.30) -> DataFrame:
    """(node_key, reason): why an account is exposed, in words, from its score, source and path."""
    level = nodes.select(plain_key(F.col("node_key")).alias("k"), F.lower("risk_level").alias("level")).dropDuplicates(["k"])
    x = exposure.withColumn("k", plain_key(F.col("source_risk_node"))).join(level, "k", "left")
    score = F.col("exposure_score").cast("double")
    kind = F.coalesce("level", F.lit("unknown"))
    hops = F.coalesce(F.array_join(F.transform(F.filter(F.slice("best_path", 2, F.greatest(F.size("best_path") - 1, F.lit(0))), lambda s: s.isNotNull()), lambda s: s["edge_type"]), " -> "), F.lit(""))
    far = F.concat(F.when(score >= review, "REVIEW").otherwise("NO_MATCH"), F.lit(" exposure from "), kind, F.lit(" anchor "), F.coalesce("k", F.lit("")), F.lit(" at depth "), F.col("best_depth").cast("string"), F.lit(" via "), F.when(hops == "", "anchor").otherwise(hops), F.lit(" (score "), F.format_number(F.round(score, 3), 3), F.lit(")"))
    return x.where("exposure_score is not null and best_depth is not null").select("node_key", F.when((F.col("best_depth") == 0) & (kind == "sanctioned"), F.lit("direct sanctioned account anchor")).when(F.col("best_depth") == 0, F.concat(kind, F.lit(" anchor node"))).otherwise(far).alias("reason"))


def account_pool(exposure: DataFrame, nodes: DataFrame, per_depth: int = 4000) -> DataFrame:
    """(node_key, depth, rank): the accounts most exposed to a sanctioned source, up to ``per_depth`` of each depth: the pool
    that payments are drawn from. Ranks come from a window that Spark cuts to the limit before the shuffle."""
    level = nodes.select(plain_key(F.col("node_key")).alias("k"), F.upper("risk_level").alias("level")).where("level = 'SANCTIONED'").select("k").distinct()
    x = exposure.withColumn("k", plain_key(F.col("source_risk_node"))).join(level, "k", "left_semi").select("node_key", F.col("best_depth").alias("depth"), F.col("exposure_score").cast("double").alias("score"))
    w = W.partitionBy("depth").orderBy(F.col("score").desc(), "node_key")
    return x.where("depth is not null and score is not null").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_depth).select("node_key", "depth", "rank")
