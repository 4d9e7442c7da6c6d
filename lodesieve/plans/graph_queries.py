"""Registered queries of the graph operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import evidence as V
from ..operators import graph as G
from ..operators import metrics as M
from ..operators.orphan_refs import plain_key
from ..session import cut, table

AS_OF = "2026-06-13"
def _day():
    return F.lit(AS_OF).cast("date")



def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_rollup(G.plain_edges(table(spark, sf_dir, "graph_edges")))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.scored_edges(_rolled(spark, sf_dir), _day())


def edge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir).select("src", "dst", "edge_type", F.round("amount", 2).alias("amount"), "transaction_count", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), F.round("confidence", 4).alias("confidence"))


def node_flow_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.flow_totals(_rolled(spark, sf_dir)).select("node_key", F.round("total_out", 2).alias("total_out"), F.round("total_in", 2).alias("total_in"))


def flow_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_concentration(_rolled(spark, sf_dir)).select("src", "dst", "edge_type", *[F.round(c, 6).alias(c) for c in ("outgoing_concentration", "incoming_concentration", "flow_concentration")])


def edge_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("src", "dst", "edge_type", F.round("flow_materiality", 6).alias("flow_materiality"), F.round("edge_score", 10).alias("edge_score"), "weak")


def adjacency_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacency(_scored(spark, sf_dir)).select("node", "neighbor", "edge_type", "direction", "flow", "override_allowed", "multiplier")


def top_k_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_edges(G.adjacency(_scored(spark, sf_dir)), 20).select("node", "rank", "neighbor", "edge_type", "direction", "degree", F.round("edge_score", 10).alias("edge_score"))


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes = table(spark, sf_dir, "graph_nodes")
    adj = cut(G.adjacency(_scored(spark, sf_dir)))
    degrees = adj.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes, adj, degrees, G.propagate(nodes, adj)


def exposure_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)[3]
    return labels.select("node_key", F.round("score", 13).alias("score"), "depth", "source", F.array_join(F.reverse("path"), ">").alias("path"))


def derived_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, degrees, labels = _labels(spark, sf_dir)
    return G.derived_anchors(labels, nodes, degrees, _day()).select("node_key", "code", "weight", "source", "depth")


def derived_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, adj, degrees, labels = _labels(spark, sf_dir)
    anchors = G.derived_anchors(labels, nodes, degrees, _day())
    return G.derived_exposure(anchors, adj, nodes, degrees, _day()).withColumn("score", F.round("score", 13))


def merged_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, adj, degrees, labels = _labels(spark, sf_dir)
    d = G.derived_exposure(G.derived_anchors(labels, nodes, degrees, _day()), adj, nodes, degrees, _day())
    return G.merge_exposure(labels, d, nodes).withColumn("score", F.round("score", 13))


def derived_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure rows of the second pass, with stitched paths: funder, derived anchor, then the anchor's path."""
    nodes, adj, degrees, labels = _labels(spark, sf_dir)
    d = G.derived_exposure(G.derived_anchors(labels, nodes, degrees, _day()), adj, nodes, degrees, _day(), with_steps=True)
    return G.stitched_paths(d, G.label_paths(labels, nodes), nodes)


def derived_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons, risk and verdict of the accounts that fund a derived anchor."""
    facts = V.path_facts(derived_paths(spark, sf_dir), _day())
    return V.judge(V.with_context(facts, table(spark, sf_dir, "graph_nodes"), G.pattern_flags(G.behavior_profile(_rolled(spark, sf_dir)))))


def derived_path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys along every stitched path, with what marks the anchor."""
    x = derived_paths(spark, sf_dir)
    a = F.get("best_path", F.lit(1))
    return x.select("node_key", "source_risk_node", F.round("exposure_score", 13).alias("score"), F.array_join(F.col("best_path.node_key"), ">").alias("path"), a["derived_anchor_score"].alias("weight"), a["derived_anchor_reason_code"].alias("code"), a["derived_suppression_reason"].alias("suppressed"), F.round(a["amount"], 2).alias("amount"))


def edge_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_math(table(spark, sf_dir, "exposure_index"), _day()).distinct()


def exposure_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.reason_of(table(spark, sf_dir, "exposure_index"), table(spark, sf_dir, "graph_nodes")).distinct()


def account_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.account_pool(table(spark, sf_dir, "exposure_index"), table(spark, sf_dir, "graph_nodes"))


def trigger_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reason codes of an account, the primary one first, each once, in order."""
    v = account_evidence(spark, sf_dir)
    codes = F.array_distinct(F.filter(F.concat(F.array("code"), F.split("further", ",")), lambda c: c.isNotNull() & (c != "")))
    return v.select("node_key", F.array_join(codes, ">").alias("codes"), F.size(codes).alias("n_codes"))


def accuracy_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from evidence against what the stored score alone would give, per depth and over all."""
    v = account_evidence(spark, sf_dir).select("node_key", F.col("verdict").alias("predicted"))
    x = table(spark, sf_dir, "exposure_index").where("exposure_score is not null and best_depth is not null")
    want = F.when(F.col("best_depth") == 0, "MATCH").when(F.col("exposure_score").cast("double") >= 0.30, "REVIEW").otherwise("NO_MATCH")
    m = M.against_expected(x.select("node_key", F.col("best_depth").alias("depth"), want.alias("expected")).join(v, "node_key"), "depth")
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "dangerous_miss_rate", "friction_rate", "review_rate")})


def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the search: entries, truncated and weak ones, hubs, anchors."""
    nodes = table(spark, sf_dir, "graph_nodes")
    top = G.top_edges(G.adjacency(_scored(spark, sf_dir)), 20)
    per = top.groupBy("node", "degree").agg(F.count(F.lit(1)).alias("kept"), F.count_if("weak").alias("weak"))
    a = per.agg(F.sum("degree").alias("entries"), F.sum(F.col("degree") - F.col("kept")).alias("truncated"), F.sum("weak").alias("weak_kept"), F.count_if(F.col("degree") > 200).alias("hubs"))
    return a.crossJoin(nodes.agg(F.count_if(S.source_risk(F.col("risk_level")) > 0).alias("anchors")))  # two single rows


def behavior_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = G.behavior_profile(_rolled(spark, sf_dir))
    digits = {"total_outgoing": 2, "total_incoming": 2, "largest_outgoing": 2, "largest_incoming": 2, "max_outgoing_concentration": 6, "max_incoming_concentration": 6, "small_inbound_amount": 2, "pass_through_ratio": 4}
    return p.withColumns({c: F.round(c, n) for c, n in digits.items()}).withColumn("account_age_days", F.datediff(_day(), "owned_since")).withColumn("owned_since", F.col("owned_since").cast("string"))


def pattern_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pattern_flags(G.behavior_profile(_rolled(spark, sf_dir))).withColumn("pass_through_ratio", F.round("pass_through_ratio", 4))


def top_counterparties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_counterparties(_rolled(spark, sf_dir)).withColumn("amount", F.round("amount", 2))


def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.incident(_rolled(spark, sf_dir)).groupBy(F.col("node").alias("node_key")).agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("other").alias("neighbors"))


def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_degree(spark, sf_dir).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def node_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds or owns a node, and what it controls, with the labels of the other end."""
    meta = table(spark, sf_dir, "graph_nodes").select(plain_key(F.col("node_key")).alias("other"), "display_name", "node_type", "risk_level")
    e = G.incident(_rolled(spark, sf_dir)).where(F.col("edge_type").isin("USES_ACCOUNT", "OWNS"))
    return e.join(meta, "other", "left").select(F.col("node").alias("node_key"), F.when(F.col("is_from"), "controls").otherwise("belongs_to").alias("relation"), "edge_type", "other", F.coalesce("display_name", "other").alias("label"), F.upper(F.coalesce("risk_level", F.lit("NONE"))).alias("risk"))


def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.path_steps(table(spark, sf_dir, "exposure_index")).withColumn("amount", F.round("amount", 2))


def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored path shows: sanctioned end, all hops one way, control or shared hops, oldest hop, new large hop."""
    x = table(spark, sf_dir, "exposure_index").select("node_key", F.filter("best_path", lambda s: s.isNotNull()).alias("p"))
    hops = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    x = x.withColumn("h", hops).where("size(p) > 0")
    date = lambda c: c.try_cast("date")
    return x.select(
        "node_key",
        F.size("h").alias("n_hops"),
        F.exists("p", lambda s: F.coalesce(F.upper(s["risk_level"]), F.lit("")) == "SANCTIONED").alias("reaches_sanctioned"),
        ((F.size("h") > 0) & F.forall("h", lambda s: F.coalesce(s["semantic_flow"], F.lit("")) == "outbound_to_anchor")).alias("all_outbound"),
        F.exists("h", lambda s: F.coalesce(F.upper(s["edge_type"]), F.lit("")).isin("USES_ACCOUNT", "OWNS")).alias("control_hop"),
        F.exists("h", lambda s: F.coalesce(F.upper(s["edge_type"]), F.lit("")) == "SHARED_IDENTIFIER").alias("shared_hop"),
        F.datediff(_day(), F.array_min(F.transform("h", lambda s: date(s["last_seen"])))).alias("oldest_days"),
    )


def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.path_facts(table(spark, sf_dir, "exposure_index"), _day())


def account_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary and further reasons, risk and verdict of every account with stored exposure."""
    facts = V.path_facts(table(spark, sf_dir, "exposure_index"), _day())
    return V.judge(V.with_context(facts, table(spark, sf_dir, "graph_nodes"), G.pattern_flags(G.behavior_profile(_rolled(spark, sf_dir)))))


def verdict_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = account_evidence(spark, sf_dir).select("node_key", "verdict", "risk")
    x = table(spark, sf_dir, "exposure_index").select("node_key", "best_depth")
    return x.join(v, "node_key").groupBy("best_depth", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("risk"), 6).alias("avg_risk"))


def related_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest edges around every listed account."""
    n = direct_accounts(spark, sf_dir).select(plain_key(F.col("node_key")).alias("target")).distinct()
    return G.related_edges(_rolled(spark, sf_dir), n).withColumn("amount", F.round("amount", 2))


def account_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, review and match shares of the evidence verdicts per source level, with a total row."""
    facts = V.path_facts(table(spark, sf_dir, "exposure_index"), _day())
    c = V.with_context(facts, table(spark, sf_dir, "graph_nodes"), G.pattern_flags(G.behavior_profile(_rolled(spark, sf_dir))))
    v = V.judge(c).join(c.select("node_key", "source_level"), "node_key")
    return v.rollup("source_level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("verdict") == "MATCH").cast("double")), 6).alias("match_share"), F.round(F.avg((F.col("verdict") == "REVIEW").cast("double")), 6).alias("review_share"))


def exposed_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best exposed nodes per depth whose source is sanctioned, at most 4,000 a depth."""
    from pyspark.sql import Window as W

    n = table(spark, sf_dir, "graph_nodes").select(plain_key(F.col("node_key")).alias("source"), F.upper("risk_level").alias("level"))
    e = table(spark, sf_dir, "exposure_index").select("node_key", "exposure_score", "best_depth", plain_key(F.col("source_risk_node")).alias("source"))
    w = W.partitionBy("best_depth").orderBy(F.col("exposure_score").desc(), "node_key")
    j = e.join(n.where("level = 'SANCTIONED'"), "source").withColumn("rank", F.row_number().over(w)).where("rank <= 4000")
    return j.select("best_depth", "rank", "node_key", F.col("exposure_score").cast("double").alias("exposure_score"))


def direct_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts and wallets that are listed themselves."""
    n = table(spark, sf_dir, "graph_nodes")
    return n.where(F.upper("risk_level").isin("SANCTIONED") & F.upper("node_type").isin("IBAN", "ACCOUNT", "WALLET")).select("node_key", "node_type", "country")


def payment_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every payment with the exposure of its account, or else its wallet; payments without a key keep a null score."""
    t = table(spark, sf_dir, "txn_event")
    key = F.coalesce(F.nullif(F.trim("bene_account"), F.lit("")), F.nullif(F.trim("wallet"), F.lit("")))
    x = table(spark, sf_dir, "exposure_index").select(F.col("node_key").alias("key"), F.col("exposure_score").cast("double").alias("score"), "best_depth")
    return t.select("txn_id", key.alias("key")).distinct().join(x, "key", "left").select("txn_id", "key", "score", "best_depth")


QUERIES = (
    edge_rollup, node_flow_totals, flow_concentration, edge_score, adjacency_entries, top_k_edges, exposure_two_hop, derived_anchor, derived_exposure, merged_exposure, derived_path_keys, derived_evidence, edge_math, exposure_reason, account_pool, trigger_codes, accuracy_by_depth, search_stats,
    behavior_profile, pattern_flags, top_counterparties, node_degree, degree_histogram, node_control, path_steps, path_predicates, path_facts, account_evidence, verdict_by_depth, related_edges, account_metrics, exposed_by_depth, direct_accounts, payment_exposure,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _key(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '\\s+', '', 'g')), '')"


def _case(c: str, table_: dict, otherwise: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "case " + " ".join(f"when {c} = {lit(k)} then {lit(v)}" for k, v in table_.items()) + f" else {lit(otherwise)} end"


def _steps(c: str, steps: tuple, otherwise: float) -> str:
    return "case " + " ".join(f"when {c} >= {b} then {w}" for b, w in steps) + f" else {otherwise} end"


_DECAY = "case when {c} is null then 0.1::double " + " ".join(f"when greatest(0, datediff('day', {{c}}, date '{AS_OF}')) <= {d} then {w}" for d, w in S.AGE_STEPS) + " else 0.1 end"
_BASE = f"""
e as (select distinct id, upper(edge_type) as edge_type, {_key("from_node_key")} as src, {_key("to_node_key")} as dst, coalesce(total_amount::double, 0) as amount,
      coalesce(transaction_count, 0) as transaction_count, first_seen, last_seen, confidence::double as confidence from graph_edges),
r as (select src, dst, edge_type, sum(amount) as amount, sum(transaction_count)::bigint as transaction_count, min(first_seen) as first_seen, max(last_seen) as last_seen, max(confidence) as confidence
      from e where src is not null and dst is not null group by all),
t as (select node_key, sum(o) as total_out, sum(i) as total_in from (select src as node_key, amount as o, 0::double as i from r where edge_type = 'SENT_TO' union all select dst, 0, amount from r where edge_type = 'SENT_TO') group by 1),
c as (select r.*, case when edge_type = 'SENT_TO' and a.total_out > 0 then amount / a.total_out else 0 end as outgoing_concentration,
      case when edge_type = 'SENT_TO' and b.total_in > 0 then amount / b.total_in else 0 end as incoming_concentration
      from r left join t a on a.node_key = r.src left join t b on b.node_key = r.dst),
f as (select *, greatest(outgoing_concentration, incoming_concentration) as flow_concentration from c),
m as (select *, case when edge_type in ('OWNS', 'USES_ACCOUNT', 'SHARED_IDENTIFIER') then 1.0::double
      else 0.7::double * ({_steps("amount", S.AMOUNT_STEPS, 0.05)}) + 0.3::double * ({_steps("flow_concentration", S.SHARE_STEPS, 0.05)}) end as flow_materiality from f),
s as (select *, ({_case("edge_type", S.RELATION, 0.2)})::double * flow_materiality * ({_DECAY.format(c="last_seen")})::double * coalesce(nullif(confidence, 0), 1) as edge_score,
      edge_type = 'SENT_TO' and amount < 100 or ({_DECAY.format(c="last_seen")}) = 0.1 and flow_materiality <= 0.2 as weak from m)"""


def _dir(k: int, src: str, dst: str, name: str) -> str:
    pick = lambda i: _case("edge_type", {r[0]: r[1:][i] for r in S.DIRECTIONS}, S.OTHER_DIRECTION[i])
    return f"select {src} as node, {dst} as neighbor, '{name}' as direction, {pick(2 + k)} as override_allowed, {pick(4 + k)} as flow, coalesce(nullif(({pick(6 + k)})::double, 0), 1) as multiplier, s.* exclude (src, dst) from s where {pick(k)}"


_ADJ = f"""{_BASE}, adj as ({_dir(0, "src", "dst", "forward")} union all {_dir(1, "dst", "src", "reverse")}),
g as (select node, count(*) as degree from adj group by 1),
k as (select * from (select adj.*, row_number() over (partition by node order by edge_score desc, neighbor, edge_type, direction) as rank from adj) join g using (node) where rank <= 20)"""


def _labels_sql(rounds: int = 5) -> str:
    step = "struct_pack(edge_type := edge_type, amount := amount, flow := flow, last_seen := last_seen, flow_concentration := flow_concentration)"
    out = f"""{_ADJ}, u as (select node, neighbor, edge_score, multiplier, {step} as step from k where degree <= 200 and not weak),
a as (select node_key, max(score) as score, 0 as depth, node_key as source, [node_key] as path, []::{"STRUCT(edge_type VARCHAR, amount DOUBLE, flow VARCHAR, last_seen DATE, flow_concentration DOUBLE)"}[] as edges
      from (select {_key("node_key")} as node_key, ({_case("upper(risk_level)", S.SOURCE_RISK, 0.0)})::double as score from graph_nodes) where score > 0 and node_key is not null group by node_key),
l0 as (select * from a)"""
    hop = _case("depth + 1", S.HOPS, 0.1)
    for i in range(rounds):
        out += f""", l{i + 1} as materialized (select node_key, score, depth, source, path, edges from (select *, row_number() over (partition by node_key order by round(score, 12) desc, depth, source || '>' || array_to_string(path, '>')) as n from (
  select * from a union all select u.neighbor, l.score * u.edge_score * u.multiplier * ({hop})::double, l.depth + 1, l.source, list_append(l.path, u.neighbor), list_append(l.edges, u.step)
  from l{i} l join u on u.node = l.node_key where l.depth < 2 and (l.score >= 0.03 or l.depth = 0) and not list_contains(l.path, u.neighbor))) where n = 1)"""
    return out + f", l as (select * from l{rounds})"


_META = f"""nm as (select {_key("node_key")} as node_key, any_value(upper(node_type)) as node_type, any_value(upper(risk_level)) as risk_level from graph_nodes group by 1)"""
_RECENT = f"len(list_filter(edges, lambda e: e.amount >= 1000 and {_DECAY.format(c='e.last_seen')} >= 0.8)) > 0"
_FLOW = lambda f: f"len(list_filter(edges, lambda e: e.flow <> '{f}')) = 0"
_ANCHORS = f"""{_labels_sql()}, {_META}, da as (select l.node_key, l.source, l.depth, l.path,
  case when {_FLOW("outbound_to_anchor")} and depth = 1 then 'OUTBOUND_1_HOP_TO_SANCTIONED' when {_FLOW("outbound_to_anchor")} and depth = 2 then 'OUTBOUND_2_HOP_TO_SANCTIONED'
       when {_FLOW("inbound_from_anchor")} and {_RECENT} then 'INBOUND_FROM_SANCTIONED'
       when {_RECENT} and (len(edges) >= 2 or len(list_filter(edges, lambda e: e.edge_type in ('USES_ACCOUNT', 'OWNS'))) > 0) and len(list_filter(edges, lambda e: e.flow_concentration >= 0.7)) > 0 then 'PROXY_ACCOUNT_BEHAVIOR' end as code
  from l join nm n on n.node_key = l.node_key join nm z on z.node_key = l.source left join g on g.node = l.node_key
  where l.depth > 0 and n.node_type <> 'BANK' and coalesce(g.degree, 0) <= 200 and z.risk_level = 'SANCTIONED' and len(list_filter(edges, lambda e: e.edge_type = 'SHARED_IDENTIFIER')) = 0),
dw as (select *, {_case("code", {"OUTBOUND_1_HOP_TO_SANCTIONED": 0.7, "OUTBOUND_2_HOP_TO_SANCTIONED": 0.55, "INBOUND_FROM_SANCTIONED": 0.55}, 0.35)}::double as weight from da where code is not null)"""
_DERIVED = f"""{_ANCHORS}, dx as (select b.neighbor as node_key, dw.node_key as anchor, dw.code, dw.source, len(dw.path)::int as depth, weight * b.edge_score * b.multiplier * 0.7::double as raw,
  case when fm.node_type = 'BANK' then 'BANK_HUB_BOUNDARY' when coalesce(fg.degree, 0) > 200 then 'HUB_DEGREE_SUPPRESSION' when b.amount < 1000 or {_DECAY.format(c="b.last_seen")} < 0.8 then 'LOW_MATERIALITY_OR_STALE'
       when b.incoming_concentration < 0.5 and b.transaction_count < 100 then 'LOW_CONCENTRATION' when weight < 0.55 then 'WEAK_DERIVED_ANCHOR' end as suppressed
  from dw join adj b on b.node = dw.node_key and b.edge_type = 'SENT_TO' and b.direction = 'reverse' join nm fm on fm.node_key = b.neighbor left join g fg on fg.node = b.neighbor where not list_contains(dw.path, b.neighbor)),
d as (select node_key, case when suppressed is null then raw else least(raw, 0.029) end as score, depth, source, anchor, code, suppressed from dx
      qualify row_number() over (partition by node_key order by round(case when suppressed is null then raw else least(raw, 0.029) end, 12) desc, anchor) = 1)"""
_STITCHED = _DERIVED.replace("b.neighbor as node_key, dw", "b.neighbor as node_key, dw.path as apath, weight as w, b.amount as amt, dw").replace("d as (select node_key, case", "d as (select node_key, apath, w, amt, case")
_INC = "i as (select src as node, dst as other, true as is_from, f.* exclude (src, dst) from f union all select dst, src, false, f.* exclude (src, dst) from f)"
_PROFILE = f"""{_BASE}, {_INC}, p as (select node as node_key,
  coalesce(sum(amount) filter (edge_type = 'SENT_TO' and is_from), 0) as total_outgoing, coalesce(sum(amount) filter (edge_type = 'SENT_TO' and not is_from), 0) as total_incoming,
  coalesce(sum(transaction_count) filter (edge_type = 'SENT_TO' and is_from), 0)::bigint as outgoing_tx, coalesce(sum(transaction_count) filter (edge_type = 'SENT_TO' and not is_from), 0)::bigint as incoming_tx,
  count(distinct other) filter (edge_type = 'SENT_TO' and is_from) as outgoing_counterparties, count(distinct other) filter (edge_type = 'SENT_TO' and not is_from) as incoming_counterparties,
  coalesce(max(amount) filter (edge_type = 'SENT_TO' and is_from), 0) as largest_outgoing, coalesce(max(amount) filter (edge_type = 'SENT_TO' and not is_from), 0) as largest_incoming,
  coalesce(max(outgoing_concentration) filter (edge_type = 'SENT_TO' and is_from), 0) as max_outgoing_concentration, coalesce(max(incoming_concentration) filter (edge_type = 'SENT_TO' and not is_from), 0) as max_incoming_concentration,
  count(distinct other) filter (small) as small_inbound_counterparties, coalesce(sum(amount) filter (small), 0) as small_inbound_amount, coalesce(sum(transaction_count) filter (small), 0)::bigint as small_inbound_tx,
  datediff('day', min(first_seen) filter (small), max(last_seen) filter (small)) as small_inbound_days, count(*) filter (not is_from and edge_type in ('USES_ACCOUNT', 'OWNS')) as control_count,
  min(first_seen) filter (not is_from and edge_type in ('USES_ACCOUNT', 'OWNS')) as owned_since
  from (select *, edge_type = 'SENT_TO' and not is_from and amount <= 2000 and case when transaction_count > 0 then amount / transaction_count else amount end <= 150 as small from i) group by 1),
q as (select *, case when total_incoming > 0 then total_outgoing / total_incoming else 0 end as pass_through_ratio from p)"""


_AGE = f"datediff('day', try_cast(s.last_seen as date), date '{AS_OF}')"
_ANY = lambda l, c: f"len(list_filter({l}, lambda s: coalesce({c}, false))) > 0"
_ALL = lambda l, c: f"len(list_filter({l}, lambda s: not coalesce({c}, false))) = 0"
_CONTROL = _ANY("h", "upper(s.edge_type) in ('OWNS', 'USES_ACCOUNT')")
_FACTS = f"""x as (select node_key, {_key("source_risk_node")} as source, list_filter(coalesce(best_path, []), lambda s: s is not null) as p from exposure_index),
y as (select *, p[2:] as h, p[2:len(p) - 1] as mid from x), z as (select *, list_filter(h, lambda s: coalesce(upper(s.edge_type) = 'SENT_TO', false)) as sent from y),
pf as (select node_key, source, coalesce(p[2].derived_anchor, false)::boolean as derived, 0.0::double as derived_score, false as suppressed, len(h) as n_hops, {_ANY("p", "upper(s.risk_level) = 'SANCTIONED'")} as reaches_sanctioned,
  len(h) > 0 and {_ALL("h", "s.semantic_flow = 'outbound_to_anchor'")} as all_outbound, len(h) > 0 and {_ALL("h", "s.semantic_flow = 'inbound_from_anchor'")} as all_inbound,
  not ({_CONTROL} or {_ANY("h", f"coalesce(s.amount, 0) >= 1000 or coalesce(s.amount, 0) >= 100 and coalesce({_AGE}, 9999) <= 180")}) and len(sent) > 0 and {_ALL("sent", f"coalesce(s.amount, 0) < 100 and coalesce({_AGE}, 9999) > 180")} as old_tiny,
  {_ANY("h", f"datediff('day', try_cast(s.first_seen as date), date '{AS_OF}') <= 30 and datediff('day', try_cast(s.first_seen as date), try_cast(s.last_seen as date)) <= 7 and coalesce(s.amount, 0) >= 10000 and coalesce(s.transaction_count, 0) <= 3")} as abnormal,
  len(p) >= 4 or {_CONTROL} as proxy, {_ANY("h", "upper(s.edge_type) = 'SHARED_IDENTIFIER'")} or {_ANY("mid", "upper(s.node_type) = 'BANK'")} as hub, {_ANY("h", f"{_AGE} > 180")} as old,
  {_ANY("h", "upper(s.edge_type) in ('USES_ACCOUNT', 'OWNS')")} as control_hop, {_ANY("h", "upper(s.edge_type) = 'SHARED_IDENTIFIER'")} as shared_hop,
  datediff('day', list_min(list_transform(h, lambda s: try_cast(s.last_seen as date))), date '{AS_OF}') as oldest_days, len(p) as n_nodes from z)"""
_ladder = lambda k: "case " + " ".join(f"when {c} then {repr(r[k]) if k == 0 else r[k]}" for c, *r in V.LADDER) + " end"
_JUDGED = f"""{_PROFILE}, {_FACTS}, fg as (select node_key as k, small_inbound_counterparties >= 8 and small_inbound_amount >= 10000 and small_inbound_tx >= 100 and largest_outgoing >= 10000 and pass_through_ratio >= 0.7 as structuring,
  max_outgoing_concentration >= 0.7 and largest_outgoing >= 10000 or max_incoming_concentration >= 0.7 and largest_incoming >= 10000 as dense from q),
nn as (select {_key("node_key")} as k, any_value(upper(risk_level)) as level, any_value(upper(node_type)) as kind, any_value(upper(country)) as country from graph_nodes group by 1),
cx as (select pf.*, coalesce(a.level, 'NONE') as level, coalesce(b.level, 'NONE') as source_level, coalesce(a.level = 'SANCTIONED' and a.kind in ('IBAN', 'ACCOUNT', 'WALLET'), false) as direct,
  coalesce(b.country in {V.CORRIDOR_COUNTRIES}, false) as corridor, coalesce(fg.structuring, false) as structuring, coalesce(fg.dense, false) as dense
  from pf left join nn a on a.k = {_key("pf.node_key")} left join nn b on b.k = pf.source left join fg on fg.k = {_key("pf.node_key")}),
c1 as (select *, {_ladder(0)} as code, ({_ladder(1)})::double as base from cx),
c2 as (select *, list_filter([{", ".join(f"case when n_hops > 0 and {c} then {{'code': '{n}', 'delta': {d}::double}} end" for c, n, d in V.ADDITIONS)}], lambda x: x is not null) as more from c1),
jd as (select node_key, nullif(code, '') as code, base, array_to_string(list_transform(more, lambda m: m.code), ',') as further, greatest(0, least(1, base + coalesce(list_sum(list_transform(more, lambda m: m.delta)), 0))) as risk, direct from c2)"""


def oracle_sql() -> dict[str, str]:
    return {
        "path_facts": f"with {_FACTS} select node_key, source, derived, derived_score, suppressed, n_hops, reaches_sanctioned, all_outbound, all_inbound, old_tiny, abnormal, proxy, hub, old from pf",
        "path_predicates": f"with {_FACTS} select node_key, n_hops, reaches_sanctioned, all_outbound, control_hop, shared_hop, oldest_days from pf where n_nodes > 0",
        "trigger_codes": f"""with {_JUDGED}, tc as (select node_key, case when code = '' then null else code end as code, string_split(further, ',') as more from jd),
tu as (select node_key, list_filter(list_concat([code], more), lambda c: c is not null and c <> '') as l from tc),
td as (select node_key, list_filter(l, lambda c, i: list_position(l, c) = i) as l from tu)
select node_key, array_to_string(l, '>') as codes, len(l)::int as n_codes from td""",
        "accuracy_by_depth": f"""with {_JUDGED}, ae as (select x.best_depth as depth, case when x.best_depth = 0 then 'MATCH' when x.exposure_score::double >= 0.30 then 'REVIEW' else 'NO_MATCH' end as e, case when direct then 'MATCH' when round(risk, 9) >= 0.30 then 'REVIEW' else 'NO_MATCH' end as p
  from exposure_index x join jd using (node_key) where x.exposure_score is not null and x.best_depth is not null)
select depth, round(avg((e = p)::int), 6) as accuracy, round(coalesce(avg((p = 'NO_MATCH')::int) filter (e <> 'NO_MATCH'), 0), 6) as dangerous_miss_rate, round(coalesce(avg((p <> 'NO_MATCH')::int) filter (e = 'NO_MATCH'), 0), 6) as friction_rate, round(avg((p = 'REVIEW')::int), 6) as review_rate, count(*) as n_rows
from ae group by rollup (depth)""",
        "account_evidence": f"with {_JUDGED} select node_key, code, base, further, round(risk, 4) as risk, case when base >= 0.9 then 'CRITICAL' when base >= 0.55 then 'HIGH' when base >= 0.3 then 'MEDIUM' else 'LOW' end as severity, case when direct then 'MATCH' when round(risk, 9) >= 0.30 then 'REVIEW' else 'NO_MATCH' end as verdict from jd",
        "verdict_by_depth": f"with {_JUDGED} select x.best_depth, case when direct then 'MATCH' when round(risk, 9) >= 0.30 then 'REVIEW' else 'NO_MATCH' end as verdict, count(*) as n, round(avg(round(risk, 4)), 6) as avg_risk from exposure_index x join jd using (node_key) group by 1, 2",
        "edge_rollup": f"with {_BASE} select src, dst, edge_type, round(amount, 2) as amount, transaction_count, first_seen::varchar as first_seen, last_seen::varchar as last_seen, round(confidence, 4) as confidence from r",
        "node_flow_totals": f"with {_BASE} select node_key, round(total_out, 2) as total_out, round(total_in, 2) as total_in from t",
        "flow_concentration": f"with {_BASE} select src, dst, edge_type, round(outgoing_concentration, 6) as outgoing_concentration, round(incoming_concentration, 6) as incoming_concentration, round(flow_concentration, 6) as flow_concentration from f",
        "edge_score": f"with {_BASE} select src, dst, edge_type, round(flow_materiality, 6) as flow_materiality, round(edge_score, 10) as edge_score, weak from s",
        "adjacency_entries": f"with {_ADJ} select node, neighbor, edge_type, direction, flow, override_allowed, multiplier from adj",
        "top_k_edges": f"with {_ADJ} select node, rank, neighbor, edge_type, direction, degree, round(edge_score, 10) as edge_score from k",
        "exposure_two_hop": f"with {_labels_sql()} select node_key, round(score, 13) as score, depth, source, array_to_string(list_reverse(path), '>') as path from l",
        "derived_anchor": f"with {_ANCHORS} select node_key, code, weight, source, depth from dw",
        "derived_exposure": f"with {_DERIVED} select node_key, round(score, 13) as score, depth, source, anchor, code, suppressed from d",
        "merged_exposure": f"""with {_DERIVED}, j as (select coalesce(l.node_key, d.node_key) as node_key, l.score as ls, l.depth as ld, l.source as lo, d.score as ds, d.depth as dd, d.source as do_, z.risk_level as lv
  from l full join d on l.node_key = d.node_key left join nm z on z.node_key = l.source),
w as (select *, ls is not null and (ds is null or ld <= 2 and coalesce(lv, '') = 'SANCTIONED' or ls >= ds) as keep from j)
select node_key, round(case when keep then ls else ds end, 13) as score, case when keep then ld else dd end as depth, case when keep then lo else do_ end as source, case when keep then 'primary' else 'derived' end as origin from w""",
        "derived_path_keys": f"with {_STITCHED} select node_key, source as source_risk_node, round(score, 13) as score, node_key || '>' || array_to_string(list_reverse(apath), '>') as path, w as weight, code, suppressed, round(amt, 2) as amount from d",
        "edge_math": f"""with x as (select node_key, unnest(best_path) as s, unnest(range(len(best_path))) as step from exposure_index)
select distinct node_key, step::int as step, s.edge_type as edge_type, s.semantic_flow as flow, round(coalesce(s.amount::decimal(20,8), 0), 4)::double as amount, round(coalesce(s.flow_materiality_weight::decimal(20,8), 0), 4)::double as materiality, round(coalesce(s.flow_concentration::decimal(20,8), 0), 4)::double as concentration,
  round({_DECAY.format(c="try_cast(s.last_seen as date)")}, 4) as time_decay, round(coalesce(nullif(s.directional_multiplier::decimal(20,8), 0), 1), 4)::double as multiplier from x where step > 0 and s is not null""",
        "exposure_reason": f"""with n as (select {_key("node_key")} as k, any_value(lower(risk_level)) as level from graph_nodes group by 1),
x as (select e.*, {_key("source_risk_node")} as k, array_to_string(list_transform(list_filter(coalesce(best_path, [])[2:], lambda s: s is not null), lambda s: s.edge_type), ' -> ') as hops from exposure_index e where exposure_score is not null and best_depth is not null)
select distinct node_key, case when best_depth = 0 and coalesce(level, 'unknown') = 'sanctioned' then 'direct sanctioned account anchor' when best_depth = 0 then coalesce(level, 'unknown') || ' anchor node'
  else case when exposure_score::double >= 0.30 then 'REVIEW' else 'NO_MATCH' end || ' exposure from ' || coalesce(level, 'unknown') || ' anchor ' || coalesce(x.k, '') || ' at depth ' || best_depth || ' via ' || case when hops = '' then 'anchor' else hops end || ' (score ' || printf('%.3f', round(exposure_score::double, 3)) || ')' end as reason
from x left join n on n.k = x.k""",
        "account_pool": f"""with n as (select distinct {_key("node_key")} as k from graph_nodes where upper(risk_level) = 'SANCTIONED')
select node_key, depth, row_number() over (partition by depth order by score desc, node_key) as rank from (select distinct node_key, best_depth as depth, exposure_score::double as score from exposure_index where {_key("source_risk_node")} in (select k from n) and best_depth is not null and exposure_score is not null) qualify rank <= 4000""",
        "search_stats": f"with {_ADJ}, per as (select node, degree, count(*) as kept, count(*) filter (weak) as weak from k group by all) select sum(degree)::bigint as entries, sum(degree - kept)::bigint as truncated, sum(weak)::bigint as weak_kept, count(*) filter (degree > 200) as hubs, (select count(*) from graph_nodes where upper(risk_level) in ('SANCTIONED', 'SUSPICIOUS')) as anchors from per",
        "behavior_profile": f"""with {_PROFILE} select node_key, round(total_outgoing, 2) as total_outgoing, round(total_incoming, 2) as total_incoming, outgoing_tx, incoming_tx, outgoing_counterparties, incoming_counterparties,
  round(largest_outgoing, 2) as largest_outgoing, round(largest_incoming, 2) as largest_incoming, round(max_outgoing_concentration, 6) as max_outgoing_concentration, round(max_incoming_concentration, 6) as max_incoming_concentration,
  small_inbound_counterparties, round(small_inbound_amount, 2) as small_inbound_amount, small_inbound_tx, small_inbound_days, control_count, owned_since::varchar as owned_since, round(pass_through_ratio, 4) as pass_through_ratio,
  datediff('day', owned_since, date '{AS_OF}') as account_age_days from q""",
        "pattern_flags": f"""with {_PROFILE} select node_key, small_inbound_counterparties >= 8 and small_inbound_amount >= 10000 and small_inbound_tx >= 100 and largest_outgoing >= 10000 and pass_through_ratio >= 0.7 as structuring,
  max_outgoing_concentration >= 0.7 and largest_outgoing >= 10000 or max_incoming_concentration >= 0.7 and largest_incoming >= 10000 as high_concentration, round(pass_through_ratio, 4) as pass_through_ratio from q""",
        "related_edges": f"""with {_BASE}, {_INC}, tg as (select distinct {_key("node_key")} as target from graph_nodes where upper(risk_level) = 'SANCTIONED' and upper(node_type) in ('IBAN', 'ACCOUNT', 'WALLET')),
nr as (select target, target as node from tg union select target, i.other from tg join i on i.node = tg.target),
fd as (select distinct nr.target, r.src, r.dst, r.edge_type, r.amount from nr join r on r.src = nr.node or r.dst = nr.node)
select target, rank, src, dst, edge_type, round(amount, 2) as amount from (select *, row_number() over (partition by target order by amount desc, edge_type, src, dst) as rank from fd) where rank <= 12""",
        "account_metrics": f"""with {_JUDGED}, vv as (select cx.source_level, case when jd.direct then 'MATCH' when round(risk, 9) >= 0.30 then 'REVIEW' else 'NO_MATCH' end as verdict from jd join cx using (node_key))
select source_level, count(*) as n, round(avg((verdict = 'MATCH')::int), 6) as match_share, round(avg((verdict = 'REVIEW')::int), 6) as review_share from vv group by rollup (source_level)""",
        "top_counterparties": f"with {_BASE}, {_INC} select node as node_key, case when is_from then 'sent' else 'received' end as way, rank, other, round(amount, 2) as amount from (select *, row_number() over (partition by node, is_from order by amount desc, other) as rank from i where edge_type = 'SENT_TO') where rank <= 8",
        "node_degree": f"with {_BASE}, {_INC} select node as node_key, count(*) as degree, count(distinct other) as neighbors from i group by 1",
        "degree_histogram": f"with {_BASE}, {_INC}, h as (select node, count(*) as degree from i group by 1) select degree, count(*) as n_nodes from h group by 1",
        "node_control": f"""with {_BASE}, {_INC} select i.node as node_key, case when is_from then 'controls' else 'belongs_to' end as relation, edge_type, other, coalesce(n.display_name, other) as label, upper(coalesce(n.risk_level, 'NONE')) as risk
  from i left join graph_nodes n on {_key("n.node_key")} = i.other where edge_type in ('USES_ACCOUNT', 'OWNS')""",
        "path_steps": """select node_key, step, s.node_key as step_key, s.node_type as step_type, case when step = 0 then 'account' when step = n - 1 then 'source' else 'hop' end as role, s.edge_type as edge_type, round(s.amount::double, 2) as amount
  from (select node_key, len(best_path) as n, unnest(best_path) as s, unnest(range(len(best_path)))::int as step from exposure_index)""",
        "exposed_by_depth": f"""select best_depth, rank, node_key, exposure_score::double as exposure_score from (select e.best_depth, e.node_key, e.exposure_score, row_number() over (partition by e.best_depth order by e.exposure_score desc, e.node_key) as rank
  from exposure_index e join graph_nodes n on {_key("n.node_key")} = {_key("e.source_risk_node")} where upper(n.risk_level) = 'SANCTIONED') where rank <= 4000""",
        "direct_accounts": "select node_key, node_type, country from graph_nodes where upper(risk_level) = 'SANCTIONED' and upper(node_type) in ('IBAN', 'ACCOUNT', 'WALLET')",
        "payment_exposure": "with t as (select distinct txn_id, coalesce(nullif(trim(bene_account), ''), nullif(trim(wallet), '')) as key from txn_event) select t.txn_id, t.key, x.exposure_score::double as score, x.best_depth from t left join exposure_index x on x.node_key = t.key",
    }
