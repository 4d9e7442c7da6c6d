"""Evidence from stored exposure paths: facts of a path, a ladder of primary reasons, additive further reasons, a verdict.

Facts are higher-order expressions over the path array, so every account is one row and nothing is exploded. The ladder
and the additions are tables of (condition, code, score) and can be replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .orphan_refs import plain_key

CORRIDOR_COUNTRIES = ("IR", "KP", "SY", "RU", "BY")
Rules = Sequence[tuple[str, str, float]]

# fixed values: the first rule that holds gives the primary reason; all further ones that hold add up
LADDER: Rules = (
    ("direct and level = 'SANCTIONED'", "DIRECT_SANCTIONS_MATCH", 1.0),
    ("n_hops = 0", "", 0.0),
    ("derived and suppressed", "DERIVED_RISK_PROPAGATION_SUPPRESSED", 0.08),
    ("derived and derived_score >= 0.70", "UPSTREAM_FUNDING_OF_DERIVED_SANCTIONS_PROXY", 0.46),
    ("derived and derived_score >= 0.55", "UPSTREAM_FUNDING_OF_DERIVED_SANCTIONS_PROXY", 0.38),
    ("derived", "UPSTREAM_FUNDING_OF_DERIVED_SANCTIONS_PROXY", 0.24),
    ("old_tiny", "OLD_EXPOSURE_DISCOUNTED", 0.05),
    ("reaches_sanctioned and all_outbound and n_hops <= 1", "OUTBOUND_1_HOP_TO_SANCTIONED", 0.82),
    ("reaches_sanctioned and all_outbound", "OUTBOUND_2_HOP_TO_SANCTIONED", 0.62),
    ("reaches_sanctioned and all_inbound", "INBOUND_FROM_SANCTIONED", 0.48),
    ("reaches_sanctioned", "SHARED_INTERMEDIARY_WITH_SANCTIONED", 0.20),
    ("source_level = 'SUSPICIOUS'", "PROXY_ACCOUNT_BEHAVIOR", 0.44),
    ("abnormal", "ABNORMAL_VALUE_TO_NEW_COUNTERPARTY", 0.38),
    ("proxy", "PROXY_ACCOUNT_BEHAVIOR", 0.40),
    ("true", "HIGH_RISK_CORRIDOR", 0.34),
)
ADDITIONS: Rules = (
    ("derived and not suppressed", "PROXY_CHAIN_FUNDING", 0.08),
    ("derived and not suppressed", "DERIVED_RISK_ANCHOR", 0.04),
    ("not derived and code in ('OUTBOUND_1_HOP_TO_SANCTIONED', 'OUTBOUND_2_HOP_TO_SANCTIONED', 'INBOUND_FROM_SANCTIONED', 'PROXY_ACCOUNT_BEHAVIOR') and source_level = 'SANCTIONED' and not hub and not old", "DERIVED_RISK_ANCHOR", 0.04),
    ("code <> 'PROXY_ACCOUNT_BEHAVIOR' and (proxy or structuring or dense)", "PROXY_ACCOUNT_BEHAVIOR", 0.10),
    ("code <> 'ABNORMAL_VALUE_TO_NEW_COUNTERPARTY' and abnormal", "ABNORMAL_VALUE_TO_NEW_COUNTERPARTY", 0.08),
    ("code <> 'HIGH_RISK_CORRIDOR' and corridor", "HIGH_RISK_CORRIDOR", 0.06),
    ("hub", "HUB_PATH_DISCOUNTED", -0.12),
    ("old", "OLD_EXPOSURE_DISCOUNTED", -0.10),
)


def path_facts(exposure: DataFrame, as_of: Column) -> DataFrame:
    """(node_key, source, n_hops, ... booleans) of every stored path; null elements are left out first. ``derived``: the
    second element is a derived anchor, where the paths have such marks at all."""
    marks = exposure.schema["best_path"].dataType.elementType.names
    x = exposure.select("node_key", plain_key(F.col("source_risk_node")).alias("source"), F.filter(F.coalesce("best_path", F.array().cast(exposure.schema["best_path"].dataType)), lambda s: s.isNotNull()).alias("p"))
    x = x.withColumn("h", F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).withColumn("mid", F.slice("p", 2, F.greatest(F.size("p") - 2, F.lit(0))))
    up = lambda c: F.coalesce(F.upper(c), F.lit(""))
    day = lambda c: c.cast("string").try_cast("date")
    amount = lambda s: F.coalesce(s["amount"].cast("double"), F.lit(0.0))
    age = lambda s: F.datediff(as_of, day(s["last_seen"]))
    flow = lambda f: (F.size("h") > 0) & F.forall("h", lambda s: F.coalesce(s["semantic_flow"], F.lit("")) == f)
    control = F.exists("h", lambda s: up(s["edge_type"]).isin("OWNS", "USES_ACCOUNT"))
    meaning = control | F.exists("h", lambda s: (amount(s) >= 1000) | (amount(s) >= 100) & (F.coalesce(age(s), F.lit(9999)) <= 180))
    sent = F.filter("h", lambda s: up(s["edge_type"]) == "SENT_TO")
    tiny = ~meaning & (F.size(sent) > 0) & F.forall(sent, lambda s: (amount(s) < 100) & (F.coalesce(age(s), F.lit(9999)) > 180))
    new_large = F.exists("h", lambda s: F.coalesce((F.datediff(as_of, day(s["first_seen"])) <= 30) & (F.datediff(day(s["last_seen"]), day(s["first_seen"])) <= 7) & (amount(s) >= 10_000) & (F.coalesce(s["transaction_count"], F.lit(0)) <= 3), F.lit(False)))
    hub = F.exists("h", lambda s: up(s["edge_type"]) == "SHARED_IDENTIFIER") | F.exists("mid", lambda s: up(s["node_type"]) == "BANK")
    second = F.get("p", F.lit(1))
    derived = F.coalesce(second["derived_anchor"].cast("boolean"), F.lit(False)) if "derived_anchor" in marks else F.lit(False)
    score = F.coalesce(second["derived_anchor_score"].cast("double"), F.lit(0.0)) if "derived_anchor_score" in marks else F.lit(0.0)
    suppressed = F.coalesce(second["derived_suppression_reason"] != "", F.lit(False)) if "derived_suppression_reason" in marks else F.lit(False)
    return x.select(
        "node_key", "source", derived.alias("derived"), score.alias("derived_score"), suppressed.alias("suppressed"), F.size("h").alias("n_hops"), F.exists("p", lambda s: up(s["risk_level"]) == "SANCTIONED").alias("reaches_sanctioned"), flow("outbound_to_anchor").alias("all_outbound"), flow("inbound_from_anchor").alias("all_inbound"),
        tiny.alias("old_tiny"), new_large.alias("abnormal"), ((F.size("p") >= 4) | control).alias("proxy"), hub.alias("hub"), F.exists("h", lambda s: F.coalesce(age(s) > 180, F.lit(False))).alias("old"),
    )


def with_context(facts: DataFrame, nodes: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds level and type of the account, level and country of the source, and the account's behaviour flags."""
    n = nodes.select(plain_key(F.col("node_key")).alias("k"), F.upper("risk_level").alias("level"), F.upper("node_type").alias("kind"), F.upper("country").alias("country")).dropDuplicates(["k"])
    x = facts.withColumn("k", plain_key(F.col("node_key"))).join(n.drop("country"), "k", "left")
    x = x.join(n.select(F.col("k").alias("source"), F.col("level").alias("source_level"), F.col("country").alias("source_country")), "source", "left")
    x = x.join(flags.select(F.col("node_key").alias("k"), "structuring", F.col("high_concentration").alias("dense")), "k", "left")
    direct = F.coalesce((F.col("level") == "SANCTIONED") & F.col("kind").isin("IBAN", "ACCOUNT", "WALLET"), F.lit(False))
    return x.withColumns({"direct": direct, "structuring": F.coalesce("structuring", F.lit(False)), "dense": F.coalesce("dense", F.lit(False)), "corridor": F.coalesce(F.col("source_country").isin(*CORRIDOR_COUNTRIES), F.lit(False)), "level": F.coalesce("level", F.lit("NONE")), "source_level": F.coalesce("source_level", F.lit("NONE"))})


def judge(context: DataFrame, ladder: Rules = LADDER, additions: Rules = ADDITIONS, review: float = 0.30) -> DataFrame:
    """(node_key, code, base, further codes, risk, severity, verdict)."""
    code, base = F.lit(None).cast("string"), F.lit(0.0)
    for cond, name, score in reversed(ladder):
        code, base = F.when(F.expr(cond), name).otherwise(code), F.when(F.expr(cond), score).otherwise(base)
    x = context.withColumn("code", code).withColumn("base", base)
    open_ = F.col("n_hops") > 0
    more = F.array_compact(F.array(*[F.when(open_ & F.expr(c), F.struct(F.lit(n).alias("code"), F.lit(d).alias("delta"))) for c, n, d in additions]))
    x = x.withColumn("more", more)
    risk = S.clamp(F.col("base") + F.aggregate("more", F.lit(0.0), lambda a, m: a + m["delta"]))
    verdict = F.when(F.col("direct"), "MATCH").when(F.round(risk, 9) >= review, "REVIEW").otherwise("NO_MATCH")
    return x.select("node_key", F.nullif("code", F.lit("")).alias("code"), "base", F.array_join(F.transform("more", lambda m: m["code"]), ",").alias("further"), F.round(risk, 4).alias("risk"), S.severity(F.abs("base")).alias("severity"), verdict.alias("verdict"))
