"""Graph scoring as column arithmetic. Every date is compared with an explicit ``as_of``; step tables are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: step tables (least value, weight) and weights by name
AMOUNT_STEPS = ((50_000, 1.0), (10_000, 0.8), (1_000, 0.5), (100, 0.2))
SHARE_STEPS = ((0.75, 1.0), (0.50, 0.8), (0.25, 0.5), (0.10, 0.2))
AGE_STEPS = ((7, 1.0), (30, 0.8), (180, 0.4))
RELATION = {"OWNS": 1.0, "USES_ACCOUNT": 0.9, "SENT_TO": 0.6, "RECEIVED_FROM": 0.6, "SHARED_IDENTIFIER": 0.4}
SOURCE_RISK = {"SANCTIONED": 1.0, "SUSPICIOUS": 0.7}
HOPS = {0: 1.0, 1: 0.7, 2: 0.4, 3: 0.2}
# (type, forward, reverse, override forward, override reverse, flow forward, flow reverse, multiplier forward, reverse)
DIRECTIONS = (
    ("SENT_TO", True, True, True, True, "inbound_from_anchor", "outbound_to_anchor", 0.85, 1.05),
    ("RECEIVED_FROM", True, True, True, True, "inbound_from_anchor", "outbound_to_anchor", 0.85, 1.05),
    ("USES_ACCOUNT", True, False, True, False, "relationship", "relationship", 0.95, 0.0),
    ("OWNS", True, False, True, False, "relationship", "relationship", 1.0, 0.0),
    ("SHARED_IDENTIFIER", True, True, False, False, "shared_intermediary", "shared_intermediary", 0.30, 0.30),
)
OTHER_DIRECTION = (True, False, False, False, "relationship", "relationship", 0.80, 0.0)


def steps(c: Column, table: Sequence[tuple[float, float]], otherwise: float) -> Column:
    """First weight whose bound the value reaches."""
    out = F.lit(otherwise)
    for bound, w in reversed(table):
        out = F.when(c >= bound, w).otherwise(out)
    return out


def lookup(c: Column, table: dict, otherwise: float) -> Column:
    out = F.lit(otherwise)
    for k, w in table.items():
        out = F.when(c == k, w).otherwise(out)
    return out


def source_risk(level: Column) -> Column:
    return lookup(F.upper(level), SOURCE_RISK, 0.0)


def relation_weight(kind: Column) -> Column:
    return lookup(F.upper(kind), RELATION, 0.2)


def amount_weight(amount: Column) -> Column:
    return steps(F.coalesce(amount.cast("double"), F.lit(0.0)), AMOUNT_STEPS, 0.05)


def concentration_score(share: Column) -> Column:
    return steps(F.coalesce(share, F.lit(0.0)), SHARE_STEPS, 0.05)


def time_decay(last_seen: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0), F.datediff(as_of, last_seen))
    out = F.lit(0.1)
    for days, w in reversed(AGE_STEPS):
        out = F.when(age <= days, w).otherwise(out)
    return F.when(last_seen.isNull(), 0.1).otherwise(out)


def hop_decay(depth: Column) -> Column:
    return lookup(depth, HOPS, 0.1)


def flow_materiality(kind: Column, amount: Column, share: Column) -> Column:
    return F.when(F.upper(kind).isin("OWNS", "USES_ACCOUNT", "SHARED_IDENTIFIER"), 1.0).otherwise(0.7 * amount_weight(amount) + 0.3 * concentration_score(share))


def edge_score(kind: Column, amount: Column, share: Column, last_seen: Column, confidence: Column, as_of: Column) -> Column:
    """A confidence of 0 counts as 1, as null does."""
    return relation_weight(kind) * flow_materiality(kind, amount, share) * time_decay(last_seen, as_of) * F.coalesce(F.nullif(confidence.cast("double"), F.lit(0.0)), F.lit(1.0))


def weak_edge(kind: Column, amount: Column, share: Column, last_seen: Column, as_of: Column) -> Column:
    small = (F.upper(kind) == "SENT_TO") & (F.coalesce(amount.cast("double"), F.lit(0.0)) < 100)
    return small | (time_decay(last_seen, as_of) == 0.1) & (flow_materiality(kind, amount, share) <= 0.2)


def severity(c: Column) -> Column:
    return F.when(c >= 0.9, "CRITICAL").when(c >= 0.55, "HIGH").when(c >= 0.3, "MEDIUM").otherwise("LOW")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
