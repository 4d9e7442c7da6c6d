"""Screening of payments: agreement of attributes, pair features, risk, thresholds, verdicts.

Weights and cut-offs are parameters with the usual values as defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import clamp, lookup

# fixed values: weights of payment risk
RAIL_RISK = {"crypto": 0.85, "SWIFT": 0.70, "FedWire": 0.60, "ACH": 0.30, "FPS": 0.25, "SEPA": 0.20, "card": 0.15}
RISK_COUNTRIES = ("ir", "kp", "sy", "af", "ru", "by", "mm", "cu", "ve")
RISK_CURRENCIES = ("RUB", "IRR", "KPW")
SEVERITY = {"NO_MATCH": 0, "REVIEW": 1, "MATCH": 2}
STATUS = {"MATCH": "blocked", "REVIEW": "review", "NO_MATCH": "allowed"}


def country_agreement(asked: Column, known: Column) -> Column:
    """1 if the country is among the known ones, -1 if it isn't, 0 if either side is unknown."""
    q = F.lower(F.trim(asked))
    codes = F.transform(F.coalesce(known, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.when(q.isNull() | (q == "") | (F.size(codes) == 0), 0).when(F.array_contains(codes, q), 1).otherwise(-1)


def dob_agreement(asked: Column, known: Column) -> Column:
    """1 for the same date, .6 for the same year, 0 if unknown, -1 else. ``known``: dates as texts."""
    q = F.trim(asked)
    ds = F.filter(F.coalesce(known, F.array().cast("array<string>")), lambda d: F.length(d) >= 4)
    same = F.exists(ds, lambda d: d == q)
    year = F.exists(ds, lambda d: F.substring(d, 1, 4) == F.substring(q, 1, 4))
    return F.when(q.isNull() | (F.length(q) < 4) | (F.size(ds) == 0), 0.0).when(same, 1.0).when(year, 0.6).otherwise(-1.0)


def id_agreement(asked: Column, known: Column) -> Column:
    """1 if an identifier is the same once letters and digits alone are compared, else 0."""
    plain = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: text.norm_id(x)), lambda x: x != "")
    return F.coalesce(F.arrays_overlap(plain(asked), plain(known)), F.lit(False)).cast("int")


def amount_risk(amount: Column) -> Column:
    return F.when(amount > 0, clamp((F.log10(amount) - 3) / 3)).otherwise(0.0)


def payment_risk(amount: Column, currency: Column, rail: Column, country: Column) -> Column:
    """.35 amount, .30 rail, .25 country, .10 currency; three places."""
    c = F.when(F.lower(country).isin(*RISK_COUNTRIES), 0.85).otherwise(0.10)
    m = F.when(F.upper(currency).isin(*RISK_CURRENCIES), 0.70).otherwise(0.10)
    return F.round(F.least(F.lit(1.0), 0.35 * amount_risk(amount) + 0.30 * lookup(rail, RAIL_RISK, 0.30) + 0.25 * c + 0.10 * m), 3)


def risk_factors(amount: Column, currency: Column, rail: Column, country: Column) -> Column:
    return F.array_compact(F.array(F.when(amount_risk(amount) >= 0.5, "amount"), F.when(lookup(rail, RAIL_RISK, 0.30) >= 0.6, "rail"), F.when(F.lower(country).isin(*RISK_COUNTRIES), "country"), F.when(F.upper(currency).isin(*RISK_CURRENCIES), "currency")))


def shifted(threshold: Column, risk: Column, most: float = 0.15) -> Column:
    """A threshold lowered by the risk, at most by ``most``, never below 0."""
    return F.greatest(F.lit(0.0), threshold - most * clamp(F.coalesce(risk, F.lit(0.0))))


def fallback_verdict(scored: DataFrame, high: float = 0.92, low: float = 0.80) -> DataFrame:
    """(query_id, entity_id, score, verdict): the best candidate per query by blended score against risk-shifted
    thresholds. ``scored``: (query_id, entity_id, score 0..1, rank, risk, dob)."""
    w = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rank")
    top = scored.withColumn("n", F.row_number().over(w)).where("n = 1")
    hi, lo = shifted(F.lit(high), F.col("risk")), shifted(F.lit(low), F.col("risk"))
    base = F.when(F.col("score") >= hi, "MATCH").when(F.col("score") >= lo, "REVIEW").otherwise("NO_MATCH")
    # the same date of birth promotes a review, a contradicting one demotes a match
    verdict = F.when((base == "REVIEW") & (F.col("dob") == 1.0), "MATCH").when((base == "MATCH") & (F.col("dob") == -1.0), "REVIEW").otherwise(base)
    return top.select("query_id", "entity_id", "score", verdict.alias("verdict"))


def wallet_verdict(payments: DataFrame, wallets: DataFrame, exposure: DataFrame, review: float = 0.08) -> DataFrame:
    """(txn_id, verdict): a listed wallet or a direct hit matches, exposure from ``review`` on is reviewed."""
    p = payments.select("txn_id", F.lower(F.trim("wallet")).alias("wallet"), F.trim("wallet").alias("node_key")).where("wallet <> ''")
    j = p.join(wallets, "wallet", "left").join(exposure.select("node_key", F.col("exposure_score").cast("double").alias("score"), "best_depth"), "node_key", "left")
    verdict = F.when(F.col("entity_id").isNotNull() | (F.col("best_depth") == 0), "MATCH").when(F.col("score") >= review, "REVIEW").otherwise("NO_MATCH")
    return j.select("txn_id", "wallet", "entity_id", F.col("score"), verdict.alias("verdict"))


def combine(results: DataFrame) -> DataFrame:
    """(txn_id, verdict, status, reasons): worst of the applicable module results, reasons prefixed by their module.

    ``results``: (txn_id, module, verdict, applicable, reasons). Without an applicable one the payment is allowed."""
    rank = F.when(F.col("applicable"), lookup(F.col("verdict"), SEVERITY, 0)).otherwise(0)
    tagged = F.when(F.col("applicable"), F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: F.concat(F.lit("["), F.col("module"), F.lit("] "), r))).otherwise(F.array().cast("array<string>"))
    # a payment has one result per module: the collected list is as short
    g = results.groupBy("txn_id").agg(F.max(rank).alias("rank"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("module", tagged.alias("r")))), lambda x: x["r"])).alias("reasons"))
    verdict = F.when(F.col("rank") == 2, "MATCH").when(F.col("rank") == 1, "REVIEW").otherwise("NO_MATCH")
    return g.select("txn_id", verdict.alias("verdict"), lookup(verdict, STATUS, "allowed").alias("status"), "reasons")
