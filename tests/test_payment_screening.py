"""Stages of payment screening on a small list, with worked values of the features."""

import math

import pytest
from pyspark.sql import functions as F

from lodesieve.functions import similarity as sim
from lodesieve.operators import payment_screening as P

ENTITY = "entity_id string, ord long, entity_schema string, name string, aliases array<string>, birth_date string, countries array<string>, identifiers array<string>"
PAY = "txn_id string, channel string, bene_name string, bene_country string, bene_dob string, bene_passport string, bene_national_id string, amount double, currency string, rail string, orig_country string, verdict string"


def listed(spark):
    rows = [
        ("e1", 1, "Person", "Joseph Peameatberg", ["Jo Peameatberg", "Vullalino Rafael"], "1970-01-02;1971", ["ru"], ["P-123 456"]),
        ("e2", 2, "Person", "Joseph Miller", None, "1980-05-05", ["us"], None),
        ("e3", 3, "Vessel", "Joseph Conrad", None, None, None, ["X1"]),
        *[(f"c{i}", 10 + i, "Person", f"Joseph Number{chr(97 + i)}", None, None, None, None) for i in range(9)],
    ]
    return spark.createDataFrame(rows, ENTITY)


def pay(txn, name, country=None, dob=None, passport=None, national=None, amount=10.0, rail="card", channel="fiat"):
    return (txn, channel, name, country, dob, passport, national, amount, "USD", rail, "us", "clash")


def screened(spark, *rows, **kw):
    out = P.screen(spark.createDataFrame(list(rows), PAY), listed(spark), **kw).collect()
    return {r.txn_id: r for r in out}


def test_stages(spark):
    got = screened(
        spark, pay("id", "Somebody Else", national="p123456"), pay("exact", "Jo Peameatberg"), pay("exact", "Jo Peameatberg"), pay("slip", "Joseph Peameatbergg"), pay("dob", "Joseph Peameatbergg", dob="1970-01-02"), pay("other", "Joseph Peameatbergg", dob="1999-01-01"),
        pay("none", "Zzyzx Qwrtp"), pay("blank", " "), pay("null", None), pay("coin", "Joseph Peameatberg", channel="crypto"), pay("short", "Joseph Miller", passport="X1"), (None, "fiat", "Joseph Peameatberg", *[None] * 8, "x"),
    )
    assert set(got) == {"id", "exact", "slip", "dob", "other", "none", "blank", "null", "short"}
    assert (got["id"].stage, got["id"].entity_id, got["id"].verdict, got["id"].status) == ("identity", "e1", "MATCH", "blocked")
    assert (got["exact"].stage, got["exact"].entity_id, got["exact"].verdict) == ("name", "e1", "MATCH")
    assert got["slip"].verdict == got["dob"].verdict == "MATCH" and got["slip"].stage == "fallback"
    assert got["other"].verdict == "REVIEW" and "date of birth differs" in got["other"].reasons and "date of birth agrees" in got["dob"].reasons
    for t in ("none", "blank", "null"):
        assert (got[t].verdict, got[t].status, got[t].stage, got[t].entity_id, got[t].score) == ("NO_MATCH", "allowed", "none", None, 0.0)


def test_risk_lowers_the_thresholds(spark):
    name = "Josif Peamettburg"
    calm, risky = (screened(spark, pay("t", name, amount=a, rail=r))["t"] for a, r in ((10.0, "card"), (900_000.0, "SWIFT")))
    assert calm.score == risky.score and risky.risk > calm.risk and calm.verdict == "NO_MATCH" and risky.verdict == "REVIEW"


def test_features_have_their_worked_values(spark):
    e = listed(spark)
    vs = P.I.variants(e)
    n = 12
    idf = P.I.token_idf(vs, n)
    q = P.query_side(spark.createDataFrame([("joseph peameatborg",)], "query_norm string"), idf, math.log1p(n))
    pairs = spark.createDataFrame([("joseph peameatborg", "ru", "e1", 1), ("joseph peameatborg", "ru", "e3", 2)], "query_norm string, country string, entity_id string, rank int")
    f = {r.entity_id: r for r in P.features(pairs, q, P.listed_side(vs, e), math.log1p(n)).collect()}
    a = f["e1"]
    idf_joseph, idf_new = math.log1p(n / 12), math.log1p(n)
    jw = sim.jaro_winkler_of("peameatborg", "peameatberg")
    assert a.variant_ord == 0 and a.matched_is_primary == 1 and a.is_person == 1 and a.country_match == 1
    assert a.rare_token_overlap == pytest.approx((idf_joseph * 1 + idf_new * jw) / (idf_joseph + idf_new))
    assert a.query_rarity == pytest.approx((idf_joseph + idf_new) / 2 / math.log1p(n)) and a.token_coverage == 0.5 and a.phonetic_agreement == 1.0
    assert (a.len_ratio, a.n_query_tokens, a.n_cand_tokens) == (1.0, 2, 2)
    assert f["e3"].schema_compatible == 0 and f["e3"].is_person == 0 and f["e3"].country_match == 0


def test_empty_lists_and_payments(spark):
    none = listed(spark).limit(0)
    p = spark.createDataFrame([pay("t", "Joseph Peameatberg")], PAY)
    assert [(r.txn_id, r.verdict) for r in P.screen(p, none).collect()] == [("t", "NO_MATCH")]
    assert P.screen(p.limit(0), listed(spark)).count() == 0


def test_a_vote_decides_instead_of_the_blended_score(spark):
    got = screened(spark, pay("t", "Joseph Peameatbergg"), vote=lambda f: f.withColumn("prob", F.when(F.col("entity_id") == "e2", 0.9).otherwise(0.1)), high=0.8, low=0.5)["t"]
    assert (got.entity_id, got.verdict, got.stage) == ("e2", "MATCH", "model")
