"""Registered queries of the model operators. Sampling and fitting have no SQL; they are tested for what must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import candidates as C
from ..operators import index as I
from ..operators import ml as L
from ..operators import metrics as M
from ..operators import payment_screening as P
from ..session import cut, table
from .screening_queries import _persons


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _persons(spark, sf_dir).select("entity_id", text.norm(F.col("name")).alias("name")).where("name <> ''")


def entity_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("entity_id", L.split_of("entity_id").alias("part"))


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import math

    names = cut(_names(spark, sf_dir))
    vs = cut(I.variants(names.withColumn("aliases", F.array().cast("array<string>"))))
    n = max(1, names.count())
    hits = cut(I.recall(names.select(F.col("entity_id").alias("query_id"), F.col("name").alias("query")), I.postings(vs), I.token_idf(vs, n), math.log1p(n), 2))
    return L.training_pairs(names, hits)


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs scored by two calibrated models and their vote; three parts of the entities to fit, one to calibrate."""
    rows = cut(L.with_features(training_pairs(spark, sf_dir)).withColumn("part", L.split_of("entity_id")))
    out = rows
    for kind in ("logistic", "trees"):
        out = L.scores(L.fit(rows.where("part > 0"), kind), out, kind)
    out = cut(out)
    for kind in ("logistic", "trees"):
        out = L.calibrator(out.where("part = 0"), kind).transform(out)
    out = L.soft_vote(out, ["logistic_calibrated", "trees_calibrated"])
    return out.select("entity_id", "query", "candidate", "label", *[F.round(c, 6).alias(c) for c in ("logistic", "trees", "prob")])


def model_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cut(model_scores(spark, sf_dir))
    rows = s.select("prob", (F.col("label") == 1).alias("listed"), F.when(F.col("prob") >= 0.5, "MATCH").otherwise("NO_MATCH").alias("verdict"))
    return M.screening_metrics(rows).crossJoin(M.choose_thresholds(M.precision_recall(rows)))  # two single rows


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs with all features; part 0 calibrates, by a hash of the owner (or of the spelling, where there is none)."""
    import math

    e = _persons(spark, sf_dir)
    vs = cut(I.variants(e))
    n = max(1, vs.select("entity_id").distinct().count())
    default, idf = math.log1p(n), cut(I.token_idf(vs, n))
    q = cut(L.training_queries(vs, e, idf))
    side = cut(P.query_side(q.select("query_norm").distinct(), idf, default))
    pairs = L.labelled(q, C.recalled(side, vs, default, 8))
    return cut(P.features(cut(pairs), side, P.listed_side(vs, e), default).withColumn("unit", F.coalesce("owner", "query_norm")).withColumn("part", L.split_of("unit")))


def model_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many training pairs there are of each kind, how many of them positive, and their mean similarity."""
    r = _training_rows(spark, sf_dir)
    return r.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("token_sort"), 2).alias("token_sort"), F.round(F.avg("rare_token_overlap"), 4).alias("rare_token_overlap"))


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member to use on its own: thresholds of each from one half of the held-out pairs, metrics from the other."""
    rows = _training_rows(spark, sf_dir)
    members = L.fit_members(rows, P.FEATURES)
    out = None
    for name in members:
        held = cut(L.vote_with({name: members[name]})(rows.where("part = 0")).select("unit", "prob", (F.col("label") == 1).alias("listed")))
        tune = F.pmod(F.xxhash64("unit", F.lit("tune")), F.lit(2)) == 0
        t = M.choose_thresholds(M.precision_recall(held.where(tune))).first()
        verdict = F.when(F.col("prob") >= t.tau_high, "MATCH").when(F.col("prob") >= t.tau_low, "REVIEW").otherwise("NO_MATCH")
        m = M.screening_metrics(held.where(~tune).select(verdict.alias("verdict"), "listed")).select(F.lit(name).alias("name"), F.lit(t.tau_high).alias("tau_high"), F.lit(t.tau_low).alias("tau_low"), "*")
        out = m if out is None else out.unionByName(m)
    return M.choose_member(out)


def screen_payments_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments through all stages with the calibrated vote of three models. Thresholds come from the held-out pairs: the
    precision aimed at, the recall aimed at and the review budget."""
    rows = _training_rows(spark, sf_dir)
    vote = L.vote_with(L.fit_members(rows, P.FEATURES))
    held = cut(vote(rows.where("part = 0")).select("prob", (F.col("label") == 1).alias("listed")))
    t = M.choose_thresholds(M.precision_recall(held)).first()
    r = P.screen(table(spark, sf_dir, "txn_event"), _persons(spark, sf_dir), vote, high=t.tau_high, low=t.tau_low)
    return r.select("txn_id", "verdict", "status", "stage", F.round("score", 4).alias("score"), "entity_id", "risk")


def queries() -> dict:
    return {f.__name__: f for f in (entity_split, training_pairs, model_scores, model_quality, model_training, model_choice, screen_payments_model)}


def oracle_sql() -> dict[str, str]:
    return {}
