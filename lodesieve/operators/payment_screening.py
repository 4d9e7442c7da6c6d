"""Screening of payments by name, in stages: exact identity, exact distinctive name, recall, features, a calibrated vote (or
the blended score where there is no model), thresholds lowered by the payment's risk, and rules on dates of birth.

Distinct work is done once: string features per distinct spelling and candidate entity, the vote per spelling, country
and candidate, and only the decision per payment. All string features of a pair are computed in one pass in Arrow batches,
with an entity's variants as one array (its aliases: a bounded list).

Defined results: payments without id or of another channel than ``fiat`` aren't screened here; a blank name or one without
usable words finds nothing (NO_MATCH), unless an identity number matches; repeated deliveries of a payment are screened as
one row per distinct content; ties go to the candidate recalled first; empty lists give NO_MATCH throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..session import cut, spread
from . import index as I
from . import screening as X
from .candidates import best_candidates

#: what a model sees, in its order
FEATURES = (
    "token_sort", "token_set", "wratio", "jaro_winkler", "phonetic_agreement", "token_coverage", "rare_token_overlap", "query_rarity",
    "len_ratio", "n_query_tokens", "n_cand_tokens", "country_match", "is_person", "schema_compatible", "matched_is_primary",
)
_STRINGS = "query_norm string, entity_id string, variant_ord int, matched_name string, wratio double, token_sort double, token_set double, jaro_winkler double, phonetic_agreement double, token_coverage double, rare_token_overlap double, query_rarity double, len_ratio double, n_query_tokens int, n_cand_tokens int"
PERSON, COMPATIBLE = "Person", ("Person", "Organization", "LegalEntity", "Company")


@lru_cache(maxsize=300_000)
def _jw(a: str, b: str) -> float:
    return sim.jaro_winkler_of(a, b)


def _best(q: str, variants: list[str]) -> tuple[int, float]:
    """Place and weighted ratio of the best variant, the first on ties. A variant that can't win by its letters alone is
    passed over: no ratio is above twice the common letters over all letters of the shorter side."""
    at, best = -1, -1.0
    for i, v in enumerate(variants):
        if best > 95.0:
            short, long = (q, v) if len(q) <= len(v) else (v, q)
            common = sum(min(short.count(c), long.count(c)) for c in set(short))
            if 100.0 * common / max(1, len(short)) <= best:
                continue
        s = sim.weighted(q, v)
        if s > best + 1e-9:
            at, best = i, s
    return at, best


def string_features(pairs: DataFrame, queries: DataFrame, listed: DataFrame, default_idf: float) -> DataFrame:
    """One row per pair (query_norm, entity_id): the best variant and all features of strings.

    ``queries``: (query_norm, tokens, idf): the distinct words and their idf; ``listed``: (entity_id, variants, raws)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q, e, toks, idf, variants, raws in zip(pdf["query_norm"], pdf["entity_id"], pdf["tokens"], pdf["idf"], pdf["variants"], pdf["raws"], strict=True):
                toks, weights = list(toks), np.asarray(idf, float)
                rarity = weights.mean() / default_idf if len(toks) and default_idf else 0.0
                i, wratio = _best(q, list(variants))
                if i < 0:
                    out.append((q, e, None, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, rarity, 0.0, len(toks), 0))
                    continue
                v = variants[i]
                cand = {t for t in v.split() if len(t) > 1 and t not in text.STOP_WORDS}
                sounds, heard = {sim.phonetic_key(t) for t in toks}, {sim.phonetic_key(t) for t in cand}
                near = [max((_jw(t, c) for c in cand), default=0.0) for t in toks]
                total = weights.sum() or 1.0
                n, m = sum(1 for t in q.split() if len(t) > 1 and t not in text.STOP_WORDS), len(cand)
                out.append((
                    q, e, i, raws[i], wratio, sim.token_sort(q, v), sim.token_set(q, v), 100 * sim.jaro_winkler_of(q, v),
                    len(sounds & heard) / len(sounds) if sounds else 0.0, len(cand.intersection(toks)) / len(toks) if toks else 0.0,
                    sum(w * s for w, s in zip(weights, near, strict=True) if s >= 0.85) / total, rarity,
                    min(n, m) / max(n, m) if max(n, m) else 0.0, n, m,
                ))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _STRINGS.split(", ")]).astype({"variant_ord": "Int32"})

    pairs = cut(pairs.select("query_norm", "entity_id"))
    sides = spread(pairs.join(queries, "query_norm").join(listed.select("entity_id", "variants", "raws"), "entity_id"), pairs.count())
    return sides.select("query_norm", "entity_id", "tokens", "idf", "variants", "raws").mapInPandas(run, _STRINGS)


def listed_side(vs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, variants, raws, countries, dobs, identifiers, is_person, schema_compatible): what a pair needs of an entity."""
    # an entity's variants: its name and aliases, a bounded list
    g = vs.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("variant_ord", "variant_norm", "variant_raw"))).alias("v"))
    e = entities.select("entity_id", "countries", text.split_multi(F.col("birth_date")).alias("dobs"), "identifiers", (F.col("entity_schema") == PERSON).cast("double").alias("is_person"), F.col("entity_schema").isin(*COMPATIBLE).cast("double").alias("schema_compatible"))
    return g.select("entity_id", F.col("v.variant_norm").alias("variants"), F.col("v.variant_raw").alias("raws")).join(e, "entity_id")


def query_side(norms: DataFrame, idf: DataFrame, default_idf: float) -> DataFrame:
    """(query_norm, tokens, idf, rarity) of distinct spellings: their distinct words, idf each, and the mean share of the
    greatest idf."""
    t = norms.select("query_norm", F.posexplode(F.array_distinct(text.tokens(F.col("query_norm")))).alias("pos", "token")).join(idf.select("token", "idf"), "token", "left")
    g = t.groupBy("query_norm").agg(F.array_sort(F.collect_list(F.struct("pos", "token", F.coalesce("idf", F.lit(default_idf)).alias("idf")))).alias("t"))
    mean = F.aggregate("t.idf", F.lit(0.0), lambda a, x: a + x) / F.size("t")
    return g.select("query_norm", F.col("t.token").alias("tokens"), F.col("t.idf").alias("idf"), (mean / F.lit(default_idf)).alias("rarity"))


def exact_stage(payments: DataFrame, ids: DataFrame, names: DataFrame, queries: DataFrame, least_rarity: float = 0.6) -> DataFrame:
    """(txn_id..., stage, entity_id): payments whose passport or national id is listed (``identity``), else whose whole name
    is a listed one of rare enough words (``name``). ``payments``: (unit, query_norm, ids)."""
    given = payments.select("unit", F.posexplode("ids").alias("pos", "raw")).select("unit", "pos", text.norm_id(F.col("raw")).alias("identifier"))
    by_id = given.join(ids, "identifier").groupBy("unit").agg(F.min_by("entity_id", "pos").alias("entity_id")).select("unit", F.lit("identity").alias("stage"), "entity_id")
    rare = names.withColumnRenamed("variant_norm", "query_norm").join(queries.where(F.col("rarity") >= least_rarity).select("query_norm"), "query_norm")
    by_name = payments.select("unit", "query_norm").join(rare, "query_norm").join(by_id, "unit", "left_anti").select("unit", F.lit("name").alias("stage"), "entity_id")
    return by_id.unionByName(by_name)


def reasons(prob: Column, risk: Column, dob: Column, ident: Column, country: Column) -> Column:
    """What speaks for and against, with the figures."""
    two = lambda c: F.format_number(c, 2)
    return F.array_compact(F.array(
        F.concat(F.lit("match probability "), two(prob)),
        F.concat(F.lit("name similarity "), F.format_number("token_sort", 0), F.lit(", jaro-winkler "), F.format_number("jaro_winkler", 0)),
        F.when(F.col("rare_token_overlap") >= 0.5, F.concat(F.lit("rare words shared: "), two(F.col("rare_token_overlap")))).when(F.col("rare_token_overlap") < 0.25, F.lit("only usual words shared")),
        F.when(ident == 1, F.lit("identity number agrees")),
        F.when(dob >= 1, F.lit("date of birth agrees")).when(dob >= 0.6, F.lit("year of birth agrees")).when(dob < 0, F.lit("date of birth differs")),
        F.when(country == 1, F.lit("country agrees")).when(country == -1, F.lit("country differs")),
        F.when(F.col("schema_compatible") == 0, F.lit("unusual kind of entity for a name")),
        F.when(risk >= 0.5, F.concat(F.lit("payment risk "), two(risk), F.lit(" lowers the thresholds"))),
    ))


def prepared(payments: DataFrame) -> DataFrame:
    """Fiat payments, one row per distinct content: unit (its hash), txn_id, query_norm, country, dob, ids, risk."""
    p = payments.where("txn_id is not null and channel = 'fiat'").select("txn_id", "bene_name", "bene_country", "bene_dob", "bene_passport", "bene_national_id", "amount", "currency", "rail", "orig_country").distinct()
    ids = F.filter(F.array("bene_passport", "bene_national_id"), lambda x: F.length(text.norm_id(x)) >= 5)
    risk = X.payment_risk(F.col("amount"), F.col("currency"), F.col("rail"), F.col("orig_country"))
    p = p.select("txn_id", F.coalesce(text.norm(F.col("bene_name")), F.lit("")).alias("query_norm"), F.lower(F.trim(F.coalesce("bene_country", F.lit("")))).alias("country"), F.trim("bene_dob").alias("dob"), ids.alias("ids"), F.coalesce(risk, F.lit(0.0)).alias("risk"))
    return p.distinct().withColumn("unit", F.xxhash64(*p.columns))


def features(pairs: DataFrame, queries: DataFrame, listed: DataFrame, default_idf: float) -> DataFrame:
    """All features of (query_norm, country, entity_id, rank): strings once per spelling and entity, country per pair."""
    strings = string_features(pairs.select("query_norm", "entity_id").distinct(), queries.select("query_norm", "tokens", "idf"), listed, default_idf)
    f = pairs.join(strings, ["query_norm", "entity_id"]).join(listed.select("entity_id", "countries", "is_person", "schema_compatible"), "entity_id")
    return f.withColumns({
        "country_match": X.country_agreement(F.col("country"), F.col("countries")).cast("double"), "matched_is_primary": F.coalesce((F.col("variant_ord") == 0).cast("double"), F.lit(0.0)),
        "raw": (0.55 * F.col("token_sort") + 0.45 * F.col("wratio")) / 100, "n_query_tokens": F.col("n_query_tokens").cast("double"), "n_cand_tokens": F.col("n_cand_tokens").cast("double"),
    }).drop("countries")


def screen(payments: DataFrame, entities: DataFrame, vote: Callable[[DataFrame], DataFrame] | None = None, high: float = 0.92, low: float = 0.80, top: int = 150) -> DataFrame:
    """(txn_id, verdict, status, stage, score, raw, entity_id, matched_name, risk, reasons) per distinct fiat payment.

    ``vote`` adds a column ``prob`` to rows of features; without it the blended score decides, and the thresholds are those
    of the blended score. Where the score can be had from arrays (``vote.arrays``, or the blended one), only candidates that
    may be the best get rows."""
    import math

    pays = cut(prepared(payments))
    vs = cut(I.variants(entities))
    n = max(1, vs.select("entity_id").distinct().count())
    default = math.log1p(n)
    idf = cut(I.token_idf(vs, n))
    listed = cut(listed_side(vs, entities))
    norms = pays.select("query_norm").where("query_norm <> ''").distinct()
    queries = cut(query_side(norms, idf, default))
    exact = cut(exact_stage(pays, I.identifiers(entities), I.exact_names(vs, entities.select("entity_id", "ord")), queries))
    open_ = pays.join(exact.select("unit"), "unit", "left_anti")
    asked = open_.select("query_norm", "country").where("query_norm <> ''").distinct()
    judge = getattr(vote, "arrays", None)
    if vote is None or judge is not None:
        pairs = best_candidates(asked, queries, vs, listed, default, top, judge)
    else:  # a vote that takes rows alone sees every candidate
        hits = I.recall(asked.select(F.col("query_norm").alias("query_id"), F.col("query_norm").alias("query")).distinct(), I.postings(vs, sim.phonetic("token")), idf, default, top, sim.phonetic("token"))
        pairs = asked.join(hits.select(F.col("query_id").alias("query_norm"), "entity_id", "rank"), "query_norm")
    f = features(cut(pairs), queries, listed, default)
    f = vote(cut(f)) if vote is not None else f.withColumn("prob", F.col("raw"))
    keep = ("entity_id", "matched_name", "prob", "raw", "rank", "token_sort", "jaro_winkler", "rare_token_overlap", "country_match", "schema_compatible")
    best = f.groupBy("query_norm", "country").agg(F.max_by(F.struct(*keep), F.struct(F.round("prob", 9), -F.col("rank"))).alias("b")).select("query_norm", "country", "b.*")
    known = listed.select("entity_id", "dobs", "identifiers")
    rows = open_.join(best, ["query_norm", "country"], "left").join(known, "entity_id", "left")
    dob, ident = X.dob_agreement(F.col("dob"), F.col("dobs")), X.id_agreement(F.col("ids"), F.col("identifiers"))
    hi, lo = X.shifted(F.lit(high), F.col("risk")), X.shifted(F.lit(low), F.col("risk"))
    base = F.when(F.col("prob") >= hi, "MATCH").when(F.col("prob") >= lo, "REVIEW").otherwise("NO_MATCH")
    # the same date of birth promotes a review, a contradicting one demotes a match
    verdict = F.when((base == "REVIEW") & (dob >= 1), "MATCH").when((base == "MATCH") & (dob < 0), "REVIEW").otherwise(base)
    found = F.col("verdict") != "NO_MATCH"
    why = F.when(F.col("prob").isNull(), F.array(F.lit("no candidates"))).otherwise(reasons(F.col("prob"), F.col("risk"), dob, ident, F.col("country_match")))
    decided = rows.withColumn("verdict", verdict).withColumn("reasons", why).select(
        "txn_id", "verdict", F.when(F.col("prob").isNull(), "none").otherwise("model" if vote is not None else "fallback").alias("stage"), F.coalesce("prob", F.lit(0.0)).alias("score"), F.coalesce("raw", F.lit(0.0)).alias("raw"),
        F.when(found, F.col("entity_id")).alias("entity_id"), F.when(found, F.col("matched_name")).alias("matched_name"), "risk", "reasons",
    )
    text_of = F.when(F.col("stage") == "identity", F.lit("identity number of a listed entity")).otherwise(F.lit("whole name of a listed entity, of rare words"))
    sure = pays.join(exact, "unit").join(entities.select("entity_id", F.col("name").alias("matched_name")), "entity_id")
    sure = sure.select("txn_id", F.lit("MATCH").alias("verdict"), "stage", F.lit(1.0).alias("score"), F.lit(1.0).alias("raw"), "entity_id", "matched_name", "risk", F.array(text_of).alias("reasons"))
    out = decided.unionByName(sure)
    return out.withColumn("status", F.element_at(F.create_map(*[F.lit(x) for kv in X.STATUS.items() for x in kv]), F.col("verdict")))
