"""Registered queries of text functions, the name index, recall, pair features and screening, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..operators import index as I
from ..operators import payment_screening as P
from ..operators import screening as X
from ..session import cut, table


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed entities, the latest row of each key: (entity_id, ord, entity_schema, name, aliases, ...)."""
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null and name is not null")
    cols = ("id", "entity_schema", "name", "aliases", "birth_date", "countries", "identifiers", "sanctions")
    e = t.groupBy("entity_id").agg(F.max_by(F.struct(*cols), F.struct("created_at", "id")).alias("r")).select("entity_id", "r.*")
    return e.withColumnRenamed("id", "ord").withColumn("name", F.trim("name"))


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).where("entity_schema <> 'CryptoWallet'")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.variants(_persons(spark, sf_dir))


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "txn_event").select("bene_name").distinct().select("bene_name", text.norm(F.col("bene_name")).alias("norm"))


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "txn_event").select("bene_name").distinct().select("bene_name", F.array_join(text.tokens(F.col("bene_name")), " ").alias("tokens"))


def norm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "opensanctions_target").select(F.explode("identifiers").alias("identifier")).distinct()
    return x.select("identifier", text.norm_id(F.col("identifier")).alias("norm_id"))


def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "txn_event")
    return t.select("txn_id", text.clean(F.col("bene_dob")).alias("bene_dob"), text.clean(F.col("bene_passport")).alias("bene_passport"), text.clean(F.col("bene_country")).alias("bene_country"), F.regexp_extract("bene_dob", "^([0-9]{4})", 1).try_cast("int").alias("dob_year")).distinct()


def multi_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "opensanctions_target").select("birth_date").distinct()
    return x.select("birth_date", F.size(text.split_multi(F.col("birth_date"))).alias("n_parts"), F.try_element_at(text.split_multi(F.col("birth_date")), F.lit(1)).alias("first_part"))


def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element names without namespace, the first text of several, what follows a dash, and a search over fields put together."""
    t = table(spark, sf_dir, "txn_event").select("txn_id", "channel", "currency", "rail", "bene_dob", "bene_name").distinct()
    tag = F.concat(F.lit("{urn:x}pay:"), F.coalesce("rail", F.lit("")))
    return t.select(
        "txn_id", text.localname(tag).alias("tag"), text.first_text(F.col("bene_name"), F.col("rail"), F.col("currency")).alias("first"), text.after_dash(F.col("bene_dob")).alias("after_dash"),
        text.contains_any("PA", "bene_name", "rail").alias("found"), text.to_int(F.substring("bene_dob", 1, 4)).alias("number"),
    ).distinct()


def latest_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("entity_id", "ord", "entity_schema", "name", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("n_aliases"))


def variant_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).select("entity_id", "variant_ord", "variant_norm", "is_primary")


def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.token_df(_variants(spark, sf_dir))


def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    vs = _variants(spark, sf_dir)
    n = _persons(spark, sf_dir).count()
    return I.token_idf(vs, n).withColumn("idf", F.round("idf", 6))


def exact_name_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.exact_names(_variants(spark, sf_dir), _persons(spark, sf_dir).select("entity_id", "ord"))


def identifier_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.identifiers(entities(spark, sf_dir))


def wallet_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.wallets(entities(spark, sf_dir))


def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _variants(spark, sf_dir).agg(F.count_distinct("entity_id").alias("n_entities"), F.count(F.lit(1)).alias("n_variants"))


def phonetic_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.postings(_variants(spark, sf_dir), sim.phonetic("token"))


def _recall_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    import math

    vs = cut(_variants(spark, sf_dir))
    n = max(1, vs.select("entity_id").distinct().count())
    q = table(spark, sf_dir, "un_entity").where("un_id is not null and name is not null").groupBy(F.col("un_id").alias("query_id")).agg(F.max_by(F.trim("name"), F.struct("created_at", "id")).alias("query"))
    return q, vs, cut(I.token_idf(vs, n)), math.log1p(n)


def recall_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 150 best entities for every name of the other list, by shared tokens."""
    q, vs, idf, default = _recall_parts(spark, sf_dir)
    return I.recall(q, I.postings(vs), idf, default, 150).withColumn("mass", F.round("mass", 4))


def recall_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, vs, idf, default = _recall_parts(spark, sf_dir)
    return I.recall(q, I.postings(vs, sim.phonetic("token")), idf, default, 150, sim.phonetic("token")).withColumn("mass", F.round("mass", 4))


def _pairs(spark: SparkSession, sf_dir: str, top: int = 150) -> tuple[DataFrame, DataFrame, DataFrame, float, DataFrame]:
    q, vs, idf, default = _recall_parts(spark, sf_dir)
    hits = cut(I.recall(q, I.postings(vs), idf, default, top))
    p = hits.join(q, "query_id").select("query_id", text.norm(F.col("query")).alias("query_norm"), "entity_id", "rank")
    return p, vs, idf, default, q


def _string_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recalled pairs (query_id, entity_id, rank) with the best variant and all string features."""
    p, vs, idf, default, _ = _pairs(spark, sf_dir)
    p, listed = cut(p), cut(P.listed_side(vs, _persons(spark, sf_dir)))
    f = P.string_features(p.select("query_norm", "entity_id").distinct(), P.query_side(p.select("query_norm").distinct(), idf, default), listed, default)
    return p.join(f, ["query_norm", "entity_id"]).join(listed.select("entity_id", "variants"), "entity_id").withColumn("variant_norm", F.get("variants", "variant_ord")).drop("variants")


def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _string_pairs(spark, sf_dir).select("query_id", "entity_id", "variant_ord", "variant_norm", F.round("wratio", 4).alias("wratio"))


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string features of every recalled pair."""
    scores = ("wratio", "token_sort", "token_set", "jaro_winkler", "phonetic_agreement", "token_coverage", "rare_token_overlap", "query_rarity", "len_ratio")
    return _string_pairs(spark, sf_dir).select("query_id", "entity_id", "variant_norm", (F.col("variant_ord") == 0).alias("is_primary"), *[F.round(c, 4).alias(c) for c in scores], "n_query_tokens", "n_cand_tokens")


def jaro_winkler_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of recalled pairs by Jaro-Winkler: the 20 best entities of a query, as its SQL defines it."""
    p, vs, *_ = _pairs(spark, sf_dir, 20)
    v = vs.where("is_primary").select("entity_id", "variant_norm")
    return p.join(v, "entity_id").select("query_id", "entity_id", F.round(sim.jaro_winkler("query_norm", "variant_norm"), 4).alias("jw"))


def token_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, vs, *_ = _pairs(spark, sf_dir)
    j = p.join(vs.where("is_primary").select("entity_id", "variant_norm"), "entity_id")
    a, b = "query_norm", "variant_norm"
    return j.select("query_id", "entity_id", F.round(sim.ratio(a, b), 4).alias("ratio"), F.round(sim.token_sort_ratio(a, b), 4).alias("token_sort"), F.round(sim.token_set_ratio(a, b), 4).alias("token_set"), F.round(sim.partial_ratio(a, b), 4).alias("partial"), F.round(sim.weighted_ratio(a, b), 4).alias("weighted"))


def stated_births(comments: Column) -> Column:
    """Dates and years of birth that a comment tells, as texts; an estimate covers its neighbours, a span its inner years."""
    c = F.coalesce(comments, F.lit(""))
    dates = F.regexp_extract_all(c, F.lit(r"((?:19|20)\d\d-\d\d-\d\d)"), 1)
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)((?:19|20)\d\d)(?!\d)"), 1), lambda y: y.cast("int"))
    span = F.sequence(F.array_min(years), F.array_max(years))
    years = F.when(F.size(years) == 0, years).when(c.rlike("(?i)circa|approx|about"), F.flatten(F.transform(years, lambda y: F.array(y - 1, y, y + 1)))).when(c.rlike("(?i)between"), span).otherwise(years)
    return F.when(c.rlike("(?i)born|birth|dob"), F.concat(dates, F.transform(years, lambda y: y.cast("string")))).otherwise(F.array().cast("array<string>"))


def fallback_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the other list screened without a model: best blended score against the thresholds. A name of a list is
    no payment, so its risk is 0; dates of birth are those of the entity against those that the comments tell."""
    s = _string_pairs(spark, sf_dir).withColumn("score", (0.55 * F.col("token_sort") + 0.45 * F.col("wratio")) / 100).withColumn("risk", F.lit(0.0))
    said = table(spark, sf_dir, "un_entity").where("un_id is not null and name is not null").groupBy(F.col("un_id").alias("query_id")).agg(F.max_by(F.struct("comments"), F.struct("created_at", "id")).alias("r")).select("query_id", stated_births(F.col("r.comments")).alias("asked"))
    born = entities(spark, sf_dir).select("entity_id", text.split_multi(F.col("birth_date")).alias("dobs"))
    s = s.join(said, "query_id", "left").join(born, "entity_id", "left")
    s = s.withColumn("dob", F.coalesce(F.array_max(F.transform("asked", lambda a: X.dob_agreement(a, F.col("dobs")))), F.lit(0.0)))
    return X.fallback_verdict(s).withColumn("score", F.round("score", 4))


def screen_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiat payments through all stages, by the blended score: the reference's behaviour without a trained model."""
    return P.screen(table(spark, sf_dir, "txn_event"), _persons(spark, sf_dir)).select("txn_id", "verdict", "status", "stage", F.round("score", 4).alias("score"), "entity_id", "matched_name", "risk", F.array_join("reasons", "; ").alias("reasons"))


def payment_exact_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments decided before any model: a listed identity number, or a listed name of rare words."""
    import math

    e = _persons(spark, sf_dir)
    vs = cut(I.variants(e))
    n = max(1, vs.select("entity_id").distinct().count())
    pays = cut(P.prepared(table(spark, sf_dir, "txn_event")))
    q = P.query_side(pays.select("query_norm").where("query_norm <> ''").distinct(), I.token_idf(vs, n), math.log1p(n))
    exact = P.exact_stage(pays, I.identifiers(e), I.exact_names(vs, e.select("entity_id", "ord")), q)
    return pays.join(exact, "unit").select("txn_id", "stage", "entity_id").distinct()


def query_rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rare the words of every typed name are among the listed names: 1 if no list has them."""
    import math

    vs = cut(_variants(spark, sf_dir))
    n = max(1, vs.select("entity_id").distinct().count())
    norms = P.prepared(table(spark, sf_dir, "txn_event")).select("query_norm").where("query_norm <> ''").distinct()
    return P.query_side(norms, I.token_idf(vs, n), math.log1p(n)).select("query_norm", F.round("rarity", 6).alias("rarity"), F.size("tokens").alias("n_tokens"))


def payment_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "txn_event").where("txn_id is not null")
    return t.select("txn_id", X.payment_risk(F.col("amount"), F.col("currency"), F.col("rail"), F.col("orig_country")).alias("risk"), F.array_join(X.risk_factors(F.col("amount"), F.col("currency"), F.col("rail"), F.col("orig_country")), ",").alias("factors")).distinct()


def risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = payment_risk(spark, sf_dir).select("risk").distinct()
    return r.select("risk", F.round(X.shifted(F.lit(0.92), F.col("risk")), 6).alias("tau_high"), F.round(X.shifted(F.lit(0.80), F.col("risk")), 6).alias("tau_low"))


def _exact_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn_id, ..., entity_id) of payments whose normalised name is a listed one."""
    t = table(spark, sf_dir, "txn_event").where("txn_id is not null and bene_name <> ''").select("txn_id", "bene_country", "bene_dob", "bene_passport", "bene_national_id", text.norm(F.col("bene_name")).alias("variant_norm")).distinct()
    names = I.exact_names(_variants(spark, sf_dir), _persons(spark, sf_dir).select("entity_id", "ord"))
    e = entities(spark, sf_dir).select("entity_id", "countries", text.split_multi(F.col("birth_date")).alias("dobs"), "identifiers")
    return t.join(names, "variant_norm").join(e, "entity_id")


def exact_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact_hits(spark, sf_dir).select("txn_id", "variant_norm", "entity_id").distinct()


def attribute_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exact_hits(spark, sf_dir)
    ids = F.array_compact(F.array("bene_passport", "bene_national_id"))
    return x.select("txn_id", "entity_id", X.country_agreement(F.col("bene_country"), F.col("countries")).alias("country"), X.dob_agreement(F.col("bene_dob"), F.col("dobs")).alias("dob"), X.id_agreement(ids, F.col("identifiers")).alias("id")).distinct()


def id_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments whose passport or national id is a listed identifier."""
    ids = I.identifiers(entities(spark, sf_dir))
    t = table(spark, sf_dir, "txn_event").select("txn_id", F.explode(F.array("bene_passport", "bene_national_id")).alias("raw")).where("txn_id is not null and raw <> ''")
    return t.select("txn_id", text.norm_id(F.col("raw")).alias("identifier")).join(ids, "identifier").distinct()


def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity numbers as somebody may type them (lower case, cut by hyphens) looked up among the listed ones."""
    ids = I.identifiers(entities(spark, sf_dir))
    t = table(spark, sf_dir, "opensanctions_target").select(F.explode("identifiers").alias("raw")).where("raw is not null").distinct()
    typed = F.lower(F.regexp_replace("raw", "(.{3})", "$1-"))
    return t.select(typed.alias("typed"), text.norm_id(typed).alias("identifier")).join(ids, "identifier").distinct()


def wallet_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "txn_event").where("txn_id is not null").select("txn_id", "wallet").distinct()
    return X.wallet_verdict(t, I.wallets(entities(spark, sf_dir)), table(spark, sf_dir, "exposure_index"))


def payment_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which module screens a payment, and which payments lack what their channel needs."""
    t = table(spark, sf_dir, "txn_event")
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    route = F.when((F.col("channel") == "crypto") & has("wallet"), "wallet").when((F.col("channel") == "fiat") & has("bene_name"), "name").otherwise("quarantine")
    return t.select(F.coalesce("channel", F.lit("")).alias("channel"), route.alias("route")).groupBy("channel", "route").agg(F.count(F.lit(1)).alias("n"))


def best_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the most mass per query, ties by entity."""
    r = recall_candidates(spark, sf_dir)
    w = W.partitionBy("query_id").orderBy(F.col("mass").desc(), "entity_id")
    return r.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "entity_id", "mass")


QUERIES = (
    norm_text, name_tokens, norm_ids, clean_cells, multi_values, text_helpers, latest_entities, variant_explode, token_df, token_idf, exact_name_map, identifier_map, wallet_map, index_size, phonetic_postings,
    recall_candidates, recall_phonetic, best_variants, pair_features, jaro_winkler_pairs, token_ratios, fallback_screening, screen_payments, payment_exact_stage, query_rarity, payment_risk, risk_thresholds, exact_screening, attribute_agreement, id_screening, id_lookup,
    wallet_screening, payment_routing, best_by_query,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _words(c: str) -> str:
    return f"regexp_extract_all({text.fold_sql(c)}, '[a-z]+')"


def _norm(c: str) -> str:
    return f"array_to_string({_words(c)}, ' ')"


_STOP = "(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"


def _tokens(c: str) -> str:
    return f"list_filter({_words(c)}, lambda w: length(w) > 1 and w not in {_STOP})"


_ENT = """ent as (select entity_id, id as ord, entity_schema, trim(name) as name, aliases, birth_date, countries, identifiers from opensanctions_target
  where entity_id is not null and name is not null qualify row_number() over (partition by entity_id order by created_at desc, id desc) = 1)"""
_VAR = f"""{_ENT}, raw as (select entity_id, ord, unnest(list_concat([name], coalesce(aliases, []))) as variant_raw, unnest(range(1 + len(coalesce(aliases, []))))::int as variant_ord from ent where entity_schema <> 'CryptoWallet'),
var as (select entity_id, ord, variant_ord, variant_raw, {_norm("variant_raw")} as variant_norm, variant_ord = 0 as is_primary from raw where {_norm("variant_raw")} <> '')"""
_DF = f"{_VAR}, tdf as (select token, count(distinct entity_id) as df from (select entity_id, unnest({_tokens('variant_raw')}) as token from var) group by 1), n as (select greatest(1, count(distinct entity_id)) as n from var), idf as (select token, ln(1 + n.n / df::double) as idf from tdf, n)"
_EXACT = f"{_VAR}, ex as (select variant_norm, entity_id from var qualify row_number() over (partition by variant_norm order by ord, variant_ord) = 1)"
_RECALL = f"""{_DF}, q as (select un_id as query_id, trim(name) as query from un_entity where un_id is not null and name is not null qualify row_number() over (partition by un_id order by created_at desc, id desc) = 1),
qt as (select query_id, unnest(list_distinct({_tokens("query")})) as token from q),
po as (select token, entity_id, count(*) as times from (select entity_id, unnest(list_distinct({_tokens("variant_raw")})) as token from var) group by all),
ms as (select query_id, entity_id, sum(coalesce(idf, ln(1 + n.n::double)) * times) as mass from qt join po using (token) left join idf using (token), n group by all),
rc as (select query_id, entity_id, mass, row_number() over (partition by query_id order by round(mass, 9) desc, entity_id) as rank from ms)"""
_RISK = """(0.35 * case when amount > 0 then greatest(0, least(1, (log10(amount) - 3) / 3)) else 0 end
  + 0.30 * case rail when 'crypto' then 0.85 when 'SWIFT' then 0.70 when 'FedWire' then 0.60 when 'ACH' then 0.30 when 'FPS' then 0.25 when 'SEPA' then 0.20 when 'card' then 0.15 else 0.30 end::double
  + 0.25 * case when lower(orig_country) in ('ir', 'kp', 'sy', 'af', 'ru', 'by', 'mm', 'cu', 've') then 0.85 else 0.10 end::double
  + 0.10 * case when upper(currency) in ('RUB', 'IRR', 'KPW') then 0.70 else 0.10 end::double)"""
_FACTORS = """array_to_string(list_filter([case when amount > 0 and greatest(0, least(1, (log10(amount) - 3) / 3)) >= 0.5 then 'amount' end, case when rail in ('crypto', 'SWIFT', 'FedWire') then 'rail' end,
  case when lower(orig_country) in ('ir', 'kp', 'sy', 'af', 'ru', 'by', 'mm', 'cu', 've') then 'country' end, case when upper(currency) in ('RUB', 'IRR', 'KPW') then 'currency' end], lambda x: x is not null), ',')"""
_PAY = f"select distinct txn_id, round(least(1, {_RISK}), 3) as risk, {_FACTORS} as factors from txn_event where txn_id is not null"
_ID = "upper(regexp_replace(lower({c}), '[^a-z0-9]', '', 'g'))"
_IDS = f"{_ENT}, ids as (select {_ID.format(c='raw')} as identifier, entity_id from (select entity_id, ord, unnest(identifiers) as raw from ent) where length({_ID.format(c='raw')}) >= 5 qualify row_number() over (partition by {_ID.format(c='raw')} order by ord, entity_id) = 1)"
_WAL = f"{_ENT}, wal as (select lower(trim(raw)) as wallet, entity_id from (select entity_id, ord, unnest(list_concat([name], coalesce(aliases, []))) as raw from ent where entity_schema = 'CryptoWallet') where trim(raw) <> '' qualify row_number() over (partition by lower(trim(raw)) order by ord desc, entity_id desc) = 1)"
_HITS = f"{_EXACT}, hit as (select distinct t.txn_id, t.bene_country, t.bene_dob, t.bene_passport, t.bene_national_id, {_norm('t.bene_name')} as variant_norm from txn_event t where txn_id is not null and bene_name <> ''), hx as (select hit.*, e.* from hit join ex using (variant_norm) join ent e using (entity_id))"

_PAYS = f"pays as (select distinct txn_id, coalesce({_norm('bene_name')}, '') as query_norm, bene_passport as i1, bene_national_id as i2 from txn_event where txn_id is not null and channel = 'fiat')"
_RARE = f"""{_DF}, {_PAYS}, qtk as (select query_norm, unnest(list_distinct({_tokens('query_norm')})) as token from (select distinct query_norm from pays where query_norm <> '')),
rare as (select query_norm, avg(coalesce(idf, ln(1 + n.n::double))) / any_value(ln(1 + n.n::double)) as rarity, count(*)::int as n_tokens from qtk left join idf using (token), n group by 1)"""
_IDS_ONLY = "ids as (select identifier, entity_id from (select entity_id, ord, " + _ID.format(c="raw") + " as identifier from (select entity_id, ord, unnest(identifiers) as raw from ent where entity_schema <> 'CryptoWallet')) where length(identifier) >= 5 qualify row_number() over (partition by identifier order by ord, entity_id) = 1)"


def oracle_sql() -> dict[str, str]:
    clean = lambda c: f"nullif(nullif(trim({c}), ''), '-0-')"
    parts = "list_filter(list_transform(string_split(coalesce(birth_date, ''), ';'), lambda x: trim(x)), lambda x: length(x) > 0)"
    return {
        "norm_text": f"select bene_name, {_norm('bene_name')} as norm from (select distinct bene_name from txn_event)",
        "name_tokens": f"select bene_name, array_to_string({_tokens('bene_name')}, ' ') as tokens from (select distinct bene_name from txn_event)",
        "norm_ids": f"select identifier, {_ID.format(c='identifier')} as norm_id from (select distinct unnest(identifiers) as identifier from opensanctions_target)",
        "clean_cells": f"select distinct txn_id, {clean('bene_dob')} as bene_dob, {clean('bene_passport')} as bene_passport, {clean('bene_country')} as bene_country, try_cast(nullif(regexp_extract(bene_dob, '^([0-9]{{4}})', 1), '') as int) as dob_year from txn_event",
        "multi_values": f"select birth_date, len({parts}) as n_parts, ({parts})[1] as first_part from (select distinct birth_date from opensanctions_target)",
        "text_helpers": """select distinct txn_id, regexp_extract(coalesce(rail, ''), '([^}:]*)$', 1) as tag, coalesce(nullif(trim(bene_name), ''), nullif(trim(rail), ''), nullif(trim(currency), '')) as first,
  case when contains(bene_dob, '-') then trim(regexp_extract(bene_dob, '^[^-]*-(.*)$', 1)) else trim(bene_dob) end as after_dash, contains(lower(concat_ws(' ', bene_name, rail)), 'pa') as found, case when regexp_full_match(trim(substring(bene_dob, 1, 4)), '[+-]?[0-9]+') then try_cast(trim(substring(bene_dob, 1, 4)) as int) end as number from txn_event""",
        "latest_entities": f"with {_ENT} select entity_id, ord, entity_schema, name, len(coalesce(aliases, [])) as n_aliases from ent",
        "variant_explode": f"with {_VAR} select entity_id, variant_ord, variant_norm, is_primary from var",
        "token_df": f"with {_DF} select token, df from tdf",
        "token_idf": f"with {_DF}, m as (select count(*) as n from ent where entity_schema <> 'CryptoWallet') select token, df, round(ln(1 + m.n / df::double), 6) as idf from tdf, m",
        "exact_name_map": f"with {_EXACT} select * from ex",
        "identifier_map": f"with {_IDS} select * from ids",
        "wallet_map": f"with {_WAL} select * from wal",
        "index_size": f"with {_VAR} select count(distinct entity_id) as n_entities, count(*) as n_variants from var",
        "recall_candidates": f"with {_RECALL} select query_id, entity_id, round(mass, 4) as mass, rank from rc where rank <= 150",
        "best_by_query": f"with {_RECALL} select query_id, entity_id, round(mass, 4) as mass from rc where rank <= 150 qualify row_number() over (partition by query_id order by round(mass, 4) desc, entity_id) = 1",
        "jaro_winkler_pairs": f"with {_RECALL} select rc.query_id, rc.entity_id, round(jaro_winkler_similarity({_norm('q.query')}, v.variant_norm), 4) as jw from rc join q using (query_id) join var v on v.entity_id = rc.entity_id and v.is_primary where rank <= 20",
        "query_rarity": f"with {_RARE} select query_norm, round(rarity, 6) as rarity, n_tokens from rare",
        "payment_exact_stage": f"""with {_RARE}, {_IDS_ONLY}, given as (select txn_id, query_norm, {_ID.format(c='i1')} as i1, {_ID.format(c='i2')} as i2 from pays),
  byid as (select g.*, coalesce(a.entity_id, b.entity_id) as entity_id from given g left join ids a on a.identifier = g.i1 left join ids b on b.identifier = g.i2),
  exn as (select variant_norm, entity_id from var qualify row_number() over (partition by variant_norm order by ord, variant_ord) = 1)
select distinct txn_id, 'identity' as stage, entity_id from byid where entity_id is not null
union select distinct b.txn_id, 'name', exn.entity_id from byid b join exn on exn.variant_norm = b.query_norm join rare r on r.query_norm = b.query_norm where b.entity_id is null and r.rarity >= 0.6""",
        "payment_risk": _PAY,
        "risk_thresholds": f"select distinct risk, round(greatest(0, 0.92 - 0.15 * greatest(0, least(1, risk))), 6) as tau_high, round(greatest(0, 0.80 - 0.15 * greatest(0, least(1, risk))), 6) as tau_low from ({_PAY})",
        "exact_screening": f"with {_HITS} select distinct txn_id, variant_norm, entity_id from hx",
        "attribute_agreement": f"""with {_HITS}, z as (select *, list_filter({parts}, lambda d: length(d) >= 4) as ds, lower(trim(bene_country)) as qc, trim(bene_dob) as qd,
  list_filter(list_transform(list_filter([bene_passport, bene_national_id], lambda x: x is not null), lambda x: {_ID.format(c='x')}), lambda x: x <> '') as qi, list_filter(list_transform(coalesce(identifiers, []), lambda x: {_ID.format(c='x')}), lambda x: x <> '') as ei from hx)
select distinct txn_id, entity_id, case when qc is null or qc = '' or len(coalesce(countries, [])) = 0 then 0 when list_contains(list_transform(countries, lambda x: lower(trim(x))), qc) then 1 else -1 end as country,
  case when qd is null or length(qd) < 4 or len(ds) = 0 then 0.0 when list_contains(ds, qd) then 1.0 when list_contains(list_transform(ds, lambda d: substring(d, 1, 4)), substring(qd, 1, 4)) then 0.6 else -1.0 end::double as dob, list_has_any(qi, ei)::int as id from z""",
        "id_screening": f"with {_IDS}, t as (select txn_id, {_ID.format(c='raw')} as identifier from (select txn_id, unnest([bene_passport, bene_national_id]) as raw from txn_event where txn_id is not null) where raw <> '') select distinct identifier, txn_id, entity_id from t join ids using (identifier)",
        "id_lookup": f"with {_IDS}, t as (select distinct lower(regexp_replace(raw, '(.{{3}})', '\\1-', 'g')) as typed from (select unnest(identifiers) as raw from opensanctions_target) where raw is not null) select distinct typed, {_ID.format(c='typed')} as identifier, entity_id from t join ids on ids.identifier = {_ID.format(c='typed')}",
        "wallet_screening": f"""with {_WAL}, t as (select distinct txn_id, wallet as w from txn_event where txn_id is not null and trim(wallet) <> '')
select txn_id, lower(trim(w)) as wallet, wal.entity_id, x.exposure_score::double as score, case when wal.entity_id is not null or x.best_depth = 0 then 'MATCH' when x.exposure_score::double >= 0.08 then 'REVIEW' else 'NO_MATCH' end as verdict
from t left join wal on wal.wallet = lower(trim(t.w)) left join exposure_index x on x.node_key = trim(t.w)""",
        "payment_routing": "select coalesce(channel, '') as channel, case when channel = 'crypto' and coalesce(trim(wallet) <> '', false) then 'wallet' when channel = 'fiat' and coalesce(trim(bene_name) <> '', false) then 'name' else 'quarantine' end as route, count(*) as n from txn_event group by all",
    }
