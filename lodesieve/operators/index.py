"""Name index: variants, postings, token frequencies, exact maps; blocking recall over it.

Every part is an ordinary DataFrame; tie-breaks are explicit (``ord``: file order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def variants(entities: DataFrame) -> DataFrame:
    """(entity_id, variant_ord, variant_raw, variant_norm, is_primary) from (entity_id, name, aliases): the name, then the
    aliases; variants without a letter are left out."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    v = entities.select("entity_id", F.posexplode(names).alias("variant_ord", "variant_raw"))
    return v.select("entity_id", "variant_ord", "variant_raw", text.norm(F.col("variant_raw")).alias("variant_norm"), (F.col("variant_ord") == 0).alias("is_primary")).where("variant_norm <> ''")


def postings(vs: DataFrame, key: Column | None = None) -> DataFrame:
    """(post_key, entity_id, variant_ord): one posting per variant and distinct token, repeats over variants kept. The
    key is the token itself or, with ``key`` (a function of column ``token``), its sound."""
    t = vs.select("entity_id", "variant_ord", F.explode(F.array_distinct(text.tokens(F.col("variant_raw")))).alias("token"))
    return t.select((F.col("token") if key is None else key).alias("post_key"), "entity_id", "variant_ord")


def token_df(vs: DataFrame) -> DataFrame:
    """(token, df): entities that have the token in any variant."""
    return vs.select("entity_id", F.explode(F.array_distinct(text.tokens(F.col("variant_raw")))).alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def token_idf(vs: DataFrame, n_entities: int) -> DataFrame:
    """(token, df, idf) with idf = ln(1 + n / df)."""
    n = max(1, n_entities)
    return token_df(vs).withColumn("idf", F.log1p(F.lit(float(n)) / F.col("df")))


def exact_names(vs: DataFrame, ord_of: DataFrame) -> DataFrame:
    """(variant_norm, entity_id): the first entity in file order that has the name. ``ord_of``: (entity_id, ord)."""
    return vs.join(ord_of, "entity_id").groupBy("variant_norm").agg(F.min_by("entity_id", F.struct("ord", "variant_ord")).alias("entity_id"))


def identifiers(entities: DataFrame, least: int = 5) -> DataFrame:
    """(identifier, entity_id): normalised identifiers of at least ``least`` characters, the first entity wins."""
    t = entities.select("entity_id", "ord", F.explode("identifiers").alias("raw")).select("entity_id", "ord", text.norm_id(F.col("raw")).alias("identifier"))
    return t.where(F.length("identifier") >= least).groupBy("identifier").agg(F.min_by("entity_id", F.struct("ord", "entity_id")).alias("entity_id"))


def wallets(entities: DataFrame) -> DataFrame:
    """(wallet, entity_id): lower-case addresses of wallet entities, aliases included, the last entity wins."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    t = entities.where(F.col("entity_schema") == "CryptoWallet").select("entity_id", "ord", F.explode(names).alias("raw")).where("raw is not null and trim(raw) <> ''")
    return t.groupBy(F.lower(F.trim("raw")).alias("wallet")).agg(F.max_by("entity_id", F.struct("ord", "entity_id")).alias("entity_id"))


def recall(queries: DataFrame, posts: DataFrame, idf: DataFrame, default_idf: float, top: int, key: Column | None = None, per_entity: bool = False) -> DataFrame:
    """(query_id, entity_id, mass, rank): entities by the summed idf of the query tokens they are posted under.

    Mass adds up per posting, so an entity with many aliases gathers more, unless ``per_entity``. An equi-join on the
    posting key; the window keeps ``top`` per query (ties: entity_id)."""
    q = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("token"))
    q = q.join(idf.select("token", "idf"), "token", "left").select("query_id", (F.col("token") if key is None else key).alias("post_key"), F.coalesce("idf", F.lit(default_idf)).alias("idf"))
    p = posts.select("post_key", "entity_id").distinct() if per_entity else posts.groupBy("post_key", "entity_id").agg(F.count(F.lit(1)).alias("times"))
    times = F.lit(1) if per_entity else F.col("times")
    mass = q.join(p, "post_key").groupBy("query_id", "entity_id").agg(F.sum(F.col("idf") * times).alias("mass"))
    w = W.partitionBy("query_id").orderBy(F.round("mass", 9).desc(), "entity_id")
    return mass.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
