"""List feeds as typed DataFrames: positional CSV, headered CSV with a preamble, multi-value CSV, XML, Parquet.

Readers declare their schema, keep the verbatim row in ``raw`` where the feed drifts, and stay lazy but for the sniffing
of a header in the first lines. Missing cells, blank lines and short rows give nulls, never errors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# fixed values: column layouts of the positional feeds
SDN = ("ent_num", "name", "sdn_type", "program", "title", "call_sign", "vess_type", "tonnage", "grt", "vess_flag", "vess_owner", "remarks")
ALT = ("ent_num", "alt_num", "alt_type", "alt_name", "alt_remarks")
ADD = ("ent_num", "add_num", "address", "city_state_zip", "country", "add_remarks")
TARGETS = ("id", "schema", "name", "aliases", "birth_date", "countries", "addresses", "identifiers", "sanctions", "first_seen", "last_seen")
WALLET_FEATURE = "Digital Currency Address"


def _strings(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def positional_csv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless CSV by position: short rows are filled with nulls, blank rows left out, cells cleaned."""
    raw = spark.read.csv(path, schema=_strings(columns), header=False, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE", multiLine=False)
    cleaned = raw.select(*[text.clean(F.col(c)).alias(c) for c in columns])
    return cleaned.where(F.coalesce(*[F.col(c) for c in columns]).isNotNull())


def list_entities(spark: SparkSession, path: str, list_source: str) -> DataFrame:
    d = positional_csv(spark, path, SDN)
    return d.select(text.to_int(F.col("ent_num")).alias("ent_num"), *SDN[1:], F.lit(list_source).alias("list_source"), F.to_json(F.struct(*SDN)).alias("raw"))


def list_aliases(spark: SparkSession, path: str) -> DataFrame:
    return positional_csv(spark, path, ALT).select(text.to_int(F.col("ent_num")).alias("ent_num"), text.to_int(F.col("alt_num")).alias("alt_num"), *ALT[2:])


def list_addresses(spark: SparkSession, path: str) -> DataFrame:
    return positional_csv(spark, path, ADD).select(text.to_int(F.col("ent_num")).alias("ent_num"), text.to_int(F.col("add_num")).alias("add_num"), *ADD[2:])


def enhanced_entities(spark: SparkSession, path: str, row_tag: str = "entity") -> DataFrame:
    """XML entities: id, type, first formatted name (else last name), programs, features."""
    schema = T.StructType([
        T.StructField("_id", T.StringType()),
        T.StructField("generalInfo", T.StructType([T.StructField("entityType", T.StringType())])),
        T.StructField("sanctionsPrograms", T.StructType([T.StructField("sanctionsProgram", T.ArrayType(T.StringType()))])),
        T.StructField("names", T.StructType([T.StructField("name", T.ArrayType(T.StructType([T.StructField("translations", T.StructType([T.StructField("translation", T.ArrayType(T.StructType([T.StructField("formattedFullName", T.StringType()), T.StructField("formattedLastName", T.StringType())])))]))])))])),
        T.StructField("features", T.StructType([T.StructField("feature", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])))])),
    ])
    d = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    tr = F.flatten(F.transform("names.name", lambda n: F.coalesce(n["translations"]["translation"], F.array())))
    pick = lambda f: F.try_element_at(F.filter(F.transform(tr, lambda t: F.trim(t[f])), lambda x: x != ""), F.lit(1))
    return d.select(
        F.col("_id").alias("entity_id"), F.col("generalInfo.entityType").alias("entity_type"), F.coalesce(pick("formattedFullName"), pick("formattedLastName")).alias("name"),
        F.coalesce("sanctionsPrograms.sanctionsProgram", F.array().cast("array<string>")).alias("programs"), F.coalesce("features.feature", F.array().cast("array<struct<type:string,value:string>>")).alias("features"),
    )


def enhanced_wallets(entities: DataFrame) -> DataFrame:
    """(entity_id, address, currency) of the wallet features; the currency follows the first dash of the type."""
    f = entities.select("entity_id", F.explode("features").alias("f"))
    return f.where(F.col("f.type").startswith(WALLET_FEATURE)).select("entity_id", F.trim("f.value").alias("address"), text.after_dash(F.col("f.type")).alias("currency")).where("address <> ''")


def un_records(spark: SparkSession, path: str) -> DataFrame:
    """XML individuals, then entities: joined names, aliases, list type (nested or flat), nationalities."""
    value = T.StructType([T.StructField("VALUE", T.ArrayType(T.StringType())), T.StructField("_VALUE", T.StringType())])
    alias = lambda tag: T.StructField(tag, T.ArrayType(T.StructType([T.StructField("ALIAS_NAME", T.StringType())])))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("DATAID", "FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME", "REFERENCE_NUMBER", "LISTED_ON", "COMMENTS1")] + [T.StructField("UN_LIST_TYPE", T.StringType()), T.StructField("NATIONALITY", value), alias("INDIVIDUAL_ALIAS"), alias("ENTITY_ALIAS")])
    parts = []
    for tag, kind in (("INDIVIDUAL", "individual"), ("ENTITY", "entity")):
        d = spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").schema(schema).load(path)
        aliases = F.filter(F.transform(F.coalesce(f"{tag}_ALIAS", F.array()), lambda a: F.trim(a["ALIAS_NAME"])), lambda x: x != "")
        listed = F.regexp_replace(F.coalesce("UN_LIST_TYPE", F.lit("")), "<[^>]*>", "")
        parts.append(d.select(
            F.trim("DATAID").alias("un_id"), F.lit(kind).alias("record_type"), F.concat_ws(" ", *[text.clean(F.col(c)) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")]).alias("name"), aliases.alias("aliases"),
            text.clean(listed).alias("un_list_type"), F.trim("REFERENCE_NUMBER").alias("reference_number"), F.coalesce("NATIONALITY.VALUE", F.array().cast("array<string>")).alias("nationalities"), F.trim("LISTED_ON").alias("listed_on"), text.clean(F.col("COMMENTS1")).alias("comments"),
        ))
    return parts[0].unionByName(parts[1])


# fixed values: names under which the feed has had its columns
OFSI_COLUMNS = {"group_id": ("Group ID",), "name_type": ("Name Type", "Alias Type"), "group_type": ("Group Type", "Entity Type"), "regime": ("Regime", "Regime Name"), "country": ("Country", "Address Country"), "listed_on": ("Listed On", "Date Designated")}


def preamble_csv(spark: SparkSession, path: str, marker: str = "Name 6", within: int = 10) -> DataFrame:
    """CSV whose header follows a preamble: it is found in the first ``within`` lines, whatever its case and spacing."""
    lines = [r.value for r in spark.read.text(path).limit(within).collect()]  # the first lines only
    plain = lambda s: "".join(s.lower().split())
    at = next((i for i, x in enumerate(lines) if plain(marker) in plain(x.lstrip("﻿"))), None)
    if at is None:
        raise ValueError(f"no header with {marker!r} in the first {within} lines of {path}")
    header = [h.strip().strip('"') for h in lines[at].lstrip("﻿").split(",")]
    rows = spark.read.csv(path, schema=_strings([f"c{i}" for i in range(len(header))]), header=False, quote='"', escape='"')
    skip = [plain(x) for x in lines[: at + 1]]
    body = rows.where(~F.regexp_replace(F.lower(F.regexp_replace(F.concat_ws(",", *rows.columns), "﻿", "")), "[\\s\"]", "").isin(*[s.replace('"', "").lstrip("﻿") for s in skip]))
    return body.toDF(*[f"{h}" for h in header])


def ofsi_entries(spark: SparkSession, path: str) -> DataFrame:
    d = preamble_csv(spark, path)
    have = {"".join(c.lower().split()): c for c in d.columns}

    def pick(*names: str) -> Column:
        found = [text.clean(d[f"`{have[k]}`"]) for n in names if (k := "".join(n.lower().split())) in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    name = F.concat_ws(" ", *[pick(f"Name {i}") for i in (1, 2, 3, 4, 5, 6)])
    out = d.select(text.none_if_empty(name).alias("name"), *[pick(*v).alias(k) for k, v in OFSI_COLUMNS.items()], F.to_json(F.struct(*[d[f"`{c}`"] for c in d.columns])).alias("raw"))
    return out.where("name is not null")


def targets_csv(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Headered CSV with five multi-value columns, read by name; absent columns give nulls."""
    d = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    col = lambda c: text.clean(F.col(c)) if c in d.columns else F.lit(None).cast("string")
    lists = ("aliases", "countries", "addresses", "identifiers", "sanctions")
    return d.select(F.lit(dataset).alias("dataset"), col("id").alias("entity_id"), col("schema").alias("entity_schema"), col("name").alias("name"), col("birth_date").alias("birth_date"), *[text.split_multi(col(c)).alias(c) for c in lists], col("first_seen").alias("first_seen"), col("last_seen").alias("last_seen"))


def target_wallets(targets: DataFrame) -> DataFrame:
    w = targets.where("entity_schema = 'CryptoWallet' and name is not null")
    return w.select(F.col("name").alias("address"), F.try_element_at("identifiers", F.lit(1)).alias("currency"), F.col("entity_id").alias("entity_ref"), "dataset")


def entities_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot with optional columns; unknown kinds become Other."""
    d = spark.read.parquet(path)
    known = ("Person", "Organization", "Company", "LegalEntity", "CryptoWallet", "Vessel", "Airplane")
    col = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    kind = F.when(col("schema").isin(*known), col("schema")).otherwise("Other")
    return d.select(col("id").alias("entity_id"), kind.alias("entity_schema"), col("name").alias("name"), *[text.split_multi(col(c).cast("string")).alias(c) for c in ("aliases", "countries", "sanctions", "identifiers")], col("birth_date").alias("birth_date"), col("first_seen").alias("first_seen"))


def all_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headered CSV, every column text, nulls as ''."""
    d = spark.read.csv(path, header=True, quote='"', escape='"')
    return d.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in d.columns])


def pattern_hits(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Matches of a pattern over text files, line by line, counted."""
    t = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), 0)).alias("hit"))
    return t.groupBy("hit").agg(F.count(F.lit(1)).alias("n"))


def line_count(spark: SparkSession, path: str, header: bool = True) -> int:
    return spark.read.text(path).count() - int(header)


@dataclass(frozen=True)
class Feed:
    """A source by name: how to read it, into which table, and which scope of the table it replaces."""

    name: str
    read: Callable[[SparkSession, str], DataFrame]
    table: str
    scope: tuple[str, str] | None = None


FEEDS = {
    f.name: f
    for f in (
        Feed("ofac_sdn", lambda s, p: list_entities(s, p, "sdn"), "ofac_entity", ("list_source", "sdn")),
        Feed("ofac_consolidated", lambda s, p: list_entities(s, p, "consolidated"), "ofac_entity", ("list_source", "consolidated")),
        Feed("ofac_alt", list_aliases, "ofac_alias"),
        Feed("ofac_add", list_addresses, "ofac_address"),
        Feed("ofac_enhanced", enhanced_entities, "ofac_enhanced"),
        Feed("un_consolidated", un_records, "un_entity"),
        Feed("uk_ofsi", ofsi_entries, "ofsi_entry"),
        Feed("opensanctions_sanctions", lambda s, p: targets_csv(s, p, "sanctions"), "opensanctions_target", ("dataset", "sanctions")),
        Feed("opensanctions_peps", lambda s, p: targets_csv(s, p, "peps"), "opensanctions_target", ("dataset", "peps")),
        Feed("opensanctions_crypto", lambda s, p: targets_csv(s, p, "crypto"), "opensanctions_target", ("dataset", "crypto")),
    )
}
