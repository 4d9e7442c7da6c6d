"""Registered queries of sources and streams. Streams run over the stored tables until nothing is left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..session import shared_folder, table
from ..sources import feeds
from ..streaming import fanin
from .screening_queries import _persons, _variants


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table as a file stream, whether it is one file or a folder."""
    t = table(spark, sf_dir, name)
    first = t.inputFiles()[0]
    folder, file = first.rsplit("/", 1)
    return fanin.files(spark, folder, t.schema, "parquet", glob=None if folder.endswith(f"{name}.parquet") else file)


def _place(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of a stream once each, counted by channel."""
    s = fanin.first_deliveries(_stream(spark, sf_dir, "txn_event"), "400 days").select("txn_id", "channel")
    return fanin.drain(s, *_place(spark)).groupBy("channel").agg(F.count_distinct("txn_id").alias("n_payments"))


def stream_name_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = I.exact_names(_variants(spark, sf_dir), _persons(spark, sf_dir).select("entity_id", "ord"))
    r = fanin.name_results(_stream(spark, sf_dir, "txn_event"), exact)
    return fanin.drain(r, *_place(spark)).select("txn_id", "module", "verdict", "applicable").distinct()


def stream_exposure_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fanin.exposure_results(_stream(spark, sf_dir, "txn_event"), table(spark, sf_dir, "exposure_index"))
    return fanin.drain(r, *_place(spark)).select("txn_id", "module", "verdict", "applicable").distinct()


def stream_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments and both module results through one keyed state; every payment is emitted once."""
    t = _stream(spark, sf_dir, "txn_event")
    exact = I.exact_names(_variants(spark, sf_dir), _persons(spark, sf_dir).select("entity_id", "ord"))
    own = fanin.named(t).select("txn_id", F.lit("txn").alias("module"), F.lit("NO_MATCH").alias("verdict"), F.lit(False).alias("applicable"), F.array().cast("array<string>").alias("reasons"), F.col("received_at").alias("at"))
    parts = own.unionByName(fanin.name_results(_stream(spark, sf_dir, "txn_event"), exact)).unionByName(fanin.exposure_results(_stream(spark, sf_dir, "txn_event"), table(spark, sf_dir, "exposure_index")))
    return fanin.drain(fanin.fan_in(parts, "60 seconds"), *_place(spark)).select("txn_id", "verdict", "status", "n_results", "timed_out")


def stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live counts by status, as the last update leaves them."""
    name = f"counts_{uuid.uuid4().hex}"
    s = fanin.status_counts(_stream(spark, sf_dir, "pipeline_verdict"))
    q = s.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", _place(spark)[1]).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def feed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets written as a multi-value CSV feed and read back."""
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null and dataset = 'sanctions'")
    join = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), ";")
    path = _place(spark)[0]
    out = t.select(F.col("entity_id").alias("id"), F.col("entity_schema").alias("schema"), "name", *[join(c).alias(c) for c in ("aliases",)], "birth_date", *[join(c).alias(c) for c in ("countries", "addresses", "identifiers", "sanctions")], "first_seen", "last_seen")
    out.write.csv(path, header=True, quote='"', escape='"', quoteAll=True)
    r = feeds.targets_csv(spark, path, "sanctions")
    return r.select("dataset", "entity_id", "entity_schema", "name", "birth_date", *[F.size(c).alias(f"n_{c}") for c in ("aliases", "countries", "sanctions")], "first_seen").distinct()


def feed_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "opensanctions_target").where("dataset = 'crypto'").withColumn("name", F.trim("name"))
    return feeds.target_wallets(t).distinct()


def feed_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons written as a headerless positional feed with its mark of missing values, and read back."""
    t = table(spark, sf_dir, "un_entity").where("un_id is not null and name is not null").select("un_id", "name", "record_type", F.try_element_at("programs", F.lit(1)).alias("program"))
    ascii_name = F.regexp_replace("name", "[^\\x20-\\x7e]", "?")
    cols = [F.col("un_id"), ascii_name.alias("name"), F.lit("-0-").alias("sdn_type"), F.coalesce("program", F.lit("-0-")).alias("program")]
    path = _place(spark)[0]
    t.select(*cols).write.csv(path, header=False, quote='"', escape='"', quoteAll=True)
    return feeds.list_entities(spark, path, "sdn").select("ent_num", "name", "sdn_type", "program", "remarks", "list_source").distinct()


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "un_entity").where("un_id is not null").select("un_id", F.explode("aliases").alias("alias")).where("trim(alias) <> ''").distinct()
    return t.select("un_id", F.regexp_replace("alias", "[^\\x20-\\x7e]", "?").alias("alias"))


def feed_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases written as a headerless positional feed and read back."""
    path = _place(spark)[0]
    _aliases(spark, sf_dir).select("un_id", F.length("alias").cast("string"), F.lit("aka"), "alias", F.lit("-0-")).write.csv(path, header=False, quote='"', escape='"', quoteAll=True)
    return feeds.list_aliases(spark, path).distinct()


def feed_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written as a headerless positional feed, blanks and marks of missing values included, and read back."""
    path = _place(spark)[0]
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null").select("id", F.explode("addresses").alias("a"))
    plain = F.regexp_replace("a", "[^\\x20-\\x7e]", "?")
    t.select(F.col("id").cast("string"), F.lit("7"), plain, F.lit(" "), F.lit("-0-"), F.lit("")).write.csv(path, header=False, quote='"', escape='"', quoteAll=True)
    return feeds.list_addresses(spark, path).distinct()


def _xml_feed(spark: SparkSession, sf_dir: str) -> str:
    """Targets as XML entities: full name for persons, last name else, programs, and a wallet feature for wallets."""
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null and name is not null").select("entity_id", "entity_schema", F.trim("name").alias("name"), F.filter(F.coalesce("sanctions", F.array().cast("array<string>")), lambda x: F.trim(x) != "").alias("programs"), F.try_element_at("identifiers", F.lit(1)).alias("cur")).distinct()
    person = F.col("entity_schema") == "Person"
    spelled = F.struct(F.when(person, F.col("name")).alias("formattedFullName"), F.when(~person, F.col("name")).alias("formattedLastName"))
    names = F.struct(F.array(F.struct(F.struct(F.array(spelled).alias("translation")).alias("translations"))).alias("name"))
    feature = F.struct(F.concat(F.lit("Digital Currency Address - "), F.coalesce("cur", F.lit("XX"))).alias("type"), F.col("name").alias("value"))
    features = F.when(F.col("entity_schema") == "CryptoWallet", F.struct(F.array(feature).alias("feature")))
    path = _place(spark)[0]
    rows = t.select(F.col("entity_id").alias("_id"), F.struct(F.col("entity_schema").alias("entityType")).alias("generalInfo"), names.alias("names"), F.struct(F.col("programs").alias("sanctionsProgram")).alias("sanctionsPrograms"), features.alias("features"))
    rows.write.format("xml").option("rootTag", "entities").option("rowTag", "entity").save(path)
    return path


def feed_xml_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = feeds.enhanced_entities(spark, _xml_feed(spark, sf_dir))
    return r.select("entity_id", "entity_type", "name", F.size("programs").alias("n_programs")).distinct()


def feed_xml_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.enhanced_wallets(feeds.enhanced_entities(spark, _xml_feed(spark, sf_dir))).distinct()


def feed_xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as XML individuals and entities, names in up to two parts, and read back."""
    path = _place(spark)[0]
    t = table(spark, sf_dir, "un_entity").where("un_id is not null and name is not null").withColumn("w", F.split(F.trim("name"), " +", 2))
    for tag, kind in (("INDIVIDUAL", "individual"), ("ENTITY", "entity")):
        aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("ALIAS_NAME"))).alias(f"{tag}_ALIAS")
        rows = t.where(F.col("record_type") == kind).select(
            F.col("un_id").alias("DATAID"), F.get("w", F.lit(0)).alias("FIRST_NAME"), F.get("w", F.lit(1)).alias("SECOND_NAME"), F.col("un_list_type").alias("UN_LIST_TYPE"), F.col("reference_number").alias("REFERENCE_NUMBER"),
            F.struct(F.coalesce("nationalities", F.array().cast("array<string>")).alias("VALUE")).alias("NATIONALITY"), F.col("listed_on").alias("LISTED_ON"), F.col("comments").alias("COMMENTS1"), aliases,
        )
        rows.write.format("xml").option("rootTag", f"{tag}S").option("rowTag", tag).save(f"{path}/{kind}")
    r = feeds.un_records(spark, f"{path}/*")
    return r.select("un_id", "record_type", "name", F.size("aliases").alias("n_aliases"), "un_list_type", "reference_number", F.size("nationalities").alias("n_nationalities"), "listed_on", "comments").distinct()


def feed_parquet_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot in Parquet that lacks some of the optional columns."""
    path = _place(spark)[0]
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null")
    t.select(F.col("entity_id").alias("id"), F.when(F.col("entity_schema") == "Company", "Trust").otherwise(F.col("entity_schema")).alias("schema"), F.trim("name").alias("name"), F.array_join(F.coalesce("countries", F.array().cast("array<string>")), ";").alias("countries"), "birth_date").write.parquet(path)
    return feeds.entities_parquet(spark, path).select("entity_id", "entity_schema", "name", F.size("countries").alias("n_countries"), F.size("aliases").alias("n_aliases"), "birth_date", "first_seen").distinct()


def feed_text_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headered CSV read as text throughout, missing values as ''."""
    path = _place(spark)[0]
    table(spark, sf_dir, "txn_event").select("txn_id", "channel", "amount", "currency", "rail").write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
    r = feeds.all_text_csv(spark, path)
    return r.select("txn_id", "channel", F.col("amount").try_cast("double").alias("amount"), "currency", "rail").distinct()


def feed_pattern_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document numbers found in text files, counted."""
    path = _place(spark)[0]
    table(spark, sf_dir, "opensanctions_target").where("raw is not null").select("raw").write.text(path)
    return feeds.pattern_hits(spark, path, "TIN-[0-9]{8}")


def feed_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a headered feed without its header, as a row."""
    path = _place(spark)[0]
    keys = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null").select("entity_id").distinct()
    spark.createDataFrame([("entity_id",)], "entity_id string").unionByName(keys).write.text(path)
    return spark.createDataFrame([(feeds.line_count(spark, path),)], "n long")


QUERIES = (feed_aliases, feed_addresses, feed_xml_entities, feed_xml_wallets, feed_xml_records, feed_parquet_entities, feed_text_csv, feed_pattern_hits, feed_line_count, stream_first_deliveries, stream_name_results, stream_exposure_results, stream_fan_in, stream_status_counts, feed_targets, feed_wallets, feed_positional)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from .screening_queries import _EXACT, _norm

    key = "coalesce(nullif(trim(bene_account), ''), nullif(trim(wallet), ''))"
    n = lambda c: f"len(list_filter(list_transform(coalesce({c}, []), lambda x: trim(x)), lambda x: length(x) > 0)) as n_{c}"
    return {
        "stream_first_deliveries": "select channel, count(distinct txn_id) as n_payments from (select txn_id, channel from txn_event where txn_id is not null and trim(txn_id) <> '' qualify row_number() over (partition by txn_id order by received_at) = 1) group by 1",
        "stream_name_results": f"with {_EXACT} select distinct txn_id, 'name' as module, case when ex.entity_id is not null then 'REVIEW' else 'NO_MATCH' end as verdict, coalesce(bene_name, '') <> '' as applicable from txn_event t left join ex on ex.variant_norm = {_norm('t.bene_name')} where txn_id is not null and trim(txn_id) <> ''",
        "stream_exposure_results": f"select distinct txn_id, 'exposure' as module, case when x.best_depth = 0 then 'MATCH' when x.exposure_score::double >= 0.30 then 'REVIEW' else 'NO_MATCH' end as verdict, {key} is not null as applicable from txn_event t left join exposure_index x on x.node_key = {key} where txn_id is not null and trim(txn_id) <> ''",
        "stream_fan_in": f"""with {_EXACT}, t as (select * from txn_event where txn_id is not null and trim(txn_id) <> ''),
r as (select txn_id, 'name' as m, case when ex.entity_id is not null then 1 else 0 end as v, coalesce(bene_name, '') <> '' as ok, received_at from t left join ex on ex.variant_norm = {_norm('t.bene_name')}
  union all select txn_id, 'exposure', case when x.best_depth = 0 then 2 when x.exposure_score::double >= 0.30 then 1 else 0 end, {key} is not null, received_at from t left join exposure_index x on x.node_key = {key}),
one as (select * from r qualify row_number() over (partition by txn_id, m order by received_at nulls last, ['NO_MATCH', 'REVIEW', 'MATCH'][v + 1], ok) = 1),
w as (select txn_id, coalesce(max(v) filter (ok), 0) as v from one group by 1)
select txn_id, ['NO_MATCH', 'REVIEW', 'MATCH'][v + 1] as verdict, ['allowed', 'review', 'blocked'][v + 1] as status, 2 as n_results, false as timed_out from w""",
        "stream_status_counts": "select status, count(*) as n from pipeline_verdict group by 1",
        "feed_targets": f"select distinct dataset, entity_id, entity_schema, nullif(trim(name), '') as name, nullif(trim(birth_date), '') as birth_date, {n('aliases')}, {n('countries')}, {n('sanctions')}, first_seen from opensanctions_target where entity_id is not null and dataset = 'sanctions'",
        "feed_aliases": "select distinct try_cast(un_id as int) as ent_num, length(a)::int as alt_num, 'aka' as alt_type, nullif(trim(a), '') as alt_name, null::varchar as alt_remarks from (select un_id, regexp_replace(alias, '[^\\x20-\\x7e]', '?', 'g') as a from (select un_id, unnest(aliases) as alias from un_entity where un_id is not null) where trim(alias) <> '')",
        "feed_addresses": "select distinct id::int as ent_num, 7 as add_num, nullif(trim(a), '') as address, null::varchar as city_state_zip, null::varchar as country, null::varchar as add_remarks from (select id, regexp_replace(x, '[^\\x20-\\x7e]', '?', 'g') as a from (select id, unnest(addresses) as x from opensanctions_target where entity_id is not null))",
        "feed_xml_entities": "select distinct entity_id, entity_schema as entity_type, trim(name) as name, len(list_filter(coalesce(sanctions, []), lambda x: trim(x) <> ''))::int as n_programs from opensanctions_target where entity_id is not null and name is not null",
        "feed_xml_wallets": "select distinct entity_id, trim(name) as address, trim(coalesce(identifiers[1], 'XX')) as currency from opensanctions_target where entity_id is not null and name is not null and entity_schema = 'CryptoWallet' and trim(name) <> ''",
        "feed_xml_records": "select distinct trim(un_id) as un_id, record_type, regexp_replace(trim(name), '^([^ ]+) +', '\\1 ') as name, len(list_filter(coalesce(aliases, []), lambda x: trim(x) <> ''))::int as n_aliases, nullif(trim(un_list_type), '') as un_list_type, trim(reference_number) as reference_number, len(list_filter(coalesce(nationalities, []), lambda x: x is not null))::int as n_nationalities, trim(listed_on) as listed_on, nullif(trim(comments), '') as comments from un_entity where un_id is not null and name is not null and record_type in ('individual', 'entity')",
        "feed_parquet_entities": "select distinct entity_id, case when entity_schema in ('Person', 'Organization', 'LegalEntity', 'CryptoWallet', 'Vessel', 'Airplane') then entity_schema else 'Other' end as entity_schema, trim(name) as name, len(list_filter(list_transform(string_split(array_to_string(coalesce(countries, []), ';'), ';'), lambda x: trim(x)), lambda x: x <> ''))::int as n_countries, 0 as n_aliases, birth_date, null::varchar as first_seen from opensanctions_target where entity_id is not null",
        "feed_text_csv": "select distinct coalesce(txn_id, '') as txn_id, coalesce(channel, '') as channel, amount, coalesce(currency, '') as currency, coalesce(rail, '') as rail from txn_event",
        "feed_pattern_hits": "select hit, count(*) as n from (select unnest(regexp_extract_all(raw, 'TIN-[0-9]{8}')) as hit from opensanctions_target where raw is not null) group by 1",
        "feed_line_count": "select count(distinct entity_id) as n from opensanctions_target where entity_id is not null",
        "feed_wallets": "select distinct trim(name) as address, identifiers[1] as currency, entity_id as entity_ref, dataset from opensanctions_target where dataset = 'crypto' and entity_schema = 'CryptoWallet' and name is not null",
        "feed_positional": "select distinct try_cast(un_id as int) as ent_num, nullif(trim(regexp_replace(name, '[^\\x20-\\x7e]', '?', 'g')), '') as name, null::varchar as sdn_type, programs[1] as program, null::varchar as remarks, 'sdn' as list_source from un_entity where un_id is not null and name is not null",
    }
