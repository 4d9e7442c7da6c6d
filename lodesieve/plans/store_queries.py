"""Registered queries of store, audit, metric and profile operators, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import screening as X
from ..operators import store as S
from ..session import shared_folder, table


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pipeline_verdict")


def _stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def latest_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _verdicts(spark, sf_dir).select("txn_id", "decided_at", "combined_verdict", "status", "channel", "amount")
    return S.latest_per_key(v, "txn_id", ["decided_at", "combined_verdict"]).withColumn("decided_at", _stamp("decided_at"))


def verdict_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews decided anew over the stored rows; channel and amount keep what was stored first."""
    v = _verdicts(spark, sf_dir).select("txn_id", "decided_at", "combined_verdict", "status", "channel", "amount")
    old = S.latest_per_key(v, "txn_id", ["decided_at", "combined_verdict"])
    new = old.where("status = 'review'").select("txn_id", (F.col("decided_at") + F.expr("interval 1 hour")).alias("decided_at"), F.lit("MATCH").alias("combined_verdict"), F.lit("blocked").alias("status"), F.lit("manual").alias("channel"), F.lit(0.0).alias("amount"))
    return S.upsert(old, new, "txn_id", ["decided_at"], keep_old=("channel", "amount")).withColumn("decided_at", _stamp("decided_at"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_counts(_verdicts(spark, sf_dir), "status")


def channel_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("channel", "combined_verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("amount"), 2).alias("avg_amount"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 200 payments to review: a top-k report."""
    return _verdicts(spark, sf_dir).where("status = 'review'").select("txn_id", "decided_at", "bene_name").distinct().orderBy(F.col("decided_at").desc(), "txn_id", "bene_name").limit(200).withColumn("decided_at", _stamp("decided_at"))


def verdict_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 100 of the stored verdicts, in order of their key."""
    return _verdicts(spark, sf_dir).select("txn_id", "status").distinct().orderBy("txn_id", "status").offset(100).limit(100)


def node_risk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on the accounts of blocked and reviewed payments, applied to the nodes."""
    t = table(spark, sf_dir, "txn_event").select("txn_id", F.trim("bene_account").alias("node_key")).where("node_key <> ''").distinct()
    d = _verdicts(spark, sf_dir).select("txn_id", F.when(F.col("status") == "blocked", "block").when(F.col("status") == "review", "escalate").alias("decision")).where("decision is not null")
    nodes = table(spark, sf_dir, "graph_nodes").select("node_key", "risk_level", "risk_source")
    return S.flag_nodes(nodes, t.join(d, "txn_id").select("node_key", "decision", F.lit("desk1").alias("analyst")))


def flagged_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_risk_upsert(spark, sf_dir).agg(F.count_if(F.col("risk_source").like("analyst:%")).alias("n_flagged"))


def scoped_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dataset replaced by its latest delivery, the others kept; counted per dataset."""
    t = table(spark, sf_dir, "opensanctions_target").select("dataset", "entity_id", "ingest_run_id")
    last = t.where("dataset = 'peps'").agg(F.max("ingest_run_id").alias("r"))
    new = t.where("dataset = 'peps'").join(F.broadcast(last), F.col("ingest_run_id") == F.col("r")).drop("r")  # one row
    return S.scoped_refresh(t, new, "dataset", ["peps"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity_id").alias("n_keys"))


def ingest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_runs(table(spark, sf_dir, "ingest_run"))


def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "ingest_run")
    return r.groupBy("source").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "fail").alias("n_fail"), F.sum(F.when(F.col("status") == "ok", F.col("row_count"))).alias("rows_ok"), F.max(F.substring("error", 1, 1000)).alias("an_error"))


def rows_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "opensanctions_target").select("ingest_run_id").unionByName(table(spark, sf_dir, "un_entity").select("ingest_run_id"))
    c = t.groupBy(F.col("ingest_run_id").alias("id")).agg(F.count(F.lit(1)).alias("n_rows"))
    return table(spark, sf_dir, "ingest_run").select("id", "source", "status").join(c, "id", "left").select("id", "source", "status", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def entity_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named rows of one dataset, with an id made from dataset and number where the key is missing."""
    t = table(spark, sf_dir, "opensanctions_target").where("dataset = 'peps' and name is not null")
    made = M.running_sums(t.where("entity_id is null").select("id", "dataset", "name", F.lit(1).alias("one")), ["one"], [F.col("id")]).withColumn("n", F.col("upto_one") - 1)
    a = t.where("entity_id is not null").select("id", "entity_id", F.trim("name").alias("name"))
    return a.unionByName(made.select("id", F.concat("dataset", F.lit("-"), F.col("n").cast("string")).alias("entity_id"), F.trim("name").alias("name")))


def wallet_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct wallets with their currency, the first identifier; the id is the key, else the address."""
    t = table(spark, sf_dir, "opensanctions_target").where("entity_schema = 'CryptoWallet' and name is not null")
    return t.select(F.coalesce("entity_id", F.trim("name")).alias("entity_id"), F.trim("name").alias("address"), F.try_element_at("identifiers", F.lit(1)).alias("currency")).distinct()


def all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of one dataset and wallets together, counted by kind."""
    e = entity_load(spark, sf_dir).select("entity_id", F.lit("entity").alias("kind"))
    return e.unionByName(wallet_load(spark, sf_dir).select("entity_id", F.lit("wallet").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("n_keys"))


def wallet_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.value_counts(wallet_load(spark, sf_dir), "currency")


def schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ("Person", "Organization", "Company", "LegalEntity", "CryptoWallet", "Vessel", "Airplane")
    kind = F.when(F.col("entity_schema").isin(*known), F.col("entity_schema")).otherwise("Other")
    return S.value_counts(table(spark, sf_dir, "opensanctions_target"), kind)


def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 countries with the most entities: a top-k report."""
    t = table(spark, sf_dir, "opensanctions_target").select("entity_id", F.explode("countries").alias("country")).distinct()
    return S.value_counts(t, "country", 20)


def name_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most frequent words of names: a top-k report."""
    t = table(spark, sf_dir, "opensanctions_target").select("name").where("name is not null")
    w = t.select(F.explode(F.regexp_extract_all(F.lower("name"), F.lit("[a-zà-öø-ÿ]+"), 0)).alias("w")).where(F.length("w") > 2)
    return S.value_counts(w.where(~F.col("w").isin(*text.STOP_WORDS)), "w", 25)


def alias_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.coalesce("aliases", F.array().cast("array<string>")))
    return table(spark, sf_dir, "opensanctions_target").agg(F.round(F.avg((n > 0).cast("double")), 6).alias("share_with_alias"), F.max(n).alias("most_aliases"))


def most_aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five entities with the most distinct aliases: a top-k report."""
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null").select("entity_id", F.explode("aliases").alias("a")).groupBy("entity_id").agg(F.count_distinct(F.trim("a")).alias("n_aliases"))
    return t.orderBy(F.col("n_aliases").desc(), "entity_id").limit(5)


def first_seen_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null").groupBy("entity_id").agg(F.min("first_seen").alias("first_seen"))
    return S.monthly_counts(t, F.col("first_seen").try_cast("date")).withColumn("month", F.col("month").cast("string"))


def name_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and counts per list row, capped at 80 characters."""
    t = table(spark, sf_dir, "un_entity")
    return t.select("id", F.least(F.length("name"), F.lit(80)).alias("name_len"), F.size(F.split(F.trim("name"), "\\s+")).alias("name_words"), F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("n_aliases"), F.try_element_at("programs", F.lit(1)).alias("first_program"), F.col("listed_on").try_cast("date").cast("string").alias("listed_on"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with a stand-in truth: payments to accounts whose exposure starts at a direct hit."""
    x = table(spark, sf_dir, "exposure_index").where("best_depth <= 1").select(F.col("node_key").alias("account"))
    t = table(spark, sf_dir, "txn_event").where("txn_id is not null").groupBy("txn_id").agg(F.max(F.trim("bene_account")).alias("account"))
    v = _verdicts(spark, sf_dir).where("txn_id is not null").select("txn_id", F.col("combined_verdict").alias("verdict"), "channel").distinct()
    j = v.join(t, "txn_id").join(x.withColumn("listed", F.lit(True)), "account", "left")
    return j.select("txn_id", "verdict", "channel", F.coalesce("listed", F.lit(False)).alias("listed"))


def screen_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.screening_metrics(_labelled(spark, sf_dir), "channel")
    return m.withColumns({c: F.round(c, 4) for c in ("block_precision", "recall", "flag_recall", "over_block_rate", "review_rate")})


def verdict_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_labelled(spark, sf_dir), "listed", "verdict", ("MATCH", "REVIEW", "NO_MATCH"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.bootstrap(_labelled(spark, sf_dir), "txn_id", 300)
    return M.interval(b, "block_precision").unionByName(M.interval(b, "recall"))


def amount_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts at the index percentiles, both definitions, per channel."""
    v = table(spark, sf_dir, "txn_event").select("channel", "amount").where("channel is not null")
    out = None
    for p in (0.5, 0.95, 0.99):
        for rule in ("floor_n_minus_1", "floor_n"):
            r = M.index_percentile(v, "amount", p, "channel", rule).select("channel", F.lit(p).alias("p"), F.lit(rule).alias("rule"), "value")
            out = r if out is None else out.unionByName(r)
    return out


def _probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "exposure_index")
    return x.select(F.col("exposure_score").cast("double").alias("prob"), (F.col("reason").contains("sanctioned")).alias("listed")).where("prob is not null and listed is not null")


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.precision_recall(_probs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "flagged_share")})


def choose_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.choose_thresholds(M.precision_recall(_probs(spark, sf_dir)))


def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_curve(_probs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("mean_prob", "share_listed")})


def combine_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module results read from the dossiers (unreadable ones give none), combined per payment and decision."""
    module = "struct<verdict:string,applicable:boolean,reasons:array<string>>"
    v = _verdicts(spark, sf_dir).where("txn_id is not null").select("txn_id", F.from_json("dossier", f"name_result {module}, exposure_result {module}").alias("d"))
    parts = F.array(*[F.struct(F.lit(m).alias("module"), F.col(f"d.{m}_result.verdict").alias("verdict"), F.col(f"d.{m}_result.applicable").alias("applicable"), F.col(f"d.{m}_result.reasons").alias("reasons")) for m in ("exposure", "name")])
    r = v.select("txn_id", F.explode(parts).alias("m")).select("txn_id", "m.*").where("verdict is not null").distinct()
    return X.combine(r.withColumn("applicable", F.coalesce("applicable", F.lit(False)))).withColumn("reasons", F.array_join("reasons", "; "))


def dossier_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of the readable dossiers for an explanation, absent parts left out."""
    d = F.from_json("dossier", "combined_verdict string, status string, txn struct<amount:double,currency:string,rail:string>, name_result struct<verdict:string,score:double>, exposure_result struct<verdict:string,score:double>, reasons array<string>")
    x = _verdicts(spark, sf_dir).select("txn_id", d.alias("d")).where("d.combined_verdict is not null")
    line = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{label}: "), c.cast("string")))
    return x.select("txn_id", F.concat_ws("\n", line("verdict", F.col("d.combined_verdict")), line("status", F.col("d.status")), line("currency", F.col("d.txn.currency")), line("rail", F.col("d.txn.rail")), line("name", F.col("d.name_result.verdict")), line("exposure", F.col("d.exposure_result.verdict")), line("reasons", F.array_join("d.reasons", "; "))).alias("context")).distinct()


def miss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.dangerous_misses(_labelled(spark, sf_dir), "channel")
    return m.withColumns({c: F.round(c, 4) for c in ("block_precision", "recall_autoblock", "dangerous_miss_pct")})


def decision_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysts' decisions on reviewed payments: an earlier one per payment, replaced where a second look came later."""
    v = S.latest_per_key(_verdicts(spark, sf_dir).select("txn_id", "decided_at", "status", "amount"), "txn_id", ["decided_at", "status", "amount"]).where("status = 'review'")
    row = lambda hours, decision, who: v.select("txn_id", decision.alias("decision"), F.lit(who).alias("analyst"), (F.col("decided_at") + F.expr(f"interval {hours} hours")).alias("at"))
    first = row(1, F.lit("escalate"), "desk1")
    again = row(5, F.when(F.col("amount") >= 1000, "block").otherwise("release"), "desk2").where("pmod(length(txn_id) + ascii(substr(txn_id, -1)), 2) = 0")
    return S.upsert(first, again, "txn_id", ["at"]).withColumn("at", _stamp("at"))


def _ledger(spark: SparkSession, sf_dir: str) -> str:
    """A store in which every dataset was loaded in part, then in full, and a third load of one failed half-way."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    t = table(spark, sf_dir, "opensanctions_target").where("entity_id is not null")
    rows = t.select("dataset", "entity_id", F.trim("name").alias("name"), "entity_schema").distinct()
    keys = t.select("dataset", "entity_id").distinct()

    def broken() -> DataFrame:
        raise ValueError("the feed ended early")

    for d in ("sanctions", "peps", "crypto"):
        mine, ks = rows.where(F.col("dataset") == d), keys.where(F.col("dataset") == d)
        L.run(spark, root, d, {"entities": lambda m=mine: m.limit(10), "entity_keys": lambda k=ks: k.limit(10)})
        L.run(spark, root, d, {"entities": lambda m=mine: m, "entity_keys": lambda k=ks: k})
    try:
        L.run(spark, root, "peps", {"entities": lambda: rows.limit(1), "entity_keys": broken})
    except ValueError:
        pass
    return root


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers see after loads of several tables of which one failed: the last whole one of each source."""
    root = _ledger(spark, sf_dir)
    e = L.read(spark, root, "entities").select("source", "entity_id", "name", "entity_schema", "ingest_run_id")
    k = L.read(spark, root, "entity_keys").select("source", "entity_id", F.col("ingest_run_id").alias("k_run"))
    return e.join(k, ["source", "entity_id"]).select("source", "entity_id", "name", "entity_schema", (F.col("ingest_run_id") == F.col("k_run")).alias("one_run"))


def ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log of the same loads: runs, outcomes, rows written and errors per source."""
    g = L.log(spark, _ledger(spark, sf_dir)).groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "fail").alias("n_failed"), F.max("row_count").alias("most_rows"), F.max("error").alias("error"))


def exposure_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure rows written in two loads, the second over the first, through the store."""
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    x = table(spark, sf_dir, "exposure_index").where("node_key is not null").select("node_key", F.col("exposure_score").cast("double").alias("score"), "best_depth", "computed_at")
    order = ["computed_at", "score", "best_depth"]
    L.run(spark, root, "exposure", {"exposure": lambda: L.upsert_load(None, x.where("best_depth <= 1"), "node_key", order, reset=True)})
    new = x.where("best_depth >= 1").withColumn("score", F.col("score") / 2)
    L.run(spark, root, "exposure", {"exposure": lambda: L.upsert_load(L.read(spark, root, "exposure"), new, "node_key", order)})
    return L.read(spark, root, "exposure").select("node_key", F.round("score", 6).alias("score"), "best_depth")


QUERIES = (
    miss_metrics, decision_upsert, ledger_rows, ledger_audit, exposure_upsert, latest_verdict, verdict_upsert, status_counts, channel_verdict_counts, review_queue, verdict_page, node_risk_upsert, flagged_count, scoped_refresh, ingest_audit, ingest_totals, rows_per_run, entity_load, wallet_load,
    all_entities, wallet_currencies, schema_counts, country_counts, name_token_counts, alias_share, most_aliased, first_seen_monthly, name_profile, screen_metrics, verdict_confusion, bootstrap_ci, amount_percentiles,
    precision_recall, choose_thresholds, calibration_curve, combine_verdict, dossier_context,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_DOSSIER = "v as (select txn_id, case when json_valid(dossier) then dossier::json end as d from pipeline_verdict)"
_LINES = (("verdict", "d ->> 'combined_verdict'"), ("status", "d ->> 'status'"), ("currency", "d -> 'txn' ->> 'currency'"), ("rail", "d -> 'txn' ->> 'rail'"), ("name", "d -> 'name_result' ->> 'verdict'"), ("exposure", "d -> 'exposure_result' ->> 'verdict'"), ("reasons", "why"))
_TS = "strftime(({c}) at time zone 'UTC', '%Y-%m-%d %H:%M:%S')"
_LATEST = "lv as (select txn_id, decided_at, combined_verdict, status, channel, amount from pipeline_verdict where txn_id is not null qualify row_number() over (partition by txn_id order by decided_at desc nulls last, combined_verdict desc nulls last) = 1)"
_DEC = "dec as (select t.node_key, max(case when v.status = 'blocked' then 2 else 1 end) as d from (select distinct txn_id, trim(bene_account) as node_key from txn_event where trim(bene_account) <> '') t join pipeline_verdict v using (txn_id) where v.status in ('blocked', 'review') group by 1)"
_FLAG = f"""with {_DEC}, fl as (select coalesce(n.node_key, dec.node_key) as node_key, case when upper(n.risk_level) = 'SANCTIONED' or d = 2 then 'SANCTIONED' when d = 1 then 'SUSPICIOUS' else coalesce(upper(n.risk_level), 'NONE') end as risk_level,
  case when d is not null then 'analyst:desk1' else n.risk_source end as risk_source from graph_nodes n full join dec on n.node_key = dec.node_key)"""
_LAB = """lab as (select v.txn_id, v.verdict, v.channel, x.node_key is not null as listed from (select distinct txn_id, combined_verdict as verdict, channel from pipeline_verdict where txn_id is not null) v
  join (select txn_id, max(trim(bene_account)) as account from txn_event where txn_id is not null group by 1) t using (txn_id) left join (select node_key from exposure_index where best_depth <= 1) x on x.node_key = t.account)"""
_PR = """pr as (select exposure_score::double as prob, contains(reason, 'sanctioned') as listed from exposure_index where exposure_score is not null and reason is not null),
cu as (select prob as threshold, sum(n) over w / sum(n) over () as flagged_share, sum(tp) over w / sum(n) over w as precision, sum(tp) over w / greatest(1, sum(tp) over ()) as recall
  from (select prob, count(*) as n, count(*) filter (listed) as tp from pr group by 1) window w as (order by prob desc rows unbounded preceding))"""
_PEPS = "pl as (select id, entity_id, trim(name) as name from opensanctions_target where dataset = 'peps' and name is not null and entity_id is not null union all select id, dataset || '-' || (row_number() over (order by id) - 1), trim(name) from opensanctions_target where dataset = 'peps' and name is not null and entity_id is null)"
_WAL = "wl as (select distinct coalesce(entity_id, trim(name)) as entity_id, trim(name) as address, identifiers[1] as currency from opensanctions_target where entity_schema = 'CryptoWallet' and name is not null)"


def oracle_sql() -> dict[str, str]:
    share = lambda a, b: f"coalesce(count(*) filter ({a} and {b}) / nullif(count(*) filter ({b}), 0), 0)"
    block, flag = "verdict = 'MATCH'", "verdict in ('MATCH', 'REVIEW')"
    return {
        "latest_verdict": f"with {_LATEST} select * replace ({_TS.format(c='decided_at')} as decided_at) from lv",
        "verdict_upsert": f"with {_LATEST} select txn_id, {_TS.format(c="case when status = 'review' then decided_at + interval 1 hour else decided_at end")} as decided_at, case when status = 'review' then 'MATCH' else combined_verdict end as combined_verdict, case when status = 'review' then 'blocked' else status end as status, channel, amount from lv",
        "status_counts": "select status as value, count(*) as n from pipeline_verdict group by 1",
        "channel_verdict_counts": "select channel, combined_verdict, count(*) as n, round(avg(amount), 2) as avg_amount from pipeline_verdict group by 1, 2",
        "review_queue": f"select * replace ({_TS.format(c='decided_at')} as decided_at) from (select distinct txn_id, decided_at, bene_name from pipeline_verdict where status = 'review') order by decided_at desc nulls last, txn_id nulls first, bene_name nulls first limit 200",
        "verdict_page": "select * from (select distinct txn_id, status from pipeline_verdict) order by txn_id nulls first, status nulls first limit 100 offset 100",
        "node_risk_upsert": f"{_FLAG} select * from fl",
        "flagged_count": f"{_FLAG} select count(*) filter (risk_source like 'analyst:%') as n_flagged from fl",
        "scoped_refresh": "select dataset, count(*) as n_rows, count(distinct entity_id) as n_keys from opensanctions_target where dataset is null or dataset <> 'peps' or ingest_run_id = (select max(ingest_run_id) from opensanctions_target where dataset = 'peps') group by 1",
        "ingest_audit": "select source, max_by(id, (started_at, id)) as last_run, max_by(status, (started_at, id)) as last_status, max_by(id, (started_at, id)) filter (status = 'ok') as last_ok_run, count(*) filter (status = 'ok') = 0 as never_succeeded from ingest_run group by 1",
        "ingest_totals": "select source, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'fail') as n_fail, (sum(row_count) filter (status = 'ok'))::bigint as rows_ok, max(substring(error, 1, 1000)) as an_error from ingest_run group by 1",
        "rows_per_run": "select r.id, r.source, r.status, coalesce(c.n, 0) as n_rows from ingest_run r left join (select ingest_run_id, count(*) as n from (select ingest_run_id from opensanctions_target union all select ingest_run_id from un_entity) group by 1) c on c.ingest_run_id = r.id",
        "entity_load": f"with {_PEPS} select * from pl",
        "wallet_load": f"with {_WAL} select * from wl",
        "all_entities": f"with {_PEPS}, {_WAL} select kind, count(*) as n, count(distinct entity_id) as n_keys from (select entity_id, 'entity' as kind from pl union all select entity_id, 'wallet' from wl) group by 1",
        "wallet_currencies": f"with {_WAL} select currency as value, count(*) as n from wl group by 1",
        "schema_counts": "select case when entity_schema in ('Person', 'Organization', 'Company', 'LegalEntity', 'CryptoWallet', 'Vessel', 'Airplane') then entity_schema else 'Other' end as value, count(*) as n from opensanctions_target group by 1",
        "country_counts": "select country as value, count(*) as n from (select distinct entity_id, unnest(countries) as country from opensanctions_target) group by 1 order by n desc, value limit 20",
        "name_token_counts": f"select w as value, count(*) as n from (select unnest(regexp_extract_all(lower(name), '[a-zà-öø-ÿ]+')) as w from opensanctions_target) where length(w) > 2 and w not in {text.STOP_WORDS} group by 1 order by n desc, value limit 25",
        "alias_share": "select round(avg((len(coalesce(aliases, [])) > 0)::int::double), 6) as share_with_alias, max(len(coalesce(aliases, []))) as most_aliases from opensanctions_target",
        "most_aliased": "select entity_id, count(distinct trim(a)) as n_aliases from (select entity_id, unnest(aliases) as a from opensanctions_target where entity_id is not null) group by 1 order by n_aliases desc, entity_id limit 5",
        "first_seen_monthly": """with m as (select date_trunc('month', d)::date as month, count(*) as n from (select try_cast(min(first_seen) as date) as d from opensanctions_target where entity_id is not null group by entity_id) where d is not null group by 1),
s as (select unnest(generate_series(min(month), max(month), interval 1 month))::date as month from m) select month::varchar as month, coalesce(n, 0) as n, (sum(coalesce(n, 0)) over (order by month))::bigint as total from s left join m using (month)""",
        "name_profile": "select id, least(length(name), 80) as name_len, len(regexp_split_to_array(trim(name), '\\s+')) as name_words, len(coalesce(aliases, [])) as n_aliases, programs[1] as first_program, try_cast(listed_on as date)::varchar as listed_on from un_entity",
        "screen_metrics": f"with {_LAB} select channel, round({share('listed', block)}, 4) as block_precision, round({share(block, 'listed')}, 4) as recall, round({share(flag, 'listed')}, 4) as flag_recall, round(100 * {share(block, 'not listed')}, 4) as over_block_rate, round(100 * avg((verdict = 'REVIEW')::int), 4) as review_rate, count(*) as n_rows from lab group by 1",
        "verdict_confusion": f"""with {_LAB} select listed, count(*) filter (verdict = 'MATCH') as "MATCH", count(*) filter (verdict = 'REVIEW') as "REVIEW", count(*) filter (verdict = 'NO_MATCH') as "NO_MATCH" from lab group by 1""",
        "amount_percentiles": "with s as (select channel, list_sort(list(amount)) as l from txn_event where channel is not null and amount is not null group by 1), p as (select unnest([0.5, 0.95, 0.99])::double as p) select channel, p, rule, case when rule = 'floor_n' then l[least(len(l) - 1, floor(len(l) * p))::int + 1] else l[floor((len(l) - 1) * p)::int + 1] end as value from s, p, (select unnest(['floor_n_minus_1', 'floor_n']) as rule)",
        "miss_metrics": f"with {_LAB} select channel, round({share('listed', block)}, 4) as block_precision, round({share(block, 'listed')}, 4) as recall_autoblock, round(100 * {share("verdict = 'NO_MATCH'", 'listed')}, 4) as dangerous_miss_pct, count(*) as n_rows from lab group by 1",
        "decision_upsert": f"""with v as (select txn_id, decided_at, status, amount from pipeline_verdict where txn_id is not null qualify row_number() over (partition by txn_id order by decided_at desc nulls last, status desc nulls last, amount desc nulls last) = 1)
select txn_id, case when twice then case when amount >= 1000 then 'block' else 'release' end else 'escalate' end as decision, case when twice then 'desk2' else 'desk1' end as analyst, {_TS.format(c="decided_at + case when twice then interval 5 hours else interval 1 hour end")} as at
from (select *, (length(txn_id) + ascii(right(txn_id, 1))) % 2 = 0 as twice from v where status = 'review')""",
        "ledger_rows": "select distinct dataset as source, entity_id, trim(name) as name, entity_schema, true as one_run from opensanctions_target where entity_id is not null and dataset in ('sanctions', 'peps', 'crypto')",
        "ledger_audit": """with r as (select dataset, count(*) as n from (select distinct dataset, entity_id, trim(name), entity_schema from opensanctions_target where entity_id is not null) group by 1), k as (select dataset, count(distinct entity_id) as n from opensanctions_target group by 1)
select dataset as source, case when dataset = 'peps' then 3 else 2 end as n_runs, 2 as n_ok, case when dataset = 'peps' then 1 else 0 end as n_failed, greatest(r.n + k.n, least(r.n, 10) + least(k.n, 10)) as most_rows, case when dataset = 'peps' then 'the feed ended early' end as error from r join k using (dataset) where dataset in ('sanctions', 'peps', 'crypto')""",
        "exposure_upsert": """with x as (select node_key, exposure_score::double as score, best_depth, computed_at from exposure_index where node_key is not null),
a as (select * from x where best_depth <= 1 qualify row_number() over (partition by node_key order by computed_at desc nulls last, score desc nulls last, best_depth desc nulls last) = 1),
b as (select node_key, score / 2 as score, best_depth from x where best_depth >= 1 qualify row_number() over (partition by node_key order by computed_at desc nulls last, score desc nulls last, best_depth desc nulls last) = 1)
select coalesce(b.node_key, a.node_key) as node_key, round(case when b.node_key is not null then b.score else a.score end, 6) as score, case when b.node_key is not null then b.best_depth else a.best_depth end as best_depth from a full join b on a.node_key = b.node_key""",
        "calibration_curve": """with p as (select exposure_score::double as prob, contains(reason, 'sanctioned') as listed from exposure_index where exposure_score is not null and reason is not null),
c as (select quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts from p)
select len(list_filter(cuts, lambda x: x < prob))::int as bin, round(avg(prob), 6) as mean_prob, round(avg(listed::int), 6) as share_listed, count(*) as n from p, c group by 1""",
        "combine_verdict": f"""with {_DOSSIER}, m as (select distinct txn_id, module, r ->> 'verdict' as verdict, coalesce((r ->> 'applicable')::boolean, false) as ok, case when json_type(r -> 'reasons') = 'ARRAY' then (r -> 'reasons')::varchar[] else [] end as reasons
  from (select txn_id, unnest(['exposure', 'name']) as module, unnest([d -> 'exposure_result', d -> 'name_result']) as r from v where txn_id is not null) where json_type(r) = 'OBJECT' and r ->> 'verdict' is not null),
g as (select txn_id, coalesce(max(case verdict when 'MATCH' then 2 when 'REVIEW' then 1 else 0 end) filter (ok), 0) as k,
  flatten(list(list_transform(case when ok then reasons else [] end, lambda x: '[' || module || '] ' || x) order by module, list_transform(case when ok then reasons else [] end, lambda x: '[' || module || '] ' || x))) as reasons from m group by 1)
select txn_id, ['NO_MATCH', 'REVIEW', 'MATCH'][k + 1] as verdict, ['allowed', 'review', 'blocked'][k + 1] as status, array_to_string(reasons, '; ') as reasons from g""",
        "dossier_context": f"""with {_DOSSIER}, o as (select txn_id, d, case when json_type(d -> 'reasons') = 'ARRAY' then array_to_string((d -> 'reasons')::varchar[], '; ') end as why from v where d ->> 'combined_verdict' is not null)
select distinct txn_id, array_to_string(list_filter([{", ".join(f"'{label}: ' || nullif({c}, '')" for label, c in _LINES)}], lambda x: x is not null), chr(10)) as context from o""",
        "precision_recall": f"with {_PR} select threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(flagged_share, 6) as flagged_share from cu",
        "choose_thresholds": f"""with {_PR}, h as (select coalesce((select threshold from cu where precision >= 0.95 order by recall desc, threshold desc limit 1), (select threshold from cu order by 1.25 * precision * recall / (0.25 * precision + recall + 1e-9) desc, threshold desc limit 1)) as hi,
  coalesce((select max(threshold) from cu where recall >= 0.93), 0) as safe, coalesce((select min(threshold) from cu where flagged_share <= 0.10), (select max(threshold) from cu) + 1e-9) as queue), l as (select hi, least(greatest(safe, queue), hi) as low from h)
select round(hi, 4) as tau_high, round(case when low >= hi then hi * 0.5 else low end, 4) as tau_low from l""",
    }
