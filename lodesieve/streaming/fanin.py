"""Streams: sources, fan-out to module results, keyed fan-in with a timeout, live counts.

The fan-in keeps what has arrived per payment until all module results are there or a processing-time timeout passes,
then emits once. A late or repeated part of an emitted payment is dropped, and its state is kept no longer than the
watermark; nothing leaks. Missing results count as not applicable (fail open), or with ``on_timeout='review'`` as a review.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MODULES = ("name", "exposure")
RESULT = "txn_id string, module string, verdict string, applicable boolean, reasons array<string>, at timestamp"
OUT = "txn_id string, verdict string, status string, n_results int, timed_out boolean"


def files(spark: SparkSession, folder: str, schema: T.StructType | str, fmt: str = "json", per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """A folder of files as a stream; on a cluster with a broker, ``broker`` is the same for topics."""
    r = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (r.option("pathGlobFilter", glob) if glob else r).load(folder)


def broker(spark: SparkSession, servers: str, topic: str, schema: str, starting: str = "earliest") -> DataFrame:
    """A topic with JSON values (needs the connector on the class path)."""
    k = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).load()
    return k.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def replay(spark: SparkSession, payments: DataFrame, rate: int) -> DataFrame:
    """Endless stream that draws stored payments by a hash of the row number, with fresh ids and times. ``payments`` is
    numbered 0..n-1 in column ``n``."""
    total = payments.count()
    r = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    r = r.withColumn("n", F.pmod(F.xxhash64("value"), F.lit(max(1, total))))
    return r.join(payments, "n").withColumn("txn_id", F.format_string("RT%09d", "value")).withColumn("txn_ts", F.col("timestamp"))


def named(events: DataFrame) -> DataFrame:
    """Events that carry an id."""
    return events.where("txn_id is not null and trim(txn_id) <> ''")


def name_results(payments: DataFrame, exact: DataFrame) -> DataFrame:
    """Module result per payment by a stream-static join with the exact names (variant_norm, entity_id)."""
    from ..functions import text

    p = named(payments).withColumn("variant_norm", text.norm(F.col("bene_name")))
    j = p.join(exact, "variant_norm", "left")
    hit = F.col("entity_id").isNotNull()
    return j.select("txn_id", F.lit("name").alias("module"), F.when(hit, "REVIEW").otherwise("NO_MATCH").alias("verdict"), (F.coalesce("bene_name", F.lit("")) != "").alias("applicable"), F.when(hit, F.array(F.lit("exact name"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.col("received_at").alias("at"))


def exposure_results(payments: DataFrame, exposure: DataFrame, review: float = 0.30) -> DataFrame:
    key = F.coalesce(F.nullif(F.trim("bene_account"), F.lit("")), F.nullif(F.trim("wallet"), F.lit("")))
    x = exposure.select("node_key", F.col("exposure_score").cast("double").alias("score"), "best_depth")
    j = named(payments).withColumn("node_key", key).join(x, "node_key", "left")
    verdict = F.when(F.col("best_depth") == 0, "MATCH").when(F.col("score") >= review, "REVIEW").otherwise("NO_MATCH")
    return j.select("txn_id", F.lit("exposure").alias("module"), verdict.alias("verdict"), F.col("node_key").isNotNull().alias("applicable"), F.when(F.col("score") > 0, F.array(F.lit("exposure path found"))).otherwise(F.array().cast("array<string>")).alias("reasons"), F.col("received_at").alias("at"))


def _verdict(got: dict[str, tuple[str, bool]], timed_out: bool, on_timeout: str) -> tuple[str, str]:
    rank = {"NO_MATCH": 0, "REVIEW": 1, "MATCH": 2}
    worst = max((rank.get(v, 0) for v, ok in got.values() if ok), default=0)
    if timed_out and on_timeout == "review":
        worst = max(worst, 1)
    v = ("NO_MATCH", "REVIEW", "MATCH")[worst]
    return v, {"MATCH": "blocked", "REVIEW": "review", "NO_MATCH": "allowed"}[v]


def fan_in(parts: DataFrame, timeout: str = "5 seconds", late: str = "1 hour", on_timeout: str = "allow") -> DataFrame:
    """Module results (schema RESULT, module 'txn' for the payment itself) joined per payment; emits once. Of several
    results of a module the earliest counts among those that arrive together, else the one that came first."""
    ms = int(float(timeout.split()[0]) * 1000)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (txn,) = key
        if state.exists:
            payload, done = state.get
            got = {m: (v, ok == "1") for m, v, ok in (x.split("\x1f") for x in payload.split("\x1e") if x)}
        else:
            got, done = {}, False
        if state.hasTimedOut:
            if done or "txn" not in got:
                state.remove()
                return
            results = {m: r for m, r in got.items() if m != "txn"}
            v, s = _verdict(results, True, on_timeout)
            state.update(("", True))
            state.setTimeoutDuration(ms * 10)
            yield pd.DataFrame([(txn, v, s, len(results), True)], columns=["txn_id", "verdict", "status", "n_results", "timed_out"])
            return
        new = [r for pdf in batches for r in zip(pdf["at"], pdf["verdict"], pdf["applicable"], pdf["module"], strict=True) if r[3] is not None]
        for _, v, ok, m in sorted(new, key=lambda r: (pd.isna(r[0]), r[0] if not pd.isna(r[0]) else 0)):
            if m not in got:
                got[m] = (v or "NO_MATCH", bool(ok))
        if done:
            state.setTimeoutDuration(ms * 10)
            return
        if "txn" in got and all(m in got for m in MODULES):
            results = {m: r for m, r in got.items() if m != "txn"}
            v, s = _verdict(results, False, on_timeout)
            state.update(("", True))
            state.setTimeoutDuration(ms * 10)
            yield pd.DataFrame([(txn, v, s, len(results), False)], columns=["txn_id", "verdict", "status", "n_results", "timed_out"])
            return
        state.update(("\x1e".join(f"{m}\x1f{v}\x1f{int(ok)}" for m, (v, ok) in got.items()), False))
        state.setTimeoutDuration(ms)

    return named(parts).groupBy("txn_id").applyInPandasWithState(step, OUT, "payload string, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def joined(payments: DataFrame, names: DataFrame, exposures: DataFrame, wait: str = "10 seconds") -> DataFrame:
    """The event-time variant: chained left outer joins with watermarks; a payment is emitted with what came in time."""
    p = named(payments).select(F.col("txn_id"), F.col("received_at").alias("at")).withWatermark("at", wait)
    out = p
    for side, tag in ((names, "name"), (exposures, "exposure")):
        s = side.select(F.col("txn_id").alias(f"{tag}_id"), F.col("verdict").alias(f"{tag}_verdict"), F.col("at").alias(f"{tag}_at")).withWatermark(f"{tag}_at", wait)
        out = out.join(s, (F.col("txn_id") == F.col(f"{tag}_id")) & (F.col(f"{tag}_at") >= F.col("at") - F.expr(f"interval {wait}")) & (F.col(f"{tag}_at") <= F.col("at") + F.expr(f"interval {wait}")), "left_outer").drop(f"{tag}_id")
    return out


def first_deliveries(events: DataFrame, within: str = "3 days") -> DataFrame:
    """Payments once each: repeats within the watermark are dropped."""
    return named(events).withWatermark("received_at", within).dropDuplicatesWithinWatermark(["txn_id"])


def status_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def upsert_sink(path: str, key: str = "txn_id"):
    """A foreachBatch sink that is idempotent: each batch overwrites its own folder, readers take the last batch per key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return write


class Reloading:
    """A foreachBatch sink whose static side is swapped while the stream runs: before each batch the version is asked for, and
    the side is loaded again if it changed (a pointer file, a count of flags, the last run of a store). Each batch overwrites
    its own folder, so a repeated batch is written once; a failed reload keeps the side that was there."""

    def __init__(self, load: Callable[[], DataFrame], version: Callable[[], object], step: Callable[[DataFrame, DataFrame], DataFrame], path: str):
        self.load, self.version, self.step, self.path = load, version, step, path
        self.static: DataFrame | None = None
        self.seen: object = None
        self.reloads = 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        now = self.version()
        if self.static is None or now != self.seen:
            try:
                self.static, self.seen = self.load(), now
                self.reloads += 1
            except Exception:
                if self.static is None:
                    raise
        self.step(batch, self.static).write.mode("overwrite").parquet(f"{self.path}/batch={number:09d}")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table; returns the table. Batches without data are switched off for
    this run: with a processing-time timeout they would follow one another without end."""
    spark = stream.sparkSession
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(path)
