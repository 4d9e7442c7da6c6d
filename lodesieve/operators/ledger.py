"""Stored loads with an audit log: the write side of feeds and results.

A run writes every table of its source under ``<root>/<table>/source=<source>/run=<id>`` and then commits with one audit
record. Readers take, per source, the rows of the last run that the log calls ``ok``. So a source's tables change
together or not at all, a failed or lost run leaves nothing visible, and nothing that is being read is overwritten. The log
is append-only; ``vacuum`` deletes the data of runs that no reader can see any more.

Defined results: a source without a finished run has no rows; an empty load is a load (it removes the source's rows); rows
are stamped with ``ingest_run_id``; columns ``source`` and ``run`` of an input are replaced by those of the store.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _remove
from . import store as S

LOG = "run_id long, source string, status string, row_count long, byte_count long, error string, at timestamp, step int"


def _note(spark: SparkSession, root: str, run: int, source: str, status: str, step: int, rows: int | None = None, size: int | None = None, error: str | None = None) -> None:
    at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = spark.createDataFrame([(run, source, status, rows, size, (error or "")[:1000] or None, at, step)], LOG)
    row.coalesce(1).write.mode("append").parquet(f"{root}/_log")


def _size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(p).getLength()


def run(spark: SparkSession, root: str, source: str, loads: Mapping[str, Callable[[], DataFrame]]) -> int:
    """Load all tables of a source in one commit and return the run's id. An error is noted (its first 1,000 characters)
    and raised again; the rows that were visible before stay visible."""
    rid = uuid.uuid4().int >> 66
    _note(spark, root, rid, source, "running", 0)
    try:
        rows = size = 0
        for name, load in loads.items():
            path = f"{root}/{name}/source={source}/run={rid}"
            load().drop("source", "run").withColumn("ingest_run_id", F.lit(rid)).write.parquet(path)
            rows += spark.read.parquet(path).count()
            size += _size(spark, path)
    except Exception as e:
        _note(spark, root, rid, source, "fail", 1, error=str(e))
        raise
    _note(spark, root, rid, source, "ok", 1, rows, size)
    return rid


def log(spark: SparkSession, root: str) -> DataFrame:
    """Every run with its last status."""
    return S.latest_per_key(spark.read.schema(LOG).parquet(f"{root}/_log"), "run_id", ["step", "at"])


def visible(spark: SparkSession, root: str) -> DataFrame:
    """(source, run): the last finished run of each source."""
    return log(spark, root).where("status = 'ok'").groupBy("source").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run"))


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The visible rows of a table, with their source. The runs are partitions, so only visible ones are read; there is one
    per source."""
    runs = visible(spark, root)
    return spark.read.parquet(f"{root}/{table}").join(F.broadcast(runs.select("source", F.col("run").cast("long").alias("run"))), ["source", "run"], "left_semi").drop("run")


def vacuum(spark: SparkSession, root: str, tables: list[str]) -> int:
    """Delete the data of runs that are neither visible nor under way; returns how many. Runs are few: one per load."""
    keep = {(r.source, r.run) for r in visible(spark, root).collect()}
    gone = [(r.source, r.run_id) for r in log(spark, root).where("status <> 'running'").select("source", "run_id").collect() if (r.source, r.run_id) not in keep]
    for source, rid in gone:
        for t in tables:
            _remove(spark, f"{root}/{t}/source={source}/run={rid}")
    return len(gone)


def upsert_load(old: DataFrame | None, new: DataFrame, key: str, order: list[str], reset: bool = False) -> DataFrame:
    """What a load of ``new`` over ``old`` leaves: everything of ``new`` alone with ``reset``, else the latest per key."""
    return S.latest_per_key(new, key, order) if reset or old is None else S.upsert(old.select(*new.columns), new, key, order)


def messages(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): rows as keyed JSON messages, as a topic takes them."""
    return rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def to_topic(stream: DataFrame, key: str, servers: str, topic: str, checkpoint: str):
    """Write a stream as keyed messages with an idempotent producer. Needs the broker connector on the class path."""
    w = messages(stream, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return w.option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint).start()
