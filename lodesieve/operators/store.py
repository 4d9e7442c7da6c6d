"""Stored results: upserts, scoped refresh, audit, counts. Upserts are latest-per-key aggregations with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order`` (nulls first); null keys are left out."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: Sequence[str], keep_old: Sequence[str] = ()) -> DataFrame:
    """Rows of ``old`` replaced by the latest of ``new``; columns in ``keep_old`` keep the value they had first."""
    n = latest_per_key(new, key, order)
    a, b = old.alias("a"), n.alias("b")
    cols = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in old.columns:
        if c != key:
            first, second = ("a", "b") if c in keep_old else ("b", "a")
            cols.append(F.when(F.col(f"{first}.{key}").isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}")).alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def flag_nodes(nodes: DataFrame, decisions: DataFrame) -> DataFrame:
    """(node_key, risk_level, risk_source): decisions (node_key, decision, analyst) on nodes. A block makes a node
    sanctioned, an escalation suspicious; a sanctioned node is never lowered, but the source is always noted."""
    d = decisions.where("node_key is not null").groupBy("node_key").agg(F.max(F.when(F.col("decision") == "block", 2).when(F.col("decision") == "escalate", 1).otherwise(0)).alias("d"), F.max("analyst").alias("analyst")).where("d > 0")
    j = nodes.select("node_key", F.upper("risk_level").alias("old"), F.col("risk_source").alias("old_source")).join(d, "node_key", "full")
    level = F.when((F.col("old") == "SANCTIONED") | (F.col("d") == 2), "SANCTIONED").when(F.col("d") == 1, "SUSPICIOUS").otherwise(F.coalesce("old", F.lit("NONE")))
    return j.select("node_key", level.alias("risk_level"), F.when(F.col("d").isNotNull(), F.concat(F.lit("analyst:"), "analyst")).otherwise(F.col("old_source")).alias("risk_source"))


def scoped_refresh(old: DataFrame, new: DataFrame, scope: str, values: Sequence[str]) -> DataFrame:
    """``old`` without the rows of the named scopes, plus ``new``: what a dynamic partition overwrite leaves."""
    return old.where(F.col(scope).isNull() | ~F.col(scope).isin(*values)).unionByName(new.where(F.col(scope).isin(*values)))


def write_scoped(new: DataFrame, path: str, scope: str) -> None:
    """Replace the partitions of the scopes that ``new`` holds, and no others."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Per source: the last run, the last finished one and whether none has ever finished."""
    ok = F.col("status") == "ok"
    return runs.groupBy("source").agg(F.max_by("id", F.struct("started_at", "id")).alias("last_run"), F.max_by("status", F.struct("started_at", "id")).alias("last_status"), F.max_by(F.when(ok, F.col("id")), F.when(ok, F.struct("started_at", "id"))).alias("last_ok_run"), (F.count_if(ok) == 0).alias("never_succeeded"))


def value_counts(rows: DataFrame, column: str | Column, top: int | None = None) -> DataFrame:
    c = rows.groupBy((F.col(column) if isinstance(column, str) else column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c if top is None else c.orderBy(F.col("n").desc(), F.col("value")).limit(top)


def monthly_counts(rows: DataFrame, day: Column) -> DataFrame:
    """(month, n, total): rows per month with empty months filled, and the running total (one row per month)."""
    from pyspark.sql import Window as W

    m = rows.select(F.trunc(day, "month").alias("month")).where("month is not null").groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    span = m.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    f = span.join(m, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))
    return f.withColumn("total", F.sum("n").over(W.orderBy("month").rowsBetween(W.unboundedPreceding, 0)))
