"""What changed between consecutive full snapshots of a table.

Rows are reduced to (delivery, key, content digest) in one scan. Keys are hashed into leaf buckets. A leaf is a page of a
few keys with their digests, and carries the sum of the digests; leaves add up to inner nodes, inner nodes to a root per
delivery. The pages are written once, columnar, so that the comparison reads their digests alone. Two consecutive
deliveries are compared from the root downward: a level is read only below nodes that differed, and pages are opened only
where the digests of a leaf differ.

The sums don't depend on the order of rows and are kept in two 32-bit lanes so that they can't overflow. Rows repeated
within a delivery count once, before anything is summed.

Defined results: rows without key or delivery are ignored; a key that stands more than once in a delivery is represented by
the set of its contents; a delivery without rows removes every key; an empty table or a feed with fewer than two
deliveries gives no rows. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

FANOUT_BITS = 4


def canonical(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns in comparable form: lists as sorted sets of trimmed, non-blank items; text trimmed; null for empty."""
    out = []
    for c in columns:
        col = df[f"`{c}`"]
        if isinstance(df.schema[c].dataType, T.ArrayType):
            items = F.filter(F.transform(col.cast("array<string>"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
            out.append(F.coalesce(F.array_join(F.array_sort(F.array_distinct(items)), "\x1f"), F.lit("")))
        else:
            out.append(F.coalesce(F.trim(col.cast("string")), F.lit("")))
    return out


def keyed_digests(df: DataFrame, key: str, run: str, columns: Sequence[str], leaf_bits: int) -> DataFrame:
    """(run_id, record_key, digest, leaf) per row; projection only, no shuffle."""
    k = F.trim(df[f"`{key}`"].cast("string"))
    return (
        df.select(df[f"`{run}`"].cast("bigint").alias("run_id"), k.alias("record_key"), F.xxhash64(F.concat_ws("\x1e", *canonical(df, columns))).alias("digest"))
        .where("run_id is not null and record_key is not null and record_key <> ''")
        .withColumn("leaf", F.shiftrightunsigned(F.xxhash64("record_key"), 64 - leaf_bits))
    )


def deliveries(runs: DataFrame, sources: Sequence[str], status: str = "ok") -> DataFrame:
    """(source, run_id, seq): the finished deliveries of each source in order of started_at, ties by id. A small table:
    one row per delivery, partitioned by source."""
    from pyspark.sql import Window as W

    w = W.partitionBy("source").orderBy("started_at", "run_id")
    return (
        runs.where((F.col("status") == status) & F.col("source").isin(*sources) & F.col("id").isNotNull())
        .select("source", F.col("id").cast("bigint").alias("run_id"), "started_at")
        .withColumn("seq", F.row_number().over(w))
        .drop("started_at")
    )


def choose_leaf_bits(rows: int, n_deliveries: int, rows_per_leaf: int = 16) -> int:
    """Leaves grow with the table, so that a leaf keeps about ``rows_per_leaf`` rows of a delivery at any scale."""
    per_delivery = max(1, rows // max(1, n_deliveries))
    bits = math.ceil(math.log2(max(2, per_delivery / rows_per_leaf)))
    return min(32, max(FANOUT_BITS, FANOUT_BITS * math.ceil(bits / FANOUT_BITS)))


def estimated_rows(df: DataFrame, bytes_per_row: int = 256) -> int:
    """Rows of a table by the size that Spark's statistics give, without reading it. It decides the depth of the tree only."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // bytes_per_row


def _lanes(h: Column) -> list[Column]:
    return [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"), F.sum(F.shiftrightunsigned(h, 32)).alias("hi")]


def pages(rows: DataFrame) -> DataFrame:
    """(source, seq, node, lo, hi, keys): the leaves of every delivery. A key's contents are made distinct and summed on the
    map side first, so a key or delivery of any frequency is small when it is grouped; a page has a leaf's keys only."""
    once = rows.select("source", "seq", F.col("leaf").alias("node"), "record_key", "digest").distinct()
    per_key = once.groupBy("source", "seq", "node", "record_key").agg(*_lanes(F.xxhash64("record_key", "digest")))
    return per_key.groupBy("source", "seq", "node").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.collect_list(F.struct("record_key", "lo", "hi")).alias("keys"))


def _differing(level: DataFrame) -> DataFrame:
    """(source, pair, node) whose digests differ between delivery ``pair`` and the one before it."""
    signed = level.select("source", "node", F.explode(F.array(F.struct(F.col("seq").alias("pair"), F.lit(1).alias("sign")), F.struct((F.col("seq") + 1).alias("pair"), F.lit(-1).alias("sign")))).alias("s"), "lo", "hi")
    g = signed.groupBy("source", F.col("s.pair").alias("pair"), "node").agg(*[F.sum(F.col(c) * F.col("s.sign")).alias(c) for c in ("lo", "hi")], F.sum("s.sign").alias("n"))
    return g.where("lo <> 0 or hi <> 0 or n <> 0").select("source", "pair", "node")


def differing_leaves(leaves: DataFrame, leaf_bits: int) -> DataFrame:
    """Top-down comparison. Each level is summed from the one below it, once; on the way down only nodes under a differing
    parent are differenced at all."""
    levels = [leaves.select("source", "seq", "node", "lo", "hi")]
    for _ in range(FANOUT_BITS, leaf_bits + 1, FANOUT_BITS):
        up = levels[-1].groupBy("source", "seq", F.shiftrightunsigned("node", FANOUT_BITS).alias("node")).agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
        levels.append(cut(up))
    found = _differing(levels.pop())
    while levels:
        level = levels.pop()
        under = found.select("source", F.explode(F.array("pair", F.col("pair") - 1)).alias("seq"), F.col("node").alias("up")).distinct()
        below = level.withColumn("up", F.shiftrightunsigned("node", FANOUT_BITS)).join(under, ["source", "seq", "up"], "left_semi").drop("up")
        # a delivery next to a differing pair comes along; its other pair is shut out again by the parents
        parents = found.withColumnRenamed("node", "up")
        found = cut(_differing(below).withColumn("up", F.shiftrightunsigned("node", FANOUT_BITS)).join(parents, ["source", "pair", "up"], "left_semi").drop("up"))
    return found


def snapshot_changes(runs: DataFrame, feeds: Mapping[str, tuple[DataFrame, str, str, Sequence[str]]], rows_per_leaf: int = 8) -> DataFrame:
    """(source, ingest_run_id, record_key, change_kind) for every delivery but the first of each source.

    ``feeds`` maps a source name to (table, key column, run column, compared columns); sources that share a table share
    its scan. ``change_kind`` is added, removed or changed.
    """
    seq = cut(deliveries(runs, list(feeds)))
    n_deliveries = seq.count()
    distinct = {id(t): (t, key, run, tuple(cols)) for t, key, run, cols in feeds.values()}
    bits = choose_leaf_bits(sum(estimated_rows(t) for t, *_ in distinct.values()), n_deliveries, rows_per_leaf)
    # one row per delivery: a few hundred at most, whatever the size of the tables
    known = F.broadcast(seq) if n_deliveries <= 10_000 else seq
    parts = []
    for t, key, run, cols in distinct.values():
        mine = [s for s, f in feeds.items() if f[0] is t]
        parts.append(keyed_digests(t, key, run, cols, bits).join(known.where(F.col("source").isin(*mine)), "run_id"))
    leaves = cut(pages(reduce(DataFrame.unionByName, parts)))
    dirty = differing_leaves(leaves, bits)
    sides = []
    for now in (True, False):
        pair = F.col("seq") if now else F.col("seq") + 1
        page = leaves.select("source", pair.alias("pair"), "node", "keys").join(dirty, ["source", "pair", "node"], "left_semi")
        sides.append(page.select("source", "pair", F.inline("keys")).withColumn("now", F.lit(now)))
    at = lambda c, now: F.max(F.when(F.col("now") == F.lit(now), F.col(c)))
    g = sides[0].unionByName(sides[1]).groupBy("source", "pair", "record_key").agg(*[at(c, now).alias(f"{c}_{n}") for c in ("lo", "hi") for n, now in (("now", True), ("old", False))])
    kind = F.when(F.col("lo_old").isNull(), "added").when(F.col("lo_now").isNull(), "removed").when((F.col("lo_now") != F.col("lo_old")) | (F.col("hi_now") != F.col("hi_old")), "changed")
    # the first delivery has none before it, the last none after it
    later = known.where("seq > 1").select("source", F.col("seq").alias("pair"), F.col("run_id").alias("ingest_run_id"))
    return g.withColumn("change_kind", kind).where("change_kind is not null").join(later, ["source", "pair"]).select("source", "ingest_run_id", "record_key", "change_kind")
