"""References to records that do not exist, are deleted, or arrived after the reference.

Parent keys, deletion log and child keys are put in one long form, grouped by key with map-side combine, and the groups
that lack a parent (or whose parent is younger than a reference) are kept. The references themselves are then matched
with these few keys; reports sum their counts by table, field and period.

Defined results: keys compare without white space and case; null or blank values are no references; a parent row
without a creation time counts as there from the beginning; several parent rows of one key count as of the earliest; a reference without its own time
can't be late and has a null period; rows delivered twice give one result row; empty tables give no rows. Only the
named columns are read, so further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = "1900-01-01 00:00:00"


@dataclass(frozen=True)
class References:
    """A table whose ``fields`` refer to parent keys; ``record_key`` names its rows and ``at`` their time."""

    table_name: str
    rows: DataFrame
    record_key: str
    fields: Sequence[str]
    at: str


def plain_key(c: Column) -> Column:
    """Without white space (no-break and zero-width blanks too) and case; null if nothing is left."""
    k = F.upper(F.regexp_replace(c.cast("string"), r"[\s\u00a0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]+", ""))
    return F.when(k != "", k)


def reference_rows(children: Sequence[References]) -> DataFrame:
    """(table_name, record_key, ref_field, key, at), one row per non-blank reference; the fields of a row come from one scan."""
    parts = []
    for c in children:
        d = c.rows
        refs = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), plain_key(d[f]).alias("key")) for f in c.fields]))
        parts.append(d.select(F.lit(c.table_name).alias("table_name"), d[c.record_key].cast("string").alias("record_key"), d[c.at].cast("timestamp").alias("at"), refs.alias("r")).select("table_name", "record_key", "r.ref_field", "r.key", "at"))
    return reduce(DataFrame.unionByName, parts).where("key is not null")


def suspect_keys(refs: DataFrame, parents: DataFrame, parent_key: str, parent_at: str, deleted: DataFrame | None, deleted_key: str | None) -> DataFrame:
    """(key, born, gone) of the keys that some reference finds absent or younger than itself. ``born`` is null without a
    parent row. The long form is summed per key on the map side, so a key that holds most rows costs one row per task."""
    none, false = F.lit(None).cast("timestamp"), F.lit(False)
    born = F.coalesce(parents[parent_at].cast("timestamp"), F.lit(EPOCH).cast("timestamp"))
    long = [
        parents.select(plain_key(parents[parent_key]).alias("key"), born.alias("born"), none.alias("first_ref"), false.alias("gone")),
        refs.select("key", none.alias("born"), F.coalesce("at", F.lit("9999-01-01").cast("timestamp")).alias("first_ref"), false.alias("gone")),
    ]
    if deleted is not None:
        long.append(deleted.select(plain_key(deleted[deleted_key]).alias("key"), none.alias("born"), none.alias("first_ref"), F.lit(True).alias("gone")))
    g = reduce(DataFrame.unionByName, long).where("key is not null").groupBy("key").agg(F.min("born").alias("born"), F.min("first_ref").alias("first_ref"), F.max("gone").alias("gone"))
    return g.where("first_ref is not null and (born is null or born > first_ref)").drop("first_ref")


def orphan_references(children: Sequence[References], parents: DataFrame, parent_key: str, parent_at: str, deleted: DataFrame | None = None, deleted_key: str | None = None) -> DataFrame:
    """(table_name, record_key, ref_field, orphan_kind, ref_period); orphan_kind is late, deleted or missing.

    The suspect keys are unique, so the second join can't multiply rows; a key that holds a large share of the references
    is split by the adaptive skew join, and Spark broadcasts the suspect side only if its measured size allows.
    """
    refs = reference_rows(children)
    bad = suspect_keys(refs, parents, parent_key, parent_at, deleted, deleted_key)
    kind = F.when(F.col("born") > F.col("at"), "late").when(F.col("born").isNotNull(), None).when(F.col("gone"), "deleted").otherwise("missing")
    return (
        refs.join(bad, "key")
        .withColumn("orphan_kind", kind)
        .where("orphan_kind is not null")
        .select("table_name", "record_key", "ref_field", "orphan_kind", F.date_format("at", "yyyy-MM").alias("ref_period"))
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per table, field, kind and period."""
    return orphans.groupBy("table_name", "ref_field", "orphan_kind", "ref_period").agg(F.count(F.lit(1)).alias("n_orphans"))
