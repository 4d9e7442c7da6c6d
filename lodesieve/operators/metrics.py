"""Quality metrics, thresholds and resampling over scored, labelled rows. All are aggregations; no row list is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def share(part: Column, whole: Column) -> Column:
    """part / whole of counted rows, 0 if there is no whole."""
    return F.coalesce(F.count_if(part & whole) / F.nullif(F.count_if(whole), F.lit(0)), F.lit(0.0))


def screening_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Block precision, recall, flag recall, over-block and review rate (percent). ``rows``: (verdict, listed boolean)."""
    block, flag = F.col("verdict") == "MATCH", F.col("verdict").isin("MATCH", "REVIEW")
    bad = F.col("listed")
    return rows.groupBy(*by).agg(
        share(bad, block).alias("block_precision"), share(block, bad).alias("recall"), share(flag, bad).alias("flag_recall"),
        (100 * share(block, ~bad)).alias("over_block_rate"), (100 * F.avg((F.col("verdict") == "REVIEW").cast("double"))).alias("review_rate"), F.count(F.lit(1)).alias("n_rows"),
    )


def dangerous_misses(rows: DataFrame, *by: str) -> DataFrame:
    """Of listed rows the percentage that is let through, beside precision over all blocks and recall by blocks alone."""
    block, bad, free = F.col("verdict") == "MATCH", F.col("listed"), F.col("verdict") == "NO_MATCH"
    return rows.groupBy(*by).agg(share(bad, block).alias("block_precision"), share(block, bad).alias("recall_autoblock"), (100 * share(free, bad)).alias("dangerous_miss_pct"), F.count(F.lit(1)).alias("n_rows"))


def against_expected(rows: DataFrame, by: str) -> DataFrame:
    """Accuracy, misses of what should be stopped, friction for what shouldn't, and reviews, per value of ``by`` and over all
    (``by`` null). ``rows``: (expected, predicted)."""
    e, p = F.col("expected"), F.col("predicted")
    risky, clean = e.isin("MATCH", "REVIEW"), e == "NO_MATCH"
    return rows.rollup(by).agg(
        F.avg((e == p).cast("double")).alias("accuracy"), share(p == "NO_MATCH", risky).alias("dangerous_miss_rate"), share(p != "NO_MATCH", clean).alias("friction_rate"), F.avg((p == "REVIEW").cast("double")).alias("review_rate"), F.count(F.lit(1)).alias("n_rows"),
    )


def confusion(rows: DataFrame, actual: str, predicted: str, values: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(actual).pivot(predicted, list(values)).count().fillna(0, list(values))


def running_sums(rows: DataFrame, values: Sequence[str], order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """rows plus ``upto_<value>``: sums over all rows before and including a row in the order, within ``by``.

    No window over everything: rows are partitioned by ranges of (by, order), summed within each range, and the sums of the
    ranges before are added. One row per range is what is joined back; the table fixes the ranges."""
    keys = [F.col(c) for c in by] + list(order)
    r = cut(rows.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*(by or (F.lit(1),))).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = r.groupBy("_range", *by).agg(*[F.sum(v).alias(f"_{v}") for v in values])  # one row per range and group
    offsets = sums.select("_range", *by, *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    out = r.withColumns({f"upto_{v}": F.sum(v).over(inside) for v in values}).join(offsets, ["_range", *by])
    return out.select(*rows.columns, *[(F.col(f"upto_{v}") + F.col(f"_{v}")).alias(f"upto_{v}") for v in values])


def index_percentile(values: DataFrame, column: str, p: float, by: str, rule: str = "floor_n_minus_1") -> DataFrame:
    """(by, value): the element at int((n - 1) p), or with rule ``floor_n`` at min(n - 1, int(n p)), in sorted order.

    Found by ranks from counts per distinct value, so a group is never collected nor sorted in one task."""
    c = values.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(c, ["n"], [F.col("v")], [by]).join(c.groupBy(by).agg(F.sum("n").alias("total")), by)
    at = F.floor((F.col("total") - 1) * p) if rule == "floor_n_minus_1" else F.least(F.col("total") - 1, F.floor(F.col("total") * p))
    return r.where((F.col("upto_n") > at) & (F.col("upto_n") - F.col("n") <= at)).select(by, F.col("v").alias("value"))


def quantiles(values: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with the array ``cuts``: exact quantiles, interpolated between neighbours, from running counts per value."""
    c = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    r = running_sums(c, ["n"], [F.col("v")]).crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))  # one row

    def at(s: float) -> Column:
        place = (F.col("total") - 1) * s
        low, high = (F.min(F.when(F.col("upto_n") > f(place), F.col("v"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(place - F.floor(place))

    return r.agg(F.array(*[at(s) for s in shares]).alias("cuts"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """(threshold, precision, recall, flagged_share) at every distinct probability, from running counts per value."""
    c = rows.groupBy(F.col("prob").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.count_if("listed").alias("tp"))
    whole = c.agg(F.sum("n").alias("all_n"), F.sum("tp").alias("all_tp"))
    r = running_sums(c, ["n", "tp"], [F.col("threshold").desc()]).crossJoin(F.broadcast(whole))  # one row
    return r.select("threshold", (F.col("upto_tp") / F.col("upto_n")).alias("precision"), (F.col("upto_tp") / F.greatest("all_tp", F.lit(1))).alias("recall"), (F.col("upto_n") / F.col("all_n")).alias("flagged_share"))


def choose_thresholds(curve: DataFrame, precision: float = 0.95, recall: float = 0.93, budget: float = 0.10) -> DataFrame:
    """(tau_high, tau_low): the lowest cut that reaches the precision (else the best F0.5), and the more selective of the
    recall cut and the review budget, below tau_high."""
    f = (1.25 * F.col("precision") * F.col("recall")) / (0.25 * F.col("precision") + F.col("recall") + 1e-9)
    a = curve.agg(
        F.coalesce(F.max_by(F.when(F.col("precision") >= precision, F.col("threshold")), F.when(F.col("precision") >= precision, F.struct("recall", "threshold"))), F.max_by("threshold", F.struct(f, "threshold"))).alias("hi"),
        F.coalesce(F.max(F.when(F.col("recall") >= recall, F.col("threshold"))), F.lit(0.0)).alias("safe"), F.coalesce(F.min(F.when(F.col("flagged_share") <= budget, F.col("threshold"))), F.max("threshold") + 1e-9).alias("queue"),
    )
    low = F.least(F.greatest("safe", "queue"), "hi")
    return a.select(F.round("hi", 4).alias("tau_high"), F.round(F.when(low >= F.col("hi"), F.col("hi") * 0.5).otherwise(low), 4).alias("tau_low"))


def choose_member(candidates: DataFrame, most_over_block: float = 1.0, most_review: float = 12.0) -> DataFrame:
    """The candidate to use: of those within the bounds on over-blocking and review (percent), else of all, the one with the
    greatest sum of flag recall and F1; ties by name. ``candidates``: (name, metrics of ``screening_metrics``)."""
    p, r = F.col("block_precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    viable = (F.col("over_block_rate") <= most_over_block) & (F.col("review_rate") <= most_review)
    scored = candidates.withColumn("viable", viable).withColumn("merit", F.col("flag_recall") + f1)
    return scored.agg(F.min_by(F.struct(*scored.columns), F.struct((~F.col("viable")).alias("a"), (-F.round("merit", 12)).alias("b"), "name")).alias("x")).select("x.*")


def bootstrap(rows: DataFrame, id_column: str, replicates: int = 300) -> DataFrame:
    """(replicate, block_precision, recall): Poisson resampling. Every row draws its weight per replicate from a hash, so
    nothing is collected; rows are first counted by (verdict, listed) and replicate."""
    x = rows.select(id_column, "verdict", "listed", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = (F.pmod(F.xxhash64(id_column, "replicate"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    times = F.lit(0)
    bound, term = 0.0, 0.36787944117144233
    k = 0
    while bound + term < 1 - 0.25 / (1 << 30):  # as many steps as a draw of 30 bits can tell apart
        bound += term
        times = times + F.when(u > bound, 1).otherwise(0)
        k += 1
        term /= k
    c = x.withColumn("times", times).groupBy("replicate", "verdict", "listed").agg(F.sum("times").alias("n"))
    at = lambda c_: F.sum(F.when(c_, F.col("n")).otherwise(0))
    block, bad = F.col("verdict") == "MATCH", F.col("listed")
    return c.groupBy("replicate").agg(F.coalesce(at(block & bad) / F.nullif(at(block), F.lit(0)), F.lit(0.0)).alias("block_precision"), F.coalesce(at(block & bad) / F.nullif(at(bad), F.lit(0)), F.lit(0.0)).alias("recall"))


def interval(replicates: DataFrame, metric: str) -> DataFrame:
    return replicates.agg(F.lit(metric).alias("metric"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.025)).alias("low"), F.percentile(metric, F.lit(0.975)).alias("high"))


def calibration_curve(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, mean_prob, share_listed, n) over equally filled bins; their bounds are exact quantiles."""
    cuts = quantiles(rows, "prob", [i / bins for i in range(1, bins)])
    x = rows.crossJoin(F.broadcast(cuts)).withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("prob"))))  # one row of cuts
    return x.groupBy("bin").agg(F.avg("prob").alias("mean_prob"), F.avg(F.col("listed").cast("double")).alias("share_listed"), F.count(F.lit(1)).alias("n"))
