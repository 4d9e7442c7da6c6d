import datetime as dt

from pyspark.sql import functions as F

from lodesieve.operators import metrics as M
from lodesieve.operators import screening as X
from lodesieve.operators import store as S

T0 = dt.datetime(2026, 1, 1)


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z"), (None, 9, "q")], "k string, at int, v string")
    assert {tuple(r) for r in S.latest_per_key(rows, "k", ["at"]).collect()} == {("a", 3, "y"), ("b", None, "z")}
    new = spark.createDataFrame([("a", 9, "n"), ("c", 1, "m"), ("c", 2, "o")], "k string, at int, v string")
    got = {tuple(r) for r in S.upsert(S.latest_per_key(rows, "k", ["at"]), new, "k", ["at"], keep_old=("v",)).collect()}
    assert got == {("a", 9, "y"), ("b", None, "z"), ("c", 2, "o")}


def test_flags_never_lower_a_sanctioned_node(spark):
    n = spark.createDataFrame([("a", "SANCTIONED", "list"), ("b", "NONE", None)], "node_key string, risk_level string, risk_source string")
    d = spark.createDataFrame([("a", "escalate", "x"), ("b", "escalate", "x"), ("c", "block", "x"), ("d", "clear", "x"), (None, "block", "x")], "node_key string, decision string, analyst string")
    assert {tuple(r) for r in S.flag_nodes(n, d).collect()} == {("a", "SANCTIONED", "analyst:x"), ("b", "SUSPICIOUS", "analyst:x"), ("c", "SANCTIONED", "analyst:x")}


def test_scoped_write(spark, tmp_path):
    p = str(tmp_path / "t")
    spark.createDataFrame([("a", 1), ("b", 2)], "scope string, v int").write.partitionBy("scope").parquet(p)
    S.write_scoped(spark.createDataFrame([("b", 3), ("c", 4)], "scope string, v int"), p, "scope")
    assert {(r.scope, r.v) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_percentiles_and_thresholds(spark):
    v = spark.createDataFrame([("g", float(i)) for i in range(1, 11)] + [("g", None)], "g string, v double")
    assert M.index_percentile(v, "v", 0.5, "g").first().value == 5.0
    assert M.index_percentile(v, "v", 0.5, "g", "floor_n").first().value == 6.0
    rows = spark.createDataFrame([(0.9, True)] * 19 + [(0.9, False)] + [(0.5, False)] * 60 + [(0.2, True)] + [(0.1, False)] * 119, "prob double, listed boolean")
    t = M.choose_thresholds(M.precision_recall(rows)).first()
    assert t.tau_high == 0.9 and t.tau_low == 0.45


def test_metrics_without_any_case(spark):
    r = M.screening_metrics(spark.createDataFrame([("NO_MATCH", False)], "verdict string, listed boolean")).first()
    assert (r.block_precision, r.recall, r.flag_recall, r.over_block_rate) == (0, 0, 0, 0)


def test_bootstrap_covers_the_estimate(spark):
    rows = spark.range(400).select(F.col("id"), F.when(F.col("id") % 4 == 0, "MATCH").otherwise("NO_MATCH").alias("verdict"), (F.col("id") % 8 < 3).alias("listed"))
    i = M.interval(M.bootstrap(rows, "id", 100), "block_precision").first()
    assert i.low <= 0.5 <= i.high and i.high - i.low < 0.4


def test_risk_values(spark):
    df = spark.createDataFrame([(500000.0, "RUB", "SWIFT", "ru"), (200.0, "USD", "card", "us"), (None, None, None, None), (-5.0, "USD", "card", "us")], "a double, c string, r string, o string")
    got = [r[0] for r in df.select(X.payment_risk(F.col("a"), F.col("c"), F.col("r"), F.col("o"))).collect()]
    assert got[:2] == [0.807, 0.08] and None not in got


def test_combine_takes_the_worst_applicable(spark):
    r = spark.createDataFrame([("t", "name", "REVIEW", True, ["n"]), ("t", "exposure", "MATCH", False, ["e"]), ("u", "name", "MATCH", False, None)], "txn_id string, module string, verdict string, applicable boolean, reasons array<string>")
    assert {(x.txn_id, x.verdict, x.status, tuple(x.reasons)) for x in X.combine(r).collect()} == {("t", "REVIEW", "review", ("[name] n",)), ("u", "NO_MATCH", "allowed", ())}


def test_monthly_counts_fill_gaps(spark):
    d = spark.createDataFrame([("2026-01-05",), ("2026-03-01",), ("2026-03-09",), (None,)], "d string")
    assert [(str(r.month), r.n, r.total) for r in S.monthly_counts(d, F.col("d").try_cast("date")).orderBy("month").collect()] == [("2026-01-01", 1, 1), ("2026-02-01", 0, 1), ("2026-03-01", 2, 3)]


def test_running_sums_and_quantiles_against_brute_force(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from lodesieve.operators import metrics as M

    rng = random.Random(4)
    rows = [(rng.choice("ab"), round(rng.random(), 2), rng.randrange(5)) for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, n int").repartition(7)
    one = df.groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {(r.g, r.v): r.upto_n for r in M.running_sums(one, ["n"], [F.col("v")], ["g"]).collect()}
    assert got == {(g, v): sum(n for a, b, n in rows if a == g and b <= v) for g, v, _ in rows}
    assert M.running_sums(one.limit(0), ["n"], [F.col("v")]).count() == 0
    cuts = M.quantiles(df, "v", [0.1, 0.5, 0.93]).first().cuts
    assert np.allclose(cuts, np.quantile([v for _, v, _ in rows], [0.1, 0.5, 0.93]))


def test_the_member_within_bounds_wins(spark):
    from lodesieve.operators import metrics as M

    cols = "name string, block_precision double, recall double, flag_recall double, over_block_rate double, review_rate double"
    rows = [("greedy", 0.9, 0.99, 1.0, 3.0, 5.0), ("b", 0.9, 0.8, 0.9, 0.5, 8.0), ("a", 0.9, 0.8, 0.9, 0.5, 8.0), ("slow", 0.99, 0.9, 0.99, 0.1, 31.0)]
    assert M.choose_member(spark.createDataFrame(rows, cols)).first().name == "a"
    assert M.choose_member(spark.createDataFrame(rows[:1] + rows[3:], cols)).first().name == "greedy"
