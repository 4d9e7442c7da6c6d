import datetime as dt

from lodesieve.operators.orphan_refs import References, orphan_references, orphan_report

T0 = dt.datetime(2026, 3, 1)


def frames(spark, children, parents, deleted):
    c = spark.createDataFrame(children, "id string, a string, b string, at timestamp, key string, born string")
    p = spark.createDataFrame(parents, "node string, created timestamp, key string")
    d = spark.createDataFrame(deleted, "node string, gone string")
    return orphan_references([References("t", c, "id", ("a", "b"), "at")], p, "node", "created", d, "node")


def test_kinds(spark):
    got = frames(
        spark,
        [("1", " n 1", "N2", T0, "x", "y"), ("1", " n 1", "N2", T0, "x", "y"), ("2", "n3", "N4", T0, None, None), ("3", None, " ", T0, None, None), ("4", "n5", "n6", None, None, None)],
        [("N1", T0 - dt.timedelta(1), "q"), ("N2", T0 + dt.timedelta(1), "q"), ("n5", T0, "q"), ("N3", None, "q"), (None, T0, "q")],
        [("N4", "z"), ("n 6", "z"), ("N2", "z"), (None, "z")],
    )
    rows = {tuple(r) for r in got.collect()}
    assert rows == {("t", "1", "b", "late", "2026-03"), ("t", "2", "b", "deleted", "2026-03"), ("t", "4", "b", "deleted", None)}
    assert {tuple(r) for r in orphan_report(got).collect()} == {("t", "b", "late", "2026-03", 1), ("t", "b", "deleted", "2026-03", 1), ("t", "b", "deleted", None, 1)}


def test_empty(spark):
    assert frames(spark, [], [], []).count() == 0
    assert frames(spark, [("1", "x", None, T0, "", "")], [], []).count() == 1


def test_hot_key(spark):
    rows = [(str(i), "HOT" if i % 3 else f"k{i}", None, T0, "", "") for i in range(3000)]
    got = frames(spark, rows, [(f"k{i}", T0, "") for i in range(0, 3000, 3)], [])
    assert got.count() == 2000
