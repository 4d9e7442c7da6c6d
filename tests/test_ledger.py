import pytest

from lodesieve.operators import ledger as L


def rows(spark, *names):
    return spark.createDataFrame([(n, "clash", "clash") for n in names], "name string, source string, run string")


def seen(spark, root, table="t"):
    return sorted((r.source, r.name) for r in L.read(spark, root, table).collect())


def test_loads_are_whole_or_invisible(spark, tmp_path):
    root = str(tmp_path / "store")
    first = L.run(spark, root, "a", {"t": lambda: rows(spark, "x", "y"), "u": lambda: rows(spark, "p")})
    L.run(spark, root, "b", {"t": lambda: rows(spark, "z")})
    assert seen(spark, root) == [("a", "x"), ("a", "y"), ("b", "z")] and seen(spark, root, "u") == [("a", "p")]

    def broken():
        raise ValueError("e" * 5000)

    with pytest.raises(ValueError):
        L.run(spark, root, "a", {"t": lambda: rows(spark, "new"), "u": broken})
    assert seen(spark, root) == [("a", "x"), ("a", "y"), ("b", "z")] and seen(spark, root, "u") == [("a", "p")]
    second = L.run(spark, root, "a", {"t": lambda: rows(spark, "n"), "u": lambda: rows(spark)})
    assert seen(spark, root) == [("a", "n"), ("b", "z")] and seen(spark, root, "u") == []
    log = {r.run_id: r for r in L.log(spark, root).collect()}
    assert (log[first].status, log[first].row_count, log[second].row_count) == ("ok", 3, 1) and log[first].byte_count > 0
    assert [len(r.error) for r in log.values() if r.status == "fail"] == [1000]
    assert {r.ingest_run_id for r in L.read(spark, root, "t").where("source = 'a'").collect()} == {second}
    assert L.vacuum(spark, root, ["t", "u"]) == 2 and seen(spark, root) == [("a", "n"), ("b", "z")]


def test_upsert_loads_and_messages(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, at int")
    new = spark.createDataFrame([("b", 5, 2), ("b", 4, 1), ("c", 6, 1), (None, 7, 1)], "k string, v int, at int")
    assert {(r.k, r.v) for r in L.upsert_load(old, new, "k", ["at"]).collect()} == {("a", 1), ("b", 5), ("c", 6)}
    assert {(r.k, r.v) for r in L.upsert_load(old, new, "k", ["at"], reset=True).collect()} == {("b", 5), ("c", 6)}
    assert [(r.key, r.value) for r in L.messages(old.where("k = 'a'"), "k").collect()] == [("a", '{"k":"a","v":1,"at":1}')]
