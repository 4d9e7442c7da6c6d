import json
import time

from lodesieve.streaming import fanin

AT = "2026-06-01T00:00:00Z"


def part(txn, module, verdict="NO_MATCH", applicable=True):
    return {"txn_id": txn, "module": module, "verdict": verdict, "applicable": applicable, "reasons": [], "at": AT}


def folder(tmp_path, rows):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(d)


def test_complete_parts_in_any_order(spark, tmp_path):
    rows = [
        part("t1", "name", "REVIEW"), part("t1", "exposure"), part("t1", "txn", applicable=False), part("t1", "name", "MATCH"),
        part("t2", "txn", applicable=False), part("t2", "exposure", "MATCH", False), part("t2", "name", "REVIEW", False),
        part(None, "txn"), part(" ", "txn"), part("t3", "txn", applicable=False), part("t3", "name", "MATCH"),
    ]
    s = fanin.files(spark, folder(tmp_path, rows), fanin.RESULT)
    out = fanin.drain(fanin.fan_in(s, "60 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    # t2: no result applies, so it is allowed; t3 still waits for a part
    assert {(r.txn_id, r.verdict, r.status, r.n_results, r.timed_out) for r in out.collect()} == {("t1", "REVIEW", "review", 2, False), ("t2", "NO_MATCH", "allowed", 2, False)}


def timed_out(spark, tmp_path, on_timeout):
    s = fanin.files(spark, folder(tmp_path, [part("t", "txn", applicable=False), part("t", "name"), part("orphan", "name", "MATCH")]), fanin.RESULT)
    name = f"out_{on_timeout}"
    q = fanin.fan_in(s, "1 seconds", on_timeout=on_timeout).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table(name).count() == 0:
            time.sleep(0.5)
    finally:
        q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_timeout_fails_open_or_to_review(spark, tmp_path):
    assert timed_out(spark, tmp_path, "allow") == [("t", "NO_MATCH", "allowed", 1, True)]
    (tmp_path / "b").mkdir()
    assert timed_out(spark, tmp_path / "b", "review") == [("t", "REVIEW", "review", 1, True)]


def test_upsert_sink_is_idempotent(spark, tmp_path):
    sink = fanin.upsert_sink(str(tmp_path / "s"))
    b = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "txn_id string, n int")
    sink(b, 3)
    sink(b, 3)
    assert spark.read.parquet(str(tmp_path / "s" / "batch=000000003")).count() == 2


def test_replay_draws_stored_payments(spark):
    p = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "n long, bene_name string")
    q = fanin.replay(spark, p, 50).writeStream.format("memory").queryName("replayed").start()
    try:
        end = time.time() + 40
        while time.time() < end and spark.table("replayed").count() < 20:
            time.sleep(0.5)
    finally:
        q.stop()
    rows = spark.table("replayed").collect()
    assert len(rows) >= 20 and {r.bene_name for r in rows} <= {f"n{i}" for i in range(5)} and len({r.txn_id for r in rows}) == len(rows)


def test_static_side_is_swapped_between_batches(spark, tmp_path):
    state = {"version": 1, "keys": ["a"], "broken": False}

    def load():
        if state["broken"]:
            raise OSError("gone")
        return spark.createDataFrame([(k, True) for k in state["keys"]], "txn_id string, listed boolean")

    sink = fanin.Reloading(load, lambda: state["version"], lambda b, side: b.join(side, "txn_id", "left").fillna(False, ["listed"]), str(tmp_path / "out"))
    (tmp_path / "in").mkdir()
    for n, (version, keys, broken) in enumerate([(1, ["a"], False), (1, ["a", "b"], False), (2, ["b"], False), (3, ["a"], True)]):
        state |= {"version": version, "keys": keys, "broken": broken}
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"txn_id": t, "n": n}) for t in "ab"))
        s = spark.readStream.schema("txn_id string, n int").json(str(tmp_path / "in"))
        s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.n, r.txn_id): r.listed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the second batch still has the first side; the third the new one; the fourth keeps it, as its load fails
    assert got == {(0, "a"): True, (0, "b"): False, (1, "a"): True, (1, "b"): False, (2, "a"): False, (2, "b"): True, (3, "a"): False, (3, "b"): True}
    assert sink.reloads == 2
