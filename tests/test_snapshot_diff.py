import datetime as dt

from lodesieve.operators.snapshot_diff import choose_leaf_bits, snapshot_changes

RUN = "id long, source string, status string, started_at timestamp"
ROW = "k string, ingest long, name string, tags array<string>, digest string, leaf int"
T0 = dt.datetime(2026, 1, 1)


def runs(spark, *rows):
    return spark.createDataFrame([(i, s, st, T0 + dt.timedelta(days=d)) for i, s, st, d in rows], RUN)


def changes(spark, rs, rows, sources=("a",), **kw):
    t = spark.createDataFrame(rows, ROW)
    out = snapshot_changes(rs, {s: (t, "k", "ingest", ("name", "tags")) for s in sources}, **kw)
    return sorted(tuple(r) for r in out.collect())


def row(k, run, name="n", tags=None):
    return (k, run, name, tags, "clash", 1)


def test_kinds_order_by_time_and_failed_runs(spark):
    rs = runs(spark, (9, "a", "ok", 0), (3, "a", "ok", 5), (5, "a", "fail", 3), (7, "a", "running", 9))
    got = changes(spark, rs, [row("x", 9), row("y", 9), row("z", 9), row("x", 3), row("y", 3, "other"), row("w", 3), row("z", 5)])
    assert got == [("a", 3, "w", "added"), ("a", 3, "y", "changed"), ("a", 3, "z", "removed")]


def test_sets_blanks_and_nulls_are_no_change(spark):
    rs = runs(spark, (1, "a", "ok", 0), (2, "a", "ok", 1))
    got = changes(spark, rs, [row("x", 1, " n ", ["b", "a"]), row("x", 2, "n", ["a ", "b", "a", ""]), row("y", 1, None, None), row("y", 2, "", [])])
    assert got == []


def test_repeats_null_keys_and_runs(spark):
    rs = runs(spark, (1, "a", "ok", 0), (2, "a", "ok", 1))
    got = changes(spark, rs, [row("x", 1), row("x", 1), row("x", 2), row(None, 2), row(" ", 2), row("q", None), row("h", 99)])
    assert got == []


def test_empty_table_single_and_empty_delivery(spark):
    one = runs(spark, (1, "a", "ok", 0))
    assert changes(spark, one, [row("x", 1)]) == []
    three = runs(spark, (1, "a", "ok", 0), (2, "a", "ok", 1), (3, "a", "ok", 2))
    assert changes(spark, three, []) == []
    assert changes(spark, three, [row("x", 1), row("x", 3)]) == [("a", 2, "x", "removed"), ("a", 3, "x", "added")]


def test_brute_force(spark):
    import random

    rng = random.Random(5)
    rs = runs(spark, *[(i, "a", "ok", i) for i in range(1, 6)])
    state, rows, want = {f"k{i}": "v" for i in range(400)}, [], set()
    for run in range(1, 6):
        before = dict(state)
        if run > 1:
            for _ in range(12):
                k = f"k{rng.randrange(430)}"
                if k in state and rng.random() < 0.5:
                    state.pop(k)
                else:
                    state[k] = f"v{rng.random()}"
            for k in before.keys() | state.keys():
                kind = "added" if k not in before else "removed" if k not in state else "changed" if before[k] != state[k] else None
                if kind:
                    want.add(("a", run, k, kind))
        rows += [row(k, run, v) for k, v in state.items()]
    assert set(changes(spark, rs, rows, rows_per_leaf=4)) == want


def test_leaves_grow_with_the_table():
    assert choose_leaf_bits(10, 5) == 4
    assert choose_leaf_bits(10**12, 10) == 32
    assert choose_leaf_bits(10**6, 10) < choose_leaf_bits(10**8, 10)


def test_a_key_of_several_contents_of_which_a_middle_one_changes(spark):
    rs = runs(spark, (1, "a", "ok", 0), (2, "a", "ok", 1))
    for i in range(6):  # whichever content has the middle digest
        got = changes(spark, rs, [row("x", 1, f"n{j}") for j in range(6)] + [row("x", 2, "other" if i == j else f"n{j}") for j in range(6)])
        assert got == [("a", 2, "x", "changed")]
