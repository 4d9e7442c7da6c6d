import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodesieve.llm.packing import VOCABULARY, pack, place, plan_packing, read_ranks, token_counter


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=120))
def test_every_piece_has_a_place_and_no_container_overflows(lengths):
    hist: dict[int, int] = {}
    rank = []
    for k in lengths:
        rank.append(hist.get(k, 0))
        hist[k] = hist.get(k, 0) + 1
    plan = plan_packing(hist, 40)
    c, p = place(plan, np.array(lengths, np.int64), np.array(rank, np.int64))
    assert len(set(zip(c.tolist(), p.tolist(), strict=True))) == len(lengths)
    load = np.bincount(c, lengths, max(1, plan.containers)) if len(lengths) else np.zeros(1)
    assert load.max() <= 40
    n = np.bincount(c, minlength=1)
    for k in set(c.tolist()):
        assert sorted(p[c == k].tolist()) == list(range(n[k]))


def test_little_room_is_left():
    rng = random.Random(1)
    hist: dict[int, int] = {}
    for _ in range(20_000):
        k = min(2048, max(1, int(rng.lognormvariate(5.5, 1))))
        hist[k] = hist.get(k, 0) + 1
    plan = plan_packing(hist, 2048)
    assert plan.used / (plan.containers * 2048) > 0.999


def test_a_third_of_one_length():
    plan = plan_packing({700: 100_000, 648: 50_000, 37: 11}, 2048)
    c, _ = place(plan, np.full(100_000, 700), np.arange(100_000))
    assert np.bincount(c).max() <= 2 and plan.containers == 50_001 or plan.used / plan.containers / 2048 > 0.99


@pytest.fixture(scope="module")
def packed(spark):
    texts = ["", None, "word " * 5000, "short text", "short text", "x" * 70_000, "ä" * 100]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2)], "doc_id long, text string, piece int, position int")
    return texts, pack(df, 2048).toPandas()


def test_texts_in_full_and_whole(packed):
    texts, g = packed
    count = token_counter(read_ranks(VOCABULARY))
    assert g.groupby("container_id").n_tokens.sum().max() <= 2048 and not g.duplicated(["container_id", "position"]).any()
    for i, t in enumerate(texts):
        mine = g[g.doc_id == i].sort_values("piece")
        assert mine.n_tokens.sum() == count(t) and (len(mine) == 1 or count(t) > 2048)
        assert mine.token_start.tolist() == [2048 * k for k in range(len(mine))]


def test_empty_table_and_only_empty_texts(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    assert pack(e).count() == 0
    z = pack(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).toPandas()
    assert set(z.container_id) == {0} and sorted(z.position) == [0, 1]


def test_long_texts_are_counted_in_parts():
    count = token_counter(read_ranks(VOCABULARY))
    import tiktoken

    from lodesieve.llm.packing import PATTERN

    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=read_ranks(VOCABULARY), special_tokens={})
    t = "some words, and 12 numbers  with\n\nbreaks " * 12_000
    assert count(t) == len(enc.encode_ordinary(t))
