"""Bounds of the vote hold, and leave out only candidates that can't have more than the least score."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_candidates import WORDS, names, tables

from lodesieve.functions import text
from lodesieve.operators import candidates as C
from lodesieve.operators import index as I
from lodesieve.operators import ml as L
from lodesieve.operators import payment_screening as P

LONG = [" ".join([w] * 2 + ["omar", "trading", "consulting", "construction", "national", "kaandelyar", "metals", w]) for w in WORDS[:5]]


def vote(spark):
    """Fitted so that names far from each other are hopeless."""
    r = random.Random(8)
    rows = []
    for _ in range(1200):
        f = {c: r.random() * 100 for c in P.FEATURES[:4]} | {c: r.random() for c in P.FEATURES[4:9]} | {c: float(r.randrange(1, 5)) for c in P.FEATURES[9:11]}
        f |= {"country_match": float(r.randrange(-1, 2)), "is_person": float(r.randrange(2)), "schema_compatible": 1.0, "matched_is_primary": float(r.randrange(2))}
        rows.append((*[f[c] for c in P.FEATURES], int(f["wratio"] > 88 - 4 * f["country_match"]), r.randrange(4)))
    data = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in P.FEATURES) + ", label int, part int")
    return L.vote_with(L.fit_members(data, P.FEATURES))


def stump():
    """A member of one tree: a good ratio and nearly the same letters."""
    m = L.ArrayMember.__new__(L.ArrayMember)
    m.kind, m.columns, m.scale, m.at, m.value, m.shares = "forest", P.FEATURES, np.ones(len(P.FEATURES)), np.array([0.0, 0.5, 1.0]), np.array([0.0, 0.0, 1.0]), [1.0]
    m.trees = [(np.array([2, -1, 3, -1, -1]), np.array([80.0, 0, 85.0, 0, 0]), np.array([1, 1, 3, 3, 4]), np.array([2, 1, 4, 3, 4]), np.array([0.0, 0, 0, 0, 1.0]))]
    return m


def test_bounds_hold_and_results_stay(spark, monkeypatch):
    v = vote(spark)
    a, b = names(60, 11) + LONG, names(90, 12) + LONG[:3]
    ids = [f"{k // 2:03d}" for k in range(len(b))]
    x = C.Index(pd.DataFrame({"entity_id": ids, "variant_ord": [k % 2 for k in range(len(b))], "variant_norm": b}), pd.DataFrame({"entity_id": sorted(set(ids)), "countries": None, "is_person": 1.0, "schema_compatible": 1.0}))
    w = C.Work(x, 3.0)
    a.sort(key=lambda t: -min(len(set(t.split())), C.WORDS))
    tokens = [list(dict.fromkeys(t for t in n.split() if len(t) > 1 and t not in text.STOP_WORDS)) for n in a]
    idf = [[1.0 + len(t) / 9 for t in ts] for ts in tokens]
    q, e, *_ = x.recall(tokens, idf, 30)
    n = C.Names(a, w.number)
    f = w.features(n, tokens, idf, q, e, True)
    odd = f.pop("odd")
    assert odd.any() and list(f.pop("row")) == list(range(len(q)))
    pair, i, j, start = w.variants(q, e)
    box = w.bounds(n, tokens, idf, i, j)
    for c, value in f.items():
        lo, hi = (np.broadcast_to(s, len(i)) for s in box[c])
        fine = ~odd | np.isin(c, ("wratio", "token_sort"))
        assert ((value >= np.minimum.reduceat(lo, start) - 1e-9) & (value <= np.maximum.reduceat(hi, start) + 1e-9))[fine].all(), c
    score = v.arrays(f | {"country_match": np.zeros(len(q))})
    most, closer = (np.maximum.reduceat(m(box), start) for m in (v.arrays.most, v.arrays.closer))
    assert (score <= closer + 1e-9)[~odd].all() and (closer <= most + 1e-9).all()
    one = stump()
    monkeypatch.setattr(L, "ArrayMember", lambda *_: one)
    near = L.ArrayVote({"forest": (None, None)})
    kept = w.features(n, tokens, idf, q, e, True, lambda bounds, dear=None: near.most(bounds) > near.least)["row"]
    lost = np.setdiff1d(np.arange(len(q)), kept)
    assert len(lost) > len(q) / 10 and (near(f | {"country_match": np.zeros(len(q))})[lost[~odd[lost]]] == near.least).all()


def test_the_vote_gives_what_it_gives_for_every_candidate(spark):
    payments, listed = tables(spark)
    v = vote(spark)
    run = lambda u: sorted((r.txn_id, r.verdict, round(r.score, 9), r.entity_id or "", str(r.reasons)) for r in P.screen(payments, listed, vote=u, high=0.6, low=0.2, top=40).collect())
    got = run(v)
    assert got == run(lambda rows: v(rows)) and len({r[2] for r in got}) > 3


def test_recalled_as_the_join_does(spark):
    _, listed = tables(spark)
    vs = I.variants(listed)
    idf = I.token_idf(vs, 60)
    asked = spark.createDataFrame([(n,) for n in names(40, 13)], "query_norm string").distinct()
    key = P.sim.phonetic("token")
    want = I.recall(asked.select(F.col("query_norm").alias("query_id"), F.col("query_norm").alias("query")), I.postings(vs, key), idf, 4.1, 8, key).select("query_id", "entity_id", "rank").collect()
    for block in (None, 13):
        got = C.recalled(P.query_side(asked, idf, 4.1), vs, 4.1, 8, block).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want
