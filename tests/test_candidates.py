"""The sieve before scoring agrees with the scalar functions, over blocks too, and lets few candidates through."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_payment_screening import ENTITY, PAY, pay

from lodesieve.functions import similarity as sim
from lodesieve.operators import candidates as C
from lodesieve.operators import payment_screening as P

WORDS = "ali alii joseph josef po box a bin al trading tradng metals mtls omar umar zkvvvv kaandelyar consulting fee national x construction".split()


def names(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6, 9, 13)))) for _ in range(n)]


def test_columns_agree_with_the_scalar_functions():
    a, b = names(80, 1), names(80, 2)
    ids = [f"{k:03d}" for k in range(80)]
    x = C.Index(pd.DataFrame({"entity_id": ids, "variant_ord": 0, "variant_norm": b}), pd.DataFrame({"entity_id": ids, "countries": None, "is_person": 1.0, "schema_compatible": 1.0}))
    w = C.Work(x, 3.0)
    n = C.Names(a, w.number)
    i, j = np.repeat(np.arange(80), 80), np.tile(np.arange(80), 80)
    ratio, ts, m1, m2 = w.weighted(n, i, j, np.arange(len(i)), len(i))
    pairs = [(a[p], b[q]) for p, q in zip(i, j, strict=True)]
    assert np.allclose(ratio, [sim.weighted(*p) for p in pairs], rtol=0, atol=1e-9) and np.allclose(ts, [sim.token_sort(*p) for p in pairs], rtol=0, atol=1e-9)
    k = ~(n.odd[i] | w.v.odd[j])
    assert 0 < k.sum() < len(k)
    assert np.allclose(w.set_ratio(n, i[k], j[k], m1[k], m2[k]), [sim.token_set(*p) for p, t in zip(pairs, k, strict=True) if t], rtol=0, atol=1e-9)
    assert np.allclose(C.jaro_winkler(n.plain, i[k], w.v.plain, j[k]), [sim.jaro_winkler_of(*p) for p, t in zip(pairs, k, strict=True) if t], rtol=0, atol=1e-12)


def tables(spark):
    listed = spark.createDataFrame([(f"e{i:03d}", i, "Person", n, [m], None, None, None) for i, (n, m) in enumerate(zip(names(60, 5), names(60, 6), strict=True))], ENTITY)
    return spark.createDataFrame([pay(f"t{i}", n, "us") for i, n in enumerate(names(30, 7))], PAY), listed


def test_few_candidates_get_rows_and_the_results_stay(spark, monkeypatch):
    payments, listed = tables(spark)
    seen, features = [], P.features
    monkeypatch.setattr(P, "features", lambda pairs, *a: (seen.append(pairs.count()), features(pairs, *a))[1])
    rows = lambda **kw: sorted((r.txn_id, r.verdict, r.score, r.entity_id or "", str(r.reasons)) for r in P.screen(payments, listed, top=40, **kw).collect())
    all_ = [r[:4] for r in rows(vote=lambda f: f.withColumn("prob", F.col("raw")))]
    assert [r[:4] for r in rows()] == all_
    assert seen[1] < seen[0] / 5


def test_blocks_give_the_same(spark, monkeypatch):
    payments, listed = tables(spark)
    run = lambda: sorted((r.txn_id, r.verdict, r.score, r.entity_id or "", str(r.reasons)) for r in P.screen(payments, listed, top=10).collect())
    one = run()
    monkeypatch.setattr(C, "BLOCK", 13)
    assert run() == one
