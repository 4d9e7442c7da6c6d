"""The vote over arrays gives what the fitted pipelines give for rows."""

import random

import numpy as np

from lodesieve.operators import ml as L


def test_arrays_give_the_vote_of_rows(spark):
    r = random.Random(4)
    columns = ("a", "b", "c")
    data = [(r.random() * 100, float(r.randrange(3)), 1.0, r.randrange(4)) for _ in range(300)]
    rows = spark.createDataFrame([(a, b, c, int(a + 20 * b + r.random() * 30 > 80), part) for a, b, c, part in data], "a double, b double, c double, label int, part int")
    vote = L.vote_with(L.fit_members(rows, columns))
    got = vote(rows).select(*columns, "prob").collect()
    prob = vote.arrays({c: np.array([x[c] for x in got]) for c in columns})
    assert len({x.prob for x in got}) > 5 and np.allclose(prob, [x.prob for x in got], rtol=0, atol=1e-12)
