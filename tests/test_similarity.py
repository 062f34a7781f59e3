"""Nearest texts against all cosines."""

import numpy as np
from pyspark.sql import functions as F

from evidentia.operators import similarity


def texts(seed, n):
    rng = np.random.default_rng(seed)
    names = [f"t{i}" for i in range(300)]
    share = 1 / np.arange(1, 301) ** 0.8
    return [(i, "shared " + " ".join(rng.choice(names, size=int(rng.integers(1, 14)), p=share / share.sum()))) for i in range(n)]


def test_exact_top(spark, monkeypatch):
    rows = texts(41, 220) + [(900, "shared"), (901, "shared"), (902, ""), (903, None), (904, "alone entirely")]
    weights = similarity.terms(spark.createDataFrame(rows, "id long, text string")).persist()
    vectors = {}
    for r in weights.collect():
        vectors.setdefault(r.id, {})[r.term] = r.weight
    want = {}
    for i, a in vectors.items():
        scores = [(-round(sum(w * b.get(t, 0.0) for t, w in a.items()), 9), j) for j, b in vectors.items() if j != i]
        want[i] = [(j, -s) for s, j in sorted(x for x in scores if x[0] < 0)[:5]]
    for first in (similarity.FIRST, 3):
        monkeypatch.setattr(similarity, "FIRST", first)
        found = {i: [] for i in vectors}
        for r in similarity.neighbours(weights, weights).orderBy("id", "rank").collect():
            found[r.id].append((r.other, round(r.score, 9)))
        # sums of other order may differ in the last digit that counts
        for i in vectors:
            assert [s for _, s in found[i]] == [s for _, s in want[i]] or np.allclose([s for _, s in found[i]], [s for _, s in want[i]], atol=2e-9)
            assert {j for j, s in found[i] if s > want[i][-1][1] + 1e-8} == {j for j, s in want[i] if s > want[i][-1][1] + 1e-8}


def test_common_terms_make_no_pairs(spark):
    """A term in every text, twice as many texts: about twice as many pairs."""
    made = []
    for n in (200, 400):
        rows = [(i, f"everywhere group{i // 8} member{i // 8} part{i // 4}") for i in range(n)]
        weights = similarity.terms(spark.createDataFrame(rows, "id long, text string"))
        pairs, _ = similarity.candidates(weights, weights)
        made.append(pairs.count())
        assert pairs.where("floor(id / 8) != floor(other / 8)").count() == 0
    assert made[1] <= 2.1 * made[0]
