"""All candidates are ranked: products with more solutions, combinations and survivors than the reference's bounds, against plain enumeration."""

import math
from itertools import product as cross

import numpy as np
import pytest

from evidentia.functions import units
from evidentia.operators import configure, ranking
from evidentia.sources import dims

AREA = 1.52 * 1.98
#: product_id, firmness, total_mm, weight_kg; whether it has a variant; layers: material, thickness_mm, density
PRODUCTS = [
    ((1, "Firm", 121, 24.0), True, [(m, 7.0 + 2 * (i % 4), None) for i, m in enumerate(list(dims.MATERIALS)[:11])]),
    ((2, "plush", 150, 26.0), True, [("memory_foam", None, None), ("hr_foam", None, 33.0), ("natural_latex", 25.0, None), ("felt_insulator", None, None), ("cover_fabric", None, 61.0)]),
    ((3, None, 90, None), True, [("hr_foam", 3.0, None)] * 8),
    ((4, "soft", 90, 30.0), False, [("hr_foam", 3.0, None), ("memory_foam", 9.0, None), ("natural_latex", 40.0, 77.0)]),
    ((5, "soft", 90, 900.0), True, [("hr_foam", 3.0, None)]),
    ((6, "medium", 100, 12.0), True, [("hr_foam", 5.0, 41.0), ("memory_foam", 95.0, 50.0)]),
    ((7, "firm", 3, 12.0), True, [("hr_foam", None, None), ("memory_foam", 95.0, None), ("hr_foam", None, None), ("polymer_grid", 1.0, 40.0)]),
]
SUPPORT = [(1, "hr_foam:60", 0.7), (1, "memory_foam:35", 0.2), (3, "hr_foam:28", 0.9)]


def solutions(total, layers):
    n, stated = len(layers), [None if t is None else max(1, round(t)) for _, t, _ in layers]
    grid = [t for t in dims.GRID if t <= max(10, total - 10 * (n - 1))]
    found = [x for x in cross(*(grid if t is None else (t,) for t in stated)) if sum(x) == total]
    if found:
        return found, total
    total = max(200, n) if total < n else total
    w = [max(1.0, t or 1.0) for _, t, _ in layers]
    extra = [(total - n) * x / sum(w) for x in w]
    taken = [1 + int(x) for x in extra]
    for i in sorted(range(n), key=lambda i: (-(extra[i] - int(extra[i])), i))[: total - sum(taken)]:
        taken[i] += 1
    return [tuple(taken)], total


def plain(row, sized, layers, bonus, limit):
    """Every combination of every solution, weighed at once."""
    _, named, total, weight = row
    found, total = solutions(total, layers)
    options = [dims.MATERIALS[m][0] if d is None else (round(d),) for m, _, d in layers]
    share = lambda m, d: dims.PRIOR[dims.MATERIALS[m][0].index(d)] if d in dims.MATERIALS[m][0] else 0.01
    densities = np.array(list(cross(*options)))
    priors = sum(np.array([math.log(share(m, d)) + math.log1p(4 * bonus.get(f"{m}:{d}", 0)) for d in densities[:, i]]) for i, (m, _, _) in enumerate(layers))
    normal = lambda o, p, s: -0.5 * ((o - p) / s) ** 2 - math.log(s * math.sqrt(2 * math.pi))
    target = next((x for n, x in units.FIRMNESS if named and n == named.lower()), None)
    scores, picked = [], []
    for taken in found:
        kg = AREA * densities @ np.array(taken) / 1000 if sized else None
        score = priors + (0 if target is None else normal(target, sum(dims.MATERIALS[m][3] * t / total for (m, _, _), t in zip(layers, taken, strict=True)), 0.18))
        keep = np.ones(len(densities), bool)
        if sized and weight is not None:
            keep, score = np.abs(kg - weight) <= max(2.0, weight * 0.25), score + normal(weight, kg, max(1.5, weight * 0.12))
        scores.append(score[keep])
        picked.append(densities[keep])
    scores, picked = np.concatenate(scores), np.concatenate(picked)
    if not len(scores):
        return [], 0
    order = np.lexsort((np.arange(len(scores)), -np.round(scores, 9)))[:limit]
    weights = np.exp(scores - scores.max())
    return [(i, int(at) + 1, weights[at] / weights.sum(), tuple(picked[at])) for i, at in enumerate(order, 1)], len(scores)


@pytest.mark.parametrize("support", [None, SUPPORT])
def test_all_candidates_are_ranked(spark, support):
    df = spark.createDataFrame([(*p, 1.0) for p, _, _ in PRODUCTS], "product_id long, firmness string, total_mm int, weight_kg double, price double")
    ls = spark.createDataFrame([(p[0], i, *x) for p, _, layers in PRODUCTS for i, x in enumerate(layers, 1)], "product_id long, position int, material string, thickness_mm double, density double")
    vs = spark.createDataFrame([(p[0], 1, 1520.0, 1980.0) for p, sized, _ in PRODUCTS if sized], "product_id long, ordinal int, width_mm double, length_mm double")
    plan = configure.planned(df, ls, vs, dims.materials(spark), "identity")
    found, limit = {}, 25
    for r in ranking.rank(plan, support and spark.createDataFrame(support, "product_id long, key string, share double"), limit).orderBy("product_id", "rank").collect():
        found.setdefault(r.product_id, []).append((r["rank"], int(r.place), r.posterior, tuple(r.picked)))
    survivors = {}
    for p, sized, layers in PRODUCTS:
        want, survivors[p[0]] = plain(p, sized, layers, {k: s for i, k, s in support or [] if i == p[0]}, limit)
        got = found.get(p[0], [])
        assert [(*x[:2], x[3]) for x in got] == [(*x[:2], x[3]) for x in want], p
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want]), p
    assert survivors[1] > 50_000 and survivors[2] > 1000 and survivors[5] == 0
    # what the bounded ranking misses
    assert max(x[1] for x in found[1]) > 1000
