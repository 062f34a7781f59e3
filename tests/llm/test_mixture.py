"""Entropy balancing against bisection over plain lists, and how near each source's words come to its target."""

import math
import random

from evidentia.llm import mixture


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    """By repeated sharing: what is above the cap goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def brute_rates(sizes, target, cap=3):
    low, high = -60.0, 60.0
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(cap, math.exp(min(2.0, mid * n / max(sizes)))) * n for n in sizes) < target:
            low = mid
        else:
            high = mid
    return [min(cap, math.exp(min(2.0, low * n / max(sizes)))) for n in sizes]


def test_rates_targets_and_nearness(spark):
    rng = random.Random(7)
    rows, sizes = [], {}
    for s, n in (("a", 12), ("b", 300), ("c", 40), (None, 25), ("d", 3)):
        for _ in range(n):
            k = int(rng.paretovariate(1.2) * 8)
            sizes.setdefault(s, []).append(k)
            rows.append((len(rows), s, "w " * k))
    found = mixture.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    again = mixture.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(rows)
    targets = brute_targets({s: sum(x) for s, x in sizes.items()})
    for s, own in sizes.items():
        mine = [r for r in found if r.source == s]
        assert all(abs(r.target - targets[s]) < 1e-6 * targets[s] for r in mine)
        by_size = dict(zip(own, brute_rates(own, targets[s])))
        assert all(abs(r.rate - by_size[r.size]) < 1e-3 for r in mine)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 1.001 for r in mine)
        if len(own) > 10:
            assert abs(sum(r.taken for r in mine) - targets[s]) <= max(3, 0.03 * targets[s])
