import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import configure, graph, records, resolve, thermal
from evidentia.sources import dims


def demo(spark):
    products = spark.createDataFrame(
        [(1, "Medium Firm", 200, 19.0, 1.0), (2, "Medium", 180, 23.0, 1.0), (3, "Firm", 150, 28.0, 1.0)], "product_id long, firmness string, total_mm int, weight_kg double, price double"
    )
    layers = spark.createDataFrame(
        [(1, 1, "memory_foam", 50.0, None), (1, 2, "hr_foam", 150.0, None), (2, 1, "natural_latex", 60.0, 75.0), (2, 2, "hr_foam", 120.0, 40.0), (3, 1, "quilt_foam", 20.0, 22.0), (3, 2, "rebonded_foam", 130.0, 90.0)],
        "product_id long, position int, material string, thickness_mm double, density double",
    )
    variants = spark.createDataFrame([(i, 1, 1520.0, 1980.0) for i in (1, 2, 3)], "product_id long, ordinal int, width_mm double, length_mm double")
    return products, layers, variants


@pytest.mark.parametrize(("mode", "expected"), [("reference", [0.540624, 0.425917, 0.033459]), ("identity", [0.602853, 0.255071, 0.142076])])
def test_demo_catalogue(spark, mode, expected):
    plan = configure.planned(*demo(spark), dims.materials(spark), normalization=mode)
    kept = {r.product_id: r["count"] for r in configure.candidates(plan)[0].groupBy("product_id").count().collect()}
    assert kept == {1: 3, 2: 1}
    ranked = configure.rank(plan).where("product_id = 1").orderBy("rank").collect()
    assert [r.posterior for r in ranked] == pytest.approx(expected, abs=1e-6)


def test_largest_remainder(spark):
    products, layers, variants = demo(spark)
    found = configure.generate(products.where("product_id = 1").withColumn("total_mm", F.lit(301)), layers, variants.where("false"), dims.materials(spark))
    assert {tuple(r.taken) for r in found.select("taken").distinct().collect()} == {(76, 225)}


def test_constant_paths(spark):
    found = spark.range(1).select(thermal.constant_path(F.lit(2.8)).alias("p2"), thermal.constant_path(F.lit(2.25)).alias("p4")).first()
    assert (round(found.p2, 4), round(found.p4, 4)) == (29.6957, 30.3333)


def test_keep_best_takes_first_of_equals(spark):
    rows = spark.createDataFrame([("a", 0.5, 1), ("a", 0.9, 2), ("a", 0.9, 3)], "k string, c double, o int")
    assert [r.o for r in records.keep_best(rows, ["k"], "c", "o").collect()] == [2]
    assert [r.o for r in records.last_wins(rows, ["k"], "o").collect()] == [3]


def test_traversal_is_bounded(spark):
    g = graph.edges(spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("c", "R", "a"), ("a", "R", "b")], "source string, relation string, target string"))
    assert g.count() == 3
    assert graph.traverse(g, "a", 2).count() == 2
    assert graph.traverse(g, "a", 9).count() == 3
    assert graph.traverse(g, "a", 2, ["X"]).count() == 0


def test_resolution_is_greedy(spark):
    rows = spark.createDataFrame([(1, "c", "b", "Ortho Support Deluxe", 1), (2, "c", "b", "Ortho Support Delux", 2), (3, "c", "b", "Latex Cloud", 3), (4, "x", "b", "Ortho Support Deluxe", 4)], "product_id long, company string, brand string, name string, ordinal long")
    found = {r.product_id: r.entity_id for r in resolve.resolve(rows).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_ledger_keeps_first_ending(spark):
    rows = spark.createDataFrame([(1, 1, "j", "create"), (2, 2, "j", "claim"), (3, 3, "j", "fail"), (4, 4, "j", "complete"), (5, 5, "k", "claim")], "event_id long, ts long, job string, action string")
    assert [(r.job, r.status, r.attempts) for r in records.ledger(rows).collect()] == [("j", "failed", 1)]


def test_default_stack_matches_plain_enumeration(spark):
    """Products without layers get three foams of unknown measures; the mass constraint drops combinations but keeps their numbers."""
    from itertools import product as cross

    products = spark.createDataFrame([(1, "Firm", 100, None, 1.0), (2, "Firm", 100, 12.0, 1.0)], "product_id long, firmness string, total_mm int, weight_kg double, price double")
    layers = spark.createDataFrame([], "product_id long, position int, material string, thickness_mm double, density double")
    variants = spark.createDataFrame([(i, 1, 1520.0, 1980.0) for i in (1, 2)], "product_id long, ordinal int, width_mm double, length_mm double")
    found: dict[int, list] = {1: [], 2: []}
    for r in configure.generate(products, layers, variants, dims.materials(spark), normalization="identity").orderBy("product_id", "place").collect():
        found[r.product_id].append((r.enumerated, tuple(r.taken), tuple(r.picked)))
    grid = [t for t in dims.GRID if t <= 80]
    densities = [dims.MATERIALS[m][0] for m in ("quilt_foam", "memory_foam", "hr_foam")]
    stacks = [t for t in cross(grid, grid, grid) if sum(t) == 100]
    every = [(n, t, d) for n, (t, d) in enumerate(cross(stacks, cross(*densities)), 1)]
    kg = lambda t, d: 1.52 * 1.98 * sum(a / 1000 * b for a, b in zip(t, d, strict=True))
    assert found[1] == every[:1000]
    assert found[2] == [x for x in every if abs(kg(x[1], x[2]) - 12.0) <= 3.0][:1000]


def test_stacks_of_any_height_match_plain_enumeration(spark):
    from itertools import product as cross

    products = spark.createDataFrame([(i, "Firm", 80, None, 1.0) for i in (1, 4, 5)], "product_id long, firmness string, total_mm int, weight_kg double, price double")
    names = ["quilt_foam", "memory_foam", "hr_foam", "memory_foam", "hr_foam"]
    layers = spark.createDataFrame([(n, i + 1, names[i], 20.0 if i == 1 else None, None if i in (0, 3) else 30.0 + i) for n in (1, 4, 5) for i in range(n)], "product_id long, position int, material string, thickness_mm double, density double")
    variants = spark.createDataFrame([(i, 1, 1520.0, 1980.0) for i in (1, 4, 5)], "product_id long, ordinal int, width_mm double, length_mm double")
    found: dict[int, list] = {1: [], 4: [], 5: []}
    plan = configure.planned(products, layers, variants, dims.materials(spark), normalization="identity")
    candidates = configure.decoded(*configure.candidates(plan), plan)
    for r in candidates.orderBy("product_id", "place").collect():
        found[r.product_id].append((r.enumerated, tuple(r.taken), tuple(r.picked)))
    for n in (1, 4, 5):
        grid = [t for t in dims.GRID if t <= max(10, 80 - 10 * (n - 1))]
        stacks = [t for t in cross(*[[20] if i == 1 else grid for i in range(n)]) if sum(t) == 80][:1000]
        densities = [dims.MATERIALS[names[i]][0] if i in (0, 3) else (30 + i,) for i in range(n)]
        assert found[n] == [(k, t, d) for k, (t, d) in enumerate(cross(stacks, cross(*densities)), 1)][:1000]
    assert {len(r.taken) for r in configure.rank(plan).where("product_id = 5").collect()} == {5}


def test_screen_counts_as_steps_do(spark):
    """Closed forms against the recurrence itself, also where next to no resistance makes the path swing."""
    from evidentia.operators import thermal

    rng = random.Random(5)
    stacks = [[(rng.choice((5, 40, 150)), rng.randint(8, 260), rng.choice((0.038, 0.12, 0.2)), rng.choice((500.0, 1400.0))) for _ in range(rng.randint(1, 4))] for _ in range(40)] + [[(1, 10, 0.2, 500.0)], [(10, 10, 50.0, 500.0)]]
    rows = [(i, 1, [dict(conductivity=k, heat=h) for _, _, k, h in s], [x[0] for x in s], [x[1] for x in s]) for i, s in enumerate(stacks)]
    got = thermal.screen(spark.createDataFrame(rows, "product_id int, place int, stack array<struct<conductivity double, heat double>>, taken array<int>, picked array<int>")).collect()
    assert len(got) == len(stacks)
    for r in got:
        room = 0.18 / sum(t / 1000 / k for t, _, k, _ in stacks[r.product_id])
        heat = max(100.0, 0.18 * sum(t / 1000 * d * h for t, d, _, h in stacks[r.product_id]))
        now, path = 25.0, [25.0]
        for _ in range(4320):
            now += (1.8 * (37 - now) - room * (now - 25)) * 5 / heat
            path.append(now)
        if abs(now) < 1e6:
            assert abs(r.comfort_minutes * 12 - sum(28 <= x <= 32 for x in path)) < 1e-6
            assert abs(r.final_c - sum(path[-181:]) / 181) < 1e-6
