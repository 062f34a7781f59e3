"""Candidate stacks: three layers against SQL, whole stacks against plain enumeration."""

from itertools import islice, product as cross

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import units
from evidentia.operators import configure, thermal
from evidentia.sources import dims, views
from evidentia.sources.views import view

from test_registry import SF, TABLES, plain

views_of_three = views.VIEWS | {"v_stacks": f"SELECT * FROM ({views.VIEWS['v_layers']}) y WHERE position <= 3"}


def with_views(*names):
    return ", ".join(f"{n} AS ({views_of_three[n]})" for n in names)


_CONFIG = f"""
WITH {with_views("v_products", "v_stacks", "v_variants")}, m(material, densities, conductivity, heat, firmness, as_named) AS (VALUES {dims.material_values()}),
g AS (SELECT unnest(generate_series(5, 300, 5))::INT AS t),
l AS (SELECT l.*, CASE WHEN l.density IS NULL THEN m.densities ELSE [CAST(round_even(l.density, 0) AS INT)] END AS ds, s.densities AS sd, s.conductivity, s.heat, s.firmness AS soft, s.material AS named FROM v_stacks l JOIN m USING (material) JOIN m s ON s.material = m.as_named),
x AS (SELECT p.*, a.ds AS d1, b.ds AS d2, c.ds AS d3, a.thickness_mm AS t1, b.thickness_mm AS t2, c.thickness_mm AS t3, a.sd AS s1, b.sd AS s2, c.sd AS s3, a.soft AS f1, b.soft AS f2, c.soft AS f3, a.named AS m1, b.named AS m2, c.named AS m3,
  a.conductivity AS k1, b.conductivity AS k2, c.conductivity AS k3, a.heat AS h1, b.heat AS h2, c.heat AS h3 FROM v_products p JOIN l a ON a.product_id = p.product_id AND a.position = 1 JOIN l b ON b.product_id = p.product_id AND b.position = 2 JOIN l c ON c.product_id = p.product_id AND c.position = 3),
o1 AS (SELECT product_id, t AS a FROM x, g WHERE t1 IS NULL AND t <= greatest(10, total_mm - 20) UNION ALL SELECT product_id, t1::INT FROM x WHERE t1 IS NOT NULL),
o2 AS (SELECT product_id, t AS b FROM x, g WHERE t2 IS NULL AND t <= greatest(10, total_mm - 20) UNION ALL SELECT product_id, t2::INT FROM x WHERE t2 IS NOT NULL),
o3 AS (SELECT product_id, t AS c FROM x, g WHERE t3 IS NULL AND t <= greatest(10, total_mm - 20) UNION ALL SELECT product_id, t3::INT FROM x WHERE t3 IS NOT NULL),
e AS (SELECT product_id, a, b, c FROM x JOIN o1 USING (product_id) JOIN o2 USING (product_id) JOIN o3 USING (product_id) WHERE a + b + c = total_mm),
er AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY a, b, c) AS sol FROM e QUALIFY sol <= 1000),
w AS (SELECT product_id, total_mm, [greatest(coalesce(t1, 1), 1), greatest(coalesce(t2, 1), 1), greatest(coalesce(t3, 1), 1)] AS w FROM x WHERE product_id NOT IN (SELECT product_id FROM er)),
q AS (SELECT product_id, total_mm, i, (total_mm - 3) * w[i] / list_sum(w) AS r FROM w, (SELECT unnest([1, 2, 3]) AS i)),
z AS (SELECT product_id, i, 1 + floor(r)::INT + CASE WHEN row_number() OVER (PARTITION BY product_id ORDER BY r - floor(r) DESC, i) <= total_mm - sum(1 + floor(r)::INT) OVER (PARTITION BY product_id) THEN 1 ELSE 0 END AS t FROM q),
sol AS (SELECT product_id, a, b, c, sol FROM er UNION ALL SELECT product_id, max(CASE WHEN i = 1 THEN t END), max(CASE WHEN i = 2 THEN t END), max(CASE WHEN i = 3 THEN t END), 1 FROM z GROUP BY product_id),
den AS (SELECT x.*, i.i, j.j, k.k, d1[i.i] AS p1, d2[j.j] AS p2, d3[k.k] AS p3 FROM x, (SELECT unnest([1, 2, 3]) AS i) i, (SELECT unnest([1, 2, 3]) AS j) j, (SELECT unnest([1, 2, 3]) AS k) k WHERE i <= len(d1) AND j <= len(d2) AND k <= len(d3)),
n AS (SELECT den.*, a, b, c, (sol - 1) * len(d1) * len(d2) * len(d3) + ((i - 1) * len(d2) + j - 1) * len(d3) + k AS enumerated, (1520.0::DOUBLE * 1980 / 1e6) * (a / 1000::DOUBLE * p1 + b / 1000::DOUBLE * p2 + c / 1000::DOUBLE * p3) AS kg FROM den JOIN sol USING (product_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY enumerated) AS place FROM n WHERE enumerated <= 50000 AND (weight_kg IS NULL OR abs(kg - weight_kg) <= greatest(2, weight_kg * 0.25::DOUBLE)) QUALIFY place <= 1000)"""



_PRIOR = "CASE list_position({s}, {p}) WHEN 1 THEN 0.2 WHEN 2 THEN 0.6 WHEN 3 THEN 0.2 ELSE 0.01 END::DOUBLE".format
_GAUSS = "(-0.5::DOUBLE * power(({o} - {p}) / ({s}), 2) - ln(({s}) * sqrt(2 * pi())))".format
_FEEL = " ".join(f"WHEN '{n}' THEN {x}" for n, x in units.FIRMNESS)
_RANKED = f"""{_CONFIG}, sc AS (SELECT *, ln({_PRIOR(s="s1", p="p1")}) + ln({_PRIOR(s="s2", p="p2")}) + ln({_PRIOR(s="s3", p="p3")}) + coalesce({_GAUSS(o="weight_kg", p="kg", s="greatest(1.5::DOUBLE, weight_kg * 0.12::DOUBLE)")}, 0)
 + {_GAUSS(o=f"(CASE firmness {_FEEL} END)::DOUBLE", p="((f1 * a + f2 * b + f3 * c) / (a + b + c))", s="0.18::DOUBLE")} AS score FROM s),
po AS (SELECT *, exp(greatest(score - max(score) OVER (PARTITION BY product_id), -700)) AS w FROM sc),
rk AS (SELECT product_id, place, score, w / sum(w) OVER (PARTITION BY product_id) AS posterior, row_number() OVER (PARTITION BY product_id ORDER BY round(score, 9) DESC, place) AS rank FROM po QUALIFY rank <= 10)"""

GENERATED = f"{_CONFIG} SELECT product_id, place, enumerated, [a, b, c] AS taken, [p1, p2, p3] AS picked, round(kg, 6) AS estimated_kg FROM s"
RANKED = f"{_RANKED} SELECT product_id, rank, place, round(posterior, 6) AS posterior FROM rk"
SCREENED = f"""{_CONFIG}, r AS (SELECT product_id, place, a / 1000::DOUBLE / k1 + b / 1000::DOUBLE / k2 + c / 1000::DOUBLE / k3 AS resistance, a / 1000::DOUBLE * p1 * h1 + b / 1000::DOUBLE * p2 * h2 + c / 1000::DOUBLE * p3 * h3 AS heat FROM s),
y AS (SELECT *, (1.8::DOUBLE * 37 + 0.18::DOUBLE / resistance * 25) / (1.8::DOUBLE + 0.18::DOUBLE / resistance) AS e, 1 - (1.8::DOUBLE + 0.18::DOUBLE / resistance) * 5 / greatest(100, heat * 0.18::DOUBLE) AS f FROM r)
SELECT product_id, place, round(resistance, 6) AS resistance, round(heat, 3) AS heat_capacity, round(list_sum(list_transform(generate_series(4140, 4320), lambda i: e + (25 - e) * power(f, i))) / 181, 6) AS final_c,
 round(list_sum(list_transform(generate_series(0, 4320), lambda i: CASE WHEN e + (25 - e) * power(f, i) BETWEEN 28 AND 32 THEN 1 ELSE 0 END)) * 5 / 60::DOUBLE, 6) AS comfort_minutes, round(greatest(25, e + (25 - e) * power(f, 4320)), 6) AS peak_c FROM y"""


@pytest.fixture(scope="module")
def plan(spark):
    products, layers, variants = (view(spark, SF, v) for v in ("v_products", "v_layers", "v_variants"))
    return configure.planned(products, layers.where("position <= 3"), variants, dims.materials(spark))


def same(df, sql):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(df.columns)
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())


def test_three_layers(plan):
    wide = configure.decoded(*configure.candidates(plan), plan)
    same(wide.select("product_id", "place", "enumerated", "taken", "picked", F.round("estimated_kg", 6).alias("estimated_kg")), GENERATED)
    same(configure.rank(plan).select("product_id", "rank", "place", F.round("posterior", 6).alias("posterior")), RANKED)
    out = thermal.screen(wide)
    same(out.select("product_id", "place", F.round("resistance", 6).alias("resistance"), F.round("heat_capacity", 3).alias("heat_capacity"), *(F.round(c, 6).alias(c) for c in ("final_c", "comfort_minutes", "peak_c"))), SCREENED)


def stacked(rng, pid, n, total):
    """A product's layers, about half of the measures unknown; thicknesses that leave room for a grid in some."""
    names = list(dims.MATERIALS)
    return [(pid, i + 1, names[rng.integers(0, 14)], float(5 * rng.integers(1, 4)) if rng.random() < 0.8 or n > 12 else None, None if rng.random() < 0.6 else float(rng.integers(20, 90))) for i in range(n)]


def enumerated(product, layers, area, most=1000, bound=50_000):
    """Plain enumeration in order, every combination weighed."""
    _, total, weight = product
    n = len(layers)
    grid = [t for t in dims.GRID if t <= max(10, total - 10 * (n - 1))]
    unknown = [i for i, x in enumerate(layers) if x[3] is None]
    fixed = [None if x[3] is None else max(1, round(x[3])) for x in layers]

    def solutions(i, left):
        if i == len(unknown):
            if left == 0:
                yield ()
            return
        for t in grid:
            if t <= left:
                for rest in solutions(i + 1, left - t):
                    yield (t, *rest)

    found = []
    for chosen in islice(solutions(0, total - sum(t for t in fixed if t is not None)), 1000):
        at = iter(chosen)
        found.append([next(at) if t is None else t for t in fixed])
    if not found:
        w = [max(1.0, 1.0 if x[3] is None else x[3]) for x in layers]
        new = max(200, n) if total < n else total
        parts = [(new - n) * x / sum(w) for x in w]
        base = [1 + int(x) for x in parts]
        for i in sorted(range(n), key=lambda i: (-(parts[i] - int(parts[i])), i))[: new - sum(base)]:
            base[i] += 1
        found = [base]
    options = [dims.MATERIALS[x[2]][0] if x[4] is None else (round(x[4]),) for x in layers]
    out = []
    for k, (t, d) in enumerate(islice(((t, d) for t in found for d in cross(*options)), bound), 1):
        kg = None if area is None else sum(area * (a / 1000) * b for a, b in zip(t, d, strict=True))
        if kg is None or weight is None or abs(kg - weight) <= max(2.0, weight * 0.25):
            out.append((k, tuple(t), tuple(d), kg))
            if len(out) == most:
                break
    return out


def test_whole_stacks(spark):
    rng = np.random.default_rng(11)
    sizes = [1, 2, 3, 4, 5, 6, 8, 12, 20, 30, 31, 45, 7, 9, 10, 14]
    products, layers, variants = [], [], []
    for pid, n in enumerate(sizes):
        total = int(rng.choice([n, 90, 150, 200, 203, 5 * n + 40]))
        mine = stacked(rng, pid, n, total)
        light, heavy = (sum(3.0096 * total / n / 1000 * f(dims.MATERIALS[x[2]][0] if x[4] is None else (x[4],)) for x in mine) for f in (min, max))
        weight = None if pid % 5 == 4 else float(light + (heavy - light) * rng.random())
        products.append((pid, total, weight))
        layers += mine
        if pid % 7 != 6:
            variants.append((pid, 1, 1520.0, 1980.0))
    df = spark.createDataFrame([(p, "Firm", t, w, 1.0) for p, t, w in products], "product_id long, firmness string, total_mm int, weight_kg double, price double")
    ls = spark.createDataFrame(layers, "product_id long, position int, material string, thickness_mm double, density double")
    vs = spark.createDataFrame(variants, "product_id long, ordinal int, width_mm double, length_mm double")
    found = {}
    for r in configure.generate(df, ls, vs, dims.materials(spark), normalization="identity").orderBy("product_id", "place").collect():
        found.setdefault(r.product_id, []).append((r.enumerated, tuple(r.taken), tuple(r.picked), r.estimated_kg))
    seen = 0
    for p in products:
        want = enumerated(p, [x for x in layers if x[0] == p[0]], 3.0096 if any(v[0] == p[0] for v in variants) else None)
        mine = found.get(p[0], [])
        assert [x[:3] for x in mine] == [x[:3] for x in want], p
        assert all(a == b or abs(a - b) < 1e-9 for a, b in ((x[3], y[3]) for x, y in zip(mine, want, strict=True)) if a is not None)
        seen += len(want)
    assert seen > 2000


def test_support_is_counted_per_layer(spark):
    df = spark.createDataFrame([(1, "Firm", 100, None, 1.0)], "product_id long, firmness string, total_mm int, weight_kg double, price double")
    ls = spark.createDataFrame([(1, 1, "memory_foam", 40.0, None), (1, 2, "hr_foam", 60.0, None)], "product_id long, position int, material string, thickness_mm double, density double")
    plan = configure.planned(df, ls, spark.createDataFrame([], "product_id long, ordinal int, width_mm double, length_mm double"), dims.materials(spark), "identity")
    support = spark.createDataFrame([(1, "memory_foam:85", 0.9), (1, "hr_foam:60", 0.5), (2, "hr_foam:28", 1.0)], "product_id long, key string, share double")
    share = {(m, d): 0.2 if i != 1 else 0.6 for m in ("memory_foam", "hr_foam") for i, d in enumerate(dims.MATERIALS[m][0])}
    bonus = {("memory_foam", 85): 1 + 4 * 0.9, ("hr_foam", 60): 1 + 4 * 0.5}
    weight = {(a, b): share["memory_foam", a] * share["hr_foam", b] * bonus.get(("memory_foam", a), 1) * bonus.get(("hr_foam", b), 1) for a in dims.MATERIALS["memory_foam"][0] for b in dims.MATERIALS["hr_foam"][0]}
    got = {tuple(r.picked): r.posterior for r in configure.rank(plan, support).collect()}
    assert got == {k: pytest.approx(w / sum(weight.values())) for k, w in weight.items()}
