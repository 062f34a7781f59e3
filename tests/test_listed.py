"""Narrow candidates hold what the wide ones hold, and no product's row is joined for a proportional solution."""

from pyspark.sql import functions as F

from evidentia.operators import configure, thermal
from evidentia.operators.listed import listed
from evidentia.sources import dims

from test_ranking import PRODUCTS


def test_narrow_candidates_equal_wide_ones(spark):
    df = spark.createDataFrame([(*p, 1.0) for p, _, _ in PRODUCTS], "product_id long, firmness string, total_mm int, weight_kg double, price double")
    ls = spark.createDataFrame([(p[0], i, *x) for p, _, layers in PRODUCTS for i, x in enumerate(layers, 1)], "product_id long, position int, material string, thickness_mm double, density double")
    vs = spark.createDataFrame([(p[0], 1, 1520.0, 1980.0) for p, sized, _ in PRODUCTS if sized], "product_id long, ordinal int, width_mm double, length_mm double")
    plan = configure.planned(df, ls, vs, dims.materials(spark), "identity")
    kg = F.round("estimated_kg", 9).alias("estimated_kg")
    wide, narrow = configure.wide(plan), listed(plan)
    for most in ({}, {"most": 3, "most_enumerated": 700}):
        wide, narrow = configure.wide(plan, **most), listed(plan, **most)
        want, got = (sorted(map(repr, x.select("product_id", "place", "solution", "enumerated", "taken", "picked", kg).collect())) for x in (wide, narrow))
        assert got == want and len(got) > 100
    same = [F.round(c, 6).alias(c) for c in ("resistance", "heat_capacity", "final_c", "comfort_minutes", "peak_c")]
    want, got = (sorted(map(repr, x.select("product_id", "place", *same).collect())) for x in (thermal.screen(wide), thermal.screened(listed(plan, thermal=True, most=3, most_enumerated=700))))
    assert got == want
