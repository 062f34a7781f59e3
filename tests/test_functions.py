import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import scores, text, units, urls
from evidentia.sources import dims


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("HTTPS://Example.com:443//bed//?utm_source=x&size=queen#buy", "https://example.com/bed?size=queen"),
        ("http://a.b", "http://a.b/"),
        ("http://a.b:8080/x/?b=2&a=1&c=", "http://a.b:8080/x?a=1&b=2"),
    ],
)
def test_canonical(spark, url, expected):
    assert one(spark, urls.canonical(F.col("u")), u=url) == expected


@pytest.mark.parametrize(("url", "expected"), [("http://a.b/products/x", 90), ("http://a.b/cart", -100), ("http://a.b/blog/x", -20), ("http://a.b/x/catalogue.pdf", 95), ("http://a.b/collections/mattresses/", 24)])
def test_priority(spark, url, expected):
    assert one(spark, urls.priority(F.col("u")), u=url) == expected


@pytest.mark.parametrize(("t", "mm"), [("Total thickness: 8 inches", 203.2), ("height 20 cm", 200.0), ("an 150 mm thick mattress", 150.0), ("none", None)])
def test_thickness(spark, t, mm):
    assert one(spark, units.first_thickness_mm(F.col("t")), t=t) == mm


@pytest.mark.parametrize(("t", "price"), [("Rs. 12,999", 12999.0), ("Rs 24999", 249.0), ("₹1,24,999", None)])
def test_price_grammar(spark, t, price):
    assert one(spark, units.price(F.col("t")), t=t) == price


def test_density_and_firmness(spark):
    assert one(spark, units.density_kg_m3(F.col("t")), t="core of 32 kg/m³") == 32.0
    assert one(spark, units.firmness(F.col("t")), t="Medium-Firm bed") == 0.65
    assert one(spark, units.firmness(F.col("t")), t="odd") is None


def test_text(spark):
    assert one(spark, text.clean_text(F.col("t")), t=" a \n b ") == "a b"
    assert one(spark, text.normalized_name(F.col("t")), t="The BED-Mattress No.5") == "the no 5"
    assert one(spark, text.is_specific_name(F.col("t")), t="Mattress") is False
    assert one(spark, text.is_specific_name(F.col("t")), t="Ortho Plus") is True


def test_ids_are_stable(spark):
    import hashlib

    assert one(spark, text.stable_id("prd", "a", F.lit(None)), a=" Foo ") == "prd_" + hashlib.sha256(b"foo|none").hexdigest()[:16]


def test_scores(spark):
    assert one(spark, scores.hamming(F.col("a"), F.col("b")), a="ff" * 8, b="00" * 8) == 64
    assert one(spark, scores.hamming(F.col("a"), F.col("b")), a="xx", b="00" * 8) == 65
    assert math.isclose(one(spark, scores.gaussian(F.col("a"), F.col("b"), F.col("c")), a=1.0, b=1.0, c=1.0), -0.5 * math.log(2 * math.pi))


def test_materials():
    assert len(dims.aliases()) == 95
    survivors = {m for m in dims.MATERIALS if dims.normalize(m) == m}
    assert survivors == {"natural_latex", "rubberised_coir", "felt_insulator", "conventional_pu_foam"}
