"""Observations, products of pages, merging, the graph, export files and checks, on small fixtures."""

import json
import re

import pytest
from pyspark.sql import functions as F

from evidentia.functions import pages, search, text, units, urls
from evidentia.operators import exports, knowledge, listing, merge, observe, validate


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(("name", "specific"), [("Mattress Topper Deluxe", True), ("Mattresses", False), ("mattresses on sale", False), ("Mattress in Pune", False), ("Mattress in-store", False), ("Mattress India Gold", True), ("Buy Mattress Online", True), ("Buy mattresses online now", False), ("Best Mattress Ever", True), ("Best mattresses 2024", False), ("Ortho", False), ("X2", True)])
def test_specific_names(spark, name, specific):
    assert one(spark, text.is_specific_name(F.col("n")), n=name) is specific


@pytest.mark.parametrize(("path", "detail", "location", "other"), [("/products/x", True, False, False), ("/products/", False, False, False), ("/a/shop/b/c", True, False, False), ("/collections/mattress-in-pune", False, True, False), ("/pages/store-locator/x", False, True, True), ("/collections/sofas", False, False, True), ("/collections/sofas-2", False, False, False), ("/pages/store", False, False, True)])
def test_paths(spark, path, detail, location, other):
    p = F.col("p")
    assert one(spark, F.struct(urls.is_detail(p), urls.is_location(p), urls.is_non_product(F.concat(F.lit("http://a.b"), p))), p=path) == (detail, location, other)


@pytest.mark.parametrize(("t", "label", "mm"), [("Medium-firm feel. Height: 8 inches", "Medium Firm", 203.2), ("a 5 inch mattress", None, None), ("softly; thickness 20 mm, depth - 150mm", None, 150.0)])
def test_labels(spark, t, label, mm):
    assert one(spark, F.struct(units.firmness_label(F.col("t")), units.explicit_thickness_mm(F.col("t"))), t=t) == (label, mm)


TEXTS = {1: "Soft HR foam 32 kg/m3 core, 5 cm foam, size 72 x 36 x 6 inches and 72x36 in. Weight: 18.5 kg. Rs. 12,999 / ₹45,000; 10 years warranty, medium-firm", 2: None, 3: "", 4: "nothing here"}
PLAIN = [
    ("measurement.density_kg_m3", r"(\d+(?:\.\d+)?)\s*kg/m3", lambda m: str(float(m[1]))),
    ("measurement.thickness_mm", r"(\d+) cm foam", lambda m: str(float(m[1]) * 10)),
    ("variant.dimensions_mm", r"(\d+)\s*x\s*(\d+)(?:\s*x\s*(\d+))?\s*(?:inches|in)", lambda m: "[" + ", ".join(str(round(float(x) * 25.4, 2)) for x in m.groups() if x) + "]"),
    ("measurement.weight_kg", r"Weight: ([\d.]+) kg", lambda m: str(float(m[1]))),
    ("commercial.price", r"(?:Rs\. |₹)(\d\d,\d{3})", lambda m: str(float(m[1].replace(",", "")))),
    ("product.firmness", r"(?i)\b(soft|medium-firm)\b", lambda m: m[1].lower().replace("-", " ")),
    ("commercial.warranty_years", r"(\d+) years warranty", lambda m: str(float(m[1]))),
]


def test_observations(spark):
    rows = spark.createDataFrame([(i, t, 0.475) for i, t in TEXTS.items()], "id long, text string, reliability double")
    found = observe.observations(rows).collect()
    want = {(1, f, value(m), m.start(), m.end()) for f, p, value in PLAIN for m in re.finditer(p, TEXTS[1])} | {(1, "material.mention", "HR foam", 5, 12)}
    assert {(r.id, r.field, r.value, r.start, r.stop) for r in found} == want
    assert {r.material for r in found if r.field == "material.mention"} == {"hr_foam"}
    assert next(r for r in found if r.field == "measurement.density_kg_m3").confidence == pytest.approx(0.46)
    twice = rows.withColumn("text", F.concat("text", F.lit(". "), "text"))
    assert observe.observations(twice, most=3).count() == 3


def test_products_from_text(spark):
    doc = "Acme density guide [PDF page 1] The Ortho Mattress is firm, thickness: 8 inches. [PDF page 2] Ortho Mattress again; Cloud Nine Mattress weight 20 kg"
    rows = spark.createDataFrame([(1, "http://x.y/a.pdf", None, doc), (2, "http://x.y/cloud-soft.pdf", None, "acme mattress density"), (3, "http://x.y/z", None, None), (4, "http://x.y/z", None, "other firm's mattress density")], "id long, url string, title string, text string")
    found = {(r.id, r.segment, r.name, r.total_mm, r.weight_kg) for r in observe.products_from_text(rows, "Acme").collect()}
    assert found == {(1, 1, "The Ortho Mattress", 203.2, None), (1, 2, "Ortho Mattress", None, 20.0), (1, 2, "Cloud Nine Mattress", None, 20.0), (2, 0, "Cloud Soft", None, None)}


LD = {"@graph": [{"@type": ["Thing", "product"], "name": "Ortho Mattress", "description": "medium firm, thickness 8 inches", "brand": {"name": "Acme"}, "offers": [{"price": "12,500", "priceCurrency": "INR"}], "weight": "21 kg"}, {"@type": "Product", "name": "Pillow One", "offers": {"lowPrice": "x"}}]}
PAGE = '<head><meta content="Two &lt;words" name="description"><meta property="product:price:amount" content="9,999"></head><body><h1>Cloud <b>Nine</b></h1><main>A mattress. Depth: 6 in. Weight 18 kg. Plush</main><p>add to cart height 10 in</p></body>'


def test_products_of_pages(spark):
    rows = spark.createDataFrame([(1, "http://a.b/x", f"<script type='application/ld+json'>{json.dumps(LD)}</script><script type='application/ld+json'>{{bad</script>"), (2, "http://a.b/products/cloud", PAGE), (3, "http://a.b/products/no", "<body>plain</body>"), (4, "http://a.b", None)], "id long, url string, html string")
    found = {r.id: r for r in listing.products_of_pages(rows, "Fallback").collect()}
    assert set(found) == {1, 2}
    a, b = found[1], found[2]
    assert (a.name, a.brand, a.price, a.currency, a.firmness, a.total_mm, a.weight_kg, a.method) == ("Ortho Mattress", "Acme", 12500.0, "INR", "Medium Firm", 203.2, 21.0, "json_ld")
    assert (b.name, b.brand, b.price, b.firmness, b.total_mm, b.weight_kg) == ("Cloud Nine", "Fallback", 9999.0, "Plush", pytest.approx(152.4), 18.0)
    veto = spark.createDataFrame([(2, False, 0.9)], "id long, product_bearing boolean, confidence double")
    assert {r.id for r in listing.products_of_pages(rows, "Fallback", veto).collect()} == {1}


def layer(position, material, thickness=None, density=None, evidence=()):
    return {"position": position, "marketing_name": None, "material": material, "thickness_mm": thickness, "thickness_status": "seen" if thickness else "unknown", "density": density, "density_status": "unknown", "evidence": list(evidence)}


def record(entity, ordinal, confidence, **more):
    base = dict.fromkeys("product_id company brand name family canonical_url description firmness total_mm weight_kg price currency method".split())
    return base | {"entity_id": entity, "ordinal": ordinal, "confidence": confidence, "layers": [], "variants": [], "source_ids": [], "tags": []} | more


def test_merging(spark):
    rows = [
        record(1, 1, 0.5, product_id="a", price=1.0, layers=[layer(1, "x", 10.0, None, ["e1"])], source_ids=["s1"], tags=["t"]),
        record(1, 2, 0.9, product_id="b", firmness="Firm", layers=[layer(1, "x", None, 30.0, ["e2"]), layer(1, "y")], source_ids=["s2", "s1"], variants=[{"variant_id": "v", "size_name": "q", "width_mm": 1.0, "length_mm": 2.0}]),
        record(1, 3, 0.2, product_id="c", family="f", firmness="Soft", variants=[{"variant_id": "v", "size_name": "k", "width_mm": 1.0, "length_mm": 2.0}]),
        record(2, 1, None, product_id="d"), record(None, 1, 0.1),
    ]
    schema = f"entity_id long, ordinal long, {merge.PRODUCT}"
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    found = {r.entity_id: r for r in merge.fold(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)).collect()}
    r = found[1]
    assert (r.product_id, r.price, r.firmness, r.family, r.method, r.confidence) == ("b", 1.0, "Firm", "f", "merged", 0.9)
    assert [(x.position, x.material, x.thickness_mm, x.density, x.evidence) for x in r.layers] == [(1, "x", 10.0, 30.0, ["e2", "e1"]), (1, "y", None, None, [])]
    assert r.source_ids == ["s2", "s1"] and [v.size_name for v in r.variants] == ["k"] and set(found) == {1, 2}


def test_layers_merge_as_listed():
    out = merge.merged_layers([layer(1, "x", 10.0), layer(2, "z")], [layer(1, "y", 5.0), layer(2, "z", 7.0, 40.0)])
    assert [(x["position"], x["material"], x["thickness_mm"], x["density"], x["thickness_status"]) for x in out] == [(1, "x", 10.0, None, "seen"), (2, "z", 7.0, 40.0, "seen"), (3, "y", 5.0, None, "seen")]
    twice = merge.merged_layers([layer(1, "x"), layer(1, "x", 4.0)], [layer(1, "x", 9.0, 8.0, ["e"]), layer(1, "q")])
    assert [(x["position"], x["material"], x["thickness_mm"], x["density"], x["evidence"]) for x in twice] == [(1, "x", None, None, []), (1, "x", 4.0, 8.0, ["e"]), (2, "q", None, None, [])]


def test_graph_properties(spark):
    frames = {
        "claims": spark.createDataFrame([("c1", "p1", "price", "s1", "a1"), ("c2", "p1", "price", "s1", "zz")], "claim_id string, product_id string, field_path string, source_id string, asset_id string"),
        "assets": spark.createDataFrame([("a1", "s1", "image")], "asset_id string, source_id string, kind string"),
        "similar": spark.createDataFrame([("p1", "p2", 0.5), ("p1", "p2", 0.7)], "product_id string, similar_product_id string, score double"),
        "configurations": spark.createDataFrame([("k", "p1", 1, 0.25)], "configuration_id string, product_id string, rank int, posterior double"),
    }
    found = sorted((r.source, r.relation, r.target) for r in knowledge.graph(frames).collect())
    assert found == [("c1", "OBSERVED_IN_ASSET", "a1"), ("c1", "SUPPORTED_BY", "s1"), ("c2", "SUPPORTED_BY", "s1"), ("p1", "HAS_CLAIM", "c1"), ("p1", "HAS_CLAIM", "c2"), ("p1", "HAS_POSSIBLE_CONFIGURATION", "k"), ("p1", "SIMILAR_TO", "p2"), ("s1", "HAS_ASSET", "a1")]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', [1, 2]), (2, None, None)], "id long, t string, l array<int>")
    exports.write({"x": df, "none": df.where("false")}, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c" / "x"))
    assert sorted(tuple(r) for r in back.collect()) == [("1", 'a "b", c', "[1,2]"), ("2", None, None)]
    exports.bundle({"primary_table": df, "summary": df.limit(1)}, str(tmp_path / "b"))
    assert spark.read.json(str(tmp_path / "b" / "json" / "primary_table")).count() == 2
    exports.write_series(spark.createDataFrame([(1.0, 2.5)], "seconds double, p double"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first().p == "2.500000"
    assets = spark.createDataFrame([("a", ["q", "q"], ["u"], [("P", [("m", 5.0)])], ["r"])], "asset_id string, queries array<string>, urls array<string>, products array<struct<name: string, layers: array<struct<material: string, thickness_mm: double>>>>, regions array<string>")
    assert exports.visual_queue(assets).count() == 2 and exports.visual_layers(assets).count() == 2


def test_search(spark):
    asked = search.queries(["Acme", "Beta"], "acme.com", "India", [" own ", " "])
    assert len(asked) == 7 and asked[0] == "own" and asked[2] == '"Acme" OR "Beta" site:acme.com inurl:products mattress'
    assert one(spark, search.error_kind(F.col("e"), "Firecrawl"), e="FIRECRAWL: HTTP 402") == "quota"
    assert one(spark, search.error_kind(F.col("e"), "Firecrawl"), e="IncompleteRead(3 bytes read, 4 more expected)") == "transport"
    assert one(spark, search.json_text(F.col("t")), t='sure:\n```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, search.json_text(F.col("t")), t='it is {"a": {"b": 2}} ok') == '{"a": {"b": 2}}'
    assert one(spark, search.original_image(F.col("u")), u="http://a.b/c_600x_crop_top.png?w=5&v=2#x") == "http://a.b/c.png?v=2#x"
    assert [tuple(x) for x in one(spark, search.markdown_images(F.col("t")), t="![a](http://x/1.png) ![](https://y/2.jpg) ![z](data:q)")] == [("a", "http://x/1.png"), ("", "https://y/2.jpg")]
    assert one(spark, search.grounded(F.lit(0.5), F.lit(0.5), F.lit("patent"))) == (0.5, True)
    assert one(spark, pages.name_hint(F.col("u")), u="http://a.b/products/ortho-plus_two.html") == "Ortho Plus Two"
    assert one(spark, pages.name_hint(F.col("u")), u="http://a.b/index.html") is None
    assert one(spark, pages.repaired_type(F.lit("application/octet-stream"), F.lit("http://a.b/x.PNG?y"))) == "image/png"
    assert one(spark, pages.body_text(F.lit("é".encode("latin-1")), F.lit("text/html; charset=iso-8859-1"))) == "é"


def test_checks(spark):
    products = spark.createDataFrame([(None, "C", "B", "N", [(None, 1, "top")], [(None, None, "queen"), ("v9", "sku", "king")])], "product_id string, company string, brand string, name string, layers array<struct<layer_id: string, position: int, marketing_name: string>>, variants array<struct<variant_id: string, sku: string, size_name: string>>")
    r = validate.with_ids(products).first()
    assert r.product_id.startswith("prd_") and r.layers[0].layer_id.startswith("lyr_") and r.variants[0].variant_id.startswith("var_") and r.variants[1].variant_id == "v9"
    old = validate.migrated(spark.createDataFrame([("r", None)], "run_id string, simulations string")).first()
    assert old.assets == [] and old.max_vision_assets == 80 and "simulations" not in old.asDict()
    assert one(spark, validate.stage_percent(F.lit("crawling"))) == 35
    ledger = spark.createDataFrame([(1, "running"), (2, "completed"), (3, "queued")], "job long, status string")
    broker = spark.createDataFrame([(1, "SUCCESS"), (2, "FAILURE")], "job long, state string")
    assert {r.job: r.status for r in validate.reconciled(ledger, broker).collect()} == {1: "completed", 2: "completed", 3: "queued"}
    docs = spark.createDataFrame([("u1", "x"), ("u9", "s2"), ("u8", "zz")], "url string, sha256 string")
    known = spark.createDataFrame([("src1", "u1", "s1"), ("src2", "u2", "s2")], "source_id string, url string, sha256 string")
    assert {r.url: r.source_id for r in validate.attached(docs, known).collect()} == {"u1": "src1", "u9": "src2"}
    terms = spark.createDataFrame([("a", "A", None, None, 0.9), ("a", "A2", 30.0, None, 0.8), ("b", "B", 40.0, None, 0.1), ("c", "C", None, None, 0.2)], "key string, name string, density double, thickness_mm double, confidence double")
    assert [r.key for r in validate.candidate_terms(terms, terms.where("key = 'c'")).collect()] == ["b", "a"]
    found = validate.fallback_dossiers(spark.createDataFrame([(1, "n", None, 50.0), (2, "m", "x", None)], "material_id long, name string, material string, density double"), spark.createDataFrame([], "material_id long")).collect()
    assert {(r.material_id, r.identity_status, r.density_status) for r in found} == {(1, "unresolved", "verified_exact"), (2, "probable", "unknown")}
