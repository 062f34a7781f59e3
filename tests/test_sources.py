import datetime
import json
import random

from pyspark.sql import functions as F

from evidentia.operators import configure, neardup
from evidentia.sources import catalogue, dims, store

PRODUCTS = [
    {"name": "Quiet Harbour Duo", "firmness": "Medium Firm", "total_thickness_mm": 200, "product_weight_kg": 19, "price": 1, "layers": [{"position": 1, "normalized_material": "memory_foam", "thickness_mm": 50}, {"position": 2, "normalized_material": "hr_foam", "thickness_mm": 150}], "variants": [{"width_mm": 1520, "length_mm": 1980}]},
    {"name": "Rubber Meadow Two", "brand": "Other", "firmness": "Medium", "total_thickness_mm": 180, "product_weight_kg": 23, "price": 1, "layers": [{"normalized_material": "natural_latex", "thickness_mm": 60, "density_kg_m3": 75}, {"normalized_material": "hr_foam", "thickness_mm": 120, "density_kg_m3": 40}], "variants": [{"width_mm": 1520, "length_mm": 1980}]},
    {"name": " ", "price": 3},
    {"name": "Rubber Meadow Two", "brand": "other", "extraction_confidence": 0.0},
]


def test_catalogue_forms(spark, tmp_path):
    for form in (PRODUCTS, {"products": PRODUCTS}):
        path = tmp_path / f"{type(form).__name__}.json"
        path.write_text(json.dumps(form))
        found = catalogue.read(spark, str(path), "Acme")
        assert sorted((r.brand, r.name) for r in found["products"].collect()) == [("Acme", "Quiet Harbour Duo"), ("Other", "Rubber Meadow Two")]
        assert found["sources"].count() == 3
        assert sorted(r.position for r in found["layers"].collect()) == [1, 1, 2, 2]
        kept = configure.generate(found["products"], found["layers"], found["variants"], dims.materials(spark))
        assert {r.name: r["count"] for r in kept.groupBy("name").count().collect()} == {"Quiet Harbour Duo": 3, "Rubber Meadow Two": 1}


def test_run_store(spark, tmp_path):
    base = str(tmp_path / "store")
    made = lambda *rows: spark.createDataFrame(list(rows), "product_id long, name string")
    head = lambda day: spark.createDataFrame([(datetime.datetime(2024, 1, day),)], "completed_at timestamp")
    store.save({"products": made((1, "a"), (2, "b")), "runs": head(1)}, base, "r1")
    store.save({"products": made((1, "old")), "runs": head(3)}, base, "r2")
    store.save({"products": made((1, "new")), "runs": head(3)}, base, "r2")
    assert [(r.product_id, r.name) for r in store.load(spark, base, "products", "r2").collect()] == [(1, "new")]
    assert sorted((r.product_id, r.name) for r in store.historical_products(spark, base, "none").collect()) == [(1, "new"), (2, "b")]
    assert sorted((r.product_id, r.name) for r in store.historical_products(spark, base, "r2").collect()) == [(1, "a"), (2, "b")]
    assert [r.run_id for r in store.runs(spark, base).collect()] == ["r2", "r1"]


def test_contents(spark, tmp_path):
    base = str(tmp_path / "contents")
    first = spark.createDataFrame([(b"x", "t"), (b"x", "u"), (b"y", "t"), (None, "t")], "body binary, content_type string")
    assert store.put_contents(first, base).count() == 2
    assert store.put_contents(first.where("body = X'78'").union(spark.createDataFrame([(b"z", "t")], first.schema)), base).count() == 2
    assert sorted(bytes(r.body) for r in spark.read.parquet(base).collect()) == [b"x", b"y", b"z"]


def greedy(rows):
    """The ordered pass itself."""
    kept, out = [], {}
    words = lambda r: set((r["ocr"] or "").lower().split())
    for r in sorted(rows, key=lambda r: (-r["priority"], r["ordinal"])):
        for k in kept:
            bits = bin(int(r["hash"], 16) ^ int(k["hash"], 16)).count("1") if r["hash"] and k["hash"] else 65
            a, b = words(r), words(k)
            near = bits <= 2 or (bits <= 5 and a and b and len(a & b) / len(a | b) >= 0.85)
            if near and all((r["width"], r["height"], k["width"], k["height"])):
                near = abs(r["width"] / r["height"] - k["width"] / k["height"]) <= 0.12
            if (r["sha"] is not None and r["sha"] == k["sha"]) or (r["url"] is not None and r["url"] == k["url"]) or near:
                out[r["asset_id"]] = (False, k["asset_id"])
                break
        else:
            kept.append(r)
            out[r["asset_id"]] = (True, None)
    return out


SCHEMA = "asset_id long, priority double, ordinal long, sha string, url string, hash string, width int, height int, ocr string"


def test_near_duplicates_match_the_ordered_pass(spark):
    rng = random.Random(5)
    bases = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(160):
        h = rng.choice(bases)
        for _ in range(rng.randrange(7)):
            h ^= 1 << rng.randrange(64)
        text = " ".join(rng.sample("abcdefgh", rng.choice((0, 7, 8))))
        rows.append({"asset_id": i, "priority": rng.randrange(4) / 4, "ordinal": i, "sha": rng.choice((None, f"s{rng.randrange(90)}")), "url": rng.choice((None, f"u{rng.randrange(120)}")), "hash": None if i % 31 == 0 else f"{h:016x}", "width": rng.choice((None, 100, 110)), "height": 100, "ocr": text or None})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    found = {r.asset_id: (r.kept, r.duplicate_of) for r in neardup.deduplicate(df).collect()}
    assert found == greedy(rows)
    assert 1 < sum(k for k, _ in found.values()) < 160
    assert neardup.deduplicate(df.where(F.lit(False))).count() == 0
