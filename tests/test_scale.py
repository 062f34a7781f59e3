"""Steps whose tables grow with the input: nothing as long as the input is sent whole, candidates are not dealt anew, small files are worked on by many tasks."""

from pyspark.sql import functions as F

from evidentia.operators import configure, knowledge, observe, page_facts, sheets
from evidentia.plans.sheets import _frames
from evidentia.sources import dims
from evidentia.sources.views import view

from test_registry import SF


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_stay_in_their_products_row(spark):
    products, layers, variants = (view(spark, SF, v) for v in ("v_products", "v_layers", "v_variants"))
    made = planned(configure.generate(products, layers, variants, dims.materials(spark)))
    after, of_candidates, _ = made.partition("Generate inline")
    assert of_candidates and "Exchange" not in after and "Sort" not in after


def test_pages_are_not_sent_whole(spark):
    made = planned(page_facts.page_observations(view(spark, SF, "v_spec_pages"), "Acme"))
    assert "Broadcast" not in made


def test_texts_are_dealt_and_not_sent_whole(spark):
    texts = view(spark, SF, "v_spec_text").withColumn("reliability", F.lit(0.95))
    made = planned(observe.observations(texts))
    before = made[made.index("MapInPandas") :]
    assert "Broadcast" not in made and "REPARTITION_BY_NUM" in before


def test_one_property_needs_no_lambda(spark):
    assets = spark.createDataFrame([("a1", "s1", "image"), ("a2", "s1", None)], "asset_id string, source_id string, kind string")
    found = knowledge.graph({"assets": assets})
    assert {r.target: r.properties for r in found.collect()} == {"a1": {"kind": "image"}, "a2": {}}
    assert "lambda" not in planned(found)


def test_claims_read_evidence_once(spark):
    made = planned(sheets.claim_sheet(*_frames(spark, SF, "products", "layers", "evidence", "sources")))
    held = [x for x in made.splitlines() if "max(reliability" in x and "keys=" in x]
    assert held and all("collect_list" in x for x in held)
