"""Frames of what a recogniser saw in pictures: assets (asset_id, page_url, asset_url, local_path, vision_payload as JSON text, vision_confidence, vision_verified, vision_priority, perceptual_hash).

Payloads that are null, empty or no JSON object count as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNASSIGNED, CLASSIFIED = "unassigned visual region", "visually_classified"


def _seen(assets: DataFrame) -> DataFrame:
    v = F.try_parse_json("vision_payload")
    return assets.withColumn("v", v).where(F.coalesce(F.schema_of_variant(v).startswith("OBJECT<") & (F.schema_of_variant(v) != "OBJECT<>"), F.lit(False)))


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _list(v: Column | str, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def visual_evidence(assets: DataFrame) -> DataFrame:
    """One row per asset with a payload: type, names of products that are not blank and terms of technology, joined by bars, summary and text seen, and how sure it is."""
    names = F.filter(F.transform(_list("v", "products"), lambda p: F.trim(F.coalesce(_get(p, "name"), F.lit("")))), lambda n: n != "")
    terms = F.transform(_list("v", "technology_terms"), lambda t: F.try_variant_get(t, "$", "string"))
    return _seen(assets).select(
        "asset_id", _get("v", "asset_type").alias("asset_type"), F.array_join(names, " | ").alias("products"), F.col("vision_confidence").alias("confidence"), F.col("vision_verified").alias("second_pass_verified"), "vision_priority", "perceptual_hash",
        _get("v", "diagram_summary").alias("diagram_summary"), _get("v", "visible_text").alias("visible_text"), F.array_join(terms, " | ").alias("technology_terms"), "page_url", "asset_url", "local_path",
    )


def visual_layers(assets: DataFrame) -> DataFrame:
    """One row per layer of each product seen, then one per region that the recogniser gave to no product; ``ordinal`` (product, layer) keeps an asset's order, products before regions."""
    own = ("asset_id", "page_url", "asset_url")
    rows = _seen(assets)
    product = rows.select(*own, F.posexplode(_list("v", "products")).alias("p", "product"))
    layer = product.select(*own, "p", "product", F.posexplode(_list("product", "layers")).alias("l", "x"))
    none = F.lit(None).cast("string")
    named = F.coalesce(F.nullif(_get("product", "name"), F.lit("")), _get("product", "family"))
    texts = ("generic_material_class", "normalized_material", "assignment_scope", "evidence_status", "visible_label", "callout_text")
    region = F.to_json(_get("x", "region", "variant"))
    layers = layer.select(
        "asset_id", F.struct(F.lit(0).alias("kind"), "p", "l").alias("ordinal"), named.alias("product"), _get("x", "position", "int").alias("position"), _get("x", "marketing_name").alias("marketing_name"), *(_get("x", c).alias(c) for c in texts),
        _get("x", "thickness_mm", "double").alias("thickness_mm"), _get("x", "density_kg_m3", "double").alias("density_kg_m3"), region.alias("region"), _get("x", "confidence", "double").alias("confidence"), "page_url", "asset_url",
    )
    loose = rows.select(*own, F.posexplode(_list("v", "unassigned_regions")).alias("p", "x"))
    given = {"generic_material_class": _get("x", "generic_material_class"), "assignment_scope": F.lit(UNASSIGNED), "evidence_status": F.lit(CLASSIFIED), "callout_text": _get("x", "visual_description")}
    regions = loose.select(
        "asset_id", F.struct(F.lit(1).alias("kind"), "p", F.lit(0).alias("l")).alias("ordinal"), none.alias("product"), _get("x", "position", "int").alias("position"), none.alias("marketing_name"), *(given.get(c, none).alias(c) for c in texts),
        F.lit(None).cast("double").alias("thickness_mm"), F.lit(None).cast("double").alias("density_kg_m3"), region.alias("region"), _get("x", "confidence", "double").alias("confidence"), "page_url", "asset_url",
    )
    return layers.union(regions)


def visual_search(assets: DataFrame) -> DataFrame:
    """asset_id, ordinal, record_type, query_or_url, source_image, source_page of what assets (asset_id, asset_url, page_url, queries, followup_urls) ask for next: each query, then each address, once, where it first stands."""
    def of(c: str, kind: str, turn: int) -> DataFrame:
        return assets.select("asset_id", F.col("asset_url").alias("source_image"), F.col("page_url").alias("source_page"), F.lit(turn).alias("turn"), F.lit(kind).alias("record_type"), F.posexplode(c).alias("at", "query_or_url"))

    each = of("queries", "forensic_query", 0).union(of("followup_urls", "followup_url", 1)).where("query_or_url is not null")
    first = each.groupBy("asset_id", "record_type", "query_or_url").agg(F.min(F.struct("turn", "at", "source_image", "source_page")).alias("f"))
    return first.select("asset_id", F.struct("f.turn", "f.at").alias("ordinal"), "record_type", "query_or_url", "f.source_image", "f.source_page")
