"""The frames of a run as they are handed to people: products, variants, layers with their evidence, claims, the two primary tables and the review queue.

Relations instead of nested records: products (product_id, name and, where known, ``PRODUCT``'s columns), layers (product_id, position, layer_id, marketing_name, material, thickness_mm,
thickness_status, density, density_status), variants (product_id, ordinal and more), evidence of layers (product_id, position, ordinal, source_id, asset_id, excerpt, reliability), sources of
products (product_id, ordinal, source_id). Lists are aggregated by key before any join, so no frame is shuffled more than once by each of its keys. Empty frames give no rows;
null lists and members are left out of joined texts; layers, variants and evidence without a known product have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exports import joined
from .frames import density_display

#: Columns that a product may lack, with their types.
PRODUCT = {
    "company": "string", "brand": "string", "family": "string", "canonical_url": "string", "firmness": "string", "total_mm": "double", "weight_kg": "double", "price": "double", "currency": "string",
    "extraction_method": "string", "confidence": "double", "reviewed": "boolean", "description": "string",
}
#: Least confidence that needs no review, and below which it is urgent; least score of a first configuration (fixed values).
SURE, UNSURE, SCORE = 0.7, 0.6, 60.0


def whole(products: DataFrame) -> DataFrame:
    """The products with every column of ``PRODUCT``."""
    return products.withColumns({c: F.lit(None).cast(t) for c, t in PRODUCT.items() if c not in products.columns})


def in_order(rows: DataFrame, keys: list[str], by: str, *more: Column, **texts: tuple[str, str]) -> DataFrame:
    """One row a key: each named column's values in order, joined; null and empty ones are left out. ``texts``: result = (column, separator); ``more``: aggregates beside them."""
    columns = list(dict.fromkeys(c for c, _ in texts.values()))
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(by, *columns))).alias("__all"), *more)
    shown = lambda c, sep: F.array_join(F.filter(F.transform("__all", lambda x: x[c]), lambda v: v.isNotNull() & (v != "")), sep)
    return held.withColumns({n: shown(c, sep) for n, (c, sep) in texts.items()}).drop("__all")


def product_sheet(products: DataFrame, layers: DataFrame, variants: DataFrame, sources: DataFrame) -> DataFrame:
    """The eighteen columns of a product, with how many layers, variants and sources it has."""
    out = whole(products)
    for n, rows in (("layer_count", layers), ("variant_count", variants), ("source_count", sources)):
        out = out.join(rows.groupBy("product_id").agg(F.count(F.lit(1)).alias(n)), "product_id", "left")
    count = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return out.select(
        "product_id", "company", "brand", F.col("name").alias("product"), "family", "canonical_url", "firmness", F.col("total_mm").alias("total_thickness_mm"), F.col("weight_kg").alias("product_weight_kg"), "price", "currency",
        count("layer_count"), count("variant_count"), count("source_count"), "extraction_method", F.col("confidence").alias("extraction_confidence"), "reviewed", "description",
    )


def variant_sheet(products: DataFrame, variants: DataFrame, sources: DataFrame) -> DataFrame:
    """Variants with all their columns, their product's name and the sources of their product, joined."""
    named = products.select("product_id", F.col("name").alias("product"))
    return variants.join(named, "product_id").join(in_order(sources, ["product_id"], "ordinal", source_ids=("source_id", ", ")), "product_id", "left").withColumn("source_ids", F.coalesce("source_ids", F.lit("")))


def layer_sheet(products: DataFrame, layers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Layers with their product's name and the sources, assets and excerpts of their evidence, in its order."""
    texts = in_order(evidence, ["product_id", "position"], "ordinal", evidence_source_ids=("source_id", ", "), evidence_asset_ids=("asset_id", ", "), evidence_excerpts=("excerpt", " | "))
    rows = layers.join(products.select("product_id", F.col("name").alias("product")), "product_id").join(texts, ["product_id", "position"], "left")
    return rows.select(
        "product_id", "product", "layer_id", "position", "marketing_name", F.col("material").alias("normalized_material"), "thickness_mm", "thickness_status", F.col("density").alias("density_kg_m3"), "density_status",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("evidence_source_ids", "evidence_asset_ids", "evidence_excerpts")),
    )


def claim_sheet(products: DataFrame, layers: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """product_id, field_path, value_double, value_string, unit, status, confidence, method, source_ids: one row for each stated fact of a product or layer.

    A product's fact is as sure as its extraction, a layer's as its most reliable evidence (0.5 without any).
    """
    number, text = (lambda c: F.col(c).cast("double")), F.lit(None).cast("string")
    fact = lambda path, value, string, unit, status: F.struct(path.alias("field_path"), value.alias("value_double"), string.alias("value_string"), unit.alias("unit"), status.alias("status"))
    none, seen = F.lit(None).cast("double"), F.lit("observed")
    of_product = F.array(
        fact(F.lit("total_thickness_mm"), number("total_mm"), text, F.lit("mm"), seen), fact(F.lit("product_weight_kg"), number("weight_kg"), text, F.lit("kg"), seen),
        fact(F.lit("price"), number("price"), text, F.col("currency"), seen), fact(F.lit("firmness"), none, F.col("firmness"), text, seen),
    )
    path = lambda f: F.concat(F.lit("layers."), F.col("position").cast("string"), F.lit(f))
    of_layer = F.array(
        fact(path(".thickness_mm"), number("thickness_mm"), text, F.lit("mm"), F.col("thickness_status")), fact(path(".density_kg_m3"), number("density"), text, F.lit("kg/m3"), F.col("density_status")),
    )
    # filtered after they are exploded: a lambda over each row's array would be interpreted
    stated = "f.value_double is not null or f.value_string is not null"
    full = whole(products)
    own = in_order(sources, ["product_id"], "ordinal", source_ids=("source_id", ", "))
    upper = full.join(own, "product_id", "left").select("product_id", F.explode(of_product).alias("f"), "confidence", F.col("extraction_method").alias("method"), "source_ids").where(stated)
    # evidence is aggregated once
    seen_in = in_order(evidence, ["product_id", "position"], "ordinal", F.max("reliability").alias("confidence"), source_ids=("source_id", ", "))
    held = layers.join(full.select("product_id", F.col("extraction_method").alias("method")).hint("merge"), "product_id").join(seen_in.hint("merge"), ["product_id", "position"], "left")
    lower = held.select("product_id", F.explode(of_layer).alias("f"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "method", "source_ids").where(stated)
    return upper.unionByName(lower).select("product_id", "f.*", "confidence", "method", F.coalesce("source_ids", F.lit("")).alias("source_ids"))


def primary_sheet(products: DataFrame, layers: DataFrame, variants: DataFrame, assets: DataFrame) -> DataFrame:
    """The product table under its fifteen titles. assets: asset_id, name (products that an asset shows, matched by trimmed lower-case name; each asset counts once)."""
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("marketing_name") != "", F.struct("position", "marketing_name")))), lambda x: x["marketing_name"])
    of_layers = layers.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count("thickness_mm").alias("t"), F.count("density").alias("d"), F.array_join(F.array_distinct(named), " | ").alias("components"))
    of_variants = variants.groupBy("product_id").agg(F.count(F.lit(1)).alias("v"))
    shown = assets.select("asset_id", F.lower(F.trim("name")).alias("key")).where("key is not null").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("a"))
    rows = whole(products).join(of_layers, "product_id", "left").join(of_variants, "product_id", "left").join(shown, F.lower("name") == F.col("key"), "left").fillna(0, ["n", "t", "d", "v", "a"])
    status = F.when(F.col("n") == 0, "Construction not publicly verified").when((F.col("d") > 0) & (F.col("t") == F.col("n")), "Observed stack with measurements").otherwise("Partial observed construction")
    return rows.select(
        F.col("name").alias("Product"), F.col("family").alias("Family"), F.col("firmness").alias("Firmness"), F.col("total_mm").alias("Thickness (mm)"), F.col("price").alias("Price"), F.col("currency").alias("Currency"),
        F.coalesce("components", F.lit("")).alias("Observed components"), F.col("n").alias("Observed component count"), F.col("t").alias("Layer thickness evidence"), F.col("d").alias("Density evidence"), F.col("a").alias("Visual evidence assets"),
        status.alias("Construction status"), F.col("v").alias("Variants"), F.bround("confidence", 3).alias("Extraction confidence"), F.col("canonical_url").alias("URL"),
    )


def material_sheet(materials: DataFrame) -> DataFrame:
    """The table of decoded materials under its twenty-one titles, lists joined by bars, the density as it may be shown."""
    as_is = lambda c: F.col(c)
    bars = lambda c: joined(c, " | ")
    columns: dict[str, Column] = {
        "Product": F.coalesce(F.nullif(F.col("product_name"), F.lit("")), F.col("family")), "Diagram crop": as_is("diagram_crop"), "Trademark / branded name": as_is("trademark"), "What it actually is": as_is("generic_name"),
        "Technical description": as_is("description"), "Base material": as_is("base_polymer"), "Additives / structure": bars("additives"), "Probable function": bars("functions"), "Stack position": as_is("stack_position"),
        "Identity status": as_is("identity_status"), "Identity confidence": as_is("identity_confidence"), "Evidence scope": as_is("evidence_scope"),
        "Density": density_display(F.col("density_status"), F.col("density_low"), F.col("density_high"), F.col("density_best")), "Density status": as_is("density_status"), "Density grade": as_is("density_grade"),
        "Density confidence": as_is("density_confidence"), "Density basis": as_is("density_basis"), "Evidence sources": F.coalesce(F.col("evidence_sources"), F.lit(0)), "Contradictions": bars("contradictions"),
        "Unknowns": bars("unknowns"), "Conclusion": as_is("conclusion"),
    }
    return materials.select(*(c.alias(n) for n, c in columns.items()))


def review_sheet(products: DataFrame, layers: DataFrame, configurations: DataFrame) -> DataFrame:
    """entity_type, entity_id, product, priority, reason, confidence: products with missing facts or an unsure extraction, and first configurations (configuration_id, product_id, rank, confidence_score) with a low score."""
    of_layers = layers.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count("density").alias("d"))
    rows = whole(products).join(of_layers, "product_id", "left").fillna(0, ["n", "d"])
    missing = F.array_compact(F.array(F.when(F.col("total_mm").isNull(), "total_thickness_mm"), F.when(F.col("n") == 0, "layers"), F.when(F.col("d") < F.col("n"), "one_or_more_layer_densities")))
    unsure = F.col("confidence") < SURE
    reason = F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise("low extraction confidence")
    text = lambda c: F.col(c).cast("string")
    upper = rows.where(unsure | (F.size(missing) > 0)).select(
        F.lit("product").alias("entity_type"), text("product_id").alias("entity_id"), F.col("name").alias("product"), F.when(F.col("confidence") < UNSURE, "high").otherwise("normal").alias("priority"), reason.alias("reason"), "confidence",
    )
    low = configurations.where((F.col("rank") == 1) & (F.col("confidence_score") < SCORE))
    lower = low.select(
        F.lit("configuration").alias("entity_type"), text("configuration_id").alias("entity_id"), text("product_id").alias("product"), F.lit("high").alias("priority"),
        F.lit("Top configuration has low provisional confidence").alias("reason"), (F.col("confidence_score") / 100).alias("confidence"),
    )
    return upper.unionByName(lower)
