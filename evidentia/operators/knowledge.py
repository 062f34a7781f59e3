"""The evidence graph: twelve relations between companies, brands, products, layers, materials, sources, assets, claims, observations and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_name, stable_id


def _edges(rows: DataFrame, source: Column | str, relation: str, target: Column | str, **properties: Column) -> DataFrame:
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    pairs = [x for k, v in properties.items() for x in (F.lit(k), v.cast("string"))]
    none = F.create_map().cast("map<string, string>")
    if len(properties) == 1:
        # without a lambda, which would be interpreted row by row
        held = F.when(pairs[1].isNotNull(), F.create_map(*pairs)).otherwise(none)
    else:
        held = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else none
    return rows.select(text(source).alias("source"), F.lit(relation).alias("relation"), text(target).alias("target"), held.alias("properties")).where("source is not null and target is not null")


def graph(frames: dict[str, DataFrame]) -> DataFrame:
    """edge_id, source, relation, target, properties, each edge once: of equal edges the last one of the frames' order counts.

    Frames, any of which may be missing: products (product_id, company, brand, name, source_ids), layers (product_id, layer_id, position, marketing_name, material, source_ids), sources (source_id),
    assets (asset_id, source_id, kind), claims (claim_id, product_id, field_path, source_id, asset_id), observations (observation_id, source_id, field, asset_id, material, product_name, confidence),
    similar (product_id, similar_product_id, score), configurations (configuration_id, product_id, rank, posterior). Evidence that names an unknown source or asset gives no edge. Observations meet
    products by normalised name; of products with one name the last identifier counts.
    """
    out: list[DataFrame] = []
    add = lambda *a, **k: out.append(_edges(*a, **k))
    sources, assets = frames.get("sources"), frames.get("assets")
    known = lambda rows, ids, on: rows.join(ids.select(F.col(on).alias("__id")).distinct(), F.col(on) == F.col("__id"), "left_semi") if ids is not None else rows.where(F.lit(False))
    products = frames.get("products")
    if products is not None:
        brand = stable_id("brd", "company", "brand")
        add(products, "company", "HAS_PRODUCT", "product_id")
        add(products, "company", "HAS_BRAND", brand, name=F.col("brand"))
        add(products, brand, "SELLS", "product_id")
        add(known(products.select("product_id", F.explode("source_ids").alias("source_id")), sources, "source_id"), "product_id", "SUPPORTED_BY", "source_id")
    material = F.concat(F.lit("mat_"), "material")
    if (layers := frames.get("layers")) is not None:
        add(layers, "product_id", "HAS_LAYER", "layer_id", position=F.col("position"), marketing_name=F.col("marketing_name"))
        add(layers, "layer_id", "NORMALIZES_TO", material)
        add(known(layers.select("layer_id", F.explode("source_ids").alias("source_id")), sources, "source_id"), "layer_id", "SUPPORTED_BY", "source_id")
    if assets is not None:
        add(assets, "source_id", "HAS_ASSET", "asset_id", kind=F.col("kind"))
    if (claims := frames.get("claims")) is not None:
        add(claims, "product_id", "HAS_CLAIM", "claim_id", field=F.col("field_path"))
        add(claims, "claim_id", "SUPPORTED_BY", "source_id")
        add(known(claims, assets, "asset_id"), "claim_id", "OBSERVED_IN_ASSET", "asset_id")
    if (seen := frames.get("observations")) is not None:
        add(seen, "source_id", "HAS_OBSERVATION", "observation_id", field=F.col("field"), confidence=F.col("confidence"))
        add(known(seen, assets, "asset_id"), "asset_id", "HAS_OBSERVATION", "observation_id")
        add(seen, "observation_id", "NORMALIZES_TO", material)
        if products is not None:
            named = products.groupBy(normalized_name("name").alias("key")).agg(F.max("product_id").alias("named"))
            add(seen.withColumn("key", normalized_name("product_name")).join(named, "key"), "named", "HAS_OBSERVATION", "observation_id")
    if (similar := frames.get("similar")) is not None:
        add(similar, "product_id", "SIMILAR_TO", "similar_product_id", score=F.col("score"))
    if (candidates := frames.get("configurations")) is not None:
        add(candidates, "product_id", "HAS_POSSIBLE_CONFIGURATION", "configuration_id", rank=F.col("rank"), posterior=F.col("posterior"))
    if not out:
        raise ValueError("no frames")
    every = None
    for i, f in enumerate(out):
        f = f.withColumn("__order", F.lit(i))
        every = f if every is None else every.unionByName(f)
    named = every.withColumn("edge_id", stable_id("edg", "source", "relation", "target"))
    held = F.when(F.size("properties") == 0, "{}").otherwise(F.to_json("properties"))
    last = Window.partitionBy("edge_id").orderBy(F.desc("__order"), F.desc(held))
    return named.withColumn("__n", F.row_number().over(last)).where("__n = 1").select("edge_id", "source", "relation", "target", "properties")
