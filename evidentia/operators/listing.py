"""Products found on pages: in structured data, and by the page itself where it looks like a product's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, pages, units
from ..functions.text import clean_text, is_specific_name
from . import walk

STRUCTURED, HEURISTIC = 0.90, 0.72


def _measures(text: Column) -> list[Column]:
    return [units.firmness_label(text).alias("firmness"), units.weight_kg(text).alias("weight_kg")]


def structured_products(captured: DataFrame, company: str) -> DataFrame:
    """id, place, brand, name, family, canonical_url, description, firmness, total_mm, weight_kg, price, currency, method, confidence of every JSON-LD product of pages (id, url, html).

    A product has a specific name, and the word mattress in its name, description or page's address.
    """
    o = F.col("o")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("script", "place")) - 1
    objects = walk.linked_objects(captured).select("id", nth.alias("place"), "v").where(walk.has_type(F.col("v"), "Product"))
    rows = objects.select("id", "place", F.to_json("v").alias("o")).join(captured.select("id", "url"), "id")
    get = lambda k: clean_text(F.get_json_object(o, f"$.{k}"))
    cut = rows.select("id", "url", "place", get("name").alias("name"), get("description").alias("description"), F.nullif(get("category"), F.lit("")).alias("family"), F.coalesce(F.nullif(get("url"), F.lit("")), F.col("url")).alias("canonical_url"), pages.brand(o, F.lit(company)).alias("brand"), pages.offer(o).alias("offer"), get("weight").alias("weight"))
    both = F.concat_ws(" ", "name", "description")
    fit = is_specific_name("name") & (F.contains(F.lower(both), F.lit("mattress")) | F.contains(F.lower("url"), F.lit("mattress")))
    return cut.where(fit).select(
        "id", "place", "brand", "name", "family", "canonical_url", "description", units.firmness_label(both).alias("firmness"), units.first_thickness_mm(both).alias("total_mm"),
        units.weight_kg(F.concat(F.lit("weight "), "weight")).alias("weight_kg"), "offer.price", "offer.currency", F.lit("json_ld").alias("method"), F.lit(STRUCTURED).alias("confidence"),
    )


def shown_products(captured: DataFrame, company: str) -> DataFrame:
    """The same columns of pages that look like a product's: name by heading or meta, measures from the page's main part only."""
    page = F.col("html")
    text = html.html_text("html")
    made = captured.withColumn("text", text).where(pages.looks_like_product(F.col("url"), F.col("text")))
    heading = html.tag_free(F.regexp_extract(page, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    name = F.coalesce(F.nullif(heading, F.lit("")), pages.meta(page, "og:title", "twitter:title"))
    main = F.nullif(html.tag_free(F.regexp_extract(page, r"(?is)<main\b[^>]*>(.*?)</main>", 1)), F.lit(""))
    stated = F.replace(pages.meta(page, "product:price:amount", "og:price:amount"), F.lit(","), F.lit("")).try_cast("double")
    cut = made.select(
        "id", "url", name.alias("name"), F.coalesce(pages.meta(page, "description", "og:description"), F.lit("")).alias("description"), F.coalesce(pages.meta(page, "product:brand", "brand"), F.lit(company)).alias("brand"),
        stated.alias("stated"), pages.meta(page, "product:price:currency", "og:price:currency").alias("money"), F.substring(F.coalesce(main, F.substring("text", 1, 20_000)), 1, 40_000).alias("main"), F.substring("text", 1, 30_000).alias("head"),
    )
    scope = clean_text(F.concat_ws(" ", "name", "description", "main"))
    return cut.where(is_specific_name("name")).select("id", "url", "brand", "name", "description", "stated", "money", "head", scope.alias("scope")).select(
        "id", F.lit(0).alias("place"), "brand", "name", F.lit(None).cast("string").alias("family"), F.col("url").alias("canonical_url"), F.coalesce(F.nullif("description", F.lit("")), F.substring("scope", 1, 3000)).alias("description"),
        units.firmness_label(F.col("scope")).alias("firmness"), units.explicit_thickness_mm(F.col("scope")).alias("total_mm"), units.weight_kg(F.col("scope")).alias("weight_kg"),
        F.coalesce("stated", units.price(F.col("head"))).alias("price"), F.coalesce("money", F.when(F.col("stated").isNull(), units.currency(F.col("head")))).alias("currency"), F.lit("heuristic").alias("method"), F.lit(HEURISTIC).alias("confidence"),
    )


def products_of_pages(captured: DataFrame, company: str, verdicts: DataFrame | None = None) -> DataFrame:
    """Products of pages by both ways; those by the page itself give way to a recogniser's veto. verdicts: id, product_bearing, confidence."""
    shown = shown_products(captured, company)
    if verdicts is not None:
        judged = shown.join(verdicts.select("id", "product_bearing", F.col("confidence").alias("sure")), "id", "left")
        shown = judged.where(pages.admitted(F.lit(False), F.col("product_bearing"), F.col("sure"))).drop("product_bearing", "sure")
    return structured_products(captured, company).unionByName(shown)
