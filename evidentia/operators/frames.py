"""Export frames over products, layers, variants, assets and decoded materials, and the choice between captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_rows(products: DataFrame, layers: DataFrame) -> DataFrame:
    """Layers with their product's name and how each measure is known."""
    known = lambda c: F.when(F.col(c).isNotNull(), "observed").otherwise("unknown")
    return layers.join(products.select("product_id", F.col("name").alias("product")), "product_id").select(
        "product_id", "product", "position", F.col("material").alias("normalized_material"), "thickness_mm", known("thickness_mm").alias("thickness_status"), F.col("density").alias("density_kg_m3"), known("density").alias("density_status")
    )


def variant_rows(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants with their product's name and area in square metres."""
    return variants.join(products.select("product_id", F.col("name").alias("product")), "product_id").select("product_id", "product", "ordinal", "width_mm", "length_mm", (F.col("width_mm") * F.col("length_mm") / 1e6).alias("area_m2"))


def primary_table(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """The short product table. ``rows``: from ``records.product_rows``; assets: asset_id, name (products that an asset shows).

    Shown products are matched by trimmed lower-case name; an asset that names a product twice counts once.
    """
    key = lambda c: F.lower(F.trim(c))
    shown = assets.select("asset_id", key(F.col("name")).alias("__key")).where("__key is not null").distinct().groupBy("__key").agg(F.count(F.lit(1)).alias("visual_assets"))
    status = (
        F.when(F.col("layer_count") == 0, "Construction not publicly verified")
        .when((F.col("densities") > 0) & (F.col("thicknesses") == F.col("layer_count")), "Observed stack with measurements")
        .otherwise("Partial observed construction")
    )
    return rows.withColumn("__key", F.lower("name")).join(shown, "__key", "left").select(
        "product_id", "name", "firmness", "total_mm", "price", F.coalesce("components", F.lit("")).alias("components"), "layer_count", "thicknesses", "densities",
        F.coalesce("visual_assets", F.lit(0)).alias("visual_assets"), status.alias("status"), "variant_count", F.round("confidence", 3).alias("confidence"),
    )


def plain_number(c: Column) -> Column:
    """A number without trailing zeros, six digits at most after the point."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")


def density_display(status: Column, low: Column, high: Column, best: Column) -> Column:
    """A verified density as a number, else a range or its one known end in kg/m³, else ``Unknown``."""
    one = F.concat(plain_number(F.coalesce(low, high)), F.lit(" kg/m³"))
    span = F.concat(plain_number(low), F.lit("–"), plain_number(high), F.lit(" kg/m³"))
    return F.when(status == "verified_exact", plain_number(best)).when(low.isNotNull() & high.isNotNull() & (low != high), span).when(low.isNotNull() | high.isNotNull(), one).otherwise("Unknown")


def within_budget(rows: DataFrame, size: Column, order: list, each: int = 12_000, total: int = 72_000) -> DataFrame:
    """Rows in order until ``total`` characters are spent, each with the characters it may use (``allowed``), at most ``each``.

    Every row that may use any takes a character at least, so ``total`` rows in order are all that the running sum has to see.
    """
    own = F.least(size, F.lit(each))
    rows = rows.where(size > 0).orderBy(*order).limit(total)
    before = F.coalesce(F.sum(own).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("allowed", F.least(own, F.lit(total) - before)).where("allowed > 0")


def best_capture(captures: DataFrame, local_first: bool = False, thin: int = 800) -> DataFrame:
    """One capture a url of captures (url, method, ok, chars): the first method that worked.

    Methods in order: service, reader, local; local, reader, service with ``local_first``. Files and XML are taken as captured locally only. A
    local page under ``thin`` characters gives way to a reader's capture that worked. A url without any that worked has no row.
    """
    order = {"local": 0.0, "reader": 1.0, "service": 2.0} if local_first else {"service": 0.0, "reader": 1.0, "local": 2.0}
    place = F.coalesce(*(F.when(F.col("method") == m, rank) for m, rank in order.items()))
    exact = F.lower("url").rlike(r"(\.pdf|\.xml|\.xml\.gz|/robots\.txt)$")
    if local_first:
        # after the reader's capture, before the service's, which is only asked where the local one failed
        place = F.when(~exact & (F.col("method") == "local") & (F.col("chars") < thin), 1.5).otherwise(place)
    fit = captures.where(F.col("ok") & place.isNotNull() & (~exact | (F.col("method") == "local")))
    return fit.groupBy("url").agg(F.min(F.struct(place.alias("rank"), "method", "chars")).alias("b")).select("url", "b.method", "b.chars")
