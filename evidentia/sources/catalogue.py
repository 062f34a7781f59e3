"""Structured catalogues as JSON: a list of products, or an object that holds one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id

RELIABILITY = 0.95
PRODUCT = (
    "brand string, name string, family string, canonical_url string, description string, firmness string, total_thickness_mm double, product_weight_kg double, price double, currency string, "
    "layers array<struct<position: int, marketing_name: string, normalized_material: string, thickness_mm: double, density_kg_m3: double>>, "
    "variants array<struct<size_name: string, width_mm: double, length_mm: double, thickness_mm: double, weight_kg: double, price: double, currency: string>>, extraction_confidence double"
)


def read(spark: SparkSession, path: str, company: str) -> dict[str, DataFrame]:
    """Frames products, layers, variants and sources. Products without a name are left out, without a brand they take the company's; each has one official source."""
    fields = [f.split(":")[0] for f in _as_fields()]
    struct = f"array<struct<{', '.join(_as_fields())}>>"
    raw = spark.read.schema(f"{PRODUCT}, products {struct}").option("multiLine", True).json(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    each = raw.select("file", "at", F.posexplode(F.coalesce("products", F.array(F.struct(*fields)))).alias("pos", "p"))
    numbered = each.withColumn("index", F.row_number().over(Window.partitionBy("file").orderBy("at", "pos"))).select("file", "index", "p.*")
    named = numbered.where(F.trim(F.coalesce("name", F.lit(""))) != "").withColumn("brand", F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.lit(company)))
    rows = named.withColumns({"company": F.lit(company), "product_id": stable_id("prd", F.lit(company), "brand", "name"), "source_id": stable_id("src", "file", "index")})
    # of products with one identifier the one of highest confidence stays, the first of equals
    best = Window.partitionBy("product_id").orderBy(F.desc(F.coalesce("extraction_confidence", F.lit(0.0))), "file", "index")
    one = rows.withColumn("__n", F.row_number().over(best)).where("__n = 1")
    layers = one.select("product_id", "source_id", F.posexplode("layers").alias("n", "l"))
    return {
        "products": one.select("product_id", "company", "brand", "name", "family", "description", "canonical_url", "price", "currency", "firmness", F.col("total_thickness_mm").cast("int").alias("total_mm"), F.col("product_weight_kg").alias("weight_kg"), F.coalesce("extraction_confidence", F.lit(0.0)).alias("confidence"), "source_id"),
        "layers": layers.select("product_id", F.coalesce("l.position", F.col("n") + 1).alias("position"), F.col("l.marketing_name").alias("marketing_name"), F.col("l.normalized_material").alias("material"), F.col("l.thickness_mm").alias("thickness_mm"), F.col("l.density_kg_m3").alias("density"), "source_id"),
        "variants": one.select("product_id", F.posexplode("variants").alias("n", "v")).select("product_id", (F.col("n") + 1).alias("ordinal"), "v.*"),
        "sources": rows.select("source_id", "company", F.concat("file", F.lit("#product="), "index").alias("url"), F.col("name").alias("title"), F.lit("official_catalogue").alias("kind"), F.lit(True).alias("official"), F.lit(RELIABILITY).alias("reliability")),
    }


def _as_fields() -> list[str]:
    """The product's fields as those of a struct: a colon between name and type."""
    out, deep, start = [], 0, 0
    for i, c in enumerate(PRODUCT + ","):
        deep += (c == "<") - (c == ">")
        if c == "," and deep == 0:
            name, kind = PRODUCT[start:i].strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            start = i + 1
    return out
