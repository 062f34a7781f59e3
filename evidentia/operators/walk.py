"""Nested JSON as rows: every value of a document with its path, by rounds of VARIANT explosion, without Python workers.

A round replaces objects and arrays by their members, and rounds end when none is left, so there are as many as the deepest document has levels. Each round is written to the
shared folder. A VARIANT keeps an object's members in the order of their names, not of the text; an array's keep theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import clean_text
from ..sources.work import cut


def _kind(v: Column) -> Column:
    """object, array or value."""
    schema = F.schema_of_variant(v)
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise("value")


def walk(docs: DataFrame, json: str = "json") -> DataFrame:
    """The other columns of docs with path (keys and places joined by dots, empty for the whole), place (positions from the outermost in, so rows sort as the document is read),
    kind (object, array, value) and v (VARIANT) of every value. Texts that are null or not JSON give no rows.
    """
    spark, keep = docs.sparkSession, [c for c in docs.columns if c != json]
    whole = docs.select(*(F.col(f"`{c}`") for c in keep), F.try_parse_json(F.col(f"`{json}`")).alias("v")).where("v is not null")
    now = cut(whole.select(*keep, F.lit("").alias("path"), F.array().cast("array<int>").alias("place"), _kind(F.col("v")).alias("kind"), "v"))
    found = [now]
    while not (open_ := now.where("kind != 'value'")).isEmpty():
        each = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        name = F.coalesce("key", F.col("pos").cast("string"))
        rows = each.select(*keep, F.concat_ws(".", F.nullif("path", F.lit("")), name).alias("path"), F.concat("place", F.array("pos")).alias("place"), F.col("value").alias("v")).where("v is not null")
        now = cut(rows.select(*keep, "path", "place", _kind(F.col("v")).alias("kind"), "v"))
        found.append(now)
    return reduce(DataFrame.union, found)


def text_of(v: Column) -> Column:
    """A value as text: texts bare, null as null, objects and arrays as JSON."""
    return F.try_variant_get(v, "$", "string")


def leaves(docs: DataFrame, json: str = "json") -> DataFrame:
    """The other columns, path, place and value (text) of every value that is neither object nor array; JSON's null gives a null value."""
    return walk(docs, json).where("kind = 'value'").withColumn("value", text_of(F.col("v"))).drop("v", "kind")


def has_type(v: Column, kind: str) -> Column:
    """Whether an object's ``@type`` is this text, or a list at any depth that holds it, in any case; types of objects within do not count."""
    given = F.try_variant_get(v, "$['@type']", "variant")
    schema = F.coalesce(F.schema_of_variant(given), F.lit(""))
    one = F.lower(F.try_variant_get(given, "$", "string"))
    # lists of lists hold texts alone, so commas and brackets outside quotes part them
    listed = F.regexp_extract_all(F.lower(F.to_json(given)), F.lit(r'"((?:[^"\\]|\\.)*+)"'), F.lit(1))
    flat = schema.startswith("ARRAY") & ~F.contains(schema, F.lit("OBJECT"))
    return F.coalesce(F.when(schema == "STRING", one == kind.lower()).when(flat, F.array_contains(listed, kind.lower())).otherwise(False), F.lit(False))


def linked_objects(captured: DataFrame) -> DataFrame:
    """id, script, place, path, v of every object in the JSON-LD scripts of pages (id, html), an object before what it holds."""
    scripts = captured.select("id", F.posexplode(html.json_ld(F.col("html"))).alias("script", "json"))
    return walk(scripts).where("kind = 'object'").select("id", "script", "place", "path", "v")


def product_facts(captured: DataFrame, company: str) -> DataFrame:
    """id, script, place, path, name, brand, price, currency of every JSON-LD product of pages (id, html).

    The brand is its object's name, else its text, else the company. The price is the first offer's, else its lowest, null if no number.
    """
    rows = linked_objects(captured).where(has_type(F.col("v"), "Product"))
    at = lambda path: F.try_variant_get("v", path, "string")
    brand = F.coalesce(F.nullif(F.when(F.schema_of_variant(F.try_variant_get("v", "$.brand", "variant")).startswith("OBJECT"), at("$.brand.name")).otherwise(at("$.brand")), F.lit("")), F.lit(company))
    listed = F.schema_of_variant(F.try_variant_get("v", "$.offers", "variant")).startswith("ARRAY")
    offer = lambda k: F.nullif(F.nullif(F.when(listed, at(f"$.offers[0].{k}")).otherwise(at(f"$.offers.{k}")), F.lit("")), F.lit("0"))
    price = F.replace(F.coalesce(offer("price"), offer("lowPrice")), F.lit(","), F.lit("")).try_cast("double")
    return rows.select("id", "script", "place", "path", clean_text(at("$.name")).alias("name"), clean_text(brand).alias("brand"), price.alias("price"), F.nullif(clean_text(offer("priceCurrency")), F.lit("")).alias("currency"))
