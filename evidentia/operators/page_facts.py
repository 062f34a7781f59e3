"""Observations from the markup of pages: headings, description, structured products, and rows of tables, each with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup, pages
from ..functions.text import clean_text, context, stable_id
from ..sources import dims
from ..sources.work import cut, parts, stored
from . import observe, walk

#: Products a page and rows of tables a page, as the feature's bounds.
PRODUCTS, ROWS = 200, 500
_KEY = "\x1f"


def number_text(c: Column) -> Column:
    """A double as digits with a point and at least one decimal, without an exponent below 10^16."""
    plain = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"(?<=\.\d)(\d*?)0+$", "$1")
    return F.when(F.abs(c) < 1e16, plain).otherwise(c.cast("string"))


def table_rows(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """id, row, text (cells that are not blank, joined by bars), start, stop of rows with two such cells or more; up to the first of these numbered ``most`` or higher."""
    cells = markup.cells(rows).withColumn("text", clean_text("text")).where("text != ''")
    listed = cells.groupBy("id", "row").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("c"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    whole = listed.where(F.size("c") >= 2).select("id", "row", F.array_join(F.transform("c", lambda x: x["text"]), " | ").alias("text"), "start", "stop")
    last = F.min(F.when(F.col("row") >= most, F.col("row"))).over(Window.partitionBy("id"))
    return whole.withColumn("__last", last).where("__last is null or row <= __last").drop("__last")


def page_observations(captured: DataFrame, company: str, most: int = observe.MOST) -> DataFrame:
    """observation_id, id, field, value, unit, material, method, locator, start, stop, excerpt, confidence of pages (id, html, reliability).

    In order: title, first heading, description; each product's name, brand and price; each row of tables with what ``observe`` finds in it. Places of headings and rows are those of their markup
    in the page, places of facts those in the row's text; values of structured data have a script and a path as their locator. Confidence is lowered by the
    source's reliability, which is a price's own. Of facts with one identifier the surest stays, the first of equals; ``most`` a page, as the feature's bound. A null page has none.
    """
    # few bytes may become many rows: pages are dealt by number, and tables as long as theirs are never sent whole
    dealt = captured.repartition(parts(captured.sparkSession), "id")
    rows = stored(markup.cuts(dealt.select("id", "html")))
    none = F.lit(None).cast("string")
    rank = lambda *n: F.struct(*(x.cast("int").alias(f"r{i}") for i, x in enumerate(n)))

    def made(df: DataFrame, field: Column, value: Column, method: str, sure: float | Column, order: Column, unit: Column = none, locator: Column | None = None, start=None, stop=None, excerpt: Column = none) -> DataFrame:
        at = lambda c: F.lit(None).cast("int") if c is None else F.col(c)
        where = F.lit("HTML structured data") if locator is None else locator
        return df.select(
            "id", field.alias("field"), value.alias("value"), unit.alias("unit"), none.alias("material"), F.lit(method).alias("method"), where.alias("locator"), at(start).alias("start"), at(stop).alias("stop"),
            excerpt.alias("excerpt"), (F.lit(sure) if isinstance(sure, float) else sure).alias("confidence"), none.alias("within"), order.alias("order"),
        )

    zero, o = F.lit(0), F.col
    heads = markup.headings(rows)
    is_title = o("field") == "document.title"
    found = made(heads, o("field"), clean_text("text"), "meta", F.when(is_title, 0.85).otherwise(0.88), rank(F.when(is_title, 0).otherwise(1), zero, zero, zero, zero), start="start", stop="stop")
    described = dealt.select("id", pages.meta(o("html"), "description", "og:description").alias("v"))
    found = found.union(made(described, F.lit("document.description"), markup.decoded(o("v")), "meta", 0.80, rank(F.lit(2), zero, zero, zero, zero)))
    products = walk.product_facts(dealt, company)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("script", "place"))
    products = cut(products.withColumn("nth", nth).where(o("nth") <= PRODUCTS))
    at = F.concat(F.lit("JSON-LD script "), o("script") + 1, F.lit(" "), o("path"))
    for k, name in enumerate(("name", "brand")):
        found = found.union(made(products, F.lit(f"product.{name}"), o(name), "json_ld", 0.95, rank(F.lit(3), o("nth"), F.lit(k), zero, zero), locator=at))
    priced = products.where("price is not null")
    found = found.union(made(priced, F.lit("commercial.price"), number_text(o("price")), "json_ld", F.lit(None).cast("double"), rank(F.lit(3), o("nth"), F.lit(2), zero, zero), unit=o("currency"), locator=F.concat(at, F.lit(" offers"))))
    listed = stored(table_rows(rows))
    of_row = F.concat(F.lit("HTML table row "), o("row"))
    found = found.union(made(listed, F.lit("table.row"), o("text"), "table", 0.82, rank(F.lit(4), o("row"), F.lit(-1), zero, zero), locator=of_row, start="start", stop="stop", excerpt=F.substring("text", 1, 1000)))
    kind = captured.schema["id"].dataType.simpleString()
    texts = listed.select(F.concat(o("id").cast("string"), F.lit(_KEY), o("row")).alias("id"), "text")
    told = observe.named(texts).unionByName(observe.facts(texts).drop("text")).join(texts.hint("merge"), "id")
    row = F.substring_index("id", _KEY, -1)
    seen = F.coalesce(F.nullif(context("text", o("start"), o("stop")), F.lit("")), none)
    found = found.union(told.select(
        F.substring_index("id", _KEY, 1).cast(kind).alias("id"), "field", "value", "unit", "material", "method", F.concat(F.lit("HTML table row "), row).alias("locator"), "start", "stop", seen.alias("excerpt"), "confidence",
        F.substring(seen, 1, 250).alias("within"), rank(F.lit(4), row, o("pass"), o("start"), -o("stop")).alias("order"),
    ))
    known = found.where("coalesce(value, '') != ''").join(captured.select("id", "reliability").hint("merge"), "id")
    sure = F.when(o("confidence").isNull(), o("reliability")).otherwise(F.least(F.lit(1.0), o("confidence") * o("reliability") / 0.95))
    source = o("id").cast("string")
    named = F.when(o("within").isNull(), stable_id("obs", source, "field", "value")).otherwise(stable_id("obs", source, "field", "value", "within"))
    rated = known.select(named.alias("observation_id"), "id", "field", "value", "unit", "material", "method", "locator", "start", "stop", "excerpt", sure.alias("confidence"), "order")
    same = Window.partitionBy("observation_id")
    tie = [o("order"), F.asc_nulls_first("material"), F.asc_nulls_first("locator")]
    once = rated.withColumns({"__n": F.row_number().over(same.orderBy(F.desc("confidence"), *tie)), "__first": F.min("order").over(same)}).where("__n = 1")
    placed = once.withColumn("__place", F.row_number().over(Window.partitionBy("id").orderBy("__first", *tie))).where(o("__place") <= most)
    return placed.drop("order", "__n", "__first", "__place")


#: How sure an endpoint with a body is, without one, and a material named in a body (fixed values).
WITH_BODY, WITHOUT_BODY, NAMED = 0.72, 0.55, 0.70
#: Kinds of requests that pages' scripts make (fixed values), and characters of a body that are kept and shown.
RESOURCES, KEPT, SHOWN = ("xhr", "fetch"), 20_000, 1000


def network_observations(manifest: DataFrame) -> DataFrame:
    """observation_id, id, field, value, material, locator, excerpt, confidence of requests (id, url, resource_type, body, stored_at) that a page's scripts made; other resources are left out.

    Each endpoint is a fact, and each material named in the first ``KEPT`` characters of its body another one, as that is what a capture keeps; of facts with one identifier the surest stays, then the first by
    value, excerpt and locator. Null bodies count as none.
    """
    body = F.substring(F.coalesce("body", F.lit("")), 1, KEPT)
    own = manifest.where(F.col("resource_type").isin(*RESOURCES)).select("id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.nullif("stored_at", F.lit("")), "url", F.lit("")).alias("stored_at"), body.alias("body"))
    source, shown = F.col("id").cast("string"), F.nullif(F.substring("body", 1, SHOWN), F.lit(""))
    none = F.lit(None).cast("string")
    endpoints = own.select(
        stable_id("obs", source, F.lit("network_json"), "url").alias("observation_id"), "id", F.lit("network_json.endpoint").alias("field"), F.col("url").alias("value"), none.alias("material"),
        F.col("stored_at").alias("locator"), shown.alias("excerpt"), F.when(F.col("body") != "", WITH_BODY).otherwise(WITHOUT_BODY).alias("confidence"),
    )
    plain = clean_text(F.regexp_replace(F.lower("body"), "-", " "))
    first = {}
    for alias, material in dims.aliases():
        first.setdefault(material, []).append(dims.plain(alias))
    # each material once, by the first of its names that the body holds
    one = lambda m, names: F.struct(F.coalesce(*(F.when(F.contains("plain", F.lit(n)), n) for n in names)).alias("value"), F.lit(m).alias("material"))
    held = own.where("body != ''").withColumn("plain", plain).select("id", "url", shown.alias("shown"), F.explode(F.array(*(one(m, names) for m, names in first.items()))).alias("m"))
    materials = held.where("m.value is not null").select(
        stable_id("obs", source, "url", "m.material").alias("observation_id"), "id", F.lit("network_json.material_mention").alias("field"), "m.value", "m.material",
        F.col("url").alias("locator"), F.col("shown").alias("excerpt"), F.lit(NAMED).alias("confidence"),
    )
    each = Window.partitionBy("observation_id").orderBy(F.desc("confidence"), "value", "excerpt", "locator")
    return endpoints.union(materials).withColumn("__n", F.row_number().over(each)).where("__n = 1").drop("__n")


def network_values(manifest: DataFrame) -> DataFrame:
    """id, url, path, value of every value in the JSON bodies of requests (id, url, resource_type, body) that a page's scripts made: dotted paths, by rounds of VARIANT explosion."""
    own = manifest.where(F.col("resource_type").isin(*RESOURCES)).select("id", "url", "body")
    return walk.leaves(own, "body").drop("place")
