"""Observations: atomic facts of a text, each with its place, its words and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.pages import looks_relevant, name_hint
from ..functions.text import clean_text, context, is_specific_name, stable_id
from ..functions.urls import source_kind
from ..sources.work import parts
from .mentions import mentions

MOST = 2000
SCHEMA = "field string, value string, unit string, material string, method string, start int, stop int, confidence double, pass int"


def located(text: Column, pattern: str, groups: int) -> Column:
    """array<struct(start, stop, g1, ...)> of a pattern's matches, places from 0: split() and extraction cut a text at the same places."""
    parts = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(groups + 1)]
    zipped = F.arrays_zip(parts.alias("p"), *(f.alias(f"g{i}") for i, f in enumerate(found)))
    names = ["p", *(f"g{i}" for i in range(groups + 1))]
    kept = ", ".join(f"g{i}: string" for i in range(1, groups + 1))
    none = F.array().cast(f"array<struct<start: int, stop: int{', ' + kept if kept else ''}>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(a: Column, x: Column) -> Column:
        at, size = a["at"] + x[names[0]], F.coalesce(F.length(x[names[1]]), F.lit(0))
        row = F.struct(at.alias("start"), (at + size).alias("stop"), *(x[n].alias(n) for n in names[2:]))
        return F.struct((at + size).alias("at"), F.when(x[names[1]].isNull(), a["found"]).otherwise(F.concat(a["found"], F.array(row))).alias("found"))

    return F.aggregate(zipped, start, step)["found"]


def facts(texts: DataFrame) -> DataFrame:
    """id and the columns of SCHEMA of the eight passes over texts (id, text): density, thickness twice, dimensions, weight, price, firmness, warranty."""
    mm = lambda n, u: F.round(units.length_to_mm(n.try_cast("double"), u), 2)
    listed = lambda x: F.concat(F.lit("["), F.array_join(F.filter(F.array(*(mm(x[g], x["g4"]).cast("string") for g in ("g1", "g2", "g3"))), lambda v: v.isNotNull()), ", "), F.lit("]"))
    number = lambda x: x["g1"].try_cast("double").cast("string")
    passes = [
        ("measurement.density_kg_m3", units.DENSITY, 1, number, "kg/m3", 0.92),
        *(("measurement.thickness_mm", p, 2, lambda x: mm(x["g1"], x["g2"]).cast("string"), "mm", 0.88) for p in units.ANY_THICKNESS),
        ("variant.dimensions_mm", units.DIMENSIONS, 4, listed, "mm", 0.85),
        ("measurement.weight_kg", units.WEIGHT, 1, number, "kg", 0.90),
        ("commercial.price", units.PRICE, 1, lambda x: F.replace(x["g1"], F.lit(","), F.lit("")).try_cast("double").cast("string"), "INR", 0.82),
        ("product.firmness", units.FEEL, 1, lambda x: F.lower(F.replace(x["g1"], F.lit("-"), F.lit(" "))), None, 0.72),
        ("commercial.warranty_years", units.WARRANTY, 1, number, "years", 0.90),
    ]
    text = F.coalesce("text", F.lit(""))

    def rows(number_of: int, field: str, pattern: str, groups: int, value, unit: str | None, sure: float) -> Column:
        one = lambda x: F.struct(
            F.lit(field).alias("field"), value(x).alias("value"), F.lit(unit).cast("string").alias("unit"), F.lit(None).cast("string").alias("material"), F.lit("regex").alias("method"),
            x["start"].alias("start"), x["stop"].alias("stop"), F.lit(sure).alias("confidence"), F.lit(number_of).alias("pass"),
        )
        return F.transform(located(text, pattern, groups), one)

    made = [rows(i, *p) for i, p in enumerate(passes, 1)]
    return texts.select("id", "text", F.explode(F.concat(*made)).alias("o")).select("id", "text", "o.*").where("value is not null")


def named(texts: DataFrame) -> DataFrame:
    """id and the columns of SCHEMA of the materials named in texts (id, text)."""
    return mentions(texts).select(
        "id", F.lit("material.mention").alias("field"), clean_text("alias").alias("value"), F.lit(None).cast("string").alias("unit"), "material", F.lit("material_dictionary").alias("method"), "start", "stop", F.lit(0.88).alias("confidence"), F.lit(0).alias("pass")
    )


def observations(texts: DataFrame, most: int = MOST) -> DataFrame:
    """observation_id, id, field, value, unit, material, method, start, stop, excerpt, confidence of texts (id, text, reliability).

    Materials named come first, then the passes of ``facts``; confidence is lowered by the source's reliability. Of facts with one
    identifier the surest stays, the first of equals; ``most`` a text, in that order, as the feature's bound.
    """
    # a small file may hold many texts: they are dealt by number, and not sent whole
    texts = texts.repartition(parts(texts.sparkSession), "id")
    known = texts.select("id", "reliability", F.col("text").alias("whole")).hint("merge")
    every = named(texts).unionByName(facts(texts.select("id", "text")).drop("text")).join(known, "id")
    sure = F.least(F.lit(1.0), F.col("confidence") * F.col("reliability") / 0.95)
    words = context("whole", F.col("start"), F.col("stop"))
    rows = every.select("id", "field", "value", "unit", "material", "method", "start", "stop", words.alias("excerpt"), sure.alias("confidence"), "pass")
    rows = rows.withColumn("observation_id", stable_id("obs", F.col("id").cast("string"), "field", "value", F.substring("excerpt", 1, 250)))
    same = Window.partitionBy("observation_id")
    order = [F.col("pass"), F.col("start"), F.desc("stop"), F.col("material")]
    first = rows.withColumns({"n": F.row_number().over(same.orderBy(F.desc("confidence"), *order)), "seen": F.min(F.struct("pass", "start")).over(same)}).where("n = 1")
    kept = first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("seen", *order))).where(F.col("place") <= most)
    return kept.drop("pass", "n", "seen", "place")


def sources(documents: DataFrame, company: str, domain: str) -> DataFrame:
    """source_id, company, url, title, kind, official, reliability, sha256, retrieved_at of documents (url, title, body text, retrieved epoch seconds)."""
    digest = F.sha2(F.coalesce("body", F.lit("")), 256)
    return documents.withColumns({"k": source_kind(F.col("url"), domain), "sha256": digest}).select(
        stable_id("src", "url", "sha256").alias("source_id"), F.lit(company).alias("company"), "url", "title", F.col("k.kind").alias("kind"), F.col("k.official").alias("official"), F.col("k.reliability").alias("reliability"), "sha256",
        F.timestamp_seconds("retrieved").alias("retrieved_at"),
    )


#: A name that ends in the word Mattress, of up to 82 characters, in capitals as written.
NAME = r"\b([A-Z][A-Za-z0-9&+™®'’().\-/ ]{2,80}?\bMattress)\b"


def products_from_text(texts: DataFrame, company: str, aliases: tuple[str, ...] = (), segments: int = 500, each: int = 20) -> DataFrame:
    """id, segment, name, description, firmness, total_mm, weight_kg, price, currency, confidence of relevant text documents (id, url, title, text).

    Documents are parted before each ``[PDF page n]``; a name counts in the first segment that has it. A document of one segment without any name takes its title
    or the hint of its address.
    """
    fit = texts.where(F.col("text").isNotNull() & looks_relevant(F.col("url"), F.col("text"), (company, *aliases)))
    parts = F.filter(F.transform(F.split("text", r"(?=\[PDF page [0-9]+\])"), clean_text), lambda s: s != "")
    cut = fit.select("id", "url", "title", F.slice(parts, 1, segments).alias("parts")).select("id", "url", "title", F.size("parts").alias("of"), F.posexplode("parts").alias("segment", "s"))
    named = F.filter(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(NAME), F.lit(1)), clean_text)), lambda n: F.size(F.split(n, " ")).between(2, 10) & is_specific_name(n))
    hint = F.coalesce("title", name_hint(F.col("url")))
    usable = (F.col("of") == 1) & is_specific_name(hint) & F.contains(F.lower(F.concat_ws(" ", hint, F.substring("s", 1, 500))), F.lit("mattress"))
    names = F.when(F.size(named) > 0, named).when(usable, F.array(hint)).otherwise(F.array().cast("array<string>"))
    rows = cut.select("id", "segment", "s", F.posexplode(names).alias("place", "name"))
    by = Window.partitionBy("id", F.lower("name")).orderBy("segment", "place")
    fresh = rows.withColumn("n", F.row_number().over(by)).where("n = 1")
    first = fresh.withColumn("k", F.row_number().over(Window.partitionBy("id", "segment").orderBy("place"))).where(F.col("k") <= each)
    s = F.col("s")
    return first.select(
        "id", "segment", "name", F.substring("s", 1, 3000).alias("description"), units.firmness_label(s).alias("firmness"), units.explicit_thickness_mm(s).alias("total_mm"), units.weight_kg(s).alias("weight_kg"),
        units.price(s).alias("price"), units.currency(s).alias("currency"), F.lit(0.48).alias("confidence"),
    )
