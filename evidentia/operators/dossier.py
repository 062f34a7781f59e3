"""Dossiers of trade-named materials: what the evidence found allows an adjudicated identity and density to claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, term_key

EXACT = ("exact_variant", "exact_product", "product_family")


def is_useful_name(name: Column, material: Column, generic: tuple[str, ...]) -> Column:
    """A trade name worth decoding: four letters or more, not generic, and with a mark, other than its class, or of words with an inner capital."""
    key = term_key(name)
    words = F.size(F.split(clean_text(name), " "))
    marked = name.rlike("[™®©]")
    other = material.isNotNull() & (key != term_key(material))
    return (F.length(key) >= 4) & ~key.isin(*generic) & (marked | other | ((words >= 2) & name.rlike("[a-z][A-Z]")))


def judged(dossiers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Dossiers (material_id, identity_status, density_grade, density_status, low, high, best) downgraded to what evidence supports.

    evidence: material_id, url, scope, kind, for_identity, for_density. Exact scopes are variant, product and family. A verified identity needs an official exact
    source, a corroborated one two exact pages; without them it is probable if any identity source is left, else unresolved. Density grade A needs an official
    exact source, B two exact pages, C a teardown; without any density source all numbers go. Ranges are put in order, unknown densities have no numbers, and grade E
    is for comparison only. Counts are taken before the join, so no material's evidence meets in one row.
    """
    exact, official = F.col("scope").isin(*EXACT), F.col("kind").startswith("official")
    pages = lambda use: F.count_distinct(F.when(F.col(use) & exact, F.col("url")))
    counts = evidence.groupBy("material_id").agg(
        F.count_if("for_identity").alias("ids"), F.count_if(F.col("for_identity") & exact & official).alias("ids_official"), pages("for_identity").alias("ids_pages"),
        F.count_if("for_density").alias("dens"), F.count_if(F.col("for_density") & exact & official).alias("dens_official"), pages("for_density").alias("dens_pages"),
        F.count_if(F.col("for_density") & (F.col("kind") == "teardown")).alias("dens_teardown"),
    )
    found = [c for c in counts.columns if c != "material_id"]
    d = dossiers.join(counts, "material_id", "left").fillna(0, found)
    status, grade, measure = F.col("identity_status"), F.col("density_grade"), F.col("density_status")
    short = ((status == "verified_primary") & (F.col("ids_official") == 0)) | ((status == "verified_corroborated") & (F.col("ids_pages") < 2))
    none = F.col("dens") == 0
    torn = F.col("dens_teardown") > 0
    fallen = (grade == "A_manufacturer_exact") & (F.col("dens_official") == 0) | (grade == "B_corroborated_exact") & (F.col("dens_pages") < 2) & ~torn | (grade == "C_measured_teardown") & ~torn
    to_c = (grade == "B_corroborated_exact") & (F.col("dens_pages") < 2) & torn
    out = d.withColumns({
        "identity_status": F.when(short, F.when(F.col("ids") > 0, "probable").otherwise("unresolved")).otherwise(status),
        "density_grade": F.when(none, "unknown").when(fallen, "D_same_technology").when(to_c, "C_measured_teardown").otherwise(grade),
        "density_status": F.when(none, "unknown").when(fallen, "provisional_range").when(to_c, "corroborated_range").when(grade == "E_generic_category", "generic_comparison_only").otherwise(measure),
    })
    known = F.col("density_status") != "unknown"
    return out.withColumns({"low": F.when(known, F.when(F.col("high").isNull(), F.col("low")).otherwise(F.least("low", "high"))), "high": F.when(known, F.when(F.col("low").isNull() | F.col("high").isNull(), F.col("high")).otherwise(F.greatest("low", "high"))), "best": F.when(known, F.col("best"))}).drop(*found)
