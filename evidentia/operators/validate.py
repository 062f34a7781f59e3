"""Checks of records, their identifiers, defaults of old ones, and what a job's stages and tokens allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, stable_id

#: Bounds of numbers, both ends allowed but for those named in ABOVE (fixed values).
BOUNDS = {"confidence": (0.0, 1.0), "reliability": (0.0, 1.0), "relevance": (0.0, 1.0), "thickness_mm": (0.0, None), "density": (0.0, None), "price": (0.0, None), "weight_kg": (0.0, None), "width_mm": (0.0, None), "length_mm": (0.0, None), "position": (1.0, None)}
ABOVE = ("thickness_mm", "density", "weight_kg", "width_mm", "length_mm")
#: Per cent done at each stage of a job (fixed values).
STAGES = {
    "queued": 3, "initializing": 7, "discovering": 15, "crawling": 35, "extracting": 58, "assets": 70, "visual_followup": 76, "material_decoding": 81, "material_evidence": 84, "material_adjudication": 88,
    "resolving": 89, "analyzing": 92, "exporting": 97, "completed": 100, "failed": 100,
}


def checked(rows: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """The rows with required texts cleaned, and ``error``: the first check that fails, null where none does. Bad rows stay, to be set aside by who reads them."""
    clean = rows.withColumns({c: clean_text(c) for c in required}) if required else rows
    tests = [F.when(F.col(c) == "", F.lit(f"{c} is empty")) for c in required]
    for c, (low, high) in BOUNDS.items():
        if c in rows.columns:
            v = F.col(c)
            bad = ((v <= low) if c in ABOVE else (v < low)) | (v > high if high is not None else F.lit(False))
            tests.append(F.when(bad | F.isnan(v.cast("double")), F.lit(f"{c} is out of range")))
    return clean.withColumn("error", F.coalesce(*tests, F.lit(None).cast("string")))


def with_ids(products: DataFrame) -> DataFrame:
    """Products (company, brand, name, layers, variants) with identifiers where they lack them: of a product by company, brand and name; of a layer by product, place and name; of a variant by product and its SKU, else its size, else its number."""
    pid = F.coalesce("product_id", stable_id("prd", "company", "brand", "name"))
    made = products.withColumn("product_id", pid)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    key = lambda prefix, *parts: F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.lower(F.concat_ws("|", *(F.trim(text(p)) for p in parts))), 256), 1, 16))
    layers = F.transform("layers", lambda x: x.withField("layer_id", F.coalesce(x["layer_id"], key("lyr", F.col("product_id"), x["position"], x["marketing_name"]))))
    name = lambda v, i: F.coalesce(F.nullif(v["sku"], F.lit("")), F.nullif(v["size_name"], F.lit("")), (i + 1).cast("string"))
    variants = F.transform("variants", lambda v, i: v.withField("variant_id", F.coalesce(v["variant_id"], key("var", F.col("product_id"), name(v, i)))))
    return made.withColumns({"layers": layers, "variants": variants})


def migrated(runs: DataFrame) -> DataFrame:
    """Saved runs of any age with today's columns: lists that are missing are empty, settings have their defaults, retired columns go."""
    lists = ("assets", "trademark_materials", "observations", "crawl_log", "acquisition_log", "recognition_log")
    defaults = {"discover_assets": F.lit(True), "analyze_assets_with_vision": F.lit(True), "max_assets_per_document": F.lit(30), "max_vision_assets": F.lit(80), "max_pdf_pages": F.lit(100)}
    out = runs.drop("simulations", "simulate_top_configurations")
    for c in lists:
        out = out.withColumn(c, F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) if c in out.columns else F.array().cast("array<string>"))
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v) if c in out.columns else v)
    return out


def stage_percent(stage: Column) -> Column:
    """Per cent done at a stage, null for one that is not known."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in STAGES.items() for x in kv)), stage)


def fenced(events: DataFrame) -> DataFrame:
    """Events (job, event_id, action, token) with ``accepted``: a claim always, progress and endings only under the token of the last claim before them, and nothing after an accepted ending."""
    by = Window.partitionBy("job").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("action") == "claim", F.col("token")), ignorenulls=True).over(by)
    mine = F.coalesce(F.col("token") == holder, F.lit(False))
    ending = F.col("action").isin("complete", "fail")
    rows = events.withColumn("__mine", mine).withColumn("__end", (ending & F.col("__mine")).cast("int"))
    over = F.coalesce(F.sum("__end").over(by), F.lit(0)) > 0
    return rows.withColumn("accepted", ~over & (F.col("action").isin("create", "claim") | F.col("__mine"))).drop("__mine", "__end")


def reconciled(ledger: DataFrame, broker: DataFrame) -> DataFrame:
    """job, status: the ledger's where it is final, else the broker's mapped to the ledger's words where it knows the job, else the ledger's."""
    words = {"PENDING": "queued", "STARTED": "running", "RETRY": "running", "SUCCESS": "completed", "FAILURE": "failed", "REVOKED": "failed"}
    mapped = F.try_element_at(F.create_map(*(F.lit(x) for kv in words.items() for x in kv)), F.upper("state"))
    final = F.col("status").isin("completed", "failed", "cancelled")
    return ledger.join(broker.select("job", "state"), "job", "left").select("job", F.when(final, F.col("status")).otherwise(F.coalesce(mapped, F.col("status"))).alias("status"))


def historical_union(current: DataFrame, history: DataFrame) -> DataFrame:
    """Products of this run and of earlier ones, one row each: this run's where both have it."""
    both = current.withColumn("scope", F.lit("current")).unionByName(history.withColumn("scope", F.lit("historical")), allowMissingColumns=True)
    first = Window.partitionBy("product_id").orderBy("scope")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def independent_pages(evidence: DataFrame, least: int = 2) -> DataFrame:
    """material_id, pages, corroborated: distinct addresses that speak for a material."""
    return evidence.groupBy("material_id").agg(F.count_distinct("url").alias("pages")).withColumn("corroborated", F.col("pages") >= least)


def fallback_dossiers(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Dossiers of candidates (material_id, name, material, density) that the adjudicator did not return: what was seen is kept, nothing else is claimed."""
    missing = candidates.join(judged.select("material_id"), "material_id", "left_anti")
    seen, classed = F.col("density").isNotNull(), F.col("material").isNotNull()
    return missing.select(
        "material_id", "name", "material", F.when(classed, "probable").otherwise("unresolved").alias("identity_status"), F.when(seen, "A_manufacturer_exact").otherwise("unknown").alias("density_grade"),
        F.when(seen, "verified_exact").otherwise("unknown").alias("density_status"), F.col("density").alias("best"),
    )


def candidate_terms(rows: DataFrame, known: DataFrame, limit: int = 32) -> DataFrame:
    """Trade names worth decoding of rows (key, name, density, thickness_mm, confidence): of each key the surest that is not yet known, those with measures first, ``limit`` in all."""
    from .records import keep_best

    best = keep_best(rows.withColumn("__o", F.col("name")), ["key"], "confidence", "__o").drop("__o")
    order = [F.col("density").isNull(), F.col("thickness_mm").isNull(), F.desc("confidence"), F.col("key")]
    return best.join(known.select("key"), "key", "left_anti").orderBy(*order).limit(limit)


def attached(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents (url, sha256) with their source: by address, else by content; those without either are left out. Of equal contents the first address's source counts."""
    by_url = sources.groupBy(F.col("url").alias("u")).agg(F.min("source_id").alias("by_url"))
    by_sha = sources.groupBy(F.col("sha256").alias("s")).agg(F.min_by("source_id", "url").alias("by_sha"))
    found = documents.join(by_url, documents["url"] == by_url["u"], "left").join(by_sha, documents["sha256"] == by_sha["s"], "left")
    return found.withColumn("source_id", F.coalesce("by_url", "by_sha")).where("source_id is not null").drop("u", "s", "by_url", "by_sha")


def keys_by_url(pages: DataFrame) -> DataFrame:
    """url, keys: every key that names an address, sorted, each once."""
    return pages.where("url is not null").groupBy("url").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def budgeted(assets: DataFrame, each: int = 30, total: int = 80, least: float = 0.42) -> DataFrame:
    """Assets to look at: of each document the ``each`` with the best scores, of those the ``total`` with the highest priorities from ``least`` on; ties by identifier."""
    by = Window.partitionBy("source_id").orderBy(F.desc("score"), "asset_id")
    kept = assets.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= each).drop("__n")
    return kept.where(F.col("priority") >= least).orderBy(F.desc("priority"), "asset_id").limit(total)


def first_seen(rows: DataFrame, ordinal: str, columns: list[str] | None = None) -> DataFrame:
    """Rows that are distinct in some columns (all but the ordinal, as JSON, if None), the first of equals."""
    names = columns or [c for c in rows.columns if c != ordinal]
    key = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"})
    order = Window.partitionBy("__key").orderBy(ordinal)
    return rows.withColumn("__key", key).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__key", "__n")
