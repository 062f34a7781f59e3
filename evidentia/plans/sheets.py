"""The frames of a run over whole tables: every part is a product, every row of lineitem a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sheets
from ..registry import query
from ..sources.views import view, with_views

_V = ("v_products", "v_layers", "v_variants", "v_assets", "v_dossiers")
#: Statements over the views above, one text for both engines.
_FRAMES = {
    "products": """
SELECT product_id, company, brand, name, CASE WHEN product_id % 4 = 0 THEN NULL ELSE company END AS family, concat('https://www.example.com/products/', CAST(product_id AS STRING)) AS canonical_url, firmness,
 CASE WHEN product_id % 11 = 0 THEN NULL ELSE CAST(total_mm AS DOUBLE) END AS total_mm, weight_kg, price, CASE WHEN product_id % 3 = 0 THEN 'USD' ELSE 'INR' END AS currency,
 CASE product_id % 3 WHEN 0 THEN 'json_ld' ELSE 'page_text' END AS extraction_method, confidence, product_id % 5 = 0 AS reviewed, CASE WHEN product_id % 6 = 0 THEN NULL ELSE concat(name, ' by ', brand) END AS description FROM v_products""",
    "layers": """
SELECT product_id, position, concat('lay_', CAST(product_id AS STRING), '_', CAST(position AS STRING)) AS layer_id, CASE WHEN position % 7 = 0 THEN '' ELSE upper(material) END AS marketing_name, material, thickness_mm,
 CASE WHEN thickness_mm IS NULL THEN 'unknown' ELSE 'observed' END AS thickness_status, density, CASE WHEN density IS NULL THEN 'unknown' ELSE 'observed' END AS density_status FROM v_layers""",
    "variants": "SELECT product_id, ordinal, width_mm, length_mm FROM v_variants",
    "assets": "SELECT asset_id, name FROM v_assets",
    "evidence": """
SELECT product_id, position, n AS ordinal, concat('src_', CAST(product_id % 7 AS STRING), '_', CAST(n AS STRING)) AS source_id, CASE WHEN position % 3 = 0 THEN NULL ELSE concat('ast_', CAST(position AS STRING)) END AS asset_id,
 CASE WHEN (position + n) % 2 = 0 THEN concat(material, ' layer') END AS excerpt, CAST(50 + 10 * ((position + n) % 5) AS DOUBLE) / CAST(100 AS DOUBLE) AS reliability
FROM (SELECT product_id, position, material, 1 AS n FROM v_layers WHERE position % 4 <> 1 UNION ALL SELECT product_id, position, material, 2 FROM v_layers WHERE position % 2 = 0) x""",
    "sources": """
SELECT product_id, n AS ordinal, concat('src_', CAST(product_id % 7 AS STRING), '_', CAST(n AS STRING)) AS source_id
FROM (SELECT product_id, 1 AS n FROM v_products WHERE product_id % 5 <> 0 UNION ALL SELECT product_id, 2 FROM v_products WHERE product_id % 2 = 0) x""",
    "configurations": "SELECT concat('cfg_', CAST(product_id AS STRING)) AS configuration_id, product_id, CAST(1 + product_id % 2 AS INT) AS rank, CAST(40 + product_id % 60 AS DOUBLE) AS confidence_score FROM v_products",
}


def _frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    out = []
    for n in names:
        text, used = _FRAMES[n], {v: view(spark, sf_dir, v) for v in _V if v in _FRAMES[n]}
        for v in used:
            text = text.replace(f"FROM {v}", f"FROM {{{v}}}")
        out.append(spark.sql(text, **used))
    return out


def _with(*names: str) -> str:
    used = [v for v in _V if any(v in _FRAMES[n] for n in names)]
    return f"WITH {with_views(*used)}, " + ", ".join(f"{n} AS ({_FRAMES[n]})" for n in names)


def _joined(rows: str, keys: str, name: str, column: str, separator: str) -> str:
    return f"(SELECT {keys}, string_agg({column}, '{separator}' ORDER BY ordinal) FILTER (coalesce({column}, '') <> '') AS {name} FROM {rows} GROUP BY {keys})"


@query(
    "sheet_products",
    f"""
{_with("products", "layers", "variants", "sources")}
SELECT product_id, company, brand, name AS product, family, canonical_url, firmness, total_mm AS total_thickness_mm, weight_kg AS product_weight_kg, price, currency, coalesce(l.n, 0) AS layer_count, coalesce(v.n, 0) AS variant_count,
 coalesce(s.n, 0) AS source_count, extraction_method, confidence AS extraction_confidence, reviewed, description FROM products
LEFT JOIN (SELECT product_id, count(*) AS n FROM layers GROUP BY 1) l USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS n FROM variants GROUP BY 1) v USING (product_id)
LEFT JOIN (SELECT product_id, count(*) AS n FROM sources GROUP BY 1) s USING (product_id)""",
)
def sheet_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.product_sheet(*_frames(spark, sf_dir, "products", "layers", "variants", "sources"))


@query(
    "sheet_variants",
    f"""
{_with("products", "variants", "sources")}
SELECT product_id, ordinal, width_mm, length_mm, name AS product, coalesce(source_ids, '') AS source_ids FROM variants JOIN products USING (product_id) LEFT JOIN {_joined("sources", "product_id", "source_ids", "source_id", ", ")} s USING (product_id)""",
)
def sheet_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.variant_sheet(*_frames(spark, sf_dir, "products", "variants", "sources"))


_KEY = "product_id, position"


@query(
    "sheet_layers",
    f"""
{_with("products", "layers", "evidence")}
SELECT product_id, name AS product, layer_id, position, marketing_name, material AS normalized_material, thickness_mm, thickness_status, density AS density_kg_m3, density_status, coalesce(evidence_source_ids, '') AS evidence_source_ids,
 coalesce(evidence_asset_ids, '') AS evidence_asset_ids, coalesce(evidence_excerpts, '') AS evidence_excerpts FROM layers JOIN products USING (product_id)
LEFT JOIN {_joined("evidence", _KEY, "evidence_source_ids", "source_id", ", ")} a USING ({_KEY}) LEFT JOIN {_joined("evidence", _KEY, "evidence_asset_ids", "asset_id", ", ")} b USING ({_KEY})
LEFT JOIN {_joined("evidence", _KEY, "evidence_excerpts", "excerpt", " | ")} c USING ({_KEY})""",
)
def sheet_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.layer_sheet(*_frames(spark, sf_dir, "products", "layers", "evidence"))


@query(
    "sheet_claims",
    f"""
{_with("products", "layers", "evidence", "sources")},
p AS (SELECT *, coalesce(source_ids, '') AS ids FROM products LEFT JOIN {_joined("sources", "product_id", "source_ids", "source_id", ", ")} s USING (product_id)),
l AS (SELECT x.*, extraction_method, coalesce(r, 0.5::DOUBLE) AS sure, coalesce(source_ids, '') AS ids FROM layers x JOIN products USING (product_id) LEFT JOIN (SELECT {_KEY}, max(reliability) AS r FROM evidence GROUP BY ALL) e USING ({_KEY})
 LEFT JOIN {_joined("evidence", _KEY, "source_ids", "source_id", ", ")} s USING ({_KEY}))
SELECT product_id, 'total_thickness_mm' AS field_path, total_mm AS value_double, NULL::VARCHAR AS value_string, 'mm' AS unit, 'observed' AS status, confidence, extraction_method AS method, ids AS source_ids FROM p WHERE total_mm IS NOT NULL
UNION ALL SELECT product_id, 'product_weight_kg', weight_kg, NULL, 'kg', 'observed', confidence, extraction_method, ids FROM p WHERE weight_kg IS NOT NULL
UNION ALL SELECT product_id, 'price', price, NULL, currency, 'observed', confidence, extraction_method, ids FROM p WHERE price IS NOT NULL
UNION ALL SELECT product_id, 'firmness', NULL, firmness, NULL, 'observed', confidence, extraction_method, ids FROM p WHERE firmness IS NOT NULL
UNION ALL SELECT product_id, 'layers.' || position || '.thickness_mm', thickness_mm, NULL, 'mm', thickness_status, sure, extraction_method, ids FROM l WHERE thickness_mm IS NOT NULL
UNION ALL SELECT product_id, 'layers.' || position || '.density_kg_m3', density, NULL, 'kg/m3', density_status, sure, extraction_method, ids FROM l WHERE density IS NOT NULL""",
)
def sheet_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.claim_sheet(*_frames(spark, sf_dir, "products", "layers", "evidence", "sources"))


@query(
    "sheet_primary",
    f"""
{_with("products", "layers", "variants", "assets")},
l AS (SELECT product_id, count(*) AS n, count(thickness_mm) AS t, count(density) AS d FROM layers GROUP BY 1), v AS (SELECT product_id, count(*) AS v FROM variants GROUP BY 1),
c AS (SELECT product_id, string_agg(marketing_name, ' | ' ORDER BY f) AS components FROM (SELECT product_id, marketing_name, min(position) AS f FROM layers WHERE marketing_name <> '' GROUP BY ALL) GROUP BY 1),
a AS (SELECT lower(trim(name)) AS k, count(DISTINCT asset_id) AS a FROM assets GROUP BY 1)
SELECT name AS "Product", family AS "Family", firmness AS "Firmness", total_mm AS "Thickness (mm)", price AS "Price", currency AS "Currency", coalesce(components, '') AS "Observed components", coalesce(n, 0) AS "Observed component count",
 coalesce(t, 0) AS "Layer thickness evidence", coalesce(d, 0) AS "Density evidence", coalesce(a, 0) AS "Visual evidence assets", CASE WHEN n IS NULL THEN 'Construction not publicly verified' WHEN d > 0 AND t = n
 THEN 'Observed stack with measurements' ELSE 'Partial observed construction' END AS "Construction status", coalesce(v, 0) AS "Variants", round_even(confidence, 3) AS "Extraction confidence", canonical_url AS "URL"
FROM products LEFT JOIN l USING (product_id) LEFT JOIN v USING (product_id) LEFT JOIN c USING (product_id) LEFT JOIN a ON k = lower(name)""",
)
def sheet_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.primary_sheet(*_frames(spark, sf_dir, "products", "layers", "variants", "assets"))


@query(
    "sheet_materials",
    f"""
WITH {with_views("v_dossiers")} SELECT CASE WHEN material_id % 3 = 0 THEN 'range' ELSE concat('product ', material_id) END AS "Product", NULL::VARCHAR AS "Diagram crop", concat('Foam ', material_id) AS "Trademark / branded name",
 'foam' AS "What it actually is", NULL::VARCHAR AS "Technical description", 'polyurethane' AS "Base material", CASE WHEN material_id % 2 = 0 THEN 'gel | cells' ELSE 'cells' END AS "Additives / structure", 'comfort' AS "Probable function",
 (material_id % 5)::INT AS "Stack position", identity_status AS "Identity status", 0.5::DOUBLE AS "Identity confidence", 'exact_product' AS "Evidence scope",
 CASE WHEN density_status = 'verified_exact' THEN '40' WHEN high IS NULL OR high = low THEN low::INT || ' kg/m³' ELSE low::INT || '–' || high::INT || ' kg/m³' END AS "Density", density_status AS "Density status",
 density_grade AS "Density grade", 0.5::DOUBLE AS "Density confidence", NULL::VARCHAR AS "Density basis", (material_id % 4)::INT AS "Evidence sources", '' AS "Contradictions", 'supplier' AS "Unknowns", NULL::VARCHAR AS "Conclusion" FROM v_dossiers""",
)
def sheet_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, text = F.col("material_id"), F.lit(None).cast("string")
    rows = view(spark, sf_dir, "v_dossiers").select(
        F.when(id_ % 3 != 0, F.concat(F.lit("product "), id_.cast("string"))).alias("product_name"), F.lit("range").alias("family"), text.alias("diagram_crop"), F.concat(F.lit("Foam "), id_.cast("string")).alias("trademark"),
        F.lit("foam").alias("generic_name"), text.alias("description"), F.lit("polyurethane").alias("base_polymer"), F.array(F.when(id_ % 2 == 0, "gel"), F.lit("cells"), F.lit("")).alias("additives"), F.array(F.lit("comfort")).alias("functions"),
        (id_ % 5).cast("int").alias("stack_position"), "identity_status", F.lit(0.5).alias("identity_confidence"), F.lit("exact_product").alias("evidence_scope"), F.col("low").alias("density_low"), F.col("high").alias("density_high"),
        F.col("best").alias("density_best"), "density_status", "density_grade", F.lit(0.5).alias("density_confidence"), text.alias("density_basis"), (id_ % 4).cast("int").alias("evidence_sources"),
        F.lit(None).cast("array<string>").alias("contradictions"), F.array(F.lit("supplier")).alias("unknowns"), text.alias("conclusion"),
    )
    return sheets.material_sheet(rows)


@query(
    "sheet_review",
    f"""
{_with("products", "layers", "configurations")}, r AS (SELECT p.*, list_filter([CASE WHEN total_mm IS NULL THEN 'total_thickness_mm' END, CASE WHEN n IS NULL THEN 'layers' END, CASE WHEN d < n THEN 'one_or_more_layer_densities' END],
 lambda x: x IS NOT NULL) AS m FROM products p LEFT JOIN (SELECT product_id, count(*) AS n, count(density) AS d FROM layers GROUP BY 1) l USING (product_id))
SELECT 'product' AS entity_type, product_id::VARCHAR AS entity_id, name AS product, CASE WHEN confidence < 0.6::DOUBLE THEN 'high' ELSE 'normal' END AS priority,
 CASE WHEN len(m) > 0 THEN array_to_string(m, ', ') ELSE 'low extraction confidence' END AS reason, confidence FROM r WHERE confidence < 0.7::DOUBLE OR len(m) > 0
UNION ALL SELECT 'configuration', configuration_id, product_id::VARCHAR, 'high', 'Top configuration has low provisional confidence', confidence_score / 100 FROM configurations WHERE rank = 1 AND confidence_score < 60""",
)
def sheet_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.review_sheet(*_frames(spark, sf_dir, "products", "layers", "configurations"))
