"""Export frames, captures and dossiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dossier, frames, records
from ..registry import query
from ..sources.views import view, with_views


@query(
    "layer_rows",
    f"""
WITH {with_views("v_products", "v_layers")} SELECT product_id, name AS product, position, material AS normalized_material, thickness_mm, CASE WHEN thickness_mm IS NULL THEN 'unknown' ELSE 'observed' END AS thickness_status,
 density AS density_kg_m3, CASE WHEN density IS NULL THEN 'unknown' ELSE 'observed' END AS density_status FROM v_layers JOIN v_products USING (product_id)""",
)
def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.layer_rows(view(spark, sf_dir, "v_products"), view(spark, sf_dir, "v_layers"))


@query("variant_rows", f"WITH {with_views('v_products', 'v_variants')} SELECT product_id, name AS product, ordinal, width_mm, length_mm, width_mm * length_mm / 1e6 AS area_m2 FROM v_variants JOIN v_products USING (product_id)")
def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.variant_rows(view(spark, sf_dir, "v_products"), view(spark, sf_dir, "v_variants"))


@query(
    "primary_table",
    f"""
WITH {with_views("v_products", "v_layers", "v_variants", "v_assets")},
l AS (SELECT product_id, count(*) AS layer_count, count(density) AS densities, count(thickness_mm) AS thicknesses FROM v_layers GROUP BY product_id),
c AS (SELECT product_id, string_agg(material, ' | ' ORDER BY f) AS components FROM (SELECT product_id, material, min(position) AS f FROM v_layers GROUP BY product_id, material) GROUP BY product_id),
v AS (SELECT product_id, count(*) AS variant_count FROM v_variants GROUP BY product_id), a AS (SELECT lower(trim(name)) AS k, count(DISTINCT asset_id) AS visual_assets FROM v_assets GROUP BY k)
SELECT product_id, name, firmness, total_mm, price, coalesce(components, '') AS components, coalesce(layer_count, 0) AS layer_count, coalesce(thicknesses, 0) AS thicknesses, coalesce(densities, 0) AS densities,
 coalesce(visual_assets, 0) AS visual_assets, CASE WHEN layer_count IS NULL THEN 'Construction not publicly verified' WHEN densities > 0 AND thicknesses = layer_count THEN 'Observed stack with measurements' ELSE 'Partial observed construction' END AS status,
 coalesce(variant_count, 0) AS variant_count, round(confidence, 3) AS confidence
FROM v_products LEFT JOIN l USING (product_id) LEFT JOIN c USING (product_id) LEFT JOIN v USING (product_id) LEFT JOIN a ON k = lower(name)""",
)
def primary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.product_rows(*(view(spark, sf_dir, v) for v in ("v_products", "v_layers", "v_variants")))
    return frames.primary_table(rows, view(spark, sf_dir, "v_assets"))


def _capture(ranks: str) -> str:
    return f"""
WITH {with_views("v_captures")}, x AS (SELECT *, regexp_matches(lower(url), '(\\.pdf|\\.xml|\\.xml\\.gz|/robots\\.txt)$') AS exact FROM v_captures)
SELECT url, arg_min(method, {ranks}) AS method, arg_min(chars, {ranks}) AS chars FROM x WHERE ok AND (NOT exact OR method = 'local') GROUP BY url"""


@query("capture_fallback", _capture("CASE method WHEN 'service' THEN 0 WHEN 'reader' THEN 1 ELSE 2 END"))
def capture_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.best_capture(view(spark, sf_dir, "v_captures"))


@query("capture_local_first", _capture("CASE method WHEN 'service' THEN 2 WHEN 'reader' THEN 1 ELSE CASE WHEN NOT exact AND chars < 800 THEN 1.5 ELSE 0 END END"))
def capture_local_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.best_capture(view(spark, sf_dir, "v_captures"), local_first=True)


_JUDGED = f"""
WITH {with_views("v_dossiers", "v_evidence")}, e AS (SELECT *, scope <> 'technology' AS exact, starts_with(kind, 'official') AS official FROM v_evidence),
n AS (SELECT material_id, count_if(for_identity) AS i, count_if(for_identity AND exact AND official) AS io, count(DISTINCT CASE WHEN for_identity AND exact THEN url END) AS ip,
 count_if(for_density) AS d, count_if(for_density AND exact AND official) AS dof, count(DISTINCT CASE WHEN for_density AND exact THEN url END) AS dp, count_if(for_density AND kind = 'teardown') AS dt FROM e GROUP BY material_id),
m AS (SELECT v.*, coalesce(i, 0) AS i, coalesce(io, 0) AS io, coalesce(ip, 0) AS ip, coalesce(d, 0) AS d, coalesce(dof, 0) AS dof, coalesce(dp, 0) AS dp, coalesce(dt, 0) AS dt FROM v_dossiers v LEFT JOIN n USING (material_id)),
s AS (SELECT *, CASE WHEN d = 0 THEN 'none' WHEN density_grade = 'A_manufacturer_exact' AND dof = 0 THEN 'D' WHEN density_grade = 'B_corroborated_exact' AND dp < 2 THEN CASE WHEN dt > 0 THEN 'C' ELSE 'D' END
 WHEN density_grade = 'C_measured_teardown' AND dt = 0 THEN 'D' WHEN density_grade = 'E_generic_category' THEN 'E' ELSE 'same' END AS fall FROM m),
t AS (SELECT material_id, CASE WHEN (identity_status = 'verified_primary' AND io = 0) OR (identity_status = 'verified_corroborated' AND ip < 2) THEN CASE WHEN i > 0 THEN 'probable' ELSE 'unresolved' END ELSE identity_status END AS identity_status,
 CASE fall WHEN 'none' THEN 'unknown' WHEN 'D' THEN 'D_same_technology' WHEN 'C' THEN 'C_measured_teardown' ELSE density_grade END AS density_grade,
 CASE fall WHEN 'none' THEN 'unknown' WHEN 'D' THEN 'provisional_range' WHEN 'C' THEN 'corroborated_range' WHEN 'E' THEN 'generic_comparison_only' ELSE density_status END AS density_status, low, high, best FROM s)
SELECT material_id, identity_status, density_grade, density_status, CASE WHEN density_status = 'unknown' THEN 'Unknown' WHEN density_status = 'verified_exact' THEN best::INT::VARCHAR
 WHEN high IS NULL OR low = high THEN low::INT || ' kg/m³' ELSE least(low, high)::INT || '–' || greatest(low, high)::INT || ' kg/m³' END AS density FROM t"""


@query("density_grade_ladder", _JUDGED)
def density_grade_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dossier.judged(view(spark, sf_dir, "v_dossiers"), view(spark, sf_dir, "v_evidence"))
    shown = frames.density_display(F.col("density_status"), F.col("low"), F.col("high"), F.col("best"))
    return out.select("material_id", "identity_status", "density_grade", "density_status", shown.alias("density"))
