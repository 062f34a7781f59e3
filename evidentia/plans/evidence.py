"""Captured pages, their sources and pictures, the whole evidence graph, and checks of records and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages, scores, search
from ..operators import exports, knowledge, observe, validate
from ..registry import _DETAIL, _HOST, _NO_PRODUCT, _VISITED, DOMAIN, ORACLE, _visited, query
from ..sources.views import table, view, with_views

@query(
    "document_types",
    f"""
SELECT page_id, CASE WHEN {_NO_PRODUCT} THEN CASE WHEN contains(low, 'mattress-in-') THEN 'location_page' WHEN contains(low, 'store') THEN 'store_page'
 WHEN contains(low, '/blog') THEN 'blog_or_guide' ELSE 'collection' END WHEN {_DETAIL} THEN 'product_detail' WHEN ends_with(low, '.pdf') THEN 'catalogue' ELSE 'other' END AS kind FROM {_VISITED}""",
)
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visited(spark, sf_dir).select("page_id", pages.document_type(F.col("url"), F.lit(False)).alias("kind"))


_SHOP = "CASE page_id % 4 WHEN 0 THEN ' Our mattress, add to cart ' WHEN 1 THEN ' latex mattress by Acme ' ELSE ' ' END"
_OWN = "CASE WHEN v.page_id < 0 THEN -1 - v.page_id ELSE v.page_id END"
_HAS = lambda t, words: "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


@query(
    "relevant_documents",
    f"""
WITH v AS (SELECT v.page_id, p, s, lower(substr(shop || coalesce(html, ''), 1, 20000)) AS a, lower(substr(shop || coalesce(html, ''), 1, 50000)) AS b FROM {_VISITED} v JOIN (SELECT page_id AS own, html, {_SHOP} AS shop FROM pages) h ON own = {_OWN}),
l AS (SELECT *, NOT {_NO_PRODUCT} AND {_DETAIL} AND contains(a, 'mattress') AND {_HAS("a", pages.COMMERCE)} AS product FROM v)
SELECT page_id, product, product OR (contains(b, 'mattress') AND contains(b, 'acme') AND {_HAS("b", pages.EVIDENCE)}) AS relevant FROM l""",
)
def relevant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = table(spark, sf_dir, "pages").select(F.col("page_id").alias("own"), F.concat(F.expr(_SHOP), F.coalesce("html", F.lit(""))).alias("t"))
    both = _visited(spark, sf_dir).alias("v").withColumn("own", F.expr(_OWN)).join(body, "own")
    return both.select("page_id", pages.looks_like_product(F.col("url"), F.col("t")).alias("product"), pages.looks_relevant(F.col("url"), F.col("t"), ("Acme",)).alias("relevant"))


@query(
    "document_sources",
    f"""
WITH k AS ({ORACLE["source_kind"]}), v AS (SELECT v.page_id, v.url, sha256(coalesce(html, '')) AS sha256 FROM {_VISITED} v JOIN (SELECT page_id AS own, html FROM pages) h ON own = {_OWN})
SELECT 'src_' || substr(sha256(lower(trim(url)) || '|' || sha256), 1, 16) AS source_id, 'Acme' AS company, url, kind, official, reliability, sha256 FROM v JOIN k USING (page_id)""",
)
def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select(F.col("page_id").alias("own"), F.col("html").alias("body"))
    docs = _visited(spark, sf_dir).alias("v").withColumn("own", F.expr(_OWN)).join(own, "own").withColumns({"title": F.lit(None).cast("string"), "retrieved": F.lit(0)})
    return observe.sources(docs, "Acme", DOMAIN).drop("title", "retrieved_at")


@query("html_meta", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1), '\s+', ' ', 'g')), '') AS description FROM pages""")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.meta(F.col("html"), "description").alias("description"))


_TEXT = "lower(url || ' ' || coalesce(alt, '') || ' ')"


@query(
    "vision_priority",
    f"""
WITH {with_views("v_images")}, s AS ({ORACLE["image_scores"]}), t AS (SELECT id, width, height, {_TEXT} AS t, score FROM v_images JOIN s USING (id))
SELECT id, greatest(0, least(1, score + least(0.45::DOUBLE, 0.055::DOUBLE * ({" + ".join(f"contains(t, '{w}')::INT" for w in search.TECHNICAL)})) + CASE WHEN width >= 1200 AND height >= 700 THEN 0.10::DOUBLE ELSE 0 END
 - CASE WHEN width <= 300 OR height <= 180 THEN 0.28::DOUBLE ELSE 0 END - CASE WHEN {_HAS("t", ("bedroom", "lifestyle", "banner", "hero"))} THEN 0.15::DOUBLE ELSE 0 END)) AS priority FROM t""",
)
def vision_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scores.image_score(F.col("url"), F.col("alt"), F.col("width"), F.col("height"))
    return view(spark, sf_dir, "v_images").select("id", search.vision_priority(base, F.col("url"), F.col("alt"), F.lit(None).cast("string"), F.lit(False), F.col("width"), F.col("height")).alias("priority"))


@query("original_images", r"SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/p/img' || (page_id % 5) || '.jpg?v=1' AS url FROM pages")
def original_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.expr("concat('/p/img', page_id % 5, CASE page_id % 4 WHEN 0 THEN '_600x400_crop_center' WHEN 1 THEN '_x200' WHEN 2 THEN '_80x' ELSE '' END, '.jpg?width=', page_id, '&v=1')"))
    return table(spark, sf_dir, "pages").select("page_id", search.original_image(sized).alias("url"))


@query("official_origins", f"SELECT page_id, 'https://' || {_HOST} AS origin FROM pages")
def official_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import urls

    return table(spark, sf_dir, "pages").select("page_id", search.official_origin(F.concat(F.lit("  "), urls.host(F.col("url")), F.lit("/a?b "))).alias("origin"))


def _frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    products = view(spark, sf_dir, "v_products").withColumn("product_id", F.col("product_id").cast("string")).withColumn("source_ids", F.expr("array(concat('src_', cast(product_id as bigint) % 7), 'src_0')"))
    layers = view(spark, sf_dir, "v_layers").selectExpr("cast(product_id as string) product_id", "concat('lyr_', product_id, '_', position) layer_id", "position", "material marketing_name", "material", "array(concat('src_', product_id % 9)) source_ids")
    sources = spark.range(5).selectExpr("concat('src_', id) source_id")
    assets = view(spark, sf_dir, "v_images").selectExpr("concat('ast_', id) asset_id", "concat('src_', id % 6) source_id", "'image' kind")
    seen = view(spark, sf_dir, "v_observations").selectExpr("concat('obs_', ordinal) observation_id", "concat('src_', source % 5) source_id", "field", "concat('ast_', ordinal) asset_id", "CASE WHEN ordinal % 2 = 0 THEN 'hr_foam' END material", "CAST(NULL AS STRING) product_name", "confidence")
    return {"products": products, "layers": layers, "sources": sources, "assets": assets, "observations": seen}


@query(
    "evidence_graph",
    f"""
WITH {with_views("v_products", "v_layers", "v_images", "v_observations")}, b AS (SELECT *, 'brd_' || substr(sha256(lower(trim(company)) || '|' || lower(trim(brand))), 1, 16) AS bid FROM v_products), e AS (
SELECT company AS source, 'HAS_PRODUCT' AS relation, product_id::VARCHAR AS target FROM b UNION SELECT company, 'HAS_BRAND', bid FROM b UNION SELECT bid, 'SELLS', product_id::VARCHAR FROM b
UNION SELECT product_id::VARCHAR, 'SUPPORTED_BY', 'src_0' FROM b UNION SELECT product_id::VARCHAR, 'SUPPORTED_BY', 'src_' || (product_id % 7) FROM b WHERE product_id % 7 < 5
UNION SELECT product_id::VARCHAR, 'HAS_LAYER', 'lyr_' || product_id || '_' || position FROM v_layers UNION SELECT 'lyr_' || product_id || '_' || position, 'NORMALIZES_TO', 'mat_' || material FROM v_layers
UNION SELECT 'lyr_' || product_id || '_' || position, 'SUPPORTED_BY', 'src_' || (product_id % 9) FROM v_layers WHERE product_id % 9 < 5
UNION SELECT 'src_' || (id % 6), 'HAS_ASSET', 'ast_' || id FROM v_images UNION SELECT 'src_' || (source % 5), 'HAS_OBSERVATION', 'obs_' || ordinal FROM v_observations
UNION SELECT 'ast_' || ordinal, 'HAS_OBSERVATION', 'obs_' || ordinal FROM v_observations WHERE ordinal IN (SELECT id FROM v_images) UNION SELECT 'obs_' || ordinal, 'NORMALIZES_TO', 'mat_hr_foam' FROM v_observations WHERE ordinal % 2 = 0)
SELECT 'edg_' || substr(sha256(lower(trim(source)) || '|' || lower(relation) || '|' || lower(trim(target))), 1, 16) AS edge_id, source, relation, target FROM e""",
)
def evidence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.graph(_frames(spark, sf_dir)).drop("properties")


@query("run_summary", f"WITH {with_views('v_products', 'v_layers', 'v_images', 'v_observations')} SELECT 'r1' AS run_id, 'Acme' AS company, (SELECT count(*) FROM v_products) AS products, (SELECT count(*) FROM v_layers) AS layers, 5::BIGINT AS sources, (SELECT count(*) FROM v_images) AS assets, (SELECT count(*) FROM v_observations) AS observations")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.run_summary(_frames(spark, sf_dir), "r1", "Acme")


@query(
    "valid_products",
    f"""
WITH {with_views("v_products")}, c AS (SELECT product_id, trim(CASE WHEN product_id % 10 = 0 THEN '  ' ELSE name END) AS name, confidence + CASE WHEN product_id % 7 = 0 THEN 1 ELSE 0 END AS confidence, CASE WHEN product_id % 11 = 0 THEN 0 ELSE weight_kg END AS weight_kg FROM v_products)
SELECT product_id, CASE WHEN name = '' THEN 'name is empty' WHEN confidence > 1 THEN 'confidence is out of range' WHEN weight_kg <= 0 THEN 'weight_kg is out of range' END AS error FROM c""",
)
def valid_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = view(spark, sf_dir, "v_products").selectExpr("product_id", "CASE WHEN product_id % 10 = 0 THEN '  ' ELSE name END name", "confidence + CASE WHEN product_id % 7 = 0 THEN 1 ELSE 0 END confidence", "CASE WHEN product_id % 11 = 0 THEN 0D ELSE weight_kg END weight_kg")
    return validate.checked(odd, ("name",)).select("product_id", "error")


@query(
    "fenced_events",
    f"""
WITH {with_views("v_jobs")}, h AS (SELECT job, event_id, action, event_id % 3 AS token, last_value(CASE WHEN action = 'claim' THEN event_id % 3 END IGNORE NULLS) OVER (PARTITION BY job ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM v_jobs),
m AS (SELECT *, coalesce(token = holder, false) AS mine FROM h), o AS (SELECT *, coalesce(sum((action IN ('complete', 'fail') AND mine)::INT) OVER (PARTITION BY job ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS over FROM m)
SELECT job, event_id, action, token, NOT over AND (action IN ('create', 'claim') OR mine) AS accepted FROM o""",
)
def fenced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.fenced(view(spark, sf_dir, "v_jobs").selectExpr("job", "event_id", "action", "event_id % 3 AS token"))


@query("first_seen_events", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_seen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.first_seen(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("keys_by_url", f"SELECT {_HOST} AS url, list_sort(list_distinct(list(page_id % 100))) AS keys FROM pages GROUP BY 1")
def keys_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import urls

    return validate.keys_by_url(table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("url"), (F.col("page_id") % 100).alias("key")))


@query(
    "budgeted_assets",
    f"""
WITH {with_views("v_images")}, s AS (SELECT id AS asset_id, id % 13 AS source_id, width::DOUBLE AS score, (id * 7 % 100) / 100::DOUBLE AS priority FROM v_images), k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, asset_id) <= 30)
SELECT asset_id, source_id, priority FROM k WHERE priority >= 0.42 ORDER BY priority DESC, asset_id LIMIT 80""",
)
def budgeted_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "v_images").selectExpr("id AS asset_id", "id % 13 AS source_id", "CAST(width AS DOUBLE) AS score", "(id * 7 % 100) / 100D AS priority")
    return validate.budgeted(rows).select("asset_id", "source_id", "priority")


@query("historical_union", f"WITH {with_views('v_products')} SELECT product_id, CASE WHEN product_id % 3 <> 1 THEN 'current' ELSE 'historical' END AS scope FROM v_products")
def historical_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = view(spark, sf_dir, "v_products")
    return validate.historical_union(every.where("product_id % 3 <> 1"), every.where("product_id % 3 <> 0")).select("product_id", "scope")


@query("independent_pages", f"WITH {with_views('v_evidence')} SELECT material_id, count(DISTINCT url) AS pages, count(DISTINCT url) >= 2 AS corroborated FROM v_evidence GROUP BY 1")
def independent_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.independent_pages(view(spark, sf_dir, "v_evidence"))


@query("text_observations")
def text_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observe.observations(view(spark, sf_dir, "v_spec_text").withColumn("reliability", F.lit(0.95)))
