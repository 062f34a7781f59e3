"""All queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scores, text, units, urls
from .operators import configure, graph, merge, ranking, records, resolve, similarity, thermal
from .operators.listed import listed
from .sources import dims
from .sources.views import table, view, with_views

DOMAIN = "example.com"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


# --- text, urls, units -------------------------------------------------------------------------------------------------

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(
    "url_canonicalize",
    rf"""
SELECT page_id, 'http' || CASE WHEN starts_with(url, 'https') THEN 's' ELSE '' END || '://' || {_HOST} || CASE WHEN p IN ('', '/') THEN '/' ELSE rtrim(p, '/') END
  || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_sort(q), '&') END AS url
FROM (SELECT page_id, url, regexp_replace({_PATH}, '/+', '/', 'g') AS p,
  list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|source|fbclid|gclid|mc_cid|mc_eid|utm_[a-z]+)=')) AS q FROM pages)""",
)
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


_PATHS = "CASE page_id % 6 WHEN 0 THEN '/products/a' WHEN 1 THEN '/collections/mattress/' WHEN 2 THEN '/blog/x' WHEN 3 THEN '/cart' WHEN 4 THEN '/catalogue.pdf' ELSE '/collections/chairs-2' END"


def _visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they are, and each once more (under -1 - page_id) with a path like a shop's."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url").union(pages.select(-1 - F.col("page_id"), F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.expr(_PATHS))))


#: The same for SQL, with the lower-case address, its path and the path's segments.
_VISITED = f"""(SELECT *, lower(url) AS low, lower({_PATH}) AS p, string_split(lower({_PATH}), '/') AS s
  FROM (SELECT page_id, url FROM pages UNION ALL SELECT -1 - page_id, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || {_PATHS} FROM pages) u)"""
_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_FOLLOWS = lambda heads, test: f"(len(list_filter(generate_series(1, len(s) - 1), lambda i: s[i] IN ({_LIST(heads)}) AND ({test}))) > 0)"
_DETAIL = _FOLLOWS(urls.DETAIL_HEADS, "s[i + 1] <> ''")
_LOCATION = _FOLLOWS(urls.LIST_HEADS, " OR ".join(f"(starts_with(s[i + 1], '{w}') AND len(s[i + 1]) > {len(w)})" for w in urls.LOCATION_STARTS) + f" OR s[i + 1] IN ({_LIST(urls.LOCATION_NAMES)})")
_OTHERS = (*urls.LOCATION_STARTS, "mattress-category", *urls.OTHER_GOODS, *(g + "s" for g in urls.OTHER_GOODS))
_NO_PRODUCT = f"({_FOLLOWS(urls.LIST_HEADS, f's[i + 1] IN ({_LIST(_OTHERS)})')} OR {_ANY('p', urls.NON_PRODUCT_TOKENS)})"


@query(
    "url_priority",
    f"""
SELECT page_id, CAST(CASE WHEN {_ANY("low", urls.REJECTED)} OR {_LOCATION} THEN -100 WHEN {_ANY("p", ("/blogs/", "/blog/"))} THEN -20
  ELSE CASE WHEN {_DETAIL} THEN 90 WHEN rtrim(p, '/') IN ('/collections/mattress', '/collections/mattresses') THEN 24 WHEN contains(p, '/collections/') THEN 4
      ELSE 10 * ({" + ".join(f"contains(p, '{w}')::INT" for w in urls.PRODUCT_HINTS)}) END
    + CASE WHEN ends_with(low, '.pdf') OR ends_with(low, '.pdf?download=1') THEN 70 ELSE 0 END + CASE WHEN {_ANY("low", ("catalog", "brochure", "specification"))} THEN 25 ELSE 0 END
    + CASE WHEN {_ANY("low", ("patent", "teardown", "cut-open", "cutopen"))} THEN 20 ELSE 0 END END AS INTEGER) AS priority FROM {_VISITED}""",
)
def url_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visited(spark, sf_dir).select("page_id", urls.priority(F.col("url")).cast("int").alias("priority"))


@query(
    "source_kind",
    rf"""
SELECT page_id, kind, o AS official, CASE kind WHEN 'official_catalogue' THEN 0.95 WHEN 'official_product' THEN 0.95 WHEN 'official_other' THEN 0.85 WHEN 'patent' THEN 0.85 WHEN 'retailer' THEN 0.6 WHEN 'teardown' THEN 0.8 ELSE 0.5 END::DOUBLE AS reliability
FROM (SELECT *, CASE WHEN o AND ends_with(low, '.pdf') THEN 'official_catalogue' WHEN o AND {_DETAIL} AND NOT {_NO_PRODUCT} THEN 'official_product' WHEN o THEN 'official_other' WHEN contains(low, 'patent') THEN 'patent'
  WHEN {_ANY("low", ("review", "retailer", "store", "shop"))} THEN 'retailer' WHEN {_ANY("low", ("teardown", "cut-open", "cutopen"))} THEN 'teardown' ELSE 'other' END AS kind
FROM (SELECT *, regexp_replace({_HOST}, '^www\.', '') = '{DOMAIN}' OR ends_with({_HOST}, '.{DOMAIN}') AS o FROM {_VISITED}) v) w""",
)
def source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visited(spark, sf_dir).select("page_id", urls.source_kind(F.col("url"), DOMAIN).alias("k")).select("page_id", "k.kind", "k.official", "k.reliability")


@query("name_normalize", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' MATTRESS-bed'), '\b(mattress|matress|bed)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalized_name(F.concat("p_name", F.lit(" MATTRESS-bed"))).alias("name"))


@query("text_clean", "SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b ]+', ' ', 'g')) AS text FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text("text").alias("text"))


@query("stable_ids", "SELECT p_partkey, 'prd_' || substr(sha256(lower(trim(p_brand)) || '|' || lower(trim(p_name)) || '|none'), 1, 16) AS id FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.stable_id("prd", "p_brand", "p_name", F.lit(None)).alias("id"))


_NUM = r"([0-9]+(?:\.[0-9]+)?)"


@query(
    "spec_facts",
    rf"""
WITH {with_views("v_spec_text")} SELECT id, round(TRY_CAST(regexp_extract(text, 'thickness: {_NUM} cm', 1) AS DOUBLE) * 10, 2) AS thickness_mm, TRY_CAST(regexp_extract(text, '{_NUM} kg/m3', 1) AS DOUBLE) AS density,
  TRY_CAST(regexp_extract(text, 'weight: {_NUM} kg', 1) AS DOUBLE) AS weight_kg, TRY_CAST(regexp_extract(text, '{_NUM} years warranty', 1) AS DOUBLE) AS warranty_years,
  TRY_CAST(replace(regexp_extract(text, 'Rs\. ([0-9]{{2,3}}(?:[,.][0-9]{{2,3}})*(?:\.[0-9]{{1,2}})?)', 1), ',', '') AS DOUBLE) AS price,
  CASE WHEN contains(text, 'medium soft') THEN 0.4 WHEN contains(text, 'medium firm') THEN 0.65 WHEN contains(text, 'extra firm') THEN 0.95 WHEN contains(text, 'very soft') THEN 0.1 WHEN contains(text, 'very firm') THEN 0.95
    WHEN contains(text, 'plush') THEN 0.2 WHEN contains(text, 'medium') THEN 0.5 WHEN contains(text, 'soft') THEN 0.25 WHEN contains(text, 'firm') THEN 0.8 END::DOUBLE AS firmness FROM v_spec_text""",
)
def spec_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return view(spark, sf_dir, "v_spec_text").select(
        "id", units.first_thickness_mm(t).alias("thickness_mm"), units.density_kg_m3(t).alias("density"), units.weight_kg(t).alias("weight_kg"),
        units.warranty_years(t).alias("warranty_years"), units.price(t).alias("price"), units.firmness(t).alias("firmness"),
    )


@query(
    "variants_from_text",
    rf"""
WITH {with_views("v_spec_text")} SELECT id, least(a, b) * 25.4 AS width_mm, greatest(a, b) * 25.4 AS length_mm, c * 25.4 AS thickness_mm FROM (
SELECT id, CAST(regexp_extract(text, 'Size {_NUM} x', 1) AS DOUBLE) AS a, CAST(regexp_extract(text, 'Size {_NUM} x {_NUM}', 2) AS DOUBLE) AS b, CAST(regexp_extract(text, 'x {_NUM} inches', 1) AS DOUBLE) AS c FROM v_spec_text)""",
)
def variants_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "v_spec_text").select("id", F.explode(units.dimensions(F.col("text"))).alias("v"))
    return found.select("id", "v.*")


@query(
    "material_mentions",
    f"""
WITH {with_views("v_spec_text")}, a(alias, material) AS (VALUES {", ".join(f"('{dims.plain(a)}', '{m}')" for a, m in dims.aliases())}),
t AS (SELECT id, trim(regexp_replace(replace(lower(text), '-', ' '), '\\s+', ' ', 'g')) AS t FROM v_spec_text) SELECT DISTINCT id, material FROM t JOIN a ON contains(t, alias)""",
)
def material_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.clean_text(F.regexp_replace(F.lower("text"), "-", " "))
    by: dict[str, list[str]] = {}
    for a, m in dims.aliases():
        by.setdefault(m, []).append(dims.plain(a))
    found = F.filter(F.array(*(F.when(urls.any_in(F.col("t"), tuple(words)), m) for m, words in by.items())), lambda x: x.isNotNull())
    return view(spark, sf_dir, "v_spec_text").select("id", t.alias("t")).select("id", F.explode(found).alias("material"))


@query("html_titles", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<h1[^>]*>(.*?)</h1>", 1).alias("h1"))


@query("html_links", "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"#][^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"#][^"]*)"'), F.lit(1))).alias("href")).distinct()


@query(
    "image_scores",
    f"""
WITH {with_views("v_images")}, t AS (SELECT *, lower(url || ' ' || coalesce(alt, '')) AS t FROM v_images) SELECT id, greatest(0, least(1, 0.15::DOUBLE
 + least(0.58::DOUBLE, 0.10::DOUBLE * ({" + ".join(f"contains(t, '{w}')::INT" for w in scores.LAYER_WORDS)})) - least(0.60::DOUBLE, 0.18::DOUBLE * ({" + ".join(f"contains(t, '{w}')::INT" for w in scores.REJECT_WORDS)}))
 + CASE WHEN width >= 800 AND height >= 500 THEN 0.15 ELSE 0 END - CASE WHEN width <= 120 OR height <= 120 THEN 0.40 ELSE 0 END
 + CASE WHEN regexp_matches(t, '\\.(jpg|jpeg|png|webp)$') THEN 0.05 ELSE 0 END)) AS score FROM t""",
)
def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_images").select("id", scores.image_score(F.col("url"), F.col("alt"), F.col("width"), F.col("height")).alias("score"))


@query(
    "hash_distance",
    """
WITH h AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS h FROM documents)
SELECT a.doc_id, bit_count(xor(('0x' || substr(a.h, 1, 8))::BIGINT, ('0x' || substr(b.h, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr(a.h, 9, 8))::BIGINT, ('0x' || substr(b.h, 9, 8))::BIGINT)) AS distance
FROM h a JOIN h b ON b.doc_id = a.doc_id + 1""",
)
def hash_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("h"))
    other = h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("g"))
    return h.join(other, "doc_id").select("doc_id", scores.hamming(F.col("h"), F.col("g")).alias("distance"))


@query(
    "token_jaccard",
    """
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents)
SELECT a.doc_id, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END AS similarity FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""",
)
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", scores.tokens(F.col("text")).alias("t"))
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return t.join(other, "doc_id").select("doc_id", scores.jaccard(F.col("t"), F.col("u")).alias("similarity"))


# --- records -------------------------------------------------------------------------------------------------------------


@query("observation_dedup", f"WITH {with_views('v_observations')} SELECT source, field, value, confidence, ordinal FROM v_observations QUALIFY row_number() OVER (PARTITION BY source, field, value ORDER BY confidence DESC, ordinal) = 1")
def observation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.keep_best(view(spark, sf_dir, "v_observations"), ["source", "field", "value"], "confidence", "ordinal").select("source", "field", "value", "confidence", "ordinal")


@query(
    "claims_unpivot",
    f"""
WITH {with_views("v_products", "v_layers")} SELECT * FROM (
 SELECT product_id, 'total_thickness_mm' AS field_path, total_mm::DOUBLE AS value_double, NULL::VARCHAR AS value_string FROM v_products UNION ALL SELECT product_id, 'product_weight_kg', weight_kg, NULL FROM v_products
 UNION ALL SELECT product_id, 'price', price, NULL FROM v_products UNION ALL SELECT product_id, 'firmness', NULL, firmness FROM v_products
 UNION ALL SELECT product_id, 'layers.' || position || '.thickness_mm', thickness_mm, NULL FROM v_layers UNION ALL SELECT product_id, 'layers.' || position || '.density_kg_m3', density, NULL FROM v_layers)
WHERE value_double IS NOT NULL OR value_string IS NOT NULL""",
)
def claims_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.claims(view(spark, sf_dir, "v_products"), view(spark, sf_dir, "v_layers"))


_ROWS = """
SELECT p.*, coalesce(l.n, 0) AS layer_count, coalesce(l.d, 0) AS densities, coalesce(l.t, 0) AS thicknesses, c.components, coalesce(v.n, 0) AS variant_count,
  CASE WHEN coalesce(l.n, 0) = 0 THEN 'undisclosed' WHEN l.d = l.n AND l.t = l.n THEN 'complete' ELSE 'partial' END AS construction
FROM v_products p LEFT JOIN (SELECT product_id, count(*) AS n, count(density) AS d, count(thickness_mm) AS t FROM v_layers GROUP BY product_id) l USING (product_id)
LEFT JOIN (SELECT product_id, string_agg(material, ' | ' ORDER BY f) AS components FROM (SELECT product_id, material, min(position) AS f FROM v_layers GROUP BY product_id, material) GROUP BY product_id) c USING (product_id)
LEFT JOIN (SELECT product_id, count(*) AS n FROM v_variants GROUP BY product_id) v USING (product_id)"""


def _product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.product_rows(*(view(spark, sf_dir, v) for v in ("v_products", "v_layers", "v_variants")))


@query("product_rows", f"WITH {with_views('v_products', 'v_layers', 'v_variants')} {_ROWS}")
def product_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _product_rows(spark, sf_dir)


@query(
    "review_queue",
    f"""
WITH {with_views("v_products", "v_layers", "v_variants")}, r AS ({_ROWS}), m AS (SELECT product_id, list_filter([CASE WHEN layer_count = 0 THEN 'layers' END, CASE WHEN densities < layer_count THEN 'densities' END,
 CASE WHEN thicknesses < layer_count THEN 'thicknesses' END, CASE WHEN weight_kg IS NULL THEN 'weight' END], lambda x: x IS NOT NULL) AS m FROM r)
SELECT product_id, array_to_string(m, ', ') AS missing, CASE WHEN len(m) >= 3 THEN 'high' WHEN len(m) = 2 THEN 'medium' ELSE 'low' END AS priority FROM m WHERE len(m) > 0""",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.review_queue(_product_rows(spark, sf_dir))


@query(
    "coverage",
    f"""
WITH s AS (SELECT page_id % 7 <> 0 AS fetched, {_HOST} = '{DOMAIN}' OR ends_with({_HOST}, '.{DOMAIN}') AS official FROM pages), c AS (SELECT count(*) AS total, count_if(fetched)::BIGINT AS fetched, count_if(fetched AND official)::BIGINT AS official FROM s)
SELECT *, least(100, 100 * (0.55::DOUBLE * fetched / total + 0.25::DOUBLE * official / fetched + 0.20::DOUBLE)) AS score FROM c""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 7 != 0).alias("fetched"), urls.is_official(F.col("url"), DOMAIN).alias("official"))
    return records.coverage(pages, 1.0)


@query(
    "job_ledger",
    f"""
WITH {with_views("v_jobs")}, b AS (SELECT *, min(CASE WHEN action = 'create' THEN event_id END) OVER (PARTITION BY job) AS born FROM v_jobs), a AS (SELECT *, coalesce(sum(CASE WHEN action IN ('complete', 'fail') THEN 1 ELSE 0 END)
 OVER (PARTITION BY job ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM b WHERE event_id >= born)
SELECT job, CASE WHEN bool_or(action = 'complete') THEN 'completed' WHEN bool_or(action = 'fail') THEN 'failed' WHEN bool_or(action IN ('claim', 'progress')) THEN 'running' ELSE 'queued' END AS status,
 count_if(action = 'claim')::BIGINT AS attempts, count_if(action = 'progress')::BIGINT AS progress, max(ts) AS updated FROM a WHERE (ended = 0 AND action <> 'create') OR event_id = born GROUP BY job""",
)
def job_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.ledger(view(spark, sf_dir, "v_jobs"))


@query("frontier_topk", f"SELECT page_id, priority, rank FROM (SELECT page_id, priority, row_number() OVER (PARTITION BY host ORDER BY priority DESC, page_id) AS rank FROM (SELECT v.page_id, p.priority, {_HOST} AS host FROM {_VISITED} v JOIN ({ORACLE['url_priority']}) p USING (page_id))) WHERE priority >= 0 AND rank <= 3")
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _visited(spark, sf_dir).select("page_id", urls.priority(F.col("url")).cast("int").alias("priority"), urls.host(F.col("url")).alias("host"))
    return records.top_per_group(rows, ["host"], [F.desc("priority"), F.asc("page_id")], 3).where("priority >= 0").select("page_id", "priority", "rank")


@query("url_antijoin", f"SELECT DISTINCT 'http://' || {_HOST} || '/seen' AS url FROM pages WHERE {_HOST} NOT IN (SELECT {_HOST} FROM pages WHERE page_id % 3 = 0)")
def url_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    known = pages.where("page_id % 3 = 0").select("host")
    return pages.join(known, "host", "left_anti").select(F.concat(F.lit("http://"), "host", F.lit("/seen")).alias("url")).distinct()


# --- resolution, similarity, graph ---------------------------------------------------------------------------------------


@query(
    "entity_resolution_exact",
    rf"""
WITH {with_views("v_products")}, k AS (SELECT product_id, company, trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(regexp_replace(lower(name), '\b(mattress|matress|bed)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS n FROM v_products)
SELECT product_id, min(product_id) OVER (PARTITION BY company, b, n) AS entity_id FROM k""",
)
def entity_resolution_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_exact(view(spark, sf_dir, "v_products"))


@query("entity_resolution_fuzzy")
def entity_resolution_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(view(spark, sf_dir, "v_products").withColumn("ordinal", F.col("product_id")))


@query(
    "products_merged",
    rf"""
WITH {with_views("v_products")}, k AS (SELECT *, company AS c, trim(regexp_replace(lower(brand), '[^a-z0-9]+', ' ', 'g')) AS b, trim(regexp_replace(regexp_replace(lower(name), '(mattress|matress|bed)', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS n FROM v_products),
e AS (SELECT *, min(product_id) OVER (PARTITION BY c, b, n) AS entity_id FROM k),
l AS (SELECT *, coalesce(confidence > max(confidence) OVER (PARTITION BY entity_id ORDER BY product_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS leads FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY NOT leads, CASE WHEN leads THEN -product_id ELSE product_id END) AS rank FROM l)
SELECT entity_id, CAST(arg_min(product_id, rank) AS VARCHAR) AS product_id, arg_min(firmness, rank) AS firmness, arg_min(total_mm, rank)::DOUBLE AS total_mm, arg_min(weight_kg, CASE WHEN weight_kg IS NOT NULL THEN rank END) AS weight_kg,
  arg_min(price, rank) AS price, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'html' END AS method, max(confidence) AS confidence, array_to_string(list(CAST(product_id AS VARCHAR) ORDER BY rank), ',') AS source_ids FROM r GROUP BY entity_id""",
)
def products_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of one company, brand and normalised name as one record."""
    products = view(spark, sf_dir, "v_products")
    own = F.col("product_id").cast("string")
    none = F.lit(None).cast("string")
    records_ = products.join(resolve.resolve_exact(products), "product_id").select(
        "entity_id", F.col("product_id").alias("ordinal"), own.alias("product_id"), "company", "brand", "name", *(none.alias(c) for c in ("family", "canonical_url", "description")), "firmness", F.col("total_mm").cast("double").alias("total_mm"),
        "weight_kg", "price", none.alias("currency"), F.array().cast(f"array<{merge.LAYER}>").alias("layers"), F.array().cast(f"array<{merge.VARIANT}>").alias("variants"), F.array(own).alias("source_ids"), F.array(F.col("company")).alias("tags"),
        F.lit("html").alias("method"), "confidence",
    )
    found = merge.fold(records_)
    return found.select("entity_id", "product_id", "firmness", "total_mm", "weight_kg", "price", "method", "confidence", F.array_join("source_ids", ",").alias("source_ids"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct brand and name of products: what similarity compares."""
    return view(spark, sf_dir, "v_products").groupBy("brand", "name").agg(F.min("product_id").alias("id")).select("id", F.concat_ws(" ", "brand", "name").alias("text"))


_TFIDF = f"""
WITH {with_views("v_products", "v_layers")}, e AS (SELECT min(product_id) AS id, brand || ' ' || name AS t FROM v_products GROUP BY brand, name), w AS (SELECT id, regexp_extract_all(lower(t), '\\w\\w+') AS w FROM e),
f AS (SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT id, term, count(*) AS tf FROM f GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 20000), r AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM e)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN d USING (term)),
v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM r), s AS (SELECT a.id, b.id AS other, sum(a.w * b.w) AS score FROM v a JOIN v b ON a.term = b.term AND a.id <> b.id GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, other) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = similarity.terms(_entries(spark, sf_dir))
    return similarity.neighbours(weights, weights)


@query("tfidf_neighbors", f"{_TFIDF} SELECT id, other, rank, round(score, 6) AS score FROM near")
def tfidf_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("id", "other", "rank", F.round("score", 6).alias("score"))


@query(
    "density_support",
    f"""{_TFIDF}, k AS (SELECT DISTINCT product_id AS other, material || ':' || CAST(round_even(density, 0) AS INT) AS key FROM v_layers WHERE density IS NOT NULL), g AS (SELECT id, key, sum(score) AS s FROM near JOIN k USING (other) GROUP BY ALL)
SELECT id, key, round(s / sum(s) OVER (PARTITION BY id), 6) AS share FROM g""",
)
def density_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.density_support(_near(spark, sf_dir), view(spark, sf_dir, "v_layers")).select("id", "key", F.round("share", 6).alias("share"))


@query("graph_edges", f"WITH {with_views('v_edges')} SELECT DISTINCT 'edg_' || substr(sha256(lower(source) || '|' || lower(relation) || '|' || lower(target)), 1, 16) AS edge_id, source, relation, target FROM v_edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges(view(spark, sf_dir, "v_edges"))


@query("graph_traverse", f"WITH RECURSIVE {with_views('v_edges')}, r(source, relation, target, depth) AS (SELECT source, relation, target, 0 FROM v_edges WHERE source = 'region:1' UNION SELECT e.source, e.relation, e.target, r.depth + 1 FROM r JOIN v_edges e ON e.source = r.target WHERE r.depth < 2) SELECT source, relation, target, depth FROM r")
def graph_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.traverse(graph.edges(view(spark, sf_dir, "v_edges")), "region:1", 3).select("source", "relation", "target", "depth")


# --- candidate stacks ----------------------------------------------------------------------------------------------------
# Whole stacks of some thirty layers: SQL would have to enumerate 50,000 combinations a product; tests hold them against plain enumeration, and stacks of three layers against SQL.


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    products, layers, variants = (view(spark, sf_dir, v) for v in ("v_products", "v_layers", "v_variants"))
    return configure.planned(products, layers, variants, dims.materials(spark))


@query("config_generate")
def config_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(_plan(spark, sf_dir)).select("product_id", "place", "enumerated", "taken", "picked", F.round("estimated_kg", 6).alias("estimated_kg"))


@query("config_rank")
def config_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_plan(spark, sf_dir)).select("product_id", "rank", "place", F.round("posterior", 6).alias("posterior"))


@query("config_rank_supported")
def config_rank_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the densities that neighbours by text state."""
    near = similarity.density_support(_near(spark, sf_dir), view(spark, sf_dir, "v_layers")).withColumnRenamed("id", "product_id")
    return ranking.rank(_plan(spark, sf_dir), near).select("product_id", "rank", "place", F.round("posterior", 6).alias("posterior"))


@query("thermal_screen")
def thermal_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens every candidate of every product."""
    out = thermal.screened(listed(_plan(spark, sf_dir), thermal=True))
    return out.select("product_id", "place", F.round("resistance", 6).alias("resistance"), F.round("heat_capacity", 3).alias("heat_capacity"), *(F.round(c, 6).alias(c) for c in ("final_c", "comfort_minutes", "peak_c")))


@query("thermal_constant_paths", "SELECT p AS prototype, round(list_sum(list_transform(generate_series(20700, 21600), lambda i: e + (25 - e) * power(1 - (1.8::DOUBLE + k) / 960, i))) / 901, 6) AS final_c FROM (SELECT p, k, (1.8::DOUBLE * 37 + k * 25) / (1.8::DOUBLE + k) AS e FROM (VALUES ('P2', 2.8::DOUBLE), ('P4', 2.25::DOUBLE)) v(p, k))")
def thermal_constant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("P2", 2.8), ("P4", 2.25)], "prototype string, k double")
    return rows.select("prototype", F.round(thermal.constant_path(F.col("k")), 6).alias("final_c"))


from . import plans  # noqa: E402, F401  its modules register their queries
