"""Views over the driver's tables that stand in for products, layers, variants and the rest; one text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .dims import MATERIALS, aliases

_LABELS = ("very soft", "plush", "soft", "medium soft", "medium", "medium firm", "firm", "extra firm", "very firm")
_D = "CAST({} AS DOUBLE)".format


def case_of(index: str, values: list[str] | tuple[str, ...]) -> str:
    """SQL: the value at an index from 0."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


VIEWS = {
    "v_products": f"""
SELECT p_partkey AS product_id, p_type AS company, p_brand AS brand, concat(p_name, ' mattress') AS name, p_retailprice AS price,
       {case_of("(p_size % 9)", _LABELS)} AS firmness, 100 + 10 * (p_size % 11) AS total_mm,
       CASE WHEN p_size % 25 = 0 THEN NULL ELSE {_D("10 + p_size % 25")} END AS weight_kg,
       {_D("50 + p_partkey % 50")} / {_D(100)} AS confidence
FROM part""",
    "v_layers": f"""
SELECT product_id, position, {case_of("material_no", tuple(MATERIALS))} AS material,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE {_D("5 * (1 + CAST(l_quantity AS INT) % 20)")} END AS thickness_mm,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE {_D("20 + 5 * (CAST(l_quantity AS INT) % 17)")} END AS density
FROM (SELECT l_partkey AS product_id, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_linestatus, l_returnflag) AS INT) AS position,
             CAST(l_suppkey % 14 AS INT) AS material_no, l_quantity, l_linestatus, l_returnflag FROM lineitem) x""",
    "v_variants": """
SELECT product_id, ordinal, CASE ordinal WHEN 1 THEN 1520.0E0 ELSE 1830.0E0 END AS width_mm, 1980.0E0 AS length_mm FROM (
  SELECT p_partkey AS product_id, 1 AS ordinal FROM part UNION ALL SELECT p_partkey, 2 FROM part WHERE p_size % 2 = 0) x""",
    "v_spec_text": f"""
SELECT p_partkey AS id, concat(p_name, ' mattress. Total thickness: ', CAST(10 + p_size % 20 AS STRING), ' cm, core of ', CAST(20 + p_size AS STRING),
       ' kg/m3 ', {case_of("CAST(p_partkey % 95 AS INT)", [a for a, _ in aliases()])}, ', ', {case_of("(p_size % 9)", _LABELS)}, ' feel. Rs. ',
       CASE p_size % 3 WHEN 0 THEN CAST(10000 + p_size * 7 AS STRING) WHEN 1 THEN concat(CAST(10 + p_size AS STRING), ',', CAST(100 + p_size AS STRING)) ELSE concat('1,', CAST(10 + p_size AS STRING), ',999') END,
       '. Size ', CAST(60 + p_size % 3 AS STRING), ' x ', CAST(72 + p_size % 6 AS STRING), ' x 8 inches. Product weight: ', CAST(15 + p_size % 9 AS STRING), ' kg. ', CAST(1 + p_size % 12 AS STRING), ' years warranty') AS text
FROM part""",
    "v_observations": f"""
SELECT event_id AS ordinal, user_id AS source, event_type AS field, CAST(round(value) AS BIGINT) AS value, {_D("event_id * 7 % 100")} / {_D(100)} AS confidence FROM events""",
    "v_images": """
SELECT page_id AS id, url, CASE page_id % 5 WHEN 0 THEN 'Layer construction diagram' WHEN 1 THEN 'logo icon' WHEN 2 THEN 'hero banner.jpg' WHEN 3 THEN NULL ELSE 'foam cross-section.png' END AS alt,
       CAST(50 + 130 * (page_id % 11) AS INT) AS width, CAST(40 + 90 * (page_id % 13) AS INT) AS height FROM pages""",
    "v_assets": """
SELECT CAST(p_partkey % 50 AS BIGINT) AS asset_id, concat(' ', upper(p_name), ' Mattress ') AS name FROM part""",
    "v_captures": """
SELECT concat('http://host', CAST(page_id % 97 AS STRING), '.example/', CAST(page_id AS STRING), CASE page_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.xml' ELSE '' END) AS url,
       CASE m WHEN 0 THEN 'service' WHEN 1 THEN 'reader' ELSE 'local' END AS method, (page_id * 7 + m * 5) % 4 <> 0 AS ok, CAST((page_id * 131 + m * 400) % 2000 AS INT) AS chars
FROM (SELECT page_id, m FROM (SELECT page_id, 0 AS m FROM pages UNION ALL SELECT page_id, 1 FROM pages UNION ALL SELECT page_id, 2 FROM pages) y) x""",
    "v_evidence": """
SELECT l_partkey AS material_id, concat('http://s', CAST(l_suppkey % 5 AS STRING), '.example/', CAST(l_partkey AS STRING)) AS url,
       CASE l_linenumber % 4 WHEN 0 THEN 'exact_product' WHEN 1 THEN 'product_family' WHEN 2 THEN 'exact_variant' ELSE 'technology' END AS scope,
       CASE l_suppkey % 4 WHEN 0 THEN 'official_product' WHEN 1 THEN 'teardown' WHEN 2 THEN 'retailer' ELSE 'patent' END AS kind,
       l_returnflag <> 'N' AS for_identity, l_linestatus = 'F' AS for_density, l_quantity AS quantity FROM lineitem""",
    "v_dossiers": """
SELECT p_partkey AS material_id, CASE p_size % 4 WHEN 0 THEN 'verified_primary' WHEN 1 THEN 'verified_corroborated' WHEN 2 THEN 'probable' ELSE 'unresolved' END AS identity_status,
       CASE p_size % 6 WHEN 0 THEN 'A_manufacturer_exact' WHEN 1 THEN 'B_corroborated_exact' WHEN 2 THEN 'C_measured_teardown' WHEN 3 THEN 'D_same_technology' WHEN 4 THEN 'E_generic_category' ELSE 'unknown' END AS density_grade,
       CASE p_size % 4 WHEN 0 THEN 'verified_exact' WHEN 1 THEN 'corroborated_range' WHEN 2 THEN 'provisional_range' ELSE 'unknown' END AS density_status,
       CAST(20 + p_size AS DOUBLE) AS low, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(60 - p_size AS DOUBLE) END AS high, CAST(40 AS DOUBLE) AS best FROM part""",
    "v_jobs": """
SELECT event_id, ts, user_id AS job, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'complete' ELSE 'fail' END AS action FROM events""",
    "v_edges": """
SELECT concat('region:', CAST(n_regionkey AS STRING)) AS source, 'HAS_NATION' AS relation, concat('nation:', CAST(n_nationkey AS STRING)) AS target FROM nation
UNION ALL SELECT concat('nation:', CAST(c_nationkey AS STRING)), 'HAS_CUSTOMER', concat('customer:', CAST(c_custkey AS STRING)) FROM customer
UNION ALL SELECT concat('customer:', CAST(o_custkey AS STRING)), 'HAS_ORDER', concat('order:', CAST(o_orderkey AS STRING)) FROM orders
UNION ALL SELECT concat('order:', CAST(l_orderkey AS STRING)), 'USES', concat('part:', CAST(l_partkey AS STRING)) FROM lineitem""",
}
_O, _C = "chr(123)", "chr(125)"  # braces, which a statement's own fields take
VIEWS["v_spec_pages"] = f"""
SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN {_D("0.95")} ELSE {_D("0.5")} END AS reliability,
       concat('<!DOCTYPE html><html><head><title>', p_name, ' &amp; &#x201c;', p_brand, '&#8221;</title><!-- <h1>no</h1> --><meta name="description" content="Made by ', p_brand,
       '"><script type="application/ld+json">', {_O}, '"@graph": [', {_O}, '"@type": ["Thing", "Product"], "name": "', p_name, '", "brand": ', {_O}, '"@type": "Brand", "name": "', p_brand, '"', {_C},
       ', "offers": [', {_O}, '"price": "', CAST(p_size AS STRING), ',999.5", "priceCurrency": "INR"', {_C}, ']', {_C}, ']', {_C}, '</script></head><body><main><h1>', p_name,
       ' <b>mattress</b></h1><table><thead><tr><th colspan="2">Specification</tr></thead><tr><th>Density<td>', CAST(20 + p_size AS STRING), ' kg/m3<tr><th>Core</th><td><b>Memory</b> <i>foam</i></td></tr><tr><td>Terms<td>',
       CAST(1 + p_size % 12 AS STRING), ' years warranty</table><h1>second</h1></main></body></html>') AS html FROM part"""
VIEWS["v_requests"] = f"""
SELECT event_id, user_id AS id, concat('https://api.example.com/', event_type, '/', CAST(event_id % 10 AS STRING)) AS url,
       CASE event_type WHEN 'view' THEN 'xhr' WHEN 'click' THEN 'fetch' WHEN 'purchase' THEN 'xhr' ELSE 'image' END AS resource_type,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat({_O}, '"data": [', props, ', ', {_O}, '"core": "', {case_of("CAST(event_id % 95 AS INT)", [a for a, _ in aliases()])}, '"', {_C}, '], "ok": true, "none": null', {_C}) END AS body,
       CASE WHEN event_id % 3 = 0 THEN concat('store/', CAST(event_id AS STRING)) END AS stored_at FROM events"""
_TABLES = {"v_spec_pages": "part", "v_requests": "events", "v_products": "part", "v_layers": "lineitem", "v_variants": "part", "v_spec_text": "part", "v_observations": "events", "v_images": "pages", "v_jobs": "events", "v_assets": "part", "v_captures": "pages", "v_evidence": "lineitem", "v_dossiers": "part", "v_edges": "nation customer orders lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view; its tables are passed to the statement itself, so no session-wide name is taken."""
    text, used = VIEWS[name], {t: table(spark, sf_dir, t) for t in _TABLES[name].split()}
    import re

    for t in used:
        text = re.sub(rf"(?<=FROM ){t}\b", f"{{{t}}}", text)
    return spark.sql(text, **used)


def with_views(*names: str) -> str:
    """WITH clauses of the views, for DuckDB."""
    return ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
