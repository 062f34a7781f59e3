"""Facts from the markup of pages and from the JSON that their scripts load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import clean_text
from ..operators import page_facts
from ..registry import query
from ..sources import dims
from ..sources.views import table, view, with_views

_UNESCAPED = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


@query(
    "html_headings",
    f"""
SELECT page_id, field, CAST(strpos(html, '<' || t || '>') - 1 AS INTEGER) AS start, CAST(strpos(html, '</' || t || '>') + len(t) + 2 AS INTEGER) AS stop,
  trim(regexp_replace({_UNESCAPED.format("regexp_extract(html, '<' || t || '>(.*?)</' || t || '>', 1, 's')")}, '[\\s\\x0b\\xa0]+', ' ', 'g')) AS text
FROM pages, (VALUES ('document.title', 'title'), ('document.h1', 'h1')) v(field, t)""",
)
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.headings(markup.cuts(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")))
    return found.select(F.col("id").alias("page_id"), "field", "start", "stop", clean_text("text").alias("text"))


_ROWS = "(2, 'Density | ' || (20 + p_size) || ' kg/m3', '<th>Density', '<tr><th>Core'), (3, 'Core | Memory foam', '<th>Core', '</td></tr><tr><td>Terms'), (4, 'Terms | ' || (1 + p_size % 12) || ' years warranty', '<td>Terms', '</table>')"


@query(
    "page_observations",
    f"""
WITH {with_views("v_spec_pages")}, j AS (SELECT * FROM v_spec_pages JOIN part ON id = p_partkey), r AS (SELECT j.*, n, t, a, b FROM j, LATERAL (VALUES {_ROWS}) v(n, t, a, b)),
f AS (
 SELECT id, reliability, 'document.title' AS field, p_name || ' & “' || p_brand || '”' AS value, NULL AS unit, NULL AS material, 'meta' AS method, 'HTML structured data' AS locator, strpos(html, '<title>') - 1 AS start, strpos(html, '</title>') + 7 AS stop, NULL AS excerpt, 0.85 AS c FROM j
 UNION ALL SELECT id, reliability, 'document.h1', p_name || ' mattress', NULL, NULL, 'meta', 'HTML structured data', strpos(html, '<main><h1>') + 5, strpos(html, '</h1><table>') + 4, NULL, 0.88 FROM j
 UNION ALL SELECT id, reliability, 'document.description', 'Made by ' || p_brand, NULL, NULL, 'meta', 'HTML structured data', NULL, NULL, NULL, 0.80 FROM j
 UNION ALL SELECT id, reliability, 'product.name', p_name, NULL, NULL, 'json_ld', 'JSON-LD script 1 @graph.0', NULL, NULL, NULL, 0.95 FROM j
 UNION ALL SELECT id, reliability, 'product.brand', p_brand, NULL, NULL, 'json_ld', 'JSON-LD script 1 @graph.0', NULL, NULL, NULL, 0.95 FROM j
 UNION ALL SELECT id, reliability, 'commercial.price', (p_size * 1000 + 999) || '.5', 'INR', NULL, 'json_ld', 'JSON-LD script 1 @graph.0 offers', NULL, NULL, NULL, 0.95 FROM j
 UNION ALL SELECT id, reliability, 'table.row', t, NULL, NULL, 'table', 'HTML table row ' || n, strpos(html, a) - 1, strpos(html, b) - 1, t, 0.82 FROM r
 UNION ALL SELECT id, reliability, 'measurement.density_kg_m3', (20 + p_size) || '.0', 'kg/m3', NULL, 'regex', 'HTML table row 2', 10, len(t), t, 0.92 FROM r WHERE n = 2
 UNION ALL SELECT id, reliability, 'material.mention', 'Memory foam', NULL, 'memory_foam', 'material_dictionary', 'HTML table row 3', 7, 18, t, 0.88 FROM r WHERE n = 3
 UNION ALL SELECT id, reliability, 'commercial.warranty_years', (1 + p_size % 12) || '.0', 'years', NULL, 'regex', 'HTML table row 4', 8, len(t), t, 0.90 FROM r WHERE n = 4)
SELECT 'obs_' || substr(sha256(id || '|' || field || '|' || lower(value) || CASE WHEN excerpt IS NULL OR field = 'table.row' THEN '' ELSE '|' || lower(excerpt) END), 1, 16) AS observation_id, id, field, value, unit, material, method, locator,
 CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, excerpt, least(1.0::DOUBLE, c::DOUBLE * reliability / 0.95::DOUBLE) AS confidence FROM f""",
)
def page_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts.page_observations(view(spark, sf_dir, "v_spec_pages"), "Acme")


@query(
    "network_values",
    f"""
WITH {with_views("v_requests")}, b AS (SELECT event_id AS id, url, body FROM v_requests WHERE resource_type IN ('xhr', 'fetch') AND body IS NOT NULL)
SELECT id, url, p AS path, v AS value FROM b, LATERAL (VALUES ('data.0.k', json_extract_string(body, '$.data[0].k')), ('data.1.core', json_extract_string(body, '$.data[1].core')), ('ok', 'true'), ('none', NULL)) x(p, v)""",
)
def network_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts.network_values(view(spark, sf_dir, "v_requests").drop("id").withColumnRenamed("event_id", "id"))


_ALIASES = ", ".join(f"({i}, '{dims.plain(a)}', '{m}')" for i, (a, m) in enumerate(dims.aliases()))


@query(
    "network_observations",
    f"""
WITH {with_views("v_requests")}, a(place, alias, material) AS (VALUES {_ALIASES}),
b AS (SELECT id, url, coalesce(stored_at, url) AS stored_at, coalesce(body, '') AS body FROM v_requests WHERE resource_type IN ('xhr', 'fetch')),
f AS (SELECT id, url AS k, 'network_json' AS kind, 'network_json.endpoint' AS field, url AS value, NULL AS material, stored_at AS locator, nullif(body, '') AS excerpt, CASE WHEN body = '' THEN 0.55 ELSE 0.72 END::DOUBLE AS confidence FROM b
 UNION ALL SELECT id, material, url, 'network_json.material_mention', arg_min(alias, place), material, url, body, 0.70::DOUBLE FROM b JOIN a ON contains(replace(lower(body), '-', ' '), alias) GROUP BY id, url, body, material),
n AS (SELECT 'obs_' || substr(sha256(id || '|' || lower(kind) || '|' || lower(k)), 1, 16) AS observation_id, * FROM f)
SELECT observation_id, id, field, value, material, locator, excerpt, confidence FROM n QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY confidence DESC, value, excerpt, locator) = 1""",
)
def network_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_facts.network_observations(view(spark, sf_dir, "v_requests"))
