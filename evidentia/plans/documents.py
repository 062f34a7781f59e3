"""Documents to text, mentions and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, scores
from ..operators import mentions, neardup
from ..registry import query
from ..sources.views import table, view


@query(
    "html_tag_free",
    r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)^.*?<body[^>]*>', ''),
 '(?is)<!--.*?-->|<(script|style|noscript|svg)\b[^>]*>.*?</(script|style|noscript|svg)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s\x{0B}\x{A0}]+', ' ', 'g')) AS text FROM pages""",
)
def html_tag_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.tag_free(F.col("html")).alias("text"))


@query("html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.html_text("html").alias("text"))


@query("material_mention_offsets")
def material_mention_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.mentions(view(spark, sf_dir, "v_spec_text"))


@query("layers_from_text")
def layers_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions.layers(view(spark, sf_dir, "v_spec_text"))


@query("neardup_images")
def neardup_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of pages: every seventh page shows the same picture as its six predecessors, some with one digit of the hash changed."""
    seen = view(spark, sf_dir, "v_images")
    first = F.sha2(F.floor(F.col("id") / 7).cast("string"), 256)
    shown = F.concat(F.substring(first, 1, 15), F.when(F.col("id") % 3 == 0, F.lit("1")).otherwise(F.lit("0")))
    return neardup.deduplicate(seen.select(
        F.col("id").alias("asset_id"), scores.image_score(F.col("url"), F.col("alt"), F.col("width"), F.col("height")).alias("priority"), F.col("id").alias("ordinal"),
        F.sha2(F.concat_ws("|", shown, "width", "height"), 256).alias("sha"), "url", shown.alias("hash"), "width", "height", F.col("alt").alias("ocr"),
    ))
