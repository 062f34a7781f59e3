"""Deduplication, claims, coverage, review and other row operators over evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_best(rows: DataFrame, keys: list[str], by: str, ordinal: str) -> DataFrame:
    """Of rows with equal keys the one with the largest ``by``, the first of equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc(by), ordinal)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def last_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def claims(products: DataFrame, layers: DataFrame) -> DataFrame:
    """product_id, field_path, value_double, value_string: stated facts of products and layers, one row each."""
    of_product = products.select(
        "product_id",
        F.expr("stack(4, 'total_thickness_mm', cast(total_mm as double), cast(null as string), 'product_weight_kg', weight_kg, null, 'price', price, null, 'firmness', null, firmness) as (field_path, value_double, value_string)"),
    )
    of_layer = layers.select("product_id", F.expr("stack(2, concat('layers.', position, '.thickness_mm'), thickness_mm, concat('layers.', position, '.density_kg_m3'), density) as (field_path, value_double)"), F.lit(None).cast("string").alias("value_string"))
    return of_product.unionByName(of_layer).where("value_double is not null or value_string is not null")


def product_rows(products: DataFrame, layers: DataFrame, variants: DataFrame) -> DataFrame:
    """Products with counts of layers, of known densities and thicknesses, of variants, and how far the construction is known."""
    of_layers = layers.groupBy("product_id").agg(F.count(F.lit(1)).alias("layer_count"), F.count("density").alias("densities"), F.count("thickness_mm").alias("thicknesses"), F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "material"))), lambda x: x["material"])), " | ").alias("components"))
    of_variants = variants.groupBy("product_id").agg(F.count(F.lit(1)).alias("variant_count"))
    out = products.join(of_layers, "product_id", "left").join(of_variants, "product_id", "left")
    out = out.fillna(0, ["layer_count", "densities", "thicknesses", "variant_count"])
    status = F.when(F.col("layer_count") == 0, "undisclosed").when((F.col("densities") == F.col("layer_count")) & (F.col("thicknesses") == F.col("layer_count")), "complete").otherwise("partial")
    return out.withColumn("construction", status)


def coverage(sources: DataFrame, bonus: float) -> DataFrame:
    """One row: counts, shares and the score 100 * (.55 retrieved + .25 official + .20 bonus), at most 100. sources: fetched, official."""
    got, n = F.count_if("fetched"), F.count(F.lit(1))
    counts = sources.agg(n.alias("total"), got.alias("fetched"), F.count_if(F.col("fetched") & F.col("official")).alias("official"))
    retrieved = F.when(F.col("total") > 0, F.col("fetched") / F.col("total")).otherwise(0.0)
    official = F.when(F.col("fetched") > 0, F.col("official") / F.col("fetched")).otherwise(0.0)
    return counts.withColumn("score", F.least(F.lit(100.0), 100.0 * (0.55 * retrieved + 0.25 * official + 0.20 * F.lit(bonus))))


def review_queue(rows: DataFrame) -> DataFrame:
    """Products with missing facts: what is missing and how urgent it is."""
    missing = F.filter(
        F.array(
            F.when(F.col("layer_count") == 0, "layers"), F.when(F.col("densities") < F.col("layer_count"), "densities"),
            F.when(F.col("thicknesses") < F.col("layer_count"), "thicknesses"), F.when(F.col("weight_kg").isNull(), "weight"),
        ),
        lambda x: x.isNotNull(),
    )
    out = rows.select("product_id", F.array_join(missing, ", ").alias("missing"), F.size(missing).alias("n"))
    return out.where("n > 0").select("product_id", "missing", F.when(F.col("n") >= 3, "high").when(F.col("n") == 2, "medium").otherwise("low").alias("priority"))


def ledger(events: DataFrame) -> DataFrame:
    """Folds job events (job, action, ts, event_id) into one row per job: the first terminal action after creation is final."""
    order = Window.partitionBy("job").orderBy("ts", "event_id")
    born = F.min(F.when(F.col("action") == "create", F.struct("ts", "event_id"))).over(Window.partitionBy("job"))
    alive = events.withColumn("born", born).where(F.col("born").isNotNull() & (F.struct("ts", "event_id") >= F.col("born")))
    ended = F.sum(F.when(F.col("action").isin("complete", "fail"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = alive.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0 and action != 'create' or event_id = born.event_id")
    status = F.when(F.max(F.col("action") == "complete"), "completed").when(F.max(F.col("action") == "fail"), "failed").when(F.max(F.col("action").isin("claim", "progress")), "running").otherwise("queued")
    return live.groupBy("job").agg(status.alias("status"), F.count_if(F.col("action") == "claim").alias("attempts"), F.count_if(F.col("action") == "progress").alias("progress"), F.max("ts").alias("updated"))


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
