"""Entity resolution: each record joins the first entity of its company and brand whose name is equal or alike, else it begins one.

An entity bears the name of its surest record so far, so what a record meets depends on those before it. But it only ever meets names
that are alike by the same measure, so names are compared first, all at once, and the ordered pass runs apart in each connected group of names:

1. Names of one company and brand are joined on their rarest pairs of characters. Alike means that 2 M / (a + b) reaches the threshold, M being the characters in the matching blocks of difflib's
   SequenceMatcher. M is no more than a longest common subsequence, so one name becomes the other by d = (1 - threshold) (a + b) insertions and deletions at most, each of
   which spoils two pairs; hence two such names share one of the 2 d + 1 rarest pairs of each, at places no more than d apart.
2. Those within d edits are measured exactly.
3. Groups of one name are one entity. The others are streamed in order, one small state at a time: which entity bears which name.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import normalized_name
from ..sources.work import cut
from .graph import components

THRESHOLD = 0.93


def _keyed(products: DataFrame) -> DataFrame:
    """product_id, ordinal, confidence, block, key: company and brand as one, and the normalised name."""
    text = lambda c: F.coalesce(c, F.lit(""))
    block = F.to_json(F.struct(text(F.col("company").cast("string")).alias("c"), text(normalized_name("brand")).alias("b")))
    sure = F.coalesce("confidence", F.lit(0.0)) if "confidence" in products.columns else F.lit(0.0)
    return products.select("product_id", "ordinal", sure.cast("double").alias("confidence"), block.alias("block"), text(normalized_name("name")).alias("key"))


def candidates(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (block, a, b), a before b, of names (block, key) that may be alike by length and by their rarest pairs of characters."""
    most = lambda n: F.floor(n * (2 * (1 - threshold) / threshold) + 1e-9).cast("int")
    long_enough = names.select("block", "key", F.length("key").alias("n"), most(F.length("key")).alias("d")).where("d > 0 and n > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.substring("key", i, 2).alias("g"), i.alias("at")))
    flat = long_enough.select("block", "key", "n", "d", F.explode(pairs).alias("p")).select("block", "key", "n", "d", "p.g", "p.at")
    common = flat.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    listed = flat.join(F.broadcast(common) if common.count() <= 100_000 else common, "g").groupBy("block", "key", "n", "d").agg(F.array_sort(F.collect_list(F.struct("f", "g", "at"))).alias("p"))
    rare = cut(listed.select("block", "key", "n", "d", F.explode(F.slice("p", 1, 2 * F.col("d") + 1)).alias("p")).select("block", "key", "n", "d", "p.g", "p.at"))
    x, y = rare.alias("x"), rare.alias("y")
    near = (F.abs(F.col("x.at") - F.col("y.at")) <= F.greatest("x.d", "y.d")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * (threshold / (2 - threshold)) - 1e-9)
    met = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.key") < F.col("y.key")) & near)
    return met.select("x.block", F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def alike(names: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """block, known, new: names (block, key) such that a record named ``new`` is taken as one named ``known``. The measure may differ by direction."""

    @F.pandas_udf(BooleanType())
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x, y).ratio() >= threshold for x, y in zip(a, b, strict=True)], dtype=bool)

    most = F.floor((F.length("a") + F.length("b")) * (1 - threshold) + 1e-9).cast("int")
    close = candidates(names, threshold).withColumn("most", most).where(F.expr("levenshtein(a, b, most) >= 0"))
    both = close.select("block", F.explode(F.array(F.struct(F.col("a").alias("known"), F.col("b").alias("new")), F.struct(F.col("b").alias("known"), F.col("a").alias("new")))).alias("p")).select("block", "p.known", "p.new")
    return both.where(measured("known", "new"))


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(component, name, near, confidence, product_id) in order to (product_id, entity_id)."""
    group, first, name_of, sure, bearers = None, [], [], [], {}
    for batch in batches:
        out = []
        for component, name, near, confidence, product in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != group:
                group, first, name_of, sure, bearers = component, [], [], [], {}
            # the earliest entity under each name; what has been renamed since is dropped on sight
            found = []
            for n in (name, *near):
                heap = bearers.get(n)
                while heap and name_of[heap[0]] != n:
                    heappop(heap)
                if heap:
                    found.append(heap[0])
            if not found:
                entity = len(first)
                first.append(product)
                name_of.append(name)
                sure.append(confidence)
            else:
                entity = min(found)
            if not found or (confidence > sure[entity]):
                name_of[entity], sure[entity] = name, confidence
                heap = bearers.setdefault(name, [])
                if entity not in heap[:1]:
                    heappush(heap, entity)
            out.append((product, first[entity]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], batch.column(4).type), pa.array([b for _, b in out], batch.column(4).type)], names=["product_id", "entity_id"])


def resolve(products: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """product_id, entity_id (the product_id of the entity's first record) of products (product_id, company, brand, name, ordinal, and confidence, if any).

    Null companies, brands and names are one each, null confidences 0. Ordinals tell a company's records apart; empty tables give no rows.
    """
    spark = products.sparkSession
    rows = cut(_keyed(products))
    names = rows.select("block", "key").distinct()
    links = cut(alike(names, threshold).select(F.xxhash64("block", "known").alias("known"), F.xxhash64("block", "new").alias("new")))
    grouped = components(links.select(F.col("known").alias("a"), F.col("new").alias("b")))
    near = links.groupBy(F.col("new").alias("id")).agg(F.collect_list("known").alias("near"))
    members = grouped.join(near, "id", "left").select("id", "component", F.coalesce("near", F.array().cast("array<long>")).alias("near"))
    placed = rows.withColumn("id", F.xxhash64("block", "key")).join(members, "id", "left")
    alone = placed.where("component is null").groupBy("id").agg(F.min_by("product_id", "ordinal").alias("entity_id"))
    single = placed.where("component is null").select("id", "product_id").join(alone, "id").select("product_id", "entity_id")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = placed.where("component is not null").repartition(parts, "component").sortWithinPartitions("component", "ordinal", "product_id").select("component", "id", "near", "confidence", "product_id")
    kind = products.schema["product_id"].dataType.simpleString()
    return single.union(stream.mapInArrow(_pass, f"product_id {kind}, entity_id {kind}"))


def resolve_exact(products: DataFrame) -> DataFrame:
    """The same by equal normalised names alone."""
    keyed = products.select("product_id", "company", normalized_name("brand").alias("brand"), normalized_name("name").alias("key"))
    first = keyed.groupBy("company", "brand", "key").agg(F.min("product_id").alias("entity_id"))
    return keyed.join(first, ["company", "brand", "key"]).select("product_id", "entity_id")
