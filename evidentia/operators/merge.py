"""Merging records of one product, as aggregations by the place that each record has among those of its entity.

Records of an entity come in order. One that is surer than all before it takes the lead, any other one follows; so the leaders, the latest first, and after them the others in
their order, are a ranking, by which every rule of merging is an ordered aggregation:

* what names the product is the first's; a fact that may be filled is the first one given;
* lists of sources and tags hold every value once, where the ranking first has it;
* of variants with one identifier the last in the ranking counts, at the place of the first.

Only layers depend on what they meet, as one whose place is taken moves on top of all. They are folded record by record, streamed, so a task
holds one stack however many records an entity has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import cut

LAYER = "struct<position: int, marketing_name: string, material: string, thickness_mm: double, thickness_status: string, density: double, density_status: string, evidence: array<string>>"
VARIANT = "struct<variant_id: string, size_name: string, width_mm: double, length_mm: double>"
PRODUCT = (
    "product_id string, company string, brand string, name string, family string, canonical_url string, description string, firmness string, total_mm double, weight_kg double, price double, currency string, "
    f"layers array<{LAYER}>, variants array<{VARIANT}>, source_ids array<string>, tags array<string>, method string, confidence double"
)
NAMING = ("product_id", "company", "brand", "name")
FILLED = ("family", "canonical_url", "description", "firmness", "total_mm", "weight_kg", "price", "currency")
COLUMNS = (*NAMING, *FILLED, "layers", "variants", "source_ids", "tags", "method", "confidence")


class Stack:
    """Layers by place and material."""

    def __init__(self, layers: list[dict] | None):
        self.layers = [dict(x) for x in layers or ()]

    def add(self, new: dict) -> None:
        twins = [x for x in self.layers if (x["position"], x["material"]) == (new["position"], new["material"])]
        if twins:
            self.join(twins[-1], new)
        else:
            places = [x["position"] for x in self.layers]
            self.layers.append({**new, "position": max(places) + 1 if new["position"] in places else new["position"]})

    @staticmethod
    def join(known: dict, new: dict) -> None:
        """Gaps are filled; where both agree on a measure then, the newer one's status holds."""
        for gap in ("marketing_name", "thickness_mm", "density"):
            if known[gap] in (None, ""):
                known[gap] = new[gap]
        known.update({f"{m}_status": new[f"{m}_status"] for m, at in (("thickness", "thickness_mm"), ("density", "density")) if known[at] == new[at]})
        known["evidence"] = [*(known["evidence"] or ()), *(e for e in new["evidence"] or () if e not in (known["evidence"] or ()))]

    def over(self, other: Stack) -> Stack:
        """This stack with the layers of one that follows it, from bottom to top."""
        for layer in other.layers:
            self.add(layer)
        self.layers.sort(key=lambda x: x["position"])
        return self


def merged_layers(leading: list[dict] | None, following: list[dict] | None) -> list[dict]:
    return Stack(leading).over(Stack(following)).layers


def _fold_layers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entity_id, leads, layers) in order to (entity_id, layers)."""
    entity, stack, schema, done = None, None, None, []
    for batch in batches:
        schema = schema or pa.schema([batch.schema.field("entity_id"), batch.schema.field("layers")])
        for row in batch.to_pylist():
            mine = Stack(row["layers"])
            if stack is None or row["entity_id"] != entity:
                if stack is not None:
                    done.append({"entity_id": entity, "layers": stack.layers})
                entity, stack = row["entity_id"], mine
            else:
                stack = mine.over(stack) if row["leads"] else stack.over(mine)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if stack is not None:
        yield pa.RecordBatch.from_pylist([*done, {"entity_id": entity, "layers": stack.layers}], schema)


def _is_given(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name).cast("string") != "")


def _once(ranked: DataFrame, name: str) -> DataFrame:
    """entity_id and the values of a list column, each once, by rank and place."""
    each = ranked.select("entity_id", "rank", F.posexplode(name).alias("at", "value")).groupBy("entity_id", "value").agg(F.min(F.struct("rank", "at")).alias("first"))
    return each.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias(name))


def fold(products: DataFrame, order: str = "ordinal") -> DataFrame:
    """One row per ``entity_id`` of products (columns of PRODUCT, entity_id, and the column ``order``, which tells an entity's records apart).

    Null confidences count as 0; a fact that no record gives is null, if only empty in them; entities without an identifier are left out; empty tables give no rows; other columns are left out.
    """
    spark = products.sparkSession
    rows = products.where("entity_id is not null").fillna(0.0, ["confidence"]).select("entity_id", *COLUMNS, F.col(order).alias("__order"))
    own = Window.partitionBy("entity_id").orderBy("__order")
    nth = F.row_number().over(own)
    best = F.max("confidence").over(own.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumns({"nth": nth, "leads": best.isNull() | (F.col("confidence") > best)})
    ranked = cut(placed.withColumn("rank", F.struct((~F.col("leads")).cast("int").alias("side"), F.when(F.col("leads"), -F.col("nth")).otherwise(F.col("nth")).alias("n"))).drop("__order"))
    facts = ranked.groupBy("entity_id").agg(
        *(F.min_by(c, "rank").alias(c) for c in NAMING), *(F.min_by(c, F.when(_is_given(c), F.col("rank"))).alias(c) for c in FILLED),
        F.when(F.count(F.lit(1)) > 1, "merged").otherwise(F.first("method")).alias("method"), F.max("confidence").alias("confidence"),
    )
    variant = ranked.select("entity_id", "rank", F.posexplode("variants").alias("at", "v")).withColumn("place", F.struct("rank", "at"))
    chosen = variant.groupBy("entity_id", "v.variant_id").agg(F.min("place").alias("first"), F.max_by("v", "place").alias("v"))
    variants = chosen.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]).alias("variants"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = ranked.select("entity_id", "nth", "leads", "layers").repartition(parts, "entity_id").sortWithinPartitions("entity_id", "nth").select("entity_id", "leads", "layers")
    kind = products.schema["entity_id"].dataType.simpleString()
    layers = stream.mapInArrow(_fold_layers, f"entity_id {kind}, layers array<{LAYER}>")
    out = facts
    for part in (layers, variants, _once(ranked, "source_ids"), _once(ranked, "tags")):
        out = out.join(part, "entity_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(products.schema[c].dataType)).alias(c)
    return out.select("entity_id", *(empty(c) if c in ("layers", "variants", "source_ids", "tags") else c for c in COLUMNS))


def within_document(first: DataFrame, second: DataFrame) -> DataFrame:
    """The products of one reading of documents, completed by those of a second reading: columns doc_id, nth and those of PRODUCT.

    A product of the second is taken as the one that first has its name in any case; otherwise it is added. The earliest record gives all facts, and others in order what it lacks:
    description, firmness, thickness, weight and currency where they are null, empty or 0, the price where it is null. A layer of a material that the first record lacks is added
    on top; the last layer of a material takes the first thickness and density that it lacks, each with its status, and all evidence once. Variants are kept once if equal in all fields.
    Null names are one name; other columns are left out; empty tables give what the other one has.
    """
    every = first.select(F.lit(0).alias("reading"), "doc_id", "nth", *COLUMNS).union(second.select(F.lit(1), "doc_id", "nth", *COLUMNS)).withColumn("at", F.struct("reading", "nth"))
    same = Window.partitionBy("doc_id", F.lower("name"))
    based = cut(every.withColumn("base", F.min("at").over(same)))
    # records of the first reading beside the one that gathers stay as they are
    alone = based.where("reading = 0 and at != base").select("doc_id", "nth", "reading", *COLUMNS)
    joined = based.where("reading = 1 or at = base")
    key = ["doc_id", "base"]
    truthy = lambda c: _is_given(c) & ((F.col(c) != 0) if c in ("total_mm", "weight_kg") else F.lit(True))
    gaps = {c: truthy(c) for c in ("description", "firmness", "total_mm", "weight_kg", "currency")} | {"price": F.col("price").isNotNull()}
    fixed = [c for c in COLUMNS if c not in gaps and c not in ("layers", "variants", "source_ids", "method", "confidence")]
    facts = joined.groupBy(*key).agg(
        *(F.min_by(c, "at").alias(c) for c in fixed), *(F.coalesce(F.min_by(c, F.when(ok, F.col("at"))), F.min_by(c, "at")).alias(c) for c, ok in gaps.items()),
        F.when(F.count(F.lit(1)) > 1, "merged").otherwise(F.first("method")).alias("method"), F.max("confidence").alias("confidence"),
    )
    unique = lambda c: joined.select(*key, "at", F.posexplode(c).alias("i", "x")).groupBy(*key, "x").agg(F.min(F.struct("at", "i")).alias("first")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda y: y["x"]).alias(c))
    layer = joined.select(*key, "at", F.posexplode("layers").alias("i", "x")).withColumn("place", F.struct("at", "i"))
    # of a material: the base's last layer, else the first that any record has; the base's earlier ones stay as they are
    own = Window.partitionBy(*key, "x.material")
    target = F.coalesce(F.max(F.when(F.col("at") == F.col("base"), F.col("place"))).over(own), F.min("place").over(own))
    aimed = layer.withColumn("target", target)
    stays = aimed.where("at = base and place != target").select(*key, "place", "x")
    filled = aimed.where("at != base or place = target").groupBy(*key, "target")
    measured = lambda m: F.min_by(F.struct(F.col(f"x.{m[0]}"), F.col(f"x.{m[1]}")), F.when(F.col(f"x.{m[0]}").isNotNull(), F.col("place")))
    notes = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.coalesce("x.evidence", F.array().cast("array<string>")).alias("e")))), lambda y: y["e"])))
    whole = filled.agg(F.min_by("x", "place").alias("x"), measured(("thickness_mm", "thickness_status")).alias("t"), measured(("density", "density_status")).alias("d"), notes.alias("e"))
    layers = whole.select(*key, F.col("target").alias("place"), F.struct(
        "x.position", "x.marketing_name", "x.material", F.coalesce("t.thickness_mm", "x.thickness_mm").alias("thickness_mm"), F.coalesce("t.thickness_status", "x.thickness_status").alias("thickness_status"),
        F.coalesce("d.density", "x.density").alias("density"), F.coalesce("d.density_status", "x.density_status").alias("density_status"), F.col("e").alias("evidence"),
    ).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "x")))
    # what is added stands above all before it
    stacked = stays.unionByName(layers).groupBy(*key).agg(ordered.alias("ordered")).select(*key, F.transform("ordered", lambda y, i: F.when(y["place"]["at"] == F.col("base"), y["x"]).otherwise(y["x"].withField("position", i + 1))).alias("layers"))
    out = facts
    for part in (stacked, unique("variants"), unique("source_ids")):
        out = out.join(part, key, "left")
    empty = lambda c: F.coalesce(c, F.array().cast(every.schema[c].dataType)).alias(c)
    done = out.select("doc_id", "base.nth", "base.reading", *(empty(c) if c in ("layers", "variants", "source_ids") else c for c in COLUMNS))
    return done.unionByName(alone)
