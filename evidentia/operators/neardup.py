"""Near-duplicate images: the greedy choice of one image per group of look-alikes, exact and without a single ordered pass.

Images are taken by falling priority, then ``ordinal``; one stays unless an earlier one that stayed has the same content or original
address, or looks alike: hashes at most ``close`` bits apart, or ``far`` bits with recognised words of Jaccard similarity ``alike``, and
proportions within ``ratio`` where both are known.

1. Images of the same hash, proportions and words are one class. Classes meet by pigeonhole: hashes ``close`` bits apart share one of close + 1 bands, and
   those ``far`` bits apart share one of far + 1 bands and one of the words that the prefix principle names. Every pair that meets is verified.
2. Rounds decide what the ordered pass would: an image stays once it comes before every undecided one that it conflicts with, and goes once
   an earlier conflicting one has stayed. Within a group only the first image is looked at, so equal images give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.work import cut


def _bands(hash_: Column, n: int) -> list[Column]:
    """The 16 digits cut into n runs of nearly equal length."""
    ends = [16 * i // n for i in range(n + 1)]
    return [F.concat(F.lit(f"{n}.{i}:"), F.substring(hash_, a + 1, b - a)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]


def like_classes(classes: DataFrame, close: int = 2, far: int = 5, alike: float = 0.85, ratio: float = 0.12) -> DataFrame:
    """one, other: classes (class, hash, aspect, words) that look alike, both ways round."""
    n = F.size("words")
    prefix = F.slice(F.array_sort("words"), 1, F.greatest(F.lit(0), n - F.ceil(n * alike).cast("int") + 1))
    keys = F.concat(F.array(*_bands(F.col("hash"), close + 1)), F.flatten(F.transform(prefix, lambda w: F.array(*(F.concat(b, F.lit(":"), w) for b in _bands(F.col("hash"), far + 1))))))
    met = cut(classes.select("class", "hash", "aspect", "words", F.explode(F.array_distinct(keys)).alias("key")))
    a, b = met.select("key", *(F.col(c).alias(f"a_{c}") for c in classes.columns)), met.select("key", *(F.col(c).alias(f"b_{c}") for c in classes.columns))
    bits = scores.hamming(F.col("a_hash"), F.col("b_hash"))
    near = (bits <= close) | ((bits <= far) & (scores.jaccard(F.col("a_words"), F.col("b_words")) >= alike))
    shape = F.coalesce(F.abs(F.col("a_aspect") - F.col("b_aspect")) <= ratio, F.lit(True))
    pairs = a.join(b, "key").where(F.col("a_class") < F.col("b_class")).where(near & shape).select("a_class", "b_class").distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a_class").alias("one"), F.col("b_class").alias("other")), F.struct(F.col("b_class").alias("one"), F.col("a_class").alias("other")))).alias("p")).select("p.*")


def deduplicate(assets: DataFrame, close: int = 2, far: int = 5, alike: float = 0.85, ratio: float = 0.12) -> DataFrame:
    """asset_id, kept, duplicate_of (the first image that stayed and conflicts) of assets: asset_id, priority, ordinal, sha, url, hash, width, height, ocr.

    ``ordinal`` is distinct. Null or malformed hashes look like nothing; null contents and addresses equal nothing; null priorities come last. Empty tables give no rows.
    """
    words = scores.tokens(F.col("ocr"))
    aspect = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height"))
    # digits of one case, so that bands compare as bits do
    valid = F.when(F.col("hash").rlike("^[0-9a-fA-F]{16}$"), F.lower("hash"))
    rows = assets.select("asset_id", F.struct((-F.coalesce("priority", F.lit(float("-inf")))).alias("p"), "ordinal", "asset_id").alias("ord"), "sha", "url", valid.alias("hash"), aspect.alias("aspect"), words.alias("words"))
    name = F.sha2(F.concat_ws("|", "hash", F.coalesce(F.col("aspect").cast("string"), F.lit("-")), F.array_join(F.array_sort("words"), " ")), 256)
    rows = cut(rows.withColumn("class", F.when(F.col("hash").isNotNull(), name)))
    likes = like_classes(rows.where("class is not null").select("class", "hash", "aspect", "words").dropDuplicates(["class"]), close, far, alike, ratio)
    own = F.filter(F.array(F.concat(F.lit("s"), "sha"), F.concat(F.lit("u"), "url"), F.concat(F.lit("c"), "class")), lambda k: k.isNotNull())
    posts = cut(rows.select("asset_id", "ord", F.explode(own).alias("key")))
    heard = rows.join(likes, rows["class"] == likes["one"]).select("asset_id", "ord", F.concat(F.lit("c"), "other").alias("key"))
    reads = cut(posts.unionByName(heard))
    state = cut(rows.select("asset_id", "ord", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast(rows.schema["asset_id"].dataType).alias("duplicate_of")))
    while not state.where("kept is null").isEmpty():
        now = posts.join(state.select("asset_id", "kept"), "asset_id").groupBy("key").agg(F.min(F.when(F.col("kept").isNull(), F.col("ord"))).alias("waiting"), F.min(F.when(F.col("kept"), F.col("ord"))).alias("stayed"))
        seen = reads.join(now, "key").groupBy("asset_id").agg(F.min("waiting").alias("waiting"), F.min("stayed").alias("stayed"))
        j = state.join(seen, "asset_id", "left")
        goes = F.coalesce(F.col("stayed") < F.col("ord"), F.lit(False))
        stays = F.coalesce(F.col("ord") <= F.col("waiting"), F.lit(True))
        open_ = F.col("kept").isNull()
        state = cut(j.select(
            "asset_id", "ord", F.when(open_, F.when(goes, False).when(stays, True)).otherwise(F.col("kept")).alias("kept"),
            F.when(open_ & goes, F.col("stayed.asset_id")).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
        ))
    return state.select("asset_id", "kept", "duplicate_of")
