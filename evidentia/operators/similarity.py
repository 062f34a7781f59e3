"""TF-IDF neighbours: words of two characters or more, single words and pairs, 1 + ln tf, smooth idf, unit length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import cut


def terms(texts: DataFrame, features: int = 20_000) -> DataFrame:
    """id, term, weight. The ``features`` terms most frequent in the corpus count, ties by term."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.element_at("w", i), F.lit(" "), F.element_at("w", i + 1)))
    flat = texts.select("id", words.alias("w")).select("id", F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))
    tf = flat.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all")).orderBy(F.desc("all"), "term").limit(features).select("term", "df")
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", ((1.0 + F.log("tf")) * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)).alias("w"))  # n is one row
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


#: Postings read per text for a first threshold, and what rounding may add to a sum.
FIRST, SLACK = 200, 1e-8


def _whole(pairs: DataFrame, terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """id, other, score of pairs (id, other, s), s being what other terms than these (id, term, w) add."""
    more = pairs.select("id", "other").join(terms.select("id", "term", "w"), "id").join(corpus.select(F.col("id").alias("other"), "term", F.col("weight").alias("v")), ["other", "term"])
    return more.select("id", "other", (F.col("w") * F.col("v")).alias("s")).union(pairs.select("id", "other", "s")).groupBy("id", "other").agg(F.sum("s").alias("score"))


def candidates(queries: DataFrame, corpus: DataFrame, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pairs (id, other, s) that may be among the ``limit`` nearest, with what their essential terms add; and the queries' terms (id, term, w, essential).

    A term adds at most its weight times the largest weight it has in the corpus. The rarest terms of a text, up to ``FIRST`` postings, give neighbours whose exact scores set a threshold. With terms from
    rare to frequent, all those from some place on cannot reach it together; so a pair that shares no term before that place is never made, and terms in every text are seldom read.
    """
    bounds = corpus.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("top"))
    rare_first = Window.partitionBy("id").orderBy("df", "term")
    known = queries.join(bounds, "term").select("id", "term", F.col("weight").alias("w"), "df", (F.col("weight") * F.col("top")).alias("gain"))
    after = F.sum("gain").over(rare_first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    own = cut(known.select("id", "term", "w", "gain", F.sum("df").over(rare_first).alias("read"), after.alias("after")))
    postings = corpus.select("term", F.col("id").alias("other"), F.col("weight").alias("v"))
    met = lambda terms: terms.join(postings, "term").where("id != other").groupBy("id", "other").agg(F.sum(F.col("w") * F.col("v")).alias("s"))
    early, late = own.where(F.col("read") <= FIRST), own.where(F.col("read") > FIRST)
    nth = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    least = _whole(met(early), late, corpus).withColumn("n", F.row_number().over(nth)).where(F.col("n") == limit).select("id", F.col("score").alias("least"))
    judged = cut(own.join(least, "id", "left").select("id", "term", "w", "gain", "least", F.coalesce(F.col("after") >= F.col("least") - SLACK, F.lit(True)).alias("essential")))
    rest = judged.groupBy("id").agg(F.first("least").alias("least"), F.sum(F.when(~F.col("essential"), F.col("gain")).otherwise(0.0)).alias("rest"))
    pairs = met(judged.where("essential")).join(rest, "id").where(F.coalesce(F.col("s") + F.col("rest") >= F.col("least") - SLACK, F.lit(True)))
    return cut(pairs.select("id", "other", "s")), judged


def neighbours(queries: DataFrame, corpus: DataFrame, limit: int = 5) -> DataFrame:
    """id, other, score, rank: the ``limit`` nearest by cosine, without itself; equal scores by identifier. Exact for any weights that are not negative."""
    pairs, terms = candidates(queries, corpus, limit)
    scored = _whole(pairs, terms.where("not essential"), corpus)
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "other")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def density_support(near: DataFrame, layers: DataFrame) -> DataFrame:
    """id, key (material:density), share: the scores of neighbours that state the key, over the sum of all."""
    keyed = layers.where("density is not null").select(F.col("product_id").alias("other"), F.concat("material", F.lit(":"), F.bround("density").cast("int").cast("string")).alias("key")).distinct()
    sums = near.join(keyed, "other").groupBy("id", "key").agg(F.sum("score").alias("s"))
    return sums.select("id", "key", (F.col("s") / F.sum("s").over(Window.partitionBy("id"))).alias("share"))
