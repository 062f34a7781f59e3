"""A corpus from raw documents to token shards: each stage calls one operator of evidentia.llm.

``run`` applies STAGES in order to the table ``documents``; every stage's result is written as Parquet in the
shared folder and read again as the next one's documents. All stages but the last return the columns of
``documents``. ORACLE_SQL is None, as trigram vectors, Newton steps and a tokenizer are beyond SQL;
tests/llm/test_pipeline.py holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, langid, mixture, ngram_join, token_shards
from evidentia.llm._io import stored
from evidentia.llm.queries import tokenizer_path

#: Near duplicates: five words to a shingle, Jaccard similarity of 80 % or more.
SHINGLE, SHARE = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the operator calls und (without letters) go, and no others, as short clean texts may have any score; empty tables stay empty, and without any labelled row all go."""
    model = langid.train(docs.where(~langid.held_out()))
    # columns of the operator's own names step aside
    own = [c for c in docs.columns if c.lower() in ("lang_pred", "score")]
    aside = dict(zip(own, fresh(docs, *(f"own_{c}" for c in own)), strict=True))
    renamed = docs.withColumnsRenamed(aside)
    (copy,) = fresh(renamed, "__copy")
    judged = langid.predict(renamed.withColumn(copy, F.col("text")), model, copy, renamed.columns)
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays; rows with a null doc_id stay."""
    return ngram_join.one_of_each(docs, width=SHINGLE, share=SHARE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows are told apart by the SHA-256 of all their columns, so equal rows only by their number."""
    key, copies, n = fresh(docs, "__key", "__copies", "__n")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
    taken = mixture.mix(keyed, id_col=key).groupBy(F.col("doc_id").alias(key)).agg(F.sum("copies").alias(copies)).where(F.col(copies) > 0)
    chosen = keyed.dropDuplicates([key]).join(taken, key)
    return chosen.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns what a reader finds in them."""
    return token_shards.token_shards(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixture", mixed),
    ("token_shards", shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
