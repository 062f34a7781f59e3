"""Ranked lexical search over a tiered index.

A document's score for an item is the sum, over the item's distinct terms, of weight * saturated frequency, all in 64-bit integers:
weight = floor(1000 ln((2 N + 2) / (2 df + 1))), frequency = 10^9 tf div (1000 tf + 20 m), m = 50 + (50 n N) div L, where N counts
documents with a term, L their terms, n one document's terms. Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.

The index has one posting (term, document, contribution) for each distinct term of each document, in tiers: a term's bound is its largest
contribution, and lists with a bound of ``CUTS[0]`` or more are the first tier, and so on; lists below the last cut are the longest
and are parted once more, postings of half the bound or more before the others. A search adds up the first tier, then
the first two, and so on, each time only for items that still lack proof:

* the residual of a term is its largest contribution in the tiers not read, and an item's residual R is the sum of those of its terms, so a
  document not met yet scores at most R, and one with the sum S so far at most S + R;
* the k documents with the largest sums so far are scored whole. The least of these scores is a threshold T that the k-th result cannot fall below;
* an item with R < T is proven: its results are among the documents met with S + R >= T, which are scored whole. All other items fall through to the next tier,
  and after the last R is 0, so every answer is exact.

Groups are (item, document), and what comes to a task is dealt by both; sums are partly made where the document's postings lie. Nothing but N, L and
the number of items without proof reaches the driver. ``vocabulary`` restricts the index to the terms of some texts, which does not change what they find.

Defined results: null text has no terms; an empty table gives no rows; items without terms have no rows; rows of one item_id (nulls
together) unite their terms; repeated documents are ranked each, null doc_ids last among equals; other columns are ignored. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import BROADCAST_ROWS, batches_of, only, stored
from ._text import U64, signed, texts

TOP = 50
#: Bounds, in contributions, at which a tier ends; a term in 5, 22 and 37 % of all documents has about these.
CUTS = (3_000_000_000, 1_500_000_000, 1_000_000_000)
#: Hashes of a vocabulary that tasks are handed (8 MB); a larger one is no filter.
VOCABULARY = 1_000_000
#: Width of the classes of sums from which the k-th largest is found.
CLASS = 100_000_000
_APART = np.zeros(256, bool)
_APART[:128] = [not chr(i).isalnum() for i in range(128)]


def _scan(vocabulary: np.ndarray | None):
    """From batches of (id, text) to (doc, id, n, terms, counts), doc being a number of the row; only rows with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i, j, words in texts(batch.column(1), lower=True, apart=_APART):
                n = np.diff(words.first)
                owner = np.repeat(np.arange(j - i), n)
                order = np.lexsort((words.hash, owner))
                h, o = words.hash[order], owner[order]
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))[: len(h)])
                tf = np.diff(np.append(first, len(h)))
                h, o = h[first], o[first]
                if vocabulary is not None:
                    known = vocabulary[np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)] == h if len(vocabulary) else np.zeros(len(h), bool)
                    h, o, tf = h[known], o[known], tf[known]
                some = np.flatnonzero(n)
                offsets = pa.array(np.append(np.searchsorted(o, some), len(o)), pa.int32())
                lists = (pa.ListArray.from_arrays(offsets, x) for x in (signed(h), pa.array(tf, pa.int64())))
                doc = pa.array(row + i + some, pa.int64())
                yield pa.RecordBatch.from_arrays([doc, batch.column(0).take(pa.array(i + some)), pa.array(n[some], pa.int64()), *lists], names=["doc", "id", "n", "terms", "counts"])
            row += batch.num_rows

    return run


def _scanned(rows: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """Each row (id, text) that has a term, under a number of its own; stored, as the numbers hold for one run only."""
    batches_of(rows.sparkSession, 500)
    kind = rows.schema["id"].dataType.simpleString()
    return stored(rows.select("id", "text").mapInArrow(_scan(vocabulary), f"doc long, id {kind}, n long, terms array<long>, counts array<long>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Index:
    """``documents`` (doc, id), ``postings`` (term, doc, c, tier) written by tier, ``bounds`` (term, tier, most: the largest contribution), and how many terms there are."""

    documents: DataFrame
    postings: DataFrame
    bounds: DataFrame
    terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: DataFrame | None = None) -> Index:
    """The index of all rows; of the terms of ``vocabulary`` (a column term of hashes) alone, if given."""
    known = None
    if vocabulary is not None:
        few = vocabulary.select("term").distinct().limit(VOCABULARY + 1).toArrow().column(0).combine_chunks().to_numpy(zero_copy_only=False)
        known = np.sort(few.astype(np.int64).view(U64)) if len(few) <= VOCABULARY else None
    scanned = _scanned(only(docs, id=id_col, text=text_col), known)
    total = scanned.agg(F.count(F.lit(1)).alias("n"), F.sum("n").cast("long").alias("l")).first()
    flat = scanned.select("doc", "n", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("doc", "n", "p.terms", "p.counts")
    m = f"(50 + (50 * n * {total.n or 1}L) div {total.l or 1}L)"
    placed = flat.select(F.col("terms").alias("term"), "doc", F.expr(f"(1000000000 * counts) div (1000 * counts + 20 * {m})").alias("impact"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * (total.n or 0) + 2) / (2 * F.col("df") + 1))).cast("long")
    lists = stored(placed.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("top")).select("term", weight.alias("w"), "top"))
    terms = lists.count()
    cut = sum((F.when(F.col("w") * F.col("top") < c, 1).otherwise(0) for c in CUTS), F.lit(0))
    low = F.when((cut == len(CUTS)) & (2 * F.col("impact") < F.col("top")), 1).otherwise(0)
    tiered = placed.join(_small(lists, terms), "term").select("term", "doc", (F.col("w") * F.col("impact")).alias("c"), (cut + low).cast("int").alias("tier"))
    postings = stored(tiered, by="tier")
    bounds = stored(postings.groupBy("term", "tier").agg(F.max("c").alias("most")))
    return Index(scanned.select("doc", "id"), postings, bounds, terms)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item (a number), item_id and term of each distinct term of each item."""
    rows = _scanned(only(items, id=id_col, text=text_col)).select("id", F.explode("terms").alias("term")).distinct()
    # one window over the items' identifiers alone
    number = F.dense_rank().over(Window.orderBy("id")).cast("int")
    return stored(rows.select(number.alias("item"), F.col("id").alias("item_id"), "term"))


def _score(found: DataFrame, index: Index, terms: DataFrame, tier: int, few: bool = False) -> DataFrame:
    """item, doc and whole score of the pairs (item, doc), of which the sum s of the tiers up to ``tier`` is known."""
    rest = index.postings.where(F.col("tier") > tier).select("term", "doc", "c")
    more = rest.join(F.broadcast(found) if few else found, "doc").join(terms, ["item", "term"], "left_semi").select("item", "doc", "c")
    return more.union(found.select("item", "doc", F.col("s").alias("c"))).groupBy("item", "doc").agg(F.sum("c").alias("score"))


def search(index: Index, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents; ``items`` as ``item_terms`` gives them."""
    terms = items.select("item", "term")
    count = terms.count()
    sent = _small(terms, count)
    bounds = stored(sent.join(index.bounds, "term").select("item", "tier", "most", "term"))
    open_, threshold, done = terms.select("item").distinct(), None, []
    tiers = sorted(r.tier for r in index.bounds.select("tier").distinct().collect()) or [0]
    for tier in tiers:
        last = tier == tiers[-1]
        each = bounds.join(_small(open_, count), "item", "left_semi").groupBy("item", "term").agg(F.max(F.when(F.col("tier") > tier, F.col("most"))).alias("most"))
        rest = each.groupBy("item").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("rest"))
        if threshold is not None:
            rest = rest.join(threshold, "item", "left").select("item", "rest", F.coalesce("least", F.lit(0)).alias("least"))
        else:
            rest = rest.withColumn("least", F.lit(0).cast("long"))
        rest = stored(rest)
        active = _small(terms.join(_small(rest, count), "item", "left_semi"), count)
        sums = index.postings.where(F.col("tier") <= tier).join(active, "term").groupBy("item", "doc").agg(F.sum("c").alias("s"))
        met = stored(sums.join(_small(rest, count), "item").where("s + rest >= least and s > 0").select("item", "doc", "s"))
        # the class that holds the k-th largest sum, then the k largest sums
        classes = met.groupBy("item", F.floor(F.col("s") / CLASS).alias("class")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("item").orderBy(F.desc("class")))
        floors = classes.withColumn("before", upto - F.col("n")).where(F.col("before") < k).groupBy("item").agg(F.min("class").alias("class"))
        near = met.join(_small(floors, count), "item").where(F.floor(F.col("s") / CLASS) >= F.col("class"))
        best = near.withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("s"), "doc"))).where(F.col("r") <= k)
        best = stored(best.select("item", "doc", "s"))
        exact = best.select("item", "doc", F.col("s").alias("score")) if last else _score(best, index, sent, tier, best.count() <= BROADCAST_ROWS)
        least = exact.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("item", "least")
        state = rest.select("item", "rest", F.col("least").alias("old")).join(least, "item", "left").select("item", "rest", F.greatest("old", F.coalesce("least", F.lit(0))).alias("least"))
        state = stored(state.withColumn("proven", (F.col("rest") < F.col("least")) | (F.col("rest") == 0)))
        proven = state.where("proven")
        candidates = met.join(_small(proven, count), "item").where("s + rest >= least")
        done.append(stored(candidates.select("item", "doc", F.col("s").alias("score")) if last else _score(candidates.select("item", "doc", "s"), index, sent, tier)))
        open_, threshold = state.where("not proven").select("item"), state.select("item", "least")
        if open_.isEmpty():
            break
    scored = done[0]
    for d in done[1:]:
        scored = scored.union(d)
    names = items.select("item", "item_id").distinct()
    id_of = scored.where("score > 0").join(index.documents, "doc").select("item", "doc", F.col("id").alias("doc_id"), "score")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc"))
    ranked = id_of.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(_small(names, count), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Indexes the documents for the items' terms and searches."""
    terms = item_terms(items)
    return search(build(docs, vocabulary=terms), terms, k)
