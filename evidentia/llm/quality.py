"""Quality rules: fixed limits, and a likelihood ratio of hashed word n-grams between trusted documents and all documents.

Words are runs of characters other than 0x20 and 0x09-0x0D, unchanged. Single words and pairs of neighbours are hashed into ``BUCKETS``
buckets. One multinomial is counted over all documents, the other over trusted ones and scaled to the size of the first; each bucket has
``PRIOR`` counts more than found in both, so that what is rare decides little. A document's score is the mean, over its words and pairs, of ln(trusted share / share in all
documents), in steps of 1 / ``STEPS``, so that sums are whole numbers and do not depend on how rows are dealt. Documents below ``LEAST`` are not kept; nor are those that
fail the fixed limits (fewer than 50 words, or over half of the words in three-word windows that the text repeats).

Trusted are documents all of whose labels have quality 1 and no toxicity; of these the ``TRUSTED`` with the smallest hash of their identifier are
used, which bounds what is sent to every task (under 2 MB). Counts over the corpus cover every document. Only the buckets' two counts reach the driver.
Defined results: null text has no words; a document without words has score 0 and fails the limits; without trusted documents, or on an empty table,
no document fails the likelihood; repeated rows are counted and judged each, rows with a null identifier are never trusted; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batches_of, fresh, only
from ._text import U64, Words, buffers, hashes, mix, pieces, texts

BUCKETS = 1 << 18
STEPS = 1 << 16
PRIOR = 4.0
LEAST = -0.4
TRUSTED = 100_000
FEWEST, REPEATED = 50, 50
_TURN = U64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and pairs of one piece, and the row of each."""
    h, rows = words.hash, np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    pairs = mix(h[pair] * _TURN + h[pair + 1])
    return (np.concatenate([h, pairs]) & U64(BUCKETS - 1)).astype(np.int64), np.concatenate([rows, rows[pair]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, words in texts(batch.column(0)):
            bucket, row = _buckets(words)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[trusted[i:j][row]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "n", "trusted"])


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    each = only(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good"))
    return each.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("trusted"))


def weights(rows: DataFrame, trusted: DataFrame) -> np.ndarray:
    """What each bucket adds to a score, in steps, from rows (doc_id, text)."""
    marked = rows.join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted"), "left").select("text", F.col("trusted").isNotNull().alias("t"))
    counts = marked.mapInArrow(_count, "bucket int, n long, trusted long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("trusted").alias("trusted")).toArrow()
    at, raw, target = (counts.column(c).to_numpy() for c in ("bucket", "n", "trusted"))
    out = np.zeros(BUCKETS, np.int64)
    if target.sum():
        out[at] = np.rint(np.log((target * (raw.sum() / target.sum()) + PRIOR) / (raw + PRIOR)) * STEPS)
    return out


def _sum_by(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.int64)
    np.add.at(out, row, values)
    return out


def _repeated(words: Words, rows: int) -> np.ndarray:
    """Words of each row in windows of three that the row has twice or more."""
    h, first = words.hash, words.first
    row = np.repeat(np.arange(rows), np.diff(first))
    if len(h) < 3:
        return np.zeros(rows, np.int64)
    begin = np.flatnonzero(row[2:] == row[:-2])
    key = mix(mix(mix(h[begin] * _TURN + h[begin + 1]) * _TURN + h[begin + 2]) ^ mix(row[begin].astype(U64) * _TURN))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = begin[order[np.append(same, False) | np.append(False, same)]] if len(key) else begin
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 3, -1)
    return np.bincount(row[np.cumsum(edge)[:-1] > 0], minlength=rows)


def _duplicate_lines(words: Words, edges: np.ndarray, rows: int) -> np.ndarray:
    """Lines of each row that have a word and equal an earlier one of the row."""
    raw = words.raw
    feed = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([edges[:-1][edges[:-1] < edges[1:]], feed + 1]))
    start = np.unique(start[start < len(raw)])
    row = np.searchsorted(edges, start, "right") - 1
    after = np.searchsorted(feed, start)
    end = np.minimum(np.append(feed, len(raw))[after], edges[row + 1])
    some = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end, row = start[some], end[some], row[some]
    if not len(start):
        return np.zeros(rows, np.int64)
    key = mix(hashes(raw, start, end) ^ mix(row.astype(U64) * _TURN))
    _, place = np.unique(key, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[place], minlength=rows)


def _judge(weight, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weight.value
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in pieces(offsets):
                words = Words(data, offsets[i : j + 1])
                n, raw, edges = j - i, words.raw, offsets[i : j + 1] - offsets[i]
                inside = np.zeros(len(raw) + 1, np.int64)
                np.add.at(inside, words.start, 1)
                np.add.at(inside, words.end, -1)
                inside = np.cumsum(inside)[:-1] > 0
                upto = lambda flag: np.diff(np.append(0, np.cumsum(flag))[edges])  # noqa: E731, B023
                chars = upto(inside & ((raw & 0xC0) != 0x80))
                symbols = upto(_SYMBOL[raw])
                count, repeat = np.diff(words.first), _repeated(words, n)
                bucket, row = _buckets(words)
                score, grams = _sum_by(w[bucket], row, n), np.bincount(row, minlength=n)
                failed = (count < FEWEST) | (100 * repeat > REPEATED * count)
                kept = ~failed & (score >= least * grams)
                mean = score / np.maximum(grams, 1) / STEPS
                columns = [count, chars, symbols, _duplicate_lines(words, edges, n), repeat, failed, kept, mean]
                names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), *(pa.array(c) for c in columns)], names=names)

    return run


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score of every document."""
    spark = docs.sparkSession
    batches_of(spark, 500)
    rows = only(docs, doc_id=id_col, text=text_col)
    weight = spark.sparkContext.broadcast(weights(rows, trusted_ids(labels)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return rows.mapInArrow(_judge(weight, round(least * STEPS)), schema)


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The documents with all their columns, without those that are not kept; of rows with one identifier all stay if one is kept, and rows with a null identifier stay."""
    gone = judge(docs, labels, id_col, text_col, least).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select("doc_id")
    name = fresh(docs, "gone")
    return docs.join(gone.withColumnRenamed("doc_id", name), F.col(f"`{id_col}`") == F.col(name), "left_anti")
