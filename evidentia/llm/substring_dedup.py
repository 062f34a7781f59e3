"""Removal of long repeats by recompression.

Rounds of recompression turn each document's words into fewer and longer symbols: round 0 names runs of two
equal words, each later round names pairs: symbols are split into left and right ones by one bit of a keyed
hash, and a left symbol followed by a right one becomes one symbol. A name is a 64-bit hash of what it
names, so equal runs and pairs get equal names everywhere at once; the global dictionary that a round of
recompression needs is that hash, and the rounds run inside the scan without a shuffle.

Whether two symbols join depends on them alone, so after R rounds a window's symbols are those of any equal
window, but for ``margin`` = 2 ** (R + 1) words on either side, which is also a symbol's greatest length. R is
the most rounds for which every window is sure to have a whole symbol inside its margins: 2 for 50 words.

1. Anchors: a window's anchor is the symbol with the least hash inside its margins, the leftmost of equals.
   Consecutive windows with one anchor form a block: one row (symbol, hash of all words of the block, document,
   start, windows). Equal windows have equal anchors, at the same place.
2. Blocks meet by their anchor, the shared high-level symbol, together with the words from ``margin`` before to 2 * ``margin``
   after its start, which lie in every window that has this anchor. A block whose anchor and words also occur in a document
   with a smaller identifier is covered. A block that is its document's own, although other blocks have its anchor, may still
   share some of its windows.
3. Only the windows of those blocks are looked at one by one: they meet by a 128-bit hash of their words.
4. Covered words are removed.

Rows that meet are sorted by key, then document, and read once from the front, so a passage that a third of
all documents share needs no more memory than any other; repeats within one piece of the scan are settled there.

Windows are judged on the input. Defined results: null text has no words; documents shorter than a window lose
nothing; rows with a null identifier neither lose words nor cause it; repeated rows lose the same words;
empty tables give no rows; other columns are ignored. Identifiers should be unique but for repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batches_of, only, partitions, stored
from ._text import U64, Words, mix, signed, texts

WINDOW = 50
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_PLACE = 28


def rounds_for(window: int) -> int:
    """The most rounds after which every window has a whole symbol inside its margins."""
    r = 0
    while 4 * 2 ** (r + 2) - 1 <= window:
        r += 1
    if 4 * 2 ** (r + 1) - 1 > window:
        raise ValueError("windows of fewer than 7 words are too short")
    return r


def recompress(words: Words, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and the words that they start at."""
    sym, start = words.hash, np.arange(len(words))
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))

    def merged(sym: np.ndarray, start: np.ndarray, row: np.ndarray, at: np.ndarray, name: np.ndarray) -> tuple:
        sym = sym.copy()
        sym[at] = name
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        return sym[keep], start[keep], row[keep]

    if len(sym) > 1:
        same = np.zeros(len(sym) + 1, bool)
        same[1:-1] = (sym[1:] == sym[:-1]) & (row[1:] == row[:-1])  # same[i]: word i equals word i - 1
        at = np.flatnonzero(~same[:-2] & same[1:-1] & ~same[2:])
        sym, start, row = merged(sym, start, row, at, mix(sym[at] * _A + _B))
    for r in range(rounds):
        left = (mix(sym + U64((r + 1) * int(_B) % (1 << 64))) >> U64(63)).astype(bool)
        at = np.flatnonzero(left[:-1] & ~left[1:] & (row[1:] == row[:-1]))
        sym, start, row = merged(sym, start, row, at, mix(sym[at] * _A + sym[at + 1] * _B + U64(r)))
    return sym, start


class Rolling:
    """Hashes of stretches of words, from running sums of their hashes times powers of an odd number."""

    def __init__(self, base: int):
        self.base = U64(base)
        self.back = U64(pow(base, -1, 1 << 64))
        self.power = self.inverse = np.ones(1, U64)

    def of(self, hashes: np.ndarray) -> Rolling:
        n = len(hashes) + 1
        if len(self.power) < n:
            ones = lambda b: np.multiply.accumulate(np.append(np.ones(1, U64), np.full(n, b)))
            self.power, self.inverse = ones(self.base), ones(self.back)
        self.sums = np.append(np.zeros(1, U64), np.add.accumulate(hashes * self.power[: n - 1]))
        return self

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def blocks(words: Words, window: int, rounds: int, rolling: Rolling) -> tuple[np.ndarray, ...]:
    """Symbol, hash, row, first word (in its row) and number of windows of each block."""
    n = len(words)
    sym, start = recompress(words, rounds)
    name, order = np.zeros(n, U64), np.full(n, ~U64(0))
    name[start] = sym
    order[start] = (mix(sym ^ _A) >> U64(_PLACE) << U64(_PLACE)) | start.astype(U64)
    margin = 2 ** (rounds + 1)
    width, least, span = window - 3 * margin + 1, order, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    p = np.arange(max(0, n - window + 1))
    p = p[row[p] == row[p + window - 1]]
    anchor = least[p + margin]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(fresh)
    count = np.diff(at, append=len(p))
    begin = p[at]
    place = (anchor[at] & U64((1 << _PLACE) - 1)).astype(np.int64)
    rolling.of(words.hash)
    body = rolling.stretch(begin, begin + count + window - 1)
    body = mix(body + (place - begin).astype(U64) * _A + count.astype(U64) * _B)
    # what every window of the block has around its anchor
    shared = mix(name[place] * _A + rolling.stretch(place - margin, place + 2 * margin))
    return shared, body, row[begin], begin - words.first[row[begin]], count


def _settled(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Which rows have a row with equal keys and a smaller document here."""
    order = np.lexsort([doc, *keys[::-1]])
    fresh = np.ones(len(doc), bool)
    fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    owner = doc[order][np.maximum.accumulate(np.where(fresh, np.arange(len(doc)), 0))]
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > owner
    return out


_BLOCK = "settled boolean, symbol long, body long, doc long, start int, windows int"


def _anchors(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(0xD1342543DE82EF95)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, words in texts(batch.column(1)):
                if len(words) < window:
                    continue
                symbol, body, row, start, count = blocks(words, window, rounds, rolling)
                doc = ids[i + row]
                done = _settled([symbol, body], doc)
                # what is settled only passes by: it is dealt evenly
                symbol = np.where(done, mix(doc.astype(U64) * _A + start.astype(U64)), symbol)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done), signed(symbol), signed(body), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["settled", "symbol", "body", "doc", "start", "windows"]
                )

    return run


def _out(covered: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(covered), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], names=["covered", "doc", "start", "windows"])


def _by_symbol(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by symbol, body, document: which blocks are covered, and which must be looked at window by window."""
    last: tuple | None = None  # symbol, body, owner, whether the symbol has several bodies
    held: list[tuple] = []  # rows of the last symbol's only body so far that its owner has
    for batch in batches:
        if not batch.num_rows:
            continue
        settled, symbol, body, doc, start, count = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if settled.any():
            yield _out(np.ones(int(settled.sum()), bool), doc[settled], start[settled], count[settled])
            open_ = ~settled
            symbol, body, doc, start, count = symbol[open_], body[open_], doc[open_], start[open_], count[open_]
            if not len(doc):
                continue
        n = len(doc)
        new_symbol, new_body = np.ones(n, bool), np.ones(n, bool)
        new_symbol[1:] = symbol[1:] != symbol[:-1]
        new_body[1:] = new_symbol[1:] | (body[1:] != body[:-1])
        goes_on = last is not None and last[0] == symbol[0]
        if goes_on:
            new_symbol[0] = False
            new_body[0] = last[1] != body[0]
        where = np.maximum.accumulate(np.where(new_body, np.arange(n), -1))
        owner = np.where(where >= 0, doc[where], last[2] if goes_on else 0)
        group = np.cumsum(new_symbol)
        bodies = np.bincount(group, weights=new_body, minlength=group[-1] + 1)
        several = bodies >= 2
        if goes_on:
            several[0] = last[3] or bodies[0] >= 1
            if several[0] and held:
                yield _out(np.zeros(len(held), bool), *(np.array(x) for x in zip(*held, strict=True)))
                held = []
        if not goes_on or group[-1] > 0:
            held = []
        mine = doc == owner
        show = ~mine | several[group]
        if show.any():
            yield _out(~mine[show], doc[show], start[show], count[show])
        if not several[group[-1]]:
            tail = mine & (group == group[-1])
            held += zip(doc[tail].tolist(), start[tail].tolist(), count[tail].tolist(), strict=True)
        last = (symbol[-1], body[-1], owner[-1], bool(several[group[-1]]))


def _windows(window: int):
    """Rows (id, text, blocks) to one row for each window of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(0xD1342543DE82EF95), Rolling(0xAF251AF3B0F025B5)
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for i, j, words in texts(batch.column(1)):
                some = lists[i:j]
                n = np.diff(some.offsets.to_numpy())
                flat = some.flatten()
                start, count = flat.field("start").to_numpy().astype(np.int64), flat.field("windows").to_numpy().astype(np.int64)
                row = np.repeat(np.arange(j - i), n)
                p = np.repeat(words.first[row] + start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                row = np.repeat(row, count)
                fits = p + window <= words.first[row + 1]
                p, row = p[fits], row[fits]
                if not len(p):
                    continue
                one.of(words.hash)
                two.of(words.hash)
                a, b, doc = one.stretch(p, p + window), two.stretch(p, p + window), ids[i + row]
                done = _settled([a, b], doc)
                place = p - words.first[row]
                a = np.where(done, mix(doc.astype(U64) * _A + place.astype(U64)), a)
                yield pa.RecordBatch.from_arrays([pa.array(done), signed(a), signed(b), pa.array(doc), pa.array(place.astype(np.int32))], names=["settled", "one", "two", "doc", "start"])

    return run


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hash, then document: the windows that a smaller document has."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        settled, one, two, doc, start = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        keep = settled.copy()
        at = np.flatnonzero(~settled)
        if len(at):
            a, b, d = one[at], two[at], doc[at]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            goes_on = last is not None and last[0] == a[0] and last[1] == b[0]
            fresh[0] = not goes_on
            where = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), -1))
            owner = np.where(where >= 0, d[where], last[2] if goes_on else 0)
            keep[at] = d > owner
            last = (a[-1], b[-1], owner[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(start[keep])], names=["doc", "start"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc``, ``start``, ``words``: stretches of words whose windows also start in a document with a smaller identifier. They may overlap."""
    spark = docs.sparkSession
    batches_of(spark, 500)
    rows = only(docs, id=id_col, text=text_col).where("id is not null")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def streamed(df: DataFrame, by: str, order: list[str], fold, schema: str) -> DataFrame:
        small = spark.conf.get(key)
        spark.conf.set(key, "50000")
        try:
            return stored(df.repartition(partitions(spark), by).sortWithinPartitions(*order).mapInArrow(fold, schema))
        finally:
            spark.conf.set(key, small)

    found = streamed(rows.mapInArrow(_anchors(window, rounds_for(window)), _BLOCK), "symbol", ["symbol", "body", "doc"], _by_symbol, "covered boolean, doc long, start int, windows int")
    open_ = found.where("not covered").groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("blocks"))
    looked = rows.join(open_, rows["id"] == open_["doc"]).select("id", "text", "blocks")
    single = streamed(looked.mapInArrow(_windows(window), "settled boolean, one long, two long, doc long, start int"), "one", ["one", "two", "doc"], _by_window, "doc long, start int")
    return found.where("covered").select("doc", "start", (F.col("windows") + (window - 1)).alias("words")).unionByName(single.select("doc", "start", F.lit(window).alias("words")))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ns, gone, kept = [], [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            words = (text.as_py() or b"").split()
            n = len(words)
            if spans.is_valid and n:
                start, size = spans.values.field("start").to_numpy(), spans.values.field("words").to_numpy()
                depth = np.zeros(n + 1, np.int64)
                np.add.at(depth, np.minimum(start, n), 1)
                np.add.at(depth, np.minimum(start + size, n), -1)
                stays = np.cumsum(depth[:-1]) == 0
                words = [w for w, k in zip(words, stays.tolist(), strict=True) if k]
            ns.append(n)
            gone.append(n - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by one space) of every row."""
    spans = repeats(docs, id_col, text_col, window).groupBy("doc").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    rows = only(docs, id=id_col, text=text_col)
    joined = rows.join(spans, rows["id"] == spans["doc"], "left").select("id", "text", "spans")
    return joined.mapInArrow(_removed, "doc_id long, n_words long, n_removed long, kept_text string")
