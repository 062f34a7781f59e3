"""Benchmark decontamination by q-gram lemma filtering.

A document is contaminated by an item if some part of it is within ``RATE`` edits per character of the
whole item, both case-folded and with each run of the six ASCII spaces as one blank (none at an item's ends).
An item of m characters with k edits keeps at least m - Q + 1 - k * Q of its q-grams, and they lie on
diagonals (position in the document less position in the item) at most k apart from where it starts. So
q-grams shared with an item are counted in bands of diagonals, each overlapping the next by half; bands with
fewer than that bound are ruled out, and the regions of the others are verified by an alignment banded to
their diagonals, free at both ends in the document.

Lengths and edits count UTF-8 bytes of the normalised text; k is lowered where the bound would fall below 1.
Whole texts are searched, each document on its own, so nothing is shuffled. The items are the query set:
they go to the executors in blocks of at most ``BLOCK_BYTES``, one pass over the documents per block; the driver holds one block at a time,
and results of all blocks but the last are written first.

Items of fewer than Q bytes are searched as whole words without edits.

Defined results: null or empty texts and items without any word match nothing; empty tables give no
rows; repeated documents or items give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batches_of, fresh, only, stored
from ._text import _SPACE, U64, pieces

Q = 8
RATE = 0.1
BLOCK_BYTES = 8 << 20
#: Meetings of equal q-grams that are held at a time.
MEETINGS = 1 << 20
#: A byte that goes on with a word.
PART = rb"[0-9A-Za-z_\x80-\xff]"
_HASH = U64(0x9E3779B97F4A7C15)


def normalised(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with single blanks, the new edges of the rows, and where each byte was."""
    space = _SPACE[raw]
    again = space.copy()
    again[1:] &= space[:-1]
    inner = edges[:-1][edges[:-1] < len(raw)]
    again[:1] = False
    again[inner] = False
    kept = np.flatnonzero(~again)
    out = raw[kept]
    out[space[kept]] = 32
    return out, np.searchsorted(kept, edges), kept


def grams(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for k in range(min(Q, n)):
        m = (len(x) - k) // Q
        out[k::Q] = np.ascontiguousarray(x[k : k + m * Q]).view("<u8")
    return out


class Items:
    """A block of items, their q-grams sorted with postings, and a bit table in front of them."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float = RATE):
        self.ids, self.bodies = [], []
        self.short: dict[bytes, list[int]] = {}
        for i, text in items:
            body = np.frombuffer(b" ".join(text.decode().casefold().encode().split()), np.uint8)
            if 0 < len(body) < Q:
                self.short.setdefault(body.tobytes(), []).append(i)
            elif len(body) >= Q:
                self.ids.append(i)
                self.bodies.append(body)
        of_size: dict[int, list[bytes]] = {}
        for b in self.short:
            of_size.setdefault(len(b), []).append(re.escape(b))
        # one pattern a length, as items of one start may have several; looked ahead, as they may overlap
        self.patterns = [re.compile(b"(?<!" + PART + b")(?=(" + b"|".join(sorted(x)) + b")(?!" + PART + b"))") for x in of_size.values()]
        m = np.array([len(b) for b in self.bodies], np.int64)
        self.m = m
        self.k = np.minimum((m * rate).astype(np.int64), (m - Q) // Q)
        self.bound = m - Q + 1 - self.k * Q
        self.step = 2 * self.k + 1
        found = [grams(b) for b in self.bodies]
        flat = np.concatenate(found) if found else np.zeros(0, U64)
        item = np.repeat(np.arange(len(found)), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.gram, self.item, self.place = flat[order], item[order], place[order]
        self.key, first = np.unique(self.gram, return_index=True)
        self.first = np.append(first, len(self.gram))
        self.bits = max(16, int(len(self.key) * 64).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[self.slot(self.key)] = True
        self.most = int(m.max()) if len(m) else 0

    def slot(self, g: np.ndarray) -> np.ndarray:
        return (g * _HASH) >> U64(64 - self.bits)

    def exact(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item's identifier, start, end) of items too short for q-grams, where they stand as whole words."""
        for p in self.patterns:
            for m in p.finditer(text):
                for i in self.short[m[1]]:
                    yield i, m.start(1), m.end(1)

    def bands(self, text: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, band) with enough shared q-grams; band b has the diagonals from b * step on, 2 * step of them."""
        g = grams(text)
        at = np.flatnonzero(self.table[self.slot(g)])
        if not len(at):
            return
        k = np.searchsorted(self.key, g[at])
        k[k == len(self.key)] = 0
        same = self.key[k] == g[at]
        at, k = at[same], k[same]
        row = np.searchsorted(edges, at, side="right") - 1
        whole = at + Q <= edges[row + 1]
        at, k, row = at[whole], k[whole], row[whole]
        n = self.first[k + 1] - self.first[k]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        wide = int((np.diff(edges).max(initial=0) + self.most) // self.step.min(initial=1)) + 2

        def met(f: int, to: int) -> tuple[np.ndarray, np.ndarray]:
            """Band and place in the item of the meetings from number f on, each in the two bands that have its diagonal."""
            g = np.arange(f, to)
            pos = np.searchsorted(ends, g, side="right")
            post = self.first[k[pos]] + g - (ends[pos] - n[pos])
            item, there = self.item[post], self.place[post]
            band = (at[pos] - edges[row[pos]] - there + self.most) // self.step[item]
            new = (row[pos] * len(self.m) + item) * wide + band
            return np.concatenate([new, (new - 1)[band > 0]]), np.concatenate([there, there[band > 0]])

        def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return keys // wide // len(self.m), keys // wide % len(self.m), keys % wide

        # the bound is on places of the item, each counted once
        if total <= MEETINGS:
            key, place = met(0, total)
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(heads, append=len(key))
            r, item, band = named(key[heads])
            for i in np.flatnonzero(count >= self.bound[item]):
                if len(np.unique(place[heads[i] : heads[i] + count[i]])) >= self.bound[item[i]]:
                    yield int(r[i]), int(item[i]), int(band[i])
            return
        # repetitive texts have very many meetings: some at a time, bands that can still grow being carried on
        key, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for f in range(0, total, MEETINGS):
            more = met(f, min(total, f + MEETINGS))
            key, place = np.concatenate([key, more[0]]), np.concatenate([place, more[1]])
            keys, index = np.unique(key, return_inverse=True)
            once = np.unique(index * (self.most + 1) + place)
            of, place = once // (self.most + 1), once % (self.most + 1)
            count = np.bincount(of, minlength=len(keys))
            r, item, band = named(keys)
            done = np.ones(len(keys), bool)
            if f + MEETINGS < total:
                after = min(int(np.searchsorted(ends, f + MEETINGS, side="right")), len(at) - 1)
                # no later place reaches a diagonal below this one
                done = (r < row[after]) | ((band + 2) * self.step[item] <= at[after] - edges[row[after]] + Q)
            for i in np.flatnonzero(done & (count >= self.bound[item])):
                yield int(r[i]), int(item[i]), int(band[i])
            open_ = ~done[of]
            key, place = keys[of[open_]], place[open_]

    def verify(self, text: np.ndarray, item: int, band: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best alignment of the item in the band of one document's text, if within its budget."""
        body, m, k, step = self.bodies[item], int(self.m[item]), int(self.k[item]), int(self.step[item])
        low = band * step - self.most - k
        span = 2 * step + 2 * k
        region = text[max(0, low) : low + span + m].tobytes()
        found = region.find(body.tobytes())
        if found >= 0:
            return 0, max(0, low) + found, max(0, low) + found + m
        if k == 0:
            return None
        none = np.int64(1) << 50
        one = np.int64(1) << 32  # cost above, start below: the least number is the cheapest, then the leftmost
        d = np.arange(span, dtype=np.int64)
        column = low + d
        padded = np.full(span + m, 256, np.int64)
        a, b = max(0, low), min(len(text), low + span + m)
        padded[a - low : b - low] = text[a:b]
        now = np.where((column >= 0) & (column <= len(text)), np.maximum(column, 0), none)
        ramp = d * one
        for i in range(m):
            step_on = now + np.where(padded[i : i + span] == body[i], 0, one)
            skip = np.append(now[1:], none) + one
            now = np.minimum(step_on, skip)
            column += 1
            now[(column < 0) | (column > len(text))] = none
            now = np.minimum.accumulate(now - ramp) + ramp
            if i % 8 == 7 and now.min() >> 32 > k:
                return None
        best = int(now.argmin())
        cost, start = int(now[best] >> 32), int(now[best] & 0xFFFFFFFF)
        return (cost, start, int(column[best])) if cost <= k else None


def _search(items: list[tuple[int, bytes]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items(items, rate)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            folded = [x.casefold().encode() for x in texts]
            offsets = np.append(0, np.cumsum([len(x) for x in folded]))
            for i, j in pieces(offsets):
                raw, edges = np.frombuffer(b"".join(folded[i:j]), np.uint8), offsets[i : j + 1] - offsets[i]
                text, at, kept = normalised(raw, edges)
                found: dict[tuple[int, int], list] = {}
                if block.short:
                    for row in range(j - i):
                        for item, start, end in block.exact(text[at[row] : at[row + 1]].tobytes()):
                            found.setdefault((row, item), []).append((0, start, end))
                for row, item, band in block.bands(text, at):
                    hit = block.verify(text[at[row] : at[row + 1]], item, band)
                    if hit:
                        found.setdefault((row, block.ids[item]), []).append(hit)
                for (row, item), hits in sorted(found.items()):
                    taken: list[tuple[int, int, int]] = []
                    for hit in sorted(set(hits)):  # the best first; others only where they do not overlap it
                        if all(hit[2] <= t[1] or t[2] <= hit[1] for t in taken):
                            taken.append(hit)
                    whole = raw[edges[row] : edges[row + 1]]
                    where = np.append(kept[at[row] : at[row + 1]] - edges[row], len(whole))
                    points = np.append(0, np.cumsum((whole & 0xC0) != 0x80))
                    grown = np.cumsum([len(c.casefold()) for c in texts[i + row]])  # a folded character may be several
                    for cost, start, end in sorted(taken, key=lambda t: t[1]):
                        a, b = (np.searchsorted(grown, points[where[x]], side="right") for x in (start, end - 1))
                        rows.append((ids[i + row], item, int(a), int(b) + 1, cost))
            kinds = [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["doc_id", "item_id", "start", "end", "edits"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end, edits: every place (code points of the text, end exclusive) where a document has an item."""
    batches_of(docs.sparkSession, 500)
    rows = only(docs, doc_id=id_col, text=text_col)
    schema = "doc_id long, item_id long, start long, end long, edits long"
    search = lambda block: rows.mapInArrow(_search(block, rate), schema)
    done, block, held = [], [], 0
    for r in only(benchmark, item=item_col, text=item_text_col).where("text is not null").toLocalIterator():
        body = r.text.encode()
        if held + len(body) > BLOCK_BYTES and block:
            done.append(stored(search(block)))
            block, held = [], 0
        block.append((r.item, body))
        held += len(body)
    return reduce(DataFrame.unionByName, [*done, search(block)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """The documents that have no item of the benchmark, with all their columns; rows with a null identifier stay."""
    hit = fresh(docs, "hit")
    hits = contaminated(docs, benchmark, id_col, text_col, **names).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(hits, F.col(f"`{id_col}`") == F.col(hit), "left_anti")
