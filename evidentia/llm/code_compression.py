"""Vector codes by product quantisation, nearest entries being searched by annular norm pruning.

Vectors become integers floor(1024 x) and are cut into ``PARTS`` equal parts; each part position has a codebook of up to ``ENTRIES``
entries, at first that part of the kept vectors with the smallest identifiers. Each of ``ROUNDS`` rounds assigns every part to its nearest
entry and replaces each used entry by its parts' mean, rounded down; then parts are assigned once more.

Nearest entries: a codebook is sorted by norm. As |norm(x) - norm(e)| <= distance(x, e), only entries in the annulus [norm(x) - best, norm(x) + best]
can be as near as the best one so far. Its ends are found by binary search; entries are evaluated outwards from x's own norm, ``WIDE`` at a
time, and each evaluation narrows the annulus, until all its entries, ends included, have been evaluated exactly. Parts are taken in order of their norms, a block at a
time, so that one matrix product serves neighbours; a block reads the hull of its annuli. Distances are whole numbers: in doubles where these hold them exactly, in 64-bit integers
otherwise. Of equal distances the lower index wins, whatever the order of evaluation.

Spark deals the vectors; a task returns one sum and count for each entry that it used, at most PARTS * ENTRIES rows, and only their totals (as many rows) reach the driver.

Defined results: rows whose vector is null or has null, NaN or infinite components are dropped, as are empty vectors, those that cannot be
cut into equal parts, and those of another length than the kept vector with the smallest identifier. With fewer than ``ENTRIES`` kept rows codebooks are smaller; an empty table gives no
rows. Null identifiers come last, repeated rows count each time, equal identifiers go by their vectors. Integers beyond ``limit(length)`` (131,072 * 1024 for 64 components) are held there, as
distances would leave 64 bits; sums of errors are held at 2^63 - 1. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import BROADCAST_ROWS, only, stored

PARTS, ENTRIES, ROUNDS, STEPS = 4, 256, 4, 1024
#: Entries evaluated before the annulus is narrowed again, and parts that share a matrix product.
WIDE, BLOCK = 32, 512
_MOST = (1 << 63) - 1


def limit(length: int) -> int:
    """The largest integer for which squared distances of vectors of this length fit 63 bits."""
    return int(2**30 / max(length, 1) ** 0.5)


class Annuli:
    """A codebook sorted by norm."""

    def __init__(self, book: np.ndarray):
        whole = book.astype(np.float64)
        norms = np.sqrt((whole * whole).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], book[self.order]
        self.largest = int(np.abs(book).max(initial=0))
        self.whole = self.entries.astype(np.float64)
        self.squares = (self.whole * self.whole).sum(1)

    def _distances(self, x: np.ndarray, lo: int, hi: int, exact: bool) -> np.ndarray:
        if exact:
            y = x.astype(np.float64)
            return (y * y).sum(1)[:, None] - 2 * (y @ self.whole[lo:hi].T) + self.squares[lo:hi]
        out = np.empty((len(x), hi - lo), np.int64)
        for k in range(lo, hi):
            out[:, k - lo] = ((x - self.entries[k]) ** 2).sum(1)
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index in the codebook and squared distance of each row's nearest entry."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        whole = x.astype(np.float64)
        norms = np.sqrt((whole * whole).sum(1))
        by_norm = np.argsort(norms, kind="stable")
        largest = max(self.largest, int(np.abs(x).max(initial=0)))
        # sums of squares and products below 2^53
        exact = 4 * x.shape[1] * largest * largest < 1 << 53
        for i in range(0, len(x), BLOCK):
            rows = by_norm[i : i + BLOCK]
            code[rows], error[rows] = self._block(x[rows], norms[rows], exact)
        return code, error

    def _block(self, x: np.ndarray, norms: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.norms)
        at = int(np.searchsorted(self.norms, norms[len(norms) // 2]))
        lo, hi = max(0, min(at - WIDE // 2, n - WIDE)), min(n, max(at + WIDE // 2, WIDE))
        code, best = self._best(x, lo, hi, exact)
        while True:
            # rounding of norms and roots is far below this
            reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-6 * (1 + norms)
            first = int(np.searchsorted(self.norms, (norms - reach).min(), "left"))
            last = int(np.searchsorted(self.norms, (norms + reach).max(), "right"))
            below, above = (max(first, lo - WIDE), lo), (hi, min(last, hi + WIDE))
            if below[0] >= below[1] and above[0] >= above[1]:
                return code, best
            for a, b in (below, above):
                if a < b:
                    c, d = self._best(x, a, b, exact)
                    better = (d < best) | ((d == best) & (c < code))
                    code, best = np.where(better, c, code), np.where(better, d, best)
            lo, hi = min(below[0], lo), max(above[1], hi)

    def _best(self, x: np.ndarray, lo: int, hi: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        index = self.order[lo:hi]
        by_index = np.argsort(index)
        d = self._distances(x, lo, hi, exact)[:, by_index]
        k = d.argmin(1)  # the first of equals, so the lowest index
        return index[by_index][k], d[np.arange(len(x)), k].astype(np.int64)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    most = limit(length)
    return np.clip(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), length), -most, most)


def _sums(books: np.ndarray):
    """One row for each used entry: part, entry, how many parts it got and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        annuli = [Annuli(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), parts * width)
            for p, a in enumerate(annuli):
                x = v[:, p * width : (p + 1) * width]
                code, _ = a.nearest(x)
                np.add.at(total[p], code, x)
                count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        annuli = [Annuli(b) for b in books]
        for batch in batches:
            v = _matrix(batch.column(2), parts * width)
            found = [a.nearest(v[:, p * width : (p + 1) * width]) for p, a in enumerate(annuli)]
            code = [bytes(c).hex() for c in np.stack([c for c, _ in found], 1).astype(np.uint8)]
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v (integers) of rows with whole vectors that can be cut."""
    rows = only(vectors, vec_id=id_col, label=label_col, v=vector_col)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = limit(1)
    whole = lambda x: F.least(F.greatest(F.floor(x.cast("double") * STEPS), F.lit(-top)), F.lit(top)).cast("int")
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0) & ~bad).select("vec_id", "label", F.transform("v", whole).alias("v"))


def train(rows: DataFrame) -> np.ndarray | None:
    """Codebooks (part, entry, component) of the rows of ``kept``, all of one length; None without rows."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    if not first:
        return None
    books = np.array([r.v for r in first], np.int64)
    books = np.clip(books, -limit(books.shape[1]), limit(books.shape[1])).reshape(len(first), PARTS, -1).swapaxes(0, 1).copy()
    for _ in range(ROUNDS):
        parts = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>")
        at = parts.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at")
        for r in at.agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            books[r.part, r.entry, r.at] = int(r.x) // r.n
    return books


def codebooks_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept vector."""
    rows = stored(kept(vectors, id_col, vector_col, label_col))
    smallest = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select(F.size("v").alias("size")).limit(1).collect()
    rows = rows.where(F.size("v") == (smallest[0].size if smallest else 0))
    books = train(rows)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    coded = stored(rows.mapInArrow(_codes(books), schema)) if books is not None else vectors.sparkSession.createDataFrame([], schema)
    by_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum")).select(F.col("label").alias("__label"), F.least("sum", F.lit(_MOST)).cast("long").alias("label_error"))
    sums = F.broadcast(by_label) if by_label.count() <= BROADCAST_ROWS else by_label
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books) if books is not None else "").alias("codebooks_sha256"))
