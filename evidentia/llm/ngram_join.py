"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersections.

A document's set holds the distinct shingles of ``WIDTH`` words (A to Z lower-cased) as 64-bit hashes; a
shorter document has its whole sequence as its one shingle. Documents link when 100 * |x and y| >= 85 * |x or y|.

1. Equal sets are one class; only its smallest identifier goes on.
2. Tiles: a class goes to the tile of each of its smallest hashes, within its band of sizes (an octave), and
   as a visitor to the band above if a partner can be there. All of its first n - ceil(0.85 n) + 1 hashes are used
   where these are at most ``KEYS``: by the prefix principle two linked sets share one of them. A larger set uses
   its ``KEYS`` smallest: hashes being random, linked sets share none of these with a probability below
   0.15 ** KEYS (7e-14), which is in the range of a clash of 64-bit hashes.
3. In a tile, the parity bitmaps of two sets differ in at most as many bits as the sets in elements; linked sets differ
   in at most 15 (|x| + |y|) / 185. That upper bound on the overlap leaves few pairs.
4. Pairs that are left are verified by intersecting the sorted arrays, made anew from the texts of those documents only.

A tile in which many pairs are left (a large group of near copies) first gives only stars around the
documents with most neighbours, and its rows are set aside; once the verified links have been joined to components, the
rows set aside give every pair whose ends are still in different components. So a group of k near copies
costs about k verifications and no link between different components is lost. Tiles above ``TILE`` rows are
dealt to several tasks by a salt; the first pass handles each part on its own, ties each of its rows to the tile's first row as well, and sets all of them aside.
The second pass only takes tiles whose rows are still in several components, as pairs of blocks: no task holds a tile.
With ``keys=None`` a set uses all the hashes that the prefix principle asks for, and nothing is left to chance.

Defined results: null or empty texts have an empty set, link with nothing and are their own component; a row
with a null identifier links with nothing and has a null component; repeated rows are one class; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._io import batches_of, fresh, only, partitions, stored
from ._text import U64, Words, mix, signed, texts

WIDTH = 4
SHARE = 85
KEYS = 16
TILE = 4096
BLOCK = 2048
#: Identifiers that are sent to every executor to pick documents; 16 MB.
SENT = 1_000_000
#: Bytes of the first rows of large tiles that are sent to every executor.
MOST_HEADS = 8 << 20
_C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(words: Words, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, n = words.hash, len(words)
    at = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        at += h[k : k + len(at)] * _C[k % len(_C)] + U64(k // len(_C))
    at = mix(at)
    first = words.first
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(at[a : b - width + 1])
        elif b > a:
            whole = np.array([b - a], U64)
            for k in range(b - a):
                whole = mix(whole * _C[0] + h[a + k])
            yield whole
        else:
            yield np.zeros(0, U64)


def octave(n: int) -> int:
    return n.bit_length() - 1


def bits_in(band: int) -> int:
    return max(256, 1 << band)


def parity(hashes: np.ndarray, band: int) -> bytes:
    size = bits_in(band)
    odd = np.bincount((hashes & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def reaches_up(n: int, share: int) -> bool:
    """Whether a set of the next octave may link with one of n."""
    return n * 100 >= share << (octave(n) + 1)


def _signatures(width: int, share: int, keys: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, words in texts(batch.column(1), lower=True):
                n, low, high, chosen, bits, up = [], [], [], [], [], []
                for s in shingle_sets(words, width):
                    m = len(s)
                    n.append(m)
                    if m:
                        low.append(np.bitwise_xor.reduce(mix(s * _C[1])))
                        high.append(np.add.reduce(mix(s + _C[2])))
                        need = m - -(-share * m // 100) + 1
                        chosen.append(s[: need if keys is None else min(keys, need)].view(np.int64))
                        bits.append(parity(s, octave(m)))
                        up.append(parity(s, octave(m) + 1) if reaches_up(m, share) else None)
                    else:
                        low.append(U64(0))
                        high.append(U64(0))
                        chosen.append(np.zeros(0, np.int64))
                        bits.append(None)
                        up.append(None)
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], pa.array(n, pa.int32()), signed(np.array(low, U64)), signed(np.array(high, U64)), pa.array(chosen, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(up, pa.binary())],
                    names=["doc_id", "n", "low", "high", "keys", "bits", "up"],
                )

    return run


_TILE = "pair boolean, a long, b long, key long, band int, home boolean, n int, bits binary"
_TILE_SCHEMA = pa.schema([("pair", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("band", pa.int32()), ("home", pa.bool_()), ("n", pa.int32()), ("bits", pa.binary())])


def near(ids: np.ndarray, n: np.ndarray, home: np.ndarray, bits: np.ndarray, share: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a tile, the later rows that its bitmap does not rule out. ``bits``: a row of 64-bit words each."""
    for i in range(len(ids) - 1):
        total = n[i] + n[i + 1 :]
        most = (100 - share) * total // (100 + share)
        apart = np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1, dtype=np.int64)
        yield i, np.flatnonzero((apart <= most) & (home[i] | home[i + 1 :]) & (ids[i + 1 :] != ids[i])) + i + 1


def _matrix(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


class _Tiles:
    """Reads rows sorted by tile and hands out whole tiles, or chunks of TILE rows of a larger one."""

    def __init__(self, share: int):
        self.share, self.pairs, self.rows = share, [], []

    def first_pass(self, key: int, band: int, rows: list[tuple], part_of_hot: bool, hub: tuple | None) -> tuple | None:
        """rows: (id, n, home, bits). Returns the row with most neighbours, to which later chunks of the tile are tied."""
        if len(rows) == 2 and not part_of_hot:
            (a, na, ha, xa), (b, nb, hb, xb) = rows
            if a != b and (ha or hb) and (int.from_bytes(xa) ^ int.from_bytes(xb)).bit_count() <= (100 - self.share) * (na + nb) // (100 + self.share):
                self.pairs.append((a, b))
            return None
        rows.sort(key=lambda r: r[0])
        ids, n, home, bits = (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], bool), _matrix([r[3] for r in rows]))
        m, links, count = len(rows), [], 0
        degree = np.zeros(m, np.int64)
        for i, later in near(ids, n, home, bits, self.share):
            if len(later):
                links.append((i, later))
                count += len(later)
                degree[i] += len(later)
                degree[later] += 1
        if count <= 4 * m:
            self.pairs += [(int(ids[i]), int(ids[j])) for i, later in links for j in later]
        else:
            covered = np.zeros(m, bool)
            for i in np.argsort(-degree, kind="stable"):
                if degree[i] == 0:
                    break
                if covered[i]:
                    continue
                mine = np.flatnonzero((np.bitwise_count(bits ^ bits[i]).sum(axis=1, dtype=np.int64) <= (100 - self.share) * (n + n[i]) // (100 + self.share)) & (home | home[i]) & (ids != ids[i]))
                covered[mine] = covered[i] = True
                self.pairs += [(int(ids[i]), int(ids[j])) for j in mine]
        if count > 4 * m or part_of_hot:
            self.rows += [(r[0], key, band, r[2], r[1], r[3]) for r in rows]
        best = rows[int(degree.argmax())]
        if hub:
            x = np.frombuffer(hub[3], np.uint64)
            some = np.flatnonzero((np.bitwise_count(bits ^ x).sum(axis=1, dtype=np.int64) <= (100 - self.share) * (n + hub[1]) // (100 + self.share)) & (ids != hub[0]))
            self.pairs += [(hub[0], int(ids[j])) for j in some]
        return hub or best

    def out(self) -> pa.RecordBatch:
        p, r = self.pairs, self.rows
        self.pairs, self.rows = [], []
        p = sorted({(min(x), max(x)) for x in p})
        k = len(p)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([True] * k + [False] * len(r), pa.bool_()),
                pa.array([x[0] for x in p] + [x[0] for x in r], pa.int64()),
                pa.array([x[1] for x in p] + [None] * len(r), pa.int64()),
                pa.array([None] * k + [x[1] for x in r], pa.int64()),
                pa.array([None] * k + [x[2] for x in r], pa.int32()),
                pa.array([None] * k + [x[3] for x in r], pa.bool_()),
                pa.array([None] * k + [x[4] for x in r], pa.int32()),
                pa.array([None] * k + [x[5] for x in r], pa.binary()),
            ],
            schema=_TILE_SCHEMA,
        )


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[int, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the starts and ends of runs of equal values in the columns ``keys``, of which it may lack the last."""
    for batch in batches:
        if batch.num_rows:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys if k < batch.num_columns]
            change = np.ones(batch.num_rows, bool)
            change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            starts = np.flatnonzero(change)
            yield batch, starts, np.append(starts[1:], batch.num_rows)


def _tiles(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, held, at, hot, hub = _Tiles(share), [], None, False, None

        def close() -> None:
            if len(held) > 1 or held and hot:
                tiles.first_pass(at[0], at[1], held, hot, hub)

        # columns key, band, home, id, n, bits; rows of large tiles have a part and their tile's first row too
        for batch, starts, ends in _groups(batches, (0, 1, 6)):
            key, band = batch.column(0), batch.column(1)
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                part, first = (batch.column(k)[a].as_py() for k in (6, 7)) if batch.num_columns > 6 else (-1, None)
                if 0 < a and b < batch.num_rows and b - a == 1 and part < 0:
                    continue  # a tile of one
                here = (key[a].as_py(), band[a].as_py(), part)
                if here != at:
                    close()
                    held, at, hot, hub = [], here, part >= 0, first and (first["id"], first["n"], first["home"], first["bits"])
                rows = batch.slice(a, b - a)
                held += zip(*(rows.column(k).to_pylist() for k in (3, 4, 2, 5)), strict=True)
                while len(held) >= TILE:
                    hot = True
                    hub = tiles.first_pass(at[0], at[1], held[:TILE], True, hub)
                    held = held[TILE:]
                    yield tiles.out()
            if len(tiles.pairs) + len(tiles.rows) > 20_000:
                yield tiles.out()
        close()
        yield tiles.out()

    return run


def _rest(share: int):
    """The second pass: pairs of different components, for rows (key, band, block pair), home, id, n, bits, component, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def pairs(rows: list[tuple], where: tuple) -> Iterator[pa.RecordBatch]:
            if len({r[4] for r in rows}) < 2:
                return
            rows.sort(key=lambda r: r[0])
            col = lambda k, t: np.array([r[k] for r in rows], t)
            ids, n, home, comp, block = col(0, np.int64), col(1, np.int64), col(2, bool), col(4, np.int64), col(5, np.int64)
            found = []
            for i, later in near(ids, n, home, _matrix([r[3] for r in rows]), share):
                later = later[comp[later] != comp[i]]
                if where[2] != where[3]:
                    later = later[block[later] != block[i]]
                found += [(int(ids[i]), int(ids[j])) for j in later]
                if len(found) > 50_000:
                    yield out(found)
                    found = []
            if found:
                yield out(found)

        def out(found: list) -> pa.RecordBatch:
            found = sorted(set(found))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        for batch, starts, ends in _groups(batches, (0, 1, 2, 3)):
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                here = tuple(batch.column(k)[a].as_py() for k in range(4))
                if here != at:
                    if held:
                        yield from pairs(held, at)
                    held, at = [], here
                rows = batch.slice(a, b - a)
                held += zip(*(rows.column(k).to_pylist() for k in (5, 6, 4, 7, 8, 9)), strict=True)
        if held:
            yield from pairs(held, at)

    return run


def _arrays(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words in texts(batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([s.tobytes() for s in shingle_sets(words, width)], pa.binary())], names=["id", "shingles"])

    return run


def _verify(share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * both >= share * (len(x) + len(y) - both))
            keep = [k for k, g in enumerate(good) if g]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) whose sets link; ``docs``: id and text. Only the texts of their ends are read into sets."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("want")).distinct())
    wanted = F.broadcast(ends) if ends.count() <= SENT else ends
    sets = stored(docs.join(wanted, docs["id"] == wanted["want"], "left_semi").mapInArrow(_arrays(width), "id long, shingles binary").dropDuplicates(["id"]))
    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return stored(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(_verify(share), "a long, b long"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = SHARE, keys: int | None = KEYS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    batches_of(spark, 500)
    rows = only(docs, id=id_col, text=text_col)
    sets = stored(rows.mapInArrow(_signatures(width, share, keys), "doc_id long, n int, low long, high long, keys array<long>, bits binary, up binary"))
    classes = stored(sets.where("n > 0 and doc_id is not null").groupBy("low", "high", "n").agg(F.min("doc_id").alias("rep")))
    first = sets.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    row = lambda band, home, bits: F.struct(F.expr(band).cast("int").alias("band"), F.lit(home).alias("home"), F.col(bits).alias("bits"))
    octaves = "length(bin(n)) - 1"
    both = F.array(row(octaves, True, "bits"), row(f"{octaves} + 1", False, "up"))
    placed = first.select("doc_id", "n", "keys", F.explode(F.filter(both, lambda e: e["bits"].isNotNull())).alias("t"))
    tiles = placed.select(F.explode("keys").alias("key"), "t.band", "t.home", F.col("doc_id").alias("id"), "n", "t.bits")
    # tiles of more than TILE rows, their first rows, and in how many parts they are dealt
    large = tiles.groupBy("key", "band").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("id")).where(F.col("rows") > TILE)
    large = stored(large.select("key", "band", "id", F.ceil(F.col("rows") / TILE * 2).cast("int").alias("parts")))
    if large.isEmpty():
        tiles = tiles.withColumns({"part": F.lit(-1), "head": F.lit(None).cast("struct<id: bigint, n: int, home: boolean, bits: binary>")})
    else:
        heads = stored(large.join(tiles, ["key", "band", "id"]).groupBy("key", "band", "parts").agg(F.min_by(F.struct("id", "n", "home", "bits"), ~F.col("home")).alias("head")))
        sent = heads.agg(F.sum(F.length("head.bits") + 64).alias("s")).first().s <= MOST_HEADS
        tiles = tiles.join(F.broadcast(heads) if sent else heads, ["key", "band"], "left")
        tiles = tiles.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).otherwise(-1))
    tiles = tiles.select("key", "band", "home", "id", "n", "bits", "part", "head")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    try:
        found = stored(tiles.repartition(partitions(spark), "key", "band", "part").sortWithinPartitions("key", "band", "part").mapInArrow(_tiles(share), _TILE))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    pairs = stored(found.where("pair").select("a", "b").distinct())
    links = verified(pairs, rows, width, share)
    joined = components(links)
    aside = found.where("not pair").select("key", "band", "home", F.col("a").alias("id"), "n", "bits")
    placed = stored(aside.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    open_ = placed.groupBy("key", "band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")).where("least != most").select("key", "band", "blocks")
    if not open_.isEmpty():
        known = placed.join(open_, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        spread = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "key", "band", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "home", "id", "n", "bits", "component", "block"
        )
        more = spread.repartition(partitions(spark), "key", "band", "one", "two").sortWithinPartitions("key", "band", "one", "two").mapInArrow(_rest(share), "a long, b long")
        more = stored(more.distinct().join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            joined = components(links.unionByName(verified(more, rows, width, share)))
    # classes without a link are their own component; members take that of their class
    whole = classes.join(joined, classes["rep"] == joined["id"], "left").select("low", "high", "n", F.coalesce("component", "rep").alias("component"))
    return (
        sets.select("doc_id", "n", "low", "high")
        .join(whole, ["low", "high", "n"], "left")
        .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows that are the smallest of their component, with all their columns; rows with a null identifier stay."""
    gone = fresh(docs, "gone")
    found = jaccard_components(docs, id_col, text_col, **how).where("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(found, F.col(f"`{id_col}`") == F.col(gone), "left_anti")
