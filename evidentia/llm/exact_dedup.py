"""Exact deduplication by Patricia-trie owners.

Texts are equal when identical after each run of [\\x20\\x09-\\x0D] becomes one space. Each task puts the
byte strings it reads into a compressed radix trie whose terminal nodes keep the smallest identifier and
a count; so a text that fills a third of all rows leaves each task once. What remains is dealt by length
and content hash, sorted by it, and inserted into a second trie, whose subtrees end (and are emptied)
where the hash changes: strings meet only as whole bytes, never as hashes alone.

Defined results: null text is the empty text; empty tables give no rows; rows with a null identifier come
last (they own a text only if no row has an identifier); repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batches_of, only, partitions

SPACES = r"[\x20\x09-\x0D]+"


def normalised(data: bytes) -> bytes:
    """bytes.split() splits at exactly the six bytes of SPACES; a run at either end stays as one space."""
    out = b" ".join(data.split())
    if not data:
        return out
    if data[:1] in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
        out = b" " + out if out else b" "
    if out != b" " and data[-1:] in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"):
        out += b" "
    return out


class Node:
    __slots__ = ("count", "edge", "kids", "owner")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.owner, self.count = edge, {}, None, 0


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving: each probe is one comparison of memory."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed radix trie of byte strings; terminal nodes keep the smallest owner and a count."""

    def __init__(self) -> None:
        self.root, self.bytes = Node(b""), 0
        self.below: dict[int, int] = {}

    def insert(self, key: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                kid = node.kids[key[at]] = Node(key[at:])
                added = len(key) - at + 200
                self.bytes += added
                self.below[key[0]] = self.below.get(key[0], 0) + added
                node = kid
                break
            rest = key[at : at + len(kid.edge)]
            if rest == kid.edge:
                node, at = kid, at + len(rest)
                continue
            n = common(rest, kid.edge)
            fork = Node(kid.edge[:n])
            kid.edge = kid.edge[n:]
            fork.kids[kid.edge[0]] = kid
            node.kids[key[at]] = fork
            node, at = fork, at + n
        if node.count == 0 or (owner is not None and (node.owner is None or owner < node.owner)):
            node.owner = owner
        node.count += count

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, int | None, int]]:
        """Strings, owners and counts; with ``first``, of the subtree under that byte, which is then cut off."""
        if first is None:
            stack = [(self.root, b"")]
        else:
            stack = [(self.root.kids.pop(first), b"")]
            self.bytes -= self.below.pop(first)
        while stack:
            node, head = stack.pop()
            key = head + node.edge
            if node.count:
                yield key, node.owner, node.count
            stack.extend((kid, key) for kid in node.kids.values())


_OWNED = "len long, hash long, body binary, owner long, n long"
_SCHEMA = pa.schema([("len", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64())])


def _rows(found: list[tuple[bytes, int | None, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([len(x[0]) for x in found], pa.int64()),
            pa.array([xxhash.xxh3_64_intdigest(x[0]) - (1 << 63) for x in found], pa.int64()),
            pa.array([x[0] for x in found], pa.binary()),
            pa.array([x[1] for x in found], pa.int64()),
            pa.array([x[2] for x in found], pa.int64()),
        ],
        schema=_SCHEMA,
    )


def _grouped(found: Iterator[tuple[bytes, int | None, int]], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for x in found:
        rows.append(x)
        held += len(x[0]) + 64
        if held >= size:
            yield _rows(rows)
            rows, held = [], 0
    if rows:
        yield _rows(rows)


def _local(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted() -> Iterator[tuple[bytes, int | None, int]]:
            trie = Trie()
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for i, text in zip(ids, batch.column(1).cast(pa.binary()), strict=True):
                    trie.insert(normalised(text.as_py() or b""), i)
                    while trie.bytes > budget:
                        yield from trie.take(max(trie.below, key=trie.below.__getitem__))
            yield from trie.take()

        yield from _grouped(emitted())

    return run


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flushed(trie: Trie) -> list:
        return [(hashlib.sha256(k).hexdigest(), o, n) for k, o, n in trie.take()]

    schema = pa.schema([("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    at, trie, rows = None, Trie(), []
    for batch in batches:
        lens, hashes, owners, counts = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        for key, body, o, n in zip(zip(lens, hashes, strict=True), batch.column(2), owners, counts, strict=True):
            if key != at:
                rows += flushed(trie)
                at, trie = key, Trie()
            trie.insert(body.as_py(), o, n)
        if len(rows) >= 2000:
            yield out(rows)
            rows = []
    rows += flushed(trie)
    yield out(rows)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (smallest identifier), group_size. ``budget``: bytes a task's trie may hold."""
    spark = docs.sparkSession
    batches_of(spark, 500)
    local = only(docs, id=id_col, text=text_col).mapInArrow(_local(budget), _OWNED)
    dealt = local.repartition(partitions(spark), "len", "hash").sortWithinPartitions("len", "hash")
    return dealt.mapInArrow(_owners, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 48 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    A row is kept if it carries the smallest identifier of its text; of repeated rows with that identifier all are marked.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    rows = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.sha2(norm, 256).alias("text_sha256"))
    return rows.join(owners(docs, id_col, text_col, budget), "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
