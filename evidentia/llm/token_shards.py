"""Token ids in sorted-string-table shards.

A shard is one file: data blocks, an index block, a Bloom filter over its keys and a fixed footer.

- Key: the identifier as 8 bytes, big-endian with the sign bit flipped, so bytes sort as numbers do; a null identifier is the empty key and sorts first.
- Block: entries ``varint shared | varint unshared | varint size of value | rest of key | value`` in key order, the key's first ``shared`` bytes being those of the entry before; the whole block is a zstandard frame. A block closes at about 64 KB.
- Value: the ids as little-endian unsigned integers of 2 bytes if all are below 65,536, else of 4; a first byte says which.
- Index: per block its first key (length-prefixed), offset and length. Bloom: 10 bits a key, 7 probes.
- Footer (64 bytes): offsets and lengths of index and Bloom, entries, tokens, part, roll, magic. A line feed ends the file.

Tables are dealt by range of identifier, sorted, encoded and cut into shards of about 16 MB before
compression, each written by Spark's own committer as one record of one file: a lost or repeated task
leaves no half shard, and any file system that Spark writes will do. (part, roll) orders the shards as
the identifiers are ordered.

Encoding splits the texts of a batch at the six ASCII spaces, groups words by 64-bit hashes, compares those of a group byte by byte and looks each distinct
word (less a mark at its end) up in a bounded table of ids that the worker process keeps; words not in it go to the
tokenizers library.
The tokenizer must keep nothing of white space, never join characters across it, and part letters and digits from
marks; ``splits_at_spaces`` checks that, and other tokenizers get whole texts.

Defined results: null text is empty (the end id alone); empty tables give empty results; repeated rows are
repeated entries, ordered by text; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import BROADCAST_ROWS, batches_of, only, partitions, stored, work_dir
from ._text import Words, pieces, same_bytes

MAGIC = b"EVSSTAB1"
FOOTER = struct.Struct("<QIQIQQIIQ8s")
BLOCK, SHARD = 64 << 10, 16 << 20
#: Words whose ids a worker remembers in a generation; some 200 bytes each.
REMEMBERED = 400_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + k * b) % bits for k in range(7)]


class Writer:
    """Builds one shard; keys must come in order."""

    def __init__(self, part: int, roll: int):
        self.part, self.roll, self.out, self.index, self.keys = part, roll, bytearray(), [], []
        self.block, self.last, self.tokens, self.raw, self.first = bytearray(), b"", 0, 0, b""
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes, tokens: int) -> None:
        shared = 0
        if not self.block:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.keys.append(key)
        self.last, self.tokens = key, self.tokens + tokens
        if len(self.block) >= BLOCK:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.index.append((self.first, len(self.out), len(data)))
            self.out += data
            self.raw += len(self.block)
            self.block = bytearray()

    def size(self) -> int:
        return self.raw + len(self.block)

    def finish(self) -> bytes:
        self.close_block()
        bits = max(64, -(-10 * len(self.keys) // 8) * 8)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.out)
        index = b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)
        foot = FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.tokens, self.part, self.roll, 0, MAGIC)
        return bytes(self.out) + index + bytes(bloom) + foot


class Shard:
    """Reads one shard's bytes."""

    def __init__(self, data: bytes):
        if data[-1:] != b"\n" or data[-9:-1] != MAGIC:
            raise ValueError("not a token shard")
        self.data = data
        at = len(data) - 1 - FOOTER.size
        i, n, b, m, self.entries, self.tokens, self.part, self.roll, _, _ = FOOTER.unpack_from(data, at)
        self.bloom, self.index, end = data[b : b + m], [], i + n
        while i < end:
            size, i = read_varint(data, i)
            key, i = data[i : i + size], i + size
            offset, i = read_varint(data, i)
            length, i = read_varint(data, i)
            self.index.append((key, offset, length))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.index[k]
        data, at, key = zstandard.ZstdDecompressor().decompress(self.data[offset : offset + length]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all entries with this identifier: Bloom filter, then binary search over the blocks."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, len(self.bloom) * 8)):
            return []
        heads = [x[0] for x in self.index]
        found = []
        for k in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
            found += [ids_of(v) for q, v in self.block(k) if q == key]
        return found


def value_of(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not ids.size or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")


def splits_at_spaces(tokenizer) -> bool:
    """Whether ids of a text are those of its space-separated words, one after the other; for the kinds known to be so."""
    import json

    d = json.loads(tokenizer.to_str())
    pre, norm = d.get("pre_tokenizer") or {}, d.get("normalizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    steps = norm.get("normalizers") or [norm]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "|[^\\s" in first.get("pattern", {}).get("Regex", "")
    plain = all(s.get("type") in ("NFC", "Lowercase") or s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    clear = not any(set(t["content"]) & set(" \t\n\r\v\f") for t in d.get("added_tokens", []))
    prefix = any(p.get("add_prefix_space") for p in pre.get("pretokenizers") or [pre])
    return bool(drops and plain and clear and not prefix)


class Encoder:
    """Token ids of texts. Words met lately are remembered in two generations of at most REMEMBERED each."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_spaces(self.tokenizer)
        d = json.loads(self.tokenizer.to_str())
        self.lowers = any(s.get("type") == "Lowercase" for s in (d.get("normalizer") or {}).get("normalizers", [d.get("normalizer") or {}]))
        pre = d.get("pre_tokenizer") or {}
        #: Whether a word of small ASCII letters goes to the model as it is.
        self.plain = self.by_word and (d["model"].get("type") == "BPE") and [p.get("type") for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]
        self.lowers &= all(t["content"] == t["content"].lower() for t in d.get("added_tokens", []))
        self.letter = "H" if self.tokenizer.get_vocab_size() < 65536 else "I"
        self.kind = np.dtype("<u2") if self.letter == "H" else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) + len(words) > REMEMBERED:
            self.old, self.known = self.known, {}
        known, old, rest, model = self.known, self.old, [], self.tokenizer.model
        for w in words:
            ids = old.get(w)
            if ids is not None:
                known[w] = ids
            elif self.plain and w.isalpha() and w.islower():  # of bytes: ASCII letters
                known[w] = array(self.letter, [t.id for t in model.tokenize(w.decode())]).tobytes()
            else:
                rest.append(w)
        for i in range(0, len(rest), 10_000):
            some = rest[i : i + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                known[w] = array(self.letter, e.ids).tobytes()

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; those unknown are learned in slices that a generation holds, and kept here whatever is forgotten."""
        found = list(map(self.known.get, words))
        new = [i for i, x in enumerate(found) if x is None]
        for k in range(0, len(new), REMEMBERED):
            some = new[k : k + REMEMBERED]
            self._learn({words[i] for i in some})
            for i in some:
                found[i] = self.known[words[i]]
        return found

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        data, offsets = b"".join(texts), np.append(0, np.cumsum([len(t) for t in texts]))
        raw = np.frombuffer(data, np.uint8)
        found = [Words(raw, offsets[i : j + 1], self.lowers, part=True) for i, j in pieces(offsets)]
        if not found:
            return []
        base = [offsets[i] for i, _ in pieces(offsets)]
        if self.lowers:
            data = data.lower()
        first = np.append(np.concatenate([w.first[:-1] + n for w, n in zip(found, np.cumsum([0, *map(len, found)]), strict=False)]), sum(map(len, found)))
        start, end = (np.concatenate([getattr(w, k) + b for w, b in zip(found, base, strict=True)]) for k in ("start", "end"))
        _, at, back = np.unique(np.concatenate([w.hash for w in found]), return_index=True, return_inverse=True)
        # words of one hash are compared byte by byte; what differs from the first of them is looked up on its own
        size = end - start
        lettered = np.frombuffer(data, np.uint8)
        equal = size == size[at][back]
        equal[equal] = same_bytes(lettered, start[equal], start[at][back][equal], size[equal])
        odd = np.flatnonzero(~equal)
        back[odd] = len(at) + np.arange(len(odd))
        at = np.append(at, odd)
        ids = self.ids_of_words([data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        size = np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        flat, place = np.frombuffer(b"".join(ids), self.kind), np.append(0, np.cumsum(size))
        n = size[back]
        upto = np.append(0, np.cumsum(n))
        tokens = flat[np.repeat(place[back] - upto[:-1], n) + np.arange(upto[-1])]
        return [tokens[upto[a] : upto[b]] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, whatever the number of its tasks; single-threaded, as the tasks fill the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def _write(path: str, end_id: int | None, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        tail = np.array([] if end_id is None else [end_id], "<u4")
        part, roll, writer = TaskContext.get().partitionId(), 0, None
        done = lambda w: pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], names=["shard"])
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            for k, ids in zip(keys, encode(texts), strict=True):
                writer = writer or Writer(part, roll)
                ids = np.concatenate([ids, tail])
                writer.add(key_of(k), value_of(ids), len(ids))
                if writer.size() >= shard_bytes:
                    yield done(writer)
                    writer, roll = None, roll + 1
        if writer:
            yield done(writer)

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> None:
    """Encodes every text with the tokenizer file ``tokenizer`` and writes shards under ``path``."""
    spark = docs.sparkSession
    batches_of(spark, 500)
    rows = only(docs, id=id_col, text=text_col)
    dealt = rows.repartitionByRange(partitions(spark), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    shards = dealt.mapInArrow(_write(tokenizer, end_id, shard_bytes), "shard binary")
    shards.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            if len(content.as_py()) == 0:
                continue
            shard = Shard(content.as_py())
            ids, ns, crcs, starts, at = [], [], [], [], 0
            for key, value in shard:
                x = ids_of(value)
                ids.append(id_of(key))
                ns.append(len(x))
                crcs.append(zlib.crc32(x.tobytes()))
                starts.append(at)
                at += len(x)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.part] * n, pa.int64()), pa.array([shard.roll] * n, pa.int64()), *(pa.array(v, pa.int64()) for v in (ids, starts, ns, crcs)), pa.array([shard.tokens] * n, pa.int64())],
                names=["part", "roll", "doc_id", "at", "n_tokens", "ids_crc32", "shard_tokens"],
            )


def _files(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard file; a small partition size keeps several of them from one task's memory."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, as the shards under ``path`` have them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        found = stored(_files(spark, path).mapInArrow(_digest, "part long, roll long, doc_id long, at long, n_tokens long, ids_crc32 long, shard_tokens long"))
    finally:
        spark.conf.set(key, before)
    shards = found.groupBy("part", "roll").agg(F.max("shard_tokens").alias("total"))
    order = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    # one row per 16 MB of ids: a million of them for 16 TB
    starts = shards.select("part", "roll", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    if shards.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return found.join(starts, ["part", "roll"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array) of the wanted documents; each shard is asked through its Bloom filter and index."""
    wanted = list(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                if content.as_py():
                    shard = Shard(content.as_py())
                    found = [(i, x.tolist()) for i in wanted for x in shard.get(i)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    batches_of(spark, 500)
    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards to the shared folder and returns what ``read_shards`` finds in them."""
    spark = docs.sparkSession
    path = work_dir(spark)
    write_shards(docs, path, tokenizer, end_id, id_col, text_col)
    return read_shards(spark, path)
