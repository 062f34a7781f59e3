"""URL block and allow lists as Bloom filter cascades.

A rule is a host and a path prefix, written ``host/path``. Every url yields its candidate keys: each suffix
of its host at a label boundary with each prefix of its path whose length some rule's path has. Those keys
of the whole corpus are the key universe. Level 0 of a cascade encodes the listed keys; level 1 the keys of
the universe that level 0 lets through wrongly; level 2 the listed keys that level 1 lets through; and so on
until nobody is wrong. A key is then listed exactly if the first level that rejects it is an odd one (or
none rejects and the number of levels is odd): exact membership for every key of the universe, without a
join, from filters whose size follows the list and not the corpus.

The filters of a level are sized so that about as many keys pass wrongly as are listed; the count is checked
and the level made larger if not, which bounds what the driver gathers and broadcasts. Lists are limited to
``MOST_RULES``; a rule without a slash fits every path of its host. If so many keys pass a filter that no rate of 128-bit hashes is low enough, an error says so.

Defined results: null urls and urls without ``://`` have empty host and path, match no rule and are judged
``allow``; empty tables give no rows; repeated urls are judged alike; other columns are ignored. Of rules
that fit, the longest (host and path together, then host) wins; of rules that differ in the case of their hosts alone, the last listed is shown.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import only

MOST_RULES = 2_000_000
#: The least rate of false keys that hashes of 128 bits can give.
LEAST_RATE = 1e-33


class Bloom:
    def __init__(self, keys: Iterable[str], rate: float, salt: int):
        keys = list(keys)
        rate = min(0.5, rate)
        self.n = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.n / max(1, len(keys)) * math.log(2))) if keys else 1
        self.salt = salt
        self.bits = np.zeros((self.n + 7) // 8, np.uint8)
        for key in keys:
            for p in self.probes(key):
                self.bits[p >> 3] |= 1 << (p & 7)

    def probes(self, key: str) -> Iterator[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), seed=self.salt)
        a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
        return ((a + i * b) % self.n for i in range(self.k))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.probes(key))


class Cascade:
    """Exact membership for listed keys and the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1

    def size(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def split_rules(rules: Iterable[str]) -> dict[str, str]:
    """Rules as listed by their keys: ``net/es/`` by host and path, the host in lower case; the path starts at the first slash, and is empty without one."""
    out = {}
    for r in rules:
        host, slash, path = r.partition("/")
        out["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) + slash + path] = r
    return out


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """Keys that may be listed, longest first."""
    if not host:
        return
    labels = host.split(".")
    found = [(host_part, path[:n]) for i in range(len(labels)) if (host_part := ".".join(labels[i:])) for n in lengths if n <= len(path)]
    yield from dict.fromkeys(h + p for h, p in sorted(found, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0]), x)))


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A to Z lower-cased) and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _passing(level: Bloom, lengths: list[int]):
    """Distinct keys of each batch that the single filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bool] = {}
        for batch in batches:
            found = set()
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in candidates(host, path, lengths):
                    if key not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen[key] = key in level
                        if seen[key]:
                            found.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    return run


def build_cascade(hosts_paths: DataFrame, listed: set[str], lengths: list[int], others: set[str] = frozenset()) -> Cascade:
    """``hosts_paths``: columns host and path of the corpus. ``others``: further keys to be told apart exactly."""
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not listed:
        return Cascade([])
    most, rate = 4 * len(listed) + 1000, 1e-3
    while True:
        first = Bloom(listed, rate, 0)
        false = hosts_paths.mapInArrow(_passing(first, lengths), "key string").distinct().limit(most + len(listed) + 1)
        wrong = {r.key for r in false.toLocalIterator()} - listed
        if len(wrong) <= most:
            break
        rate /= 1000  # the limit only ends a level that is to be built anew
        if rate < LEAST_RATE:
            raise ValueError(f"more than {most} keys pass a filter of rate {rate * 1000}: the corpus has too many keys for 128-bit hashes")
    wrong |= {k for k in others if k in first} - listed
    levels, include, exclude = [first], wrong, listed
    while include:
        level = Bloom(include, 0.5, len(levels))
        levels.append(level)
        include, exclude = {k for k in exclude if k in level}, include
    return Cascade(levels)


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of each row. ``rules``: (``allow`` or ``block``, ``host/path``)."""
    named = {k: r for k, r in split_rules(r for _, r in rules).items()}
    lists = {v: {k for k, _ in split_rules(r for w, r in rules if w == v).items()} for v in ("block", "allow")}
    lists["allow"] -= lists["block"]
    lengths = sorted({len("".join(k.partition("/")[1:])) for k in named})
    url = F.col("url")
    host, path = parts(url)
    rows = only(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    universe = rows.select("host", "path")
    cascades = {v: build_cascade(universe, keys, lengths, lists["block" if v == "allow" else "allow"]) for v, keys in lists.items()}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rule, verdict = [], []
            for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hit = next(((k, v) for k in candidates(h, p, lengths) for v, c in cascades.items() if k in c), None)
                rule.append(hit and named[hit[0]])
                verdict.append(hit[1] if hit else default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
