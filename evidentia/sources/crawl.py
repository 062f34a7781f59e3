"""Crawling without a network of its own: frontier, robots, sitemaps and captures are tables; what fetches is handed in.

A fetcher is any function from an iterator of addresses to an iterator of captures (url, status, content_type, body). It runs inside tasks, one host's
addresses together and in turn, so a pause between requests holds for the host. Tests and offline runs hand in a lookup in a table of pages.
"""

from __future__ import annotations

import gzip
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import html, urls
from .work import cut

CAPTURE = "url string, status int, content_type string, body binary"


class Fetcher(Protocol):
    def __call__(self, addresses: Iterable[str]) -> Iterator[tuple[str, int, str, bytes]]: ...


def fetched(addresses: DataFrame, fetcher: Fetcher, pause: float = 0.0, most_bytes: int = 25 << 20) -> DataFrame:
    """Captures of addresses (url): of each host in turn, ``pause`` seconds apart; bodies above ``most_bytes`` are left out with status 413, and errors are status 0."""
    parts = max(1, int(addresses.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, float] = {}
        for batch in batches:
            out = []
            for url, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wait = last.get(host, 0.0) + pause - time.monotonic()
                if pause and wait > 0:
                    time.sleep(wait)
                try:
                    found = next(iter(fetcher([url])), (url, 404, "", b""))
                except Exception as e:  # noqa: BLE001  whatever a fetcher raises is this address's failure
                    found = (url, 0, type(e).__name__, b"")
                last[host] = time.monotonic()
                out.append(found if len(found[3]) <= most_bytes else (found[0], 413, found[2], b""))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.binary()))], names=["url", "status", "content_type", "body"])

    rows = addresses.where("url is not null").select("url", urls.host(F.col("url")).alias("host")).distinct()
    return rows.repartition(parts, "host").sortWithinPartitions("host", "url").mapInArrow(run, CAPTURE)


def robots_rules(files: DataFrame) -> DataFrame:
    """host, allow, prefix of robots files (host, text): rules for every agent. Sitemaps are in ``robots_sitemaps``."""
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    cut_ = lines.select("host", "n", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("k"), F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*[A-Za-z-]+\s*:(.*)$", 1), r"#.*$", "")).alias("v"))
    from pyspark.sql import Window

    before = F.last(F.when(F.col("k") == "user-agent", F.col("v")), ignorenulls=True).over(Window.partitionBy("host").orderBy("n"))
    return cut_.withColumn("agent", before).where("agent = '*' and k in ('allow', 'disallow') and v != ''").select("host", (F.col("k") == "allow").alias("allow"), F.col("v").alias("prefix"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    return files.select("host", F.explode(F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))).alias("url")).distinct()


def allowed(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Addresses that no rule of their host forbids: the longest prefix counts, an allowing one of equals."""
    keyed = addresses.withColumns({"__host": urls.host(F.col("url")), "__path": urls.path(F.col("url"))})
    met = keyed.select("url", "__host", "__path").distinct().join(rules, F.col("__host") == rules["host"]).where(F.startswith(F.when(F.col("__path") == "", "/").otherwise(F.col("__path")), F.col("prefix")))
    best = met.groupBy("url").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow")).alias("b"))
    return addresses.join(best.where("not b.allow").select("url"), "url", "left_anti")


def unpacked(body: Column, content_type: Column, url: Column) -> Column:
    """A sitemap's text, whether it is packed or not."""
    packed = F.lower(url).endswith(".gz") | F.contains(F.coalesce(content_type, F.lit("")), F.lit("gzip"))
    return F.when(packed, _gunzip(body)).otherwise(F.decode(body, "UTF-8"))


@F.pandas_udf(StringType())
def _gunzip(bodies: pd.Series) -> pd.Series:
    def one(b):
        try:
            return gzip.decompress(b).decode("utf-8", "replace")
        except (OSError, EOFError, TypeError):
            return None

    return bodies.map(one)


def sitemap_addresses(start: DataFrame, capture: Callable[[DataFrame], DataFrame], domain: str, most: int = 25) -> DataFrame:
    """url: pages that sitemaps (url) and the sitemaps they list name, of one company's hosts; ``most`` sitemaps are read, breadth first, which is the feature's bound."""
    waiting, seen, found, left = start.select("url").distinct(), None, None, most
    while left > 0:
        now = cut(waiting.orderBy("url").limit(left))
        n = now.count()
        if n == 0:
            break
        left -= n
        seen = now if seen is None else seen.unionByName(now)
        read = capture(now).where("status = 200").select(unpacked(F.col("body"), F.col("content_type"), F.col("url")).alias("xml")).where("xml is not null")
        kind = F.when(F.contains("xml", F.lit("<sitemapindex")), "index").otherwise("pages")
        # well-formed or not, a location is what stands between its tags
        listed = cut(read.select(kind.alias("kind"), F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?loc>\s*([^<\s]+)\s*</"), F.lit(1))).alias("url")).where(urls.is_official(F.col("url"), domain)).distinct())
        pages = listed.where("kind = 'pages'").select("url")
        found = pages if found is None else found.unionByName(pages)
        waiting = cut(listed.where("kind = 'index'").select("url").distinct().join(seen, "url", "left_anti"))
    return start.select("url").where(F.lit(False)) if found is None else found.distinct()


def links(captures: DataFrame) -> DataFrame:
    """source, url: canonical addresses that pages (url, body) link to, each once; mail, phone, script and fragment links are left out."""
    page = F.decode("body", "UTF-8")
    raw = captures.select(F.col("url").alias("source"), F.explode(F.regexp_extract_all(page, F.lit(r"""(?is)<a\b[^>]*?\shref\s*=\s*["']([^"']+)["']"""), F.lit(1))).alias("h"))
    fit = raw.where(~F.lower(F.trim("h")).rlike("^(mailto:|tel:|javascript:|data:|#)"))
    return fit.select("source", urls.canonical(urls.resolved(F.trim("h"), F.col("source"))).alias("url")).where("url is not null").distinct()


def crawl(spark: SparkSession, start: list[str], capture: Callable[[DataFrame], DataFrame], domain: str, most_pages: int = 100, depth: int = 4, step: int = 20) -> dict[str, DataFrame]:
    """pages (captures with depth) and log (url, depth, priority, decision) of a best-first crawl of one company's hosts.

    Each round fetches the ``step`` most promising addresses of the frontier (ties by address); addresses of negative priority are logged as rejected, those deeper than
    ``depth`` are not followed. Frontier and seen addresses stay tables, cut from their lineage every round.
    """
    first = spark.createDataFrame([(u,) for u in start], "url string").select(urls.canonical(F.col("url")).alias("url")).distinct()
    frontier = cut(first.select("url", F.lit(0).alias("depth"), F.lit(100).alias("priority")))
    seen, pages, log, left = frontier.select("url"), None, None, most_pages
    while left > 0:
        now = cut(frontier.orderBy(F.desc("priority"), "depth", "url").limit(min(step, left)))
        n = now.count()
        if n == 0:
            break
        left -= n
        got = cut(capture(now.select("url")).join(now.select("url", "depth"), "url"))
        pages = got if pages is None else pages.unionByName(got)
        html_ = got.where((F.col("status") == 200) & (F.col("depth") < depth) & F.contains(F.lower("content_type"), F.lit("html")))
        new = links(html_).join(html_.select(F.col("url").alias("source"), "depth"), "source").groupBy("url").agg((F.min("depth") + 1).alias("depth")).where(urls.is_official(F.col("url"), domain))
        new = cut(new.join(seen, "url", "left_anti").withColumn("priority", urls.priority(F.col("url")).cast("int")))
        fetched_ = now.select("url", "depth", "priority", F.lit("fetched").alias("decision"))
        made = fetched_.unionByName(new.where("priority < 0").select("url", "depth", "priority", F.lit("rejected").alias("decision")))
        log = made if log is None else log.unionByName(made)
        seen = cut(seen.unionByName(new.select("url")))
        frontier = cut(frontier.join(now.select("url"), "url", "left_anti").unionByName(new.where("priority >= 0")))
    if pages is None:
        raise ValueError("nowhere to start")
    return {"pages": pages, "log": log}


def from_pages(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A capture that looks addresses up in a table of pages (url, html); those that are not there have status 404."""
    known = pages.select(urls.canonical(F.col("url")).alias("url"), F.encode("html", "UTF-8").alias("body")).dropDuplicates(["url"])
    return lambda wanted: wanted.select("url").join(known, "url", "left").select("url", F.when(F.col("body").isNull(), 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), "body")
