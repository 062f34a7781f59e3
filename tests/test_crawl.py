"""Addresses seen from a page, robots, sitemaps and the crawl, over tables alone."""

import gzip
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from evidentia.functions import urls
from evidentia.sources import crawl


@pytest.mark.parametrize("base", ["http://a.b/c/d/e.html?q=1", "http://a.b", "https://a.b/c/"])
def test_resolved(spark, base):
    targets = ["x", "./x", "../x", "/x/y", "//h.i/x", "http://z/y", "?r=2", "../../../x", "x/../y?z=1#f", ".."]
    rows = spark.createDataFrame([(t,) for t in targets], "t string")
    found = [r.u for r in rows.select(urls.resolved(F.col("t"), F.lit(base)).alias("u")).collect()]
    assert found == [urljoin(base, t) for t in targets]


def test_robots(spark):
    files = spark.createDataFrame([("a.b", "User-agent: x\nDisallow: /\nUser-agent: *\nDisallow: /p # no\nAllow: /p/ok\nSitemap: http://a.b/s.xml"), ("c.d", "")], "host string, text string")
    pages = spark.createDataFrame([("http://a.b/p/1",), ("http://a.b/p/ok/2",), ("http://a.b/q",), ("http://c.d/p",), ("http://e.f/",)], "url string")
    assert {r.url for r in crawl.allowed(pages, crawl.robots_rules(files)).collect()} == {"http://a.b/p/ok/2", "http://a.b/q", "http://c.d/p", "http://e.f/"}
    assert [r.url for r in crawl.robots_sitemaps(files).collect()] == ["http://a.b/s.xml"]


def test_sitemaps(spark):
    index = b"<sitemapindex><sitemap><loc>http://a.b/2.xml.gz</loc></sitemap><sitemap><loc>http://a.b/1.xml</loc></sitemap></sitemapindex>"
    leaf = gzip.compress(b"<urlset><url><loc> http://a.b/x </loc></url><url><loc>http://other/y</loc></url></urlset>")
    store = {"http://a.b/1.xml": index, "http://a.b/2.xml.gz": leaf}

    def fetch(addresses):
        return ((u, 200, "", store[u]) for u in addresses if u in store)

    start = spark.createDataFrame([("http://a.b/1.xml",)], "url string")
    found = crawl.sitemap_addresses(start, lambda df: crawl.fetched(df, fetch), "a.b")
    assert [r.url for r in found.collect()] == ["http://a.b/x"]


def test_fetching(spark):
    def fetch(addresses):
        for u in addresses:
            if u.endswith("bad"):
                raise OSError("no")
            yield u, 200, "text/html", b"x" * (5 if u.endswith("1") else 50)

    df = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://b/bad",), (None,)], "url string")
    assert {(r.url, r.status) for r in crawl.fetched(df, fetch, most_bytes=10).collect()} == {("http://a/1", 200), ("http://a/2", 413), ("http://b/bad", 0)}


def test_crawl(spark):
    site = {
        "http://a.b/": '<a href="/products/x">x</a> <a href="cart">c</a> <a href="mailto:z">m</a><a href="http://else/products/q">q</a>', "http://a.b/products/x": '<a class="k" href="/deep/1">d</a><a href="/products/x#r">self</a>',
        "http://a.b/deep/1": '<a href="/deep/2">d</a>', "http://a.b/deep/2": '<a href="/deep/3">e</a>',
    }
    pages = spark.createDataFrame(list(site.items()), "url string, html string")
    found = crawl.crawl(spark, ["http://a.b"], crawl.from_pages(pages), "a.b", depth=2, step=1)
    assert {(r.url, r.depth, r.status) for r in found["pages"].collect()} == {("http://a.b/", 0, 200), ("http://a.b/products/x", 1, 200), ("http://a.b/deep/1", 2, 200)}
    assert {r.url for r in found["log"].where("decision = 'rejected'").collect()} == {"http://a.b/cart"}
    few = crawl.crawl(spark, ["http://a.b"], crawl.from_pages(pages), "a.b", most_pages=1)
    assert few["pages"].count() == 1
