"""Text, links and structured data out of HTML."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = ("script", "style", "noscript", "svg")
BLANKS = r"[\s\x{0B}\x{A0}]+"


class _Text(HTMLParser):
    """Collects the text nodes of the body outside skipped elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found, self.deep, self.body = [], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "body":
            self.body = True
        elif tag in SKIPPED:
            self.deep += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.deep:
            self.deep -= 1

    def handle_data(self, data: str) -> None:
        if self.body and not self.deep:
            self.found.append(data)


def plain_text(page: str | None) -> str:
    """Text of the body, nodes joined by blanks; a page without a body is read whole; null as empty."""
    if not page:
        return ""
    parser = _Text()
    parser.body = "<body" not in page.lower()
    parser.feed(page)
    parser.close()
    return " ".join(" ".join(parser.found).split())


@F.pandas_udf(StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(plain_text, na_action=None)


def tag_free(page: Column) -> Column:
    """The same without a parser, inside the JVM: exact for pages whose markup is closed; entities stay as written."""
    body = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)^.*?<body[^>]*>", "")
    bare = F.regexp_replace(body, r"(?is)<!--.*?-->|<(script|style|noscript|svg)\b[^>]*>.*?</(script|style|noscript|svg)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), BLANKS, " "))


def json_ld(page: Column) -> Column:
    """The bodies of all JSON-LD scripts, in order."""
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))


def images(page: Column) -> Column:
    """Distinct addresses of images: src and data-src of img and source, every address of a srcset, and the pages' own picture."""
    p = F.coalesce(page, F.lit(""))
    plain = F.regexp_extract_all(p, F.lit(r"""(?is)<(?:img|source)\b[^>]*?\s(?:data-)?src=["']([^"']+)["']"""), F.lit(1))
    sets = F.regexp_extract_all(p, F.lit(r"""(?is)<(?:img|source)\b[^>]*?\s(?:data-)?srcset=["']([^"']+)["']"""), F.lit(1))
    of_sets = F.flatten(F.transform(sets, lambda s: F.transform(F.split(s, r",\s+"), lambda x: F.element_at(F.split(F.trim(x), r"\s+"), 1))))
    meta = F.regexp_extract_all(p, F.lit(r"""(?is)<meta\b[^>]*(?:property|name)=["'](?:og|twitter):image["'][^>]*content=["']([^"']+)["']"""), F.lit(1))
    return F.filter(F.array_distinct(F.transform(F.concat(plain, of_sets, meta), lambda x: F.trim(x))), lambda x: (x != "") & ~x.startswith("data:"))


def sitemap_locations(xml: Column) -> Column:
    """Addresses in a sitemap or an index of sitemaps."""
    return F.transform(F.xpath(xml, F.lit("//*[local-name()='loc']/text()")), lambda x: F.trim(x))


