"""Search results of several services as one log: answers in JSON or markdown become rows, scored, and every address is taken once.

An answer is one service's reply to one query: service, query_number, query, body (its text, null after an error), error. What a body is, it shows itself: a list of items, or an object
that holds them; items with usage and scores of their own; an answer with places that ground it; or blocks of markdown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.search import is_kept
from ..functions.urls import discovery_score

#: Before which lines a block of markdown begins, and where addresses and titles stand in it (fixed values).
BLOCK = r"\n(?=Title:|\[[0-9]+\])"
STATED_URL = r"(?:URL Source|URL):\s*(https?://\S+)"
STATED_TITLE = r"Title:[^\S\n]*\n?\s*(.+)"
LINK = r"\[([^\]]+)\]\((https?://[^)]+)\)"
IN_TEXT = r"""https?://[^\s)\]}>"']+"""
#: Signs that are no part of an address at its end (fixed values).
TRAILING, TRAILING_IN_BLOCKS = ".,;", ".,;)"
_ITEM = "array<struct<url: string, title: string, content: string, score: double, kind: string>>"


def _item(url: Column, title: Column, content: Column, score: Column | None = None, kind: str = "search") -> Column:
    none = F.lit(None).cast("double")
    return F.struct(url.alias("url"), title.alias("title"), content.alias("content"), (none if score is None else score).alias("score"), F.lit(kind).alias("kind"))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def in_markdown(text: Column) -> Column:
    """array of items: one for each block with an address; a stated one comes before a link's."""
    bare = lambda u: F.rtrim(u, F.lit(TRAILING_IN_BLOCKS))
    one = lambda b: _item(F.coalesce(bare(_found(b, STATED_URL)), _found(b, LINK, 2)), F.trim(F.coalesce(_found(b, STATED_TITLE), _found(b, LINK))), F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))
    return F.filter(F.transform(F.split(text, BLOCK), one), lambda x: x["url"].isNotNull()).cast(_ITEM)


def _text(v: Column, *names: str) -> Column:
    """The first of these members that is neither null, empty nor false."""
    return F.coalesce(*(F.nullif(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")), F.lit("false")) for n in names))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def in_json(v: Column) -> Column:
    """array of items of a VARIANT: its list, the list or object in ``data``, scored ``results``, or what grounds an answer (its places, then addresses in its text)."""
    schema = F.coalesce(F.schema_of_variant(v), F.lit(""))
    data = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.data", "variant")), F.lit(""))
    listed = F.when(schema.startswith("ARRAY"), _list(v, "$")).when(data.startswith("ARRAY"), _list(v, "$.data")).when(data.startswith("OBJECT"), F.array(F.try_variant_get(v, "$.data", "variant"))).otherwise(F.array().cast("array<variant>"))
    plain = F.transform(listed, lambda x: _item(F.trim(_text(x, "url", "sourceURL")), F.trim(_text(x, "title")), F.coalesce(_text(x, "content", "description"), F.lit(""))))
    plain = F.filter(plain, lambda x: x["url"].startswith("http://") | x["url"].startswith("https://"))
    bare = lambda u: F.rtrim(F.trim(u), F.lit(TRAILING))
    scored = F.transform(_list(v, "$.results"), lambda x: _item(bare(_text(x, "url")), _text(x, "title"), F.coalesce(_text(x, "content"), F.lit("")), F.try_variant_get(x, "$.score", "double"), "scored"))
    places = F.transform(_list(v, "$.candidates[0].groundingMetadata.groundingChunks"), lambda x: _item(bare(_text(x, "web.uri")), _text(x, "web.title"), F.lit(""), kind="grounding"))
    told = F.array_join(F.transform(_list(v, "$.candidates[0].content.parts"), lambda x: F.coalesce(_text(x, "text"), F.lit(""))), "\n")
    named = F.transform(F.regexp_extract_all(told, F.lit(IN_TEXT), F.lit(0)), lambda u: _item(bare(u), F.lit(None).cast("string"), F.lit(""), kind="grounded_text"))
    return F.filter(F.concat(*(x.cast(_ITEM) for x in (plain, scored, places, named))), lambda x: F.coalesce(x["url"] != "", F.lit(False)))


def results(answers: DataFrame) -> DataFrame:
    """service, query_number, query, rank (from 1 within an answer), url, title, content, score (the service's own), kind of every result of answers."""
    v = F.try_parse_json("body")
    items = F.when(v.isNotNull() & ~F.coalesce(F.schema_of_variant(v), F.lit("")).isin("STRING"), in_json(v)).otherwise(in_markdown(F.coalesce(F.try_variant_get(v, "$", "string"), F.col("body"))))
    rows = answers.where("body is not null").select("service", "query_number", "query", F.posexplode(items).alias("at", "x"))
    return rows.select("service", "query_number", "query", (F.col("at") + 1).alias("rank"), "x.url", "x.title", "x.content", "x.score", "x.kind")


def discovery_log(answers: DataFrame, domain: str) -> DataFrame:
    """service, query_number, query, rank, url, title, score, snippet, kind, accepted, error: every result, and a row without one for each query that failed, so that no failure hides the other queries.

    Plain results are scored and kept from 0.18 on or if official; those that a service scored or that ground an answer are all kept. Nulls anywhere are allowed; empty tables give no rows.
    """
    found = results(answers)
    own = discovery_score(F.col("url"), F.col("title"), F.col("content"), domain)
    plain = F.col("kind") == "search"
    score = F.when(plain, F.round(own, 4)).otherwise(F.col("score"))
    kept = F.when(plain, is_kept(F.col("url"), own, domain)).otherwise(True)
    cols = ["service", "query_number", "query"]
    rows = found.select(*cols, "rank", "url", "title", score.alias("score"), F.substring("content", 1, 1000).alias("snippet"), "kind", kept.alias("accepted"), F.lit(None).cast("string").alias("error"))
    text = F.lit(None).cast("string")
    failed = answers.where("error is not null").select(*cols, F.lit(None).cast("int").alias("rank"), text.alias("url"), text.alias("title"), F.lit(None).cast("double").alias("score"), text.alias("snippet"), F.lit("error").alias("kind"), F.lit(False).alias("accepted"), "error")
    return rows.union(failed)


def accepted(log: DataFrame, services: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """url, service, query_number, rank of each accepted address where it comes first: by service in the order given, query and rank; the first ``limit`` addresses. Other services are left out."""
    turn = F.array_position(F.array(*map(F.lit, services)), F.col("service"))
    order = F.struct(turn.alias("turn"), "query_number", "rank")
    once = log.where(F.col("accepted") & (turn > 0)).groupBy("url").agg(F.min(F.struct(order.alias("o"), "service")).alias("f"))
    first = once.select("url", "f.service", "f.o.query_number", "f.o.rank", F.col("f.o").alias("o")).orderBy("o")
    return (first if limit is None else first.limit(limit)).drop("o")


def first_answering(log: DataFrame, services: tuple[str, ...], limit: int | None = None) -> DataFrame:
    """``accepted`` of the first service in the order given that has any accepted address at all, whatever failed before; no rows if none has, which callers take for the search's failure."""
    turn = F.array_position(F.array(*map(F.lit, services)), F.col("service"))
    first = log.where(F.col("accepted") & F.col("url").isNotNull() & (turn > 0)).agg(F.min(turn).alias("__first"))
    chosen = log.join(F.broadcast(first), turn == F.col("__first")).drop("__first")
    return accepted(chosen, services, limit)


def material_results(found: DataFrame, keys: DataFrame, limit: int, least: float = 0.5) -> DataFrame:
    """The first ``limit`` of results (ordinal, key, url, relevance and more) that name a known key, have a web address, are relevant enough, and are the first of their key and address."""
    fit = found.join(keys.select("key").distinct(), "key", "left_semi").where((F.col("url").startswith("http://") | F.col("url").startswith("https://")) & (F.col("relevance") >= least))
    first = fit.groupBy("key", "url").agg(F.min("ordinal").alias("ordinal")).orderBy("ordinal").limit(limit)
    return found.join(F.broadcast(first) if limit <= 10_000 else first, ["key", "url", "ordinal"], "left_semi")


def read_pages(answers: DataFrame) -> DataFrame:
    """asked, url, title, content, published_at of a reader's answers (asked: the address asked for; body): a markdown text with ``Title:`` and ``URL Source:`` lines, or JSON, in ``data`` or bare. Null bodies and other shapes give none."""
    v = F.try_parse_json("body")
    data = F.try_variant_get(v, "$.data", "variant")
    inner = F.when(F.coalesce(F.schema_of_variant(data), F.lit("")).startswith("OBJECT"), data).otherwise(v)
    shape = F.coalesce(F.schema_of_variant(v), F.lit(""))
    markdown = v.isNull() | (shape == "STRING")
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.col("body"))
    rows = answers.where(F.col("body").isNotNull()).withColumns({"__v": inner, "__md": markdown, "__text": text, "__ok": markdown | shape.startswith("OBJECT")}).where("__ok")
    o = F.col("__v")
    either = lambda md, js: F.when(F.col("__md"), md).otherwise(js)
    return rows.select(
        "asked", F.coalesce(either(_found(F.col("__text"), r"(?m)^URL Source:\s*(https?://\S+)$"), _text(o, "url")), F.col("asked")).alias("url"), F.trim(either(_found(F.col("__text"), r"(?m)^Title:[^\S\n]*(.+)$"), _text(o, "title"))).alias("title"),
        either(F.col("__text"), F.coalesce(_text(o, "content", "markdown"), F.lit(""))).alias("content"), either(F.lit(None).cast("string"), _text(o, "publishedTime", "timestamp")).alias("published_at"),
    )
