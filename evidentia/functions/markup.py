"""Markup as rows: a page's structural tags, the text after each, and the element that each lies in, in JVM expressions and windows.

A page is cut at its structural tags (tables and their parts, sections, headings, titles) and at what shows no text (comments, scripts, styles). Row i holds the
i-th cut, its places in the page, and the text up to the next one, other tags read as blanks and entities decoded. Elements are nested as a
browser does it without errors: a cell ends at the next cell, row or end of its own table, a row at the next row; ends that match nothing are passed over.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that part headings into groups: such as may not be left open.
SECTIONS = ("body", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "ul", "ol", "figure", "blockquote")
_REST = r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+>"""
_NAMES = "|".join(dict.fromkeys(("title", "h1", "table", "tbody", "thead", "tfoot", "tr", "td", "th", *SECTIONS)))
CUT = rf"(?is)<!--.*?(?:-->|\z)|<(script|style)\b{_REST}.*?(?:</\1\s*+>|\z)|</?(?:{_NAMES})\b{_REST}"
_TAG = rf"(?s)<[!?/a-zA-Z]{_REST}"
_ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def decoded(text: Column) -> Column:
    """Entities by name or number as characters; names and numbers that mean nothing stay as written."""
    table = F.create_map(*(F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))))
    number = lambda n: F.when(n.rlike("^#[0-9]+$"), F.substring(n, 2, 9).cast("int")).when(n.rlike("^#[xX]"), F.conv(F.substring(n, 3, 9), 16, 10).cast("int"))
    valid = lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
    wide = lambda c: F.lpad(F.hex(c), 4, "0")
    pair = lambda c: F.concat(F.hex(0xD800 + F.shiftright(c - 0x10000, 10)), F.hex(0xDC00 + (c - 0x10000).bitwiseAND(0x3FF)))
    char = lambda c: F.decode(F.unhex(F.when(c < 0x10000, wide(c)).otherwise(pair(c))), "UTF-16BE")
    of = lambda n: F.when(valid(number(n)), char(number(n))).otherwise(F.try_element_at(table, n))
    names = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(1))
    signs = F.transform(names, lambda n: F.coalesce(of(n), F.concat(F.lit("&"), n, F.lit(";"))))
    between = F.split(text, _ENTITY, -1)
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("a"), signs.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit(""))))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def _net(opens: Column, closes: Column, order) -> tuple[Column, Column]:
    """How many are open after a row, ends without a beginning being passed over; and whether the row's own end counts."""
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = opens.cast("int") - closes.cast("int")
    now, was = F.sum(step).over(upto), F.coalesce(F.sum(step).over(before), F.lit(0))
    return now, was


def cuts(pages: DataFrame) -> DataFrame:
    """id, i (from 0), tag (lower case, empty for the beginning and what shows no text), closes, start and stop (places of the tag, from 0), text (after it) of pages (id, html)."""
    page = F.coalesce("html", F.lit(""))
    found = F.concat(F.array(F.lit("")), F.regexp_extract_all(page, F.lit(CUT), F.lit(0)))
    rows = pages.select("id", F.posexplode(F.arrays_zip(found.alias("tag"), F.split(page, CUT, -1).alias("text"))).alias("i", "x")).select("id", "i", "x.tag", "x.text")
    order = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("tag") + F.length("text")).over(order), F.lit(0)).cast("int")
    name = F.lower(F.regexp_extract("tag", "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    shown = F.when(name.isin("script", "style"), "").otherwise(name)
    return rows.select("id", "i", shown.alias("tag"), F.col("tag").startswith("</").alias("closes"), start.alias("start"), (start + F.length("tag")).alias("stop"), decoded(F.regexp_replace("text", _TAG, " ")).alias("text"))


def _depth(rows: DataFrame, name: str, is_one: Column) -> DataFrame:
    """Adds ``name``: how many of these elements the row lies in, its own counted at both of its tags; 0 for ends that match nothing."""
    order = Window.partitionBy("id").orderBy("i")
    now, was = _net(is_one & ~F.col("closes"), is_one & F.col("closes"), order)
    counted = rows.withColumns({"__now": now, "__was": was})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low, low_before = F.least(F.lit(0), F.min("__now").over(upto)), F.least(F.lit(0), F.coalesce(F.min("__now").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.when(is_one & F.col("closes"), F.col("__was") - low_before).otherwise(F.col("__now") - low)
    return counted.withColumn(name, inside.cast("int")).drop("__now", "__was")


def _instance(rows: DataFrame, name: str, depth: str, is_one: Column) -> DataFrame:
    """Adds ``name``: the i of the element's beginning that the row lies in."""
    by = Window.partitionBy("id", depth).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.max(F.when(is_one & ~F.col("closes"), F.col("i"))).over(by))


def texts_within(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """spans (id, i, last, ...) with ``text``: the texts after the cuts i to last - 1, joined by blanks. Both sides grow with the pages, however small the planner takes them to be, so neither is sent whole."""
    known = rows.select("id", "i", "text").hint("merge")
    alone = spans.where("last = i + 1").join(known, ["id", "i"])
    wide = spans.where("last > i + 1").select("id", "i", F.explode(F.sequence("i", F.col("last") - 1)).alias("k")).join(known.withColumnRenamed("i", "k"), ["id", "k"])
    joined = wide.groupBy("id", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ").alias("text"))
    return alone.unionByName(spans.where("last > i + 1").join(joined.hint("merge"), ["id", "i"]))


def _ends(rows: DataFrame, tag: str) -> DataFrame:
    """id, i, last, start, stop (of the whole element) of each element of this kind; one not closed ends at the next of its kind, or with the page."""
    size = F.max("i").over(Window.partitionBy("id")) + 1
    sized = rows.withColumns({"__size": size, "__end": F.max("stop").over(Window.partitionBy("id"))}).where(F.col("tag") == tag)
    each = Window.partitionBy("id").orderBy("i")
    ended = sized.select("id", "i", "closes", "start", F.coalesce(F.lead("i").over(each), F.col("__size")).alias("last"), F.coalesce(F.lead("stop").over(each), F.col("__end")).alias("stop"))
    return ended.where("not closes").drop("closes")


def headings(rows: DataFrame) -> DataFrame:
    """id, field (document.title, document.h1), start, stop, text (not cleaned) of ``cuts``: all titles as one, and the first h1 of each section as one."""
    titles = texts_within(_ends(rows, "title"), rows).withColumn("field", F.lit("document.title"))
    section = F.col("tag").isin(*SECTIONS)
    placed = _instance(_depth(rows.withColumn("__h1", (F.col("tag") == "h1") & ~F.col("closes")), "__deep", section), "__in", "__deep", section)
    first = placed.where("__h1").groupBy("id", "__deep", "__in").agg(F.min("i").alias("i")).select("id", "i")
    h1 = texts_within(_ends(rows, "h1").join(first.hint("merge"), ["id", "i"]), rows).withColumn("field", F.lit("document.h1"))
    both = titles.unionByName(h1).groupBy("id", "field")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ")
    return both.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), listed.alias("text"))


def cells(rows: DataFrame) -> DataFrame:
    """id, row (number of the tr among all of the page's that lie in a table, from 1), i, start, stop, text (not cleaned) of every cell of ``cuts``."""
    is_table, is_tr, is_group, is_cell = F.col("tag") == "table", F.col("tag") == "tr", F.col("tag").isin("tbody", "thead", "tfoot"), F.col("tag").isin("td", "th")
    size, end = F.max("i").over(Window.partitionBy("id")) + 1, F.max("stop").over(Window.partitionBy("id"))
    sized = _depth(rows.withColumns({"__size": size, "__end": end}), "__deep", is_table).where((is_table | is_tr | is_group | is_cell) & (F.col("__deep") > 0))
    placed = _instance(sized, "__in", "__deep", is_table)
    upto = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("row", F.sum((is_tr & ~F.col("closes")).cast("int")).over(upto).cast("int"))
    own = Window.partitionBy("id", "__deep", "__in").orderBy("i")
    # the last beginning or end of a row in this table: a cell counts where that is a beginning
    state = F.max(F.when(is_tr | is_group | is_table, F.struct("i", (is_tr & ~F.col("closes")).alias("open"), "row"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = numbered.withColumns({"__state": state, "last": F.coalesce(F.lead("i").over(own), F.col("__size")), "__stop": F.coalesce(F.lead("start").over(own), F.col("__end"))})
    spans = held.where(is_cell & ~F.col("closes") & F.col("__state.open")).select("id", F.col("__state.row").alias("row"), "i", "last", "start", F.col("__stop").alias("stop"))
    return texts_within(spans, rows).select("id", "row", "i", "start", "stop", "text")
