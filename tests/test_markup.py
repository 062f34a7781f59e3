"""Markup and nested JSON as rows, on fixtures and against plain walks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import markup
from evidentia.functions.text import clean_text
from evidentia.operators import page_facts, walk

PAGES = {
    1: "<html><head><title>A &amp; B</title></head><body><h1>One <i>two</i></h1><h1>no</h1><div><h1>other section</h1></div></body></html>",
    2: "<table><tr><th>a<td>b<tr><td>c</td><td> </td><td>d&nbsp;e</td></table>",
    3: "<table><tr><td>out<table><tr><td>x</td><td>y</td></tr></table>side</td><td>last</td></tr></table>",
    4: "<table><td>no row</td><tr><td>1</td><!-- <td>2</td> --><td>3<script>var a = '<td>';</script></td></tr></tr><td>after</td></table><tr><td>outside</td><td>z</td></tr>",
    5: "",
    6: None,
    7: "<TABLE><TBODY><TR CLASS='a>b'><TD title=\"</td>\">p</TD><TD>q</TBODY><tr><td>r</td><td>s</td></tr></table></table><table><tr><td>t<td>u",
    8: "<h1>never closed <p>text &#8377;5 &#x1F600; &bogus; &#0;",
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(PAGES.items()), "id int, html string")
    return markup.cuts(df).persist()


def test_places(rows):
    for r in rows.where("id is not null").collect():
        page = PAGES[r.id] or ""
        assert r.tag == "" or page[r.start : r.stop].lower().lstrip("</").startswith(r.tag)


def test_headings(rows):
    found = {(r.id, r.field): r.t for r in markup.headings(rows).withColumn("t", clean_text("text")).collect()}
    assert found == {(1, "document.title"): "A & B", (1, "document.h1"): "One two other section", (8, "document.h1"): "never closed text ₹5 😀 &bogus; &#0;"}


def test_tables(rows):
    found = {}
    for r in page_facts.table_rows(rows).collect():
        found.setdefault(r.id, {})[r.row] = r.text
    assert found == {
        2: {1: "a | b", 2: "c | d e"},
        3: {1: "out x y side | last", 2: "x | y"},
        4: {1: "1 | 3"},
        7: {1: "p | q", 2: "r | s", 3: "t | u"},
    }


def test_most_rows(spark):
    page = "<table>" + "".join(f"<tr><td>a{i}</td>" + ("" if i in (4, 5) else "<td>b</td>") + "</tr>" for i in range(1, 12)) + "</table>"
    rows = markup.cuts(spark.createDataFrame([(1, page)], "id int, html string"))
    # the first row with two cells numbered 4 or more is the last
    assert sorted(r.row for r in page_facts.table_rows(rows, 4).collect()) == [1, 2, 3, 6]


def test_page_observations(spark):
    page = """<title>Alpha</title><meta name="description" content="Nice &amp; soft"><script type="application/ld+json">
    [{"@type": "product", "name": "Alpha Mattress", "brand": "Own", "offers": {"lowPrice": "19,999"}}, {"@type": "Product", "name": "", "isRelatedTo": {"@type": [["PRODUCT"]], "name": "Inner", "offers": []}}, {"@type": "Offer", "name": "x"}]
    </script><script type="application/ld+json">{broken</script><table><tr><td>Core<td>40 kg/m3 latex</table>"""
    df = spark.createDataFrame([(7, page, 0.95), (8, None, 0.5)], "id long, html string, reliability double")
    found = {(r.field, r.value, round(r.confidence, 4), r.locator) for r in page_facts.page_observations(df, "Acme").collect()}
    one = "JSON-LD script 1 "
    assert found == {
        ("document.title", "Alpha", 0.85, "HTML structured data"), ("document.description", "Nice & soft", 0.8, "HTML structured data"), ("product.name", "Alpha Mattress", 0.95, one + "0"), ("product.brand", "Own", 0.95, one + "0"),
        ("commercial.price", "19999.0", 0.95, one + "0 offers"), ("product.brand", "Acme", 0.95, one + "1"), ("product.name", "Inner", 0.95, one + "1.isRelatedTo"), ("table.row", "Core | 40 kg/m3 latex", 0.82, "HTML table row 1"),
        ("measurement.density_kg_m3", "40.0", 0.92, "HTML table row 1"), ("material.mention", "latex", 0.88, "HTML table row 1"),
    }


def plain_walk(v, path=()):
    yield path, v
    for k, x in sorted(v.items()) if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from plain_walk(x, (*path, str(k)))


def random_json(rng, deep):
    kind = rng.integers(0, 6 if deep else 4)
    if kind == 4:
        return {f"k{i}": random_json(rng, deep - 1) for i in range(rng.integers(0, 4))}
    if kind == 5:
        return [random_json(rng, deep - 1) for _ in range(rng.integers(0, 4))]
    return [None, True, int(rng.integers(-9, 9)), "té\"xt"][kind]


def test_walk(spark):
    rng = np.random.default_rng(1)
    docs = [(i, {"a": random_json(rng, 5), "b": [random_json(rng, 3)]}) for i in range(40)]
    deep = json.loads("[" * 30 + "1" + "]" * 30)
    docs.append((99, deep))
    df = spark.createDataFrame([*((i, json.dumps(d)) for i, d in docs), (100, "no json"), (101, None)], "id long, json string")
    got = walk.walk(df).withColumn("t", F.when(F.col("kind") == "value", walk.text_of(F.col("v")))).orderBy("id", "place").collect()
    want = [(i, ".".join(p), v) for i, d in docs for p, v in plain_walk(d)]
    assert [(r.id, r.path) for r in got] == [(i, p) for i, p, _ in want]
    for r, (_, _, v) in zip(got, want, strict=True):
        assert r.kind == ("object" if isinstance(v, dict) else "array" if isinstance(v, list) else "value")
        assert r.t == (None if v is None or isinstance(v, dict | list) else "true" if v is True else str(v))


def test_network(spark):
    body = json.dumps({"items": [{"core": "Pocket-Spring unit", "mm": 50}], "x": "latex"})
    rows = [(1, "u1", "xhr", body, None), (1, "u1", "fetch", None, "kept"), (1, "u2", "image", body, None), (2, None, "fetch", "", ""), (None, "u3", "xhr", "[]", None)]
    df = spark.createDataFrame(rows, "id long, url string, resource_type string, body string, stored_at string")
    found = {(r.id, r.field, r.value, r.material, r.locator, r.confidence) for r in page_facts.network_observations(df).collect()}
    assert found == {
        (1, "network_json.endpoint", "u1", None, "u1", 0.72), (2, "network_json.endpoint", "", None, "", 0.55), (None, "network_json.endpoint", "u3", None, "u3", 0.72),
        (1, "network_json.material_mention", "pocket spring unit", "pocket_spring_unit", "u1", 0.70), (1, "network_json.material_mention", "latex", "natural_latex", "u1", 0.70),
    }
    values = {(r.id, r.path, r.value) for r in page_facts.network_values(df).collect()}
    assert values == {(1, "items.0.core", "Pocket-Spring unit"), (1, "items.0.mm", "50"), (1, "x", "latex")}
