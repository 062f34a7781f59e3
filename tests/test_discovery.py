"""Search answers of every shape, the fused order, and frames of pictures."""

import json

from evidentia.operators import discovery, visual

MARKDOWN = "intro\nTitle: Ortho Mattress\nURL Source: https://www.acme.com/products/ortho.\nlayer density\n[2] [Blog post](https://other.org/x)\nTitle: none here\ntext\nTitle:   Cat\nURL: http://b.org/catalogue.pdf;)"
ANSWERS = [
    ("web", 1, "q1", MARKDOWN, None),
    ("web", 2, "q2", json.dumps({"data": [{"url": " https://acme.com/a ", "title": " T ", "description": "d"}, {"sourceURL": "ftp://no"}, {"sourceURL": "https://b.org/mattress", "title": ""}, "x"]}), None),
    ("web", 3, "q3", None, "timed out"),
    ("web", 4, "q4", json.dumps({"data": {"url": "https://one.org/"}}), None),
    ("scored", 1, "q1", json.dumps({"results": [{"url": "https://c.org/z.,", "title": "Z", "score": 0.4, "content": "c"}, {"url": ""}], "usage": {"credits": 1}}), None),
    ("model", 1, "q1", json.dumps({"candidates": [{"groundingMetadata": {"groundingChunks": [{"web": {"uri": "https://g.org/1;", "title": "G"}}, {}]}, "content": {"parts": [{"text": "see https://g.org/1 and (https://g.org/2)."}]}}]}), None),
    ("web", 5, "q5", "[]", None), ("web", 6, "q6", "", None), ("web", 7, "q7", json.dumps([{"url": "https://acme.com/a"}]), None),
]


def answers(spark):
    return spark.createDataFrame(ANSWERS, "service string, query_number int, query string, body string, error string")


def test_results(spark):
    found = [(r.service, r.query_number, r["rank"], r.url, r.title) for r in discovery.results(answers(spark)).orderBy("service", "query_number", "rank").collect()]
    assert found == [
        ("model", 1, 1, "https://g.org/1", "G"), ("model", 1, 2, "https://g.org/1", None), ("model", 1, 3, "https://g.org/2", None), ("scored", 1, 1, "https://c.org/z", "Z"),
        ("web", 1, 1, "https://www.acme.com/products/ortho", "Ortho Mattress"), ("web", 1, 2, "https://other.org/x", "Blog post"), ("web", 1, 3, "http://b.org/catalogue.pdf", "Cat"),
        ("web", 2, 1, "https://acme.com/a", "T"), ("web", 2, 2, "https://b.org/mattress", None), ("web", 4, 1, "https://one.org/", None), ("web", 7, 1, "https://acme.com/a", None),
    ]


def test_order(spark):
    log = discovery.discovery_log(answers(spark), "acme.com")
    kept = {(r.service, r.url) for r in log.where("accepted").collect()}
    assert ("web", "https://other.org/x") not in kept and ("web", "https://one.org/") not in kept and ("web", "https://acme.com/a") in kept and ("scored", "https://c.org/z") in kept
    assert [(r.query_number, r.error) for r in log.where("kind = 'error'").collect()] == [(3, "timed out")]
    first = [(r.url, r.service, r.query_number) for r in discovery.accepted(log, ("scored", "web"), 4).collect()]
    assert first == [("https://c.org/z", "scored", 1), ("https://www.acme.com/products/ortho", "web", 1), ("http://b.org/catalogue.pdf", "web", 1), ("https://acme.com/a", "web", 2)]
    assert discovery.accepted(log, ("scored", "web", "model")).count() == 7


def test_material_results(spark):
    rows = [(1, "k", "http://a", 0.9), (2, "k", "http://a", 0.9), (3, "x", "http://a", 0.9), (4, "l", "ftp://a", 0.9), (5, "l", "https://b", 0.4), (6, "l", "https://b", 0.5), (7, "k", "http://c", 0.7), (8, None, None, None)]
    found = spark.createDataFrame(rows, "ordinal int, key string, url string, relevance double")
    keys = spark.createDataFrame([("k",), ("l",), (None,)], "key string")
    assert sorted(r.ordinal for r in discovery.material_results(found, keys, 2).collect()) == [1, 6]
    assert sorted(r.ordinal for r in discovery.material_results(found, keys, 9).collect()) == [1, 6, 7]


def test_reader(spark):
    rows = [("a", "Title: Page One\n\nURL Source: https://x.org/p\n\nMarkdown"), ("b", json.dumps({"data": {"title": " T ", "content": "c", "publishedTime": "2024"}})), ("c", json.dumps({"url": "https://y.org", "markdown": "m"})), ("d", None), ("e", "[1]"), ("f", "plain")]
    found = {r.asked: (r.url, r.title, r.content, r.published_at) for r in discovery.read_pages(spark.createDataFrame(rows, "asked string, body string")).collect()}
    assert found == {"a": ("https://x.org/p", "Page One", rows[0][1], None), "b": ("b", "T", "c", "2024"), "c": ("https://y.org", None, "m", None), "f": ("f", None, "plain", None)}


def test_visual(spark):
    payload = {
        "asset_type": "cutaway", "diagram_summary": "s", "technology_terms": ["gel", "coil"],
        "products": [{"name": " Ortho ", "layers": [{"position": 1, "marketing_name": "Top", "normalized_material": "memory_foam", "thickness_mm": 50, "region": {"x": 1}, "confidence": 0.8}, {"position": 2}]}, {"name": "", "family": "Fam", "layers": [{"position": 1, "density_kg_m3": "40"}]}],
        "unassigned_regions": [{"position": 3, "visual_description": "grey band", "generic_material_class": "foam", "confidence": 0.5}],
    }
    rows = [(1, "p", "a", "l", json.dumps(payload), 0.9, True, 0.7, "h"), (2, "p", "a", "l", None, None, None, None, None), (3, "p", "a", "l", "{}", None, None, None, None), (4, "p", "a", "l", "[1]", None, None, None, None), (5, "p", "a", "l", '{"asset_type": "x"}', None, None, None, None)]
    assets = spark.createDataFrame(rows, "asset_id long, page_url string, asset_url string, local_path string, vision_payload string, vision_confidence double, vision_verified boolean, vision_priority double, perceptual_hash string")
    found = {r.asset_id: (r.asset_type, r.products, r.technology_terms, r.confidence) for r in visual.visual_evidence(assets).collect()}
    assert found == {1: ("cutaway", "Ortho", "gel | coil", 0.9), 5: ("x", "", "", None)}
    layers = [(r.product, r.position, r.normalized_material, r.thickness_mm, r.density_kg_m3, r.region, r.assignment_scope, r.callout_text) for r in visual.visual_layers(assets).orderBy("asset_id", "ordinal").collect()]
    assert layers == [
        (" Ortho ", 1, "memory_foam", 50.0, None, '{"x":1}', None, None), (" Ortho ", 2, None, None, None, None, None, None), ("Fam", 1, None, None, 40.0, None, None, None),
        (None, 3, None, None, None, None, "unassigned visual region", "grey band"),
    ]
    asked = spark.createDataFrame([(1, "a", "p", ["q2", "q1", "q2"], ["u", None]), (2, "b", "p", ["q1"], None)], "asset_id long, asset_url string, page_url string, queries array<string>, followup_urls array<string>")
    got = [(r.asset_id, r.record_type, r.query_or_url) for r in visual.visual_search(asked).orderBy("asset_id", "ordinal").collect()]
    assert got == [(1, "forensic_query", "q2"), (1, "forensic_query", "q1"), (1, "followup_url", "u"), (2, "forensic_query", "q1")]
