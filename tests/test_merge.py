"""Merging against record-by-record rules in plain Python, and canonical addresses against the standard library."""

import functools
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import numpy as np
from pyspark.sql import functions as F

from evidentia.functions import urls
from evidentia.operators import merge

LISTS = ("layers", "variants", "source_ids", "tags")


def random_layers(rng):
    return [
        {"position": int(rng.integers(1, 4)), "marketing_name": [None, "", "n"][rng.integers(0, 3)], "material": "xyz"[rng.integers(0, 3)], "thickness_mm": [None, 5.0, 9.0][rng.integers(0, 3)], "thickness_status": "ab"[rng.integers(0, 2)],
         "density": [None, 30.0][rng.integers(0, 2)], "density_status": "cd"[rng.integers(0, 2)], "evidence": [f"e{k}" for k in rng.integers(0, 4, rng.integers(0, 3))]} for _ in range(rng.integers(0, 4))
    ]


def random_product(rng, k):
    pick = lambda *values: values[rng.integers(0, len(values))]
    return {
        "product_id": f"p{k}", "company": "c", "brand": pick("b", None), "name": pick("Alpha", "alpha", "Beta", None), "family": pick(None, "", "f"), "canonical_url": None, "description": pick(None, "", "d1", "d2"), "firmness": pick(None, "Firm"),
        "total_mm": pick(None, 0.0, 200.0), "weight_kg": pick(None, 0.0, 20.0), "price": pick(None, 0.0, 99.0), "currency": pick(None, "INR"), "layers": random_layers(rng),
        "variants": [{"variant_id": pick("v", "w"), "size_name": pick("q", "k"), "width_mm": 1.0, "length_mm": 2.0} for _ in range(rng.integers(0, 3))], "source_ids": [pick("s1", "s2", "s3") for _ in range(rng.integers(0, 3))],
        "tags": [pick("t1", "t2")], "method": "html", "confidence": pick(0.5, 0.7, 0.9),
    }


def pairwise(a, b):
    lead, rest = (b, a) if b["confidence"] > a["confidence"] else (a, b)
    out = {**lead, **{f: rest[f] for f in merge.FILLED if lead[f] in (None, "")}, "method": "merged"}
    out["variants"] = list(({v["variant_id"]: v for v in lead["variants"]} | {v["variant_id"]: v for v in rest["variants"]}).values())
    out["layers"] = merge.merged_layers(lead["layers"], rest["layers"])
    return out | {f: list(dict.fromkeys(lead[f] + rest[f])) for f in ("source_ids", "tags")}


def rows_of(spark, extra, rows):
    schema = f"{extra}, {merge.PRODUCT}"
    names = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_fold(spark):
    rng = np.random.default_rng(3)
    rows = [random_product(rng, k) | {"entity_id": int(rng.integers(0, 40)), "ordinal": k} for k in range(160)]
    by = {}
    for r in rows:
        by.setdefault(r["entity_id"], []).append(r)
    found = merge.fold(rows_of(spark, "entity_id long, ordinal long", rows).withColumn("extra", F.lit(1)).repartition(5)).collect()
    assert {r.entity_id for r in found} == set(by)
    for r in found:
        want, mine = functools.reduce(pairwise, by[r.entity_id]), r.asDict(recursive=True)
        if len(by[r.entity_id]) == 1:
            want = want | {f: list({v["variant_id"]: v for v in want[f]}.values()) if f == "variants" else list(dict.fromkeys(want[f])) for f in ("variants", "source_ids", "tags")}
        blank = {f: None for f in merge.FILLED if want[f] == ""}
        assert {c: mine[c] for c in merge.COLUMNS} == {c: want[c] for c in merge.COLUMNS} | blank


def read_twice(first, second):
    out = [dict(x) for x in first]
    for new in second:
        old = next((x for x in out if (x["name"] or "").lower() == (new["name"] or "").lower() and (x["name"] is None) == (new["name"] is None)), None)
        if old is None:
            out.append(dict(new))
            continue
        layers = [dict(x) for x in old["layers"]]
        last = {x["material"]: x for x in layers}
        for x in new["layers"]:
            if x["material"] not in last:
                layers.append({**x, "position": len(layers) + 1, "evidence": list(dict.fromkeys(x["evidence"]))})
                last[x["material"]] = layers[-1]
                continue
            known = last[x["material"]]
            for value, status in (("thickness_mm", "thickness_status"), ("density", "density_status")):
                if known[value] is None and x[value] is not None:
                    known[value], known[status] = x[value], x[status]
            known["evidence"] = list(dict.fromkeys([*known["evidence"], *x["evidence"]]))
        for c in ("description", "firmness", "total_mm", "weight_kg", "currency"):
            old[c] = old[c] or new[c]
        old["price"] = new["price"] if old["price"] is None else old["price"]
        old["variants"] = [v for i, v in enumerate([*old["variants"], *new["variants"]]) if v not in [*old["variants"], *new["variants"]][:i]]
        old |= {"layers": layers, "source_ids": list(dict.fromkeys(old["source_ids"] + new["source_ids"])), "method": "merged", "confidence": max(old["confidence"], new["confidence"])}
    return out


def plain(v):
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else None if v in ("", 0.0) else v


def unique(r):
    """Lists as merging leaves them, whether or not anything was merged."""
    r = dict(r)
    r["variants"] = [v for i, v in enumerate(r["variants"]) if v not in r["variants"][:i]]
    r["source_ids"] = list(dict.fromkeys(r["source_ids"]))
    r["layers"] = [x | {"evidence": list(dict.fromkeys(x["evidence"]))} for x in r["layers"]]
    return r


def test_within_document(spark):
    rng = np.random.default_rng(4)
    make = lambda: [random_product(rng, k) | {"doc_id": d, "nth": n} for k, (d, n) in enumerate((d, n) for d in range(25) for n in range(rng.integers(0, 4)))]
    first, second = make(), make()
    found = merge.within_document(*(rows_of(spark, "doc_id long, nth long", r) for r in (first, second))).collect()
    for d in range(25):
        want = read_twice([r for r in first if r["doc_id"] == d], [r for r in second if r["doc_id"] == d])
        mine = [r.asDict(recursive=True) for r in sorted((r for r in found if r.doc_id == d), key=lambda r: (r.reading, r.nth))]
        assert [plain(unique({c: r[c] for c in merge.COLUMNS})) for r in mine] == [plain(unique({c: r[c] for c in merge.COLUMNS})) for r in want]


def standard(url):
    s = urlsplit(url)
    path = re.sub("/{2,}", "/", s.path or "/")
    path = path if path == "/" else path.rstrip("/")
    port = "" if s.port in (None, 0, 80, 443) else f":{s.port}"
    query = urlencode(sorted((k, v) for k, v in parse_qsl(s.query) if k.lower() not in urls.TRACKING))
    return urlunsplit((s.scheme.lower() or "https", f"{(s.hostname or '').lower()}{port}", path, query, ""))


def test_canonical(spark):
    rng = np.random.default_rng(5)
    bits = ["%", "%2", "%zz", "%41", "%C3%A9", "%FF", "+", "=", "&", "a", "Ref", "ref=1", "utm_source=x", "~", "*", "é", " ", "/", "//", ";", "x=1", "b=2=", "%26", "%3D", "-_.!'()"]
    some = lambda n: "".join(rng.choice(bits, size=int(rng.integers(0, n))))
    made = [f"{'HTTP' if i % 3 else 'https'}://{['Example.com', 'u:p@a.B', 'x.org:8080', 'x.org:80'][i % 4]}/{some(4).replace('%', 'p')}?{some(9)}" + ("#f?x" if i % 5 == 0 else "") for i in range(400)]
    made += ["http://a.com/?x=100%", "http://a.com/?x=%zz", "http://a.com", "https://a.com:443/x//y//", "http://a.com/?b=2&a=1&a=0&c=&d"]
    df = spark.createDataFrame([(u,) for u in made], "u string")
    for r in df.select("u", urls.canonical(F.col("u")).alias("c")).collect():
        assert r.c == standard(r.u), r.u
    odd = spark.createDataFrame([("a.com/x",), ("",), ("%",), ("mailto:x",), ("://",), ("http://",), (None,)], "u string").select(urls.canonical(F.col("u")).alias("c")).collect()
    assert [r.c for r in odd[:3]] == ["https:///a.com/x", "https:///", "https:///%"] and odd[-1].c is None
