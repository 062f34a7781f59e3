"""Entity resolution against the ordered pass in plain Python."""

import re
from difflib import SequenceMatcher

import numpy as np
import pytest

from evidentia.operators import graph, resolve


def plain_name(s):
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\b(mattress|matress|bed)\b", " ", (s or "").lower())).strip()


def ordered_pass(rows, threshold=0.93):
    entities, out = [], {}
    for pid, company, brand, name, _, sure in sorted(rows, key=lambda r: r[4]):
        key = plain_name(name)
        found = next((e for e in entities if e[0] == (company or "", plain_name(brand)) and (e[1] == key or SequenceMatcher(None, e[1], key).ratio() >= threshold)), None)
        if found is None:
            entities.append([(company or "", plain_name(brand)), key, sure or 0.0, pid])
            out[pid] = pid
        else:
            out[pid] = found[3]
            if (sure or 0.0) > found[2]:
                found[1:3] = key, sure
    return out


def names(rng, n):
    """Names and variants with characters changed, dropped, doubled or swapped at random places."""
    base = [" ".join("".join(rng.choice(list("aeioulnrst"), size=int(rng.integers(2, 9)))) for _ in range(int(rng.integers(1, 7)))) for _ in range(max(3, n // 12))]
    out = []
    for _ in range(n):
        s = list(base[rng.integers(0, len(base))])
        for _ in range(int(rng.integers(0, 5))):
            k = int(rng.integers(0, len(s)))
            s[k : k + 1] = [[], ["x"], [s[k], s[k]], [s[k], "é"]][rng.integers(0, 4)]
            s = s or ["q"]
        out.append("".join(s) + (" Mattress" if rng.random() < 0.3 else ""))
    return out


@pytest.mark.parametrize("threshold", [0.93, 0.85])
def test_as_the_ordered_pass(spark, threshold):
    rng = np.random.default_rng(21)
    rows = [(i, ["c", "d", None][rng.integers(0, 3)], ["B-1", "b 1", None][rng.integers(0, 3)], s, int(p), float(rng.choice([0.3, 0.6, 0.9]))) for i, (s, p) in enumerate(zip(names(rng, 500), rng.permutation(500), strict=True))]
    rows += [(1000, "c", "b", "", 1000, None), (1001, "c", "b", None, 1001, 0.5), (1002, "c", "b", "a", 1002, 0.5)]
    df = spark.createDataFrame(rows, "product_id long, company string, brand string, name string, ordinal long, confidence double").repartition(5)
    found = {r.product_id: r.entity_id for r in resolve.resolve(df, threshold).collect()}
    want = ordered_pass(rows, threshold)
    assert found == want and len(set(want.values())) < len(want) - 50
    assert resolve.resolve(df.where("false")).count() == 0


def test_no_similar_pair_is_missed(spark):
    rng = np.random.default_rng(22)
    keys = sorted({plain_name(s) for s in names(rng, 400)})
    df = spark.createDataFrame([("x", k) for k in keys], "block string, key string")
    found = {(r.known, r.new) for r in resolve.alike(df).collect()}
    assert found == {(a, b) for a in keys for b in keys if a != b and SequenceMatcher(None, a, b).ratio() >= 0.93}


def test_components(spark):
    rng = np.random.default_rng(23)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 260)] + [(7, 7)]
    label = {x: x for l in links for x in l}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: c for x, c in label.items() if any(x in l and l[0] != l[1] for l in links)}
