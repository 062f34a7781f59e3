"""The pipeline's stages on the smallest tables, each held against brute force on its own input."""

import os
import re
from collections import Counter, defaultdict

import pytest

from evidentia.llm._io import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def duplicates(rows):
    """doc_ids that are not the smallest of their group."""
    sets, at = {}, defaultdict(set)
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
        for s in sets[r.doc_id]:
            at[s].add(r.doc_id)
    both = Counter((a, b) for ids in at.values() for a in ids for b in ids if a < b)
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            head[b] = a
    return {i for i in sets if find(i) != i}


def test_stages(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    one = stored(stages["language_id"](spark, docs, SF))
    assert one.columns == names and docs.count() - one.count() <= 2
    two = stored(stages["near_duplicates"](spark, one, SF))
    before = {r.doc_id for r in one.collect()}
    assert {r.doc_id for r in two.collect()} == before - duplicates(one.collect()) and two.columns == names
    three = stored(stages["decontamination"](spark, two, SF))
    flat = lambda t: " ".join(t.split()).casefold()
    items = [flat(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in two.collect() if not any(i in flat(r.text) for i in items)}
    assert {r.doc_id for r in three.collect()} <= clean and len(clean) - three.count() <= 2
    four = stored(stages["mixture"](spark, three, SF))
    counts = Counter(r.doc_id for r in four.collect())
    assert four.columns == names and max(counts.values()) <= 3 and set(counts) <= clean
    five = stages["token_shards"](spark, four, SF)
    assert five.count() == four.count() and five.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_short_clean_documents_stay(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    short = [(-1, "A.", "en"), (-2, "Avec.", "fr"), (-3, "Lllldoado.", "es"), (-4, "Qx", "en"), (-5, "A.\nAll rights reserved.", "en")]
    blank = [(-6, " 12 -", "en"), (-7, None, "en"), (-8, "", "en")]
    rows = docs.union(spark.createDataFrame(short + blank, docs.schema))
    found = {r.doc_id for r in corpus_pipeline.language(spark, rows, SF).collect()}
    assert found == {r.doc_id for r in rows.collect() if any(map(str.isalpha, r.text or ""))}
    assert found >= {-1, -2, -3, -4, -5} and not found & {-6, -7, -8}
