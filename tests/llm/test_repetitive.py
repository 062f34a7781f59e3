"""Repetitive texts in bounded memory, and columns with the operators' own names."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import decontaminate, line_dedup, ngram_join


def bands_of(items, texts):
    raw = [t.encode() for t in texts]
    edges = np.append(0, np.cumsum([len(t) for t in raw]))
    return sorted(decontaminate.Items([(i, t.encode()) for i, t in enumerate(items)]).bands(np.frombuffer(b"".join(raw), np.uint8), edges))


def test_bands_in_parts(monkeypatch):
    rng = np.random.default_rng(31)
    some = lambda n: "".join(rng.choice(list("ab"), size=n, p=[0.9, 0.1]))
    items, texts = [some(int(n)) for n in rng.integers(8, 60, 12)], [some(int(n)) for n in rng.integers(0, 150, 9)]
    texts += ["x" + items[3] + "y", items[5] * 3]
    whole = bands_of(items, texts)
    assert len(whole) > 50
    for size in (1, 17, 500):
        monkeypatch.setattr(decontaminate, "MEETINGS", size)
        assert bands_of(items, texts) == whole


def test_dashes_in_bounded_memory(spark):
    items = spark.createDataFrame([(1, "-" * 1000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a" + "-" * 3000 + "b"), (2, "- " * 50), (3, "-" * 999)], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == {1, 3}
    tracemalloc.start()
    found = bands_of(["-" * 1000], ["-" * 30_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 250e6


def test_own_names(spark):
    """Callers' columns that bear the operators' names come back as they were."""
    docs = spark.createDataFrame([(1, "one two three four five six seven eight", "x"), (2, "one two three four five six seven eight", "y"), (None, "other text\nother text", "z")], "doc_id long, text string, gone string")
    docs = docs.withColumns({c: F.lit(c) for c in ("hit", "__hit", "__gone", "__doc", "of_doc", "lines_gone")})
    items = spark.createDataFrame([(1, "nowhere to be found here")], "item_id long, text string")
    for made, ids in ((decontaminate.decontaminate(docs, items), {1, 2, None}), (ngram_join.one_of_each(docs), {1, None}), (line_dedup.without_repeated_lines(docs), {1, 2, None})):
        rows = made.collect()
        assert made.columns == docs.columns and {r.doc_id for r in rows} == ids
        assert all(r["hit"] == "hit" and r["__doc"] == "__doc" and r.gone in "xyz" for r in rows)


def test_pipeline_keeps_own_columns(spark):
    import corpus_pipeline

    rows = [(i, f"the words of this text are {i}", "en", "mine", 7.0) for i in range(8)] + [(8, None, "en", "null", 1.0), (9, "...", "en", "dots", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, Score double")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == rows[:8]
