"""Operators 11 to 13 against brute force, on random and on awkward rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import code_compression, lexical_search, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(120)] + ["the", "of", "É1", "Straße", "x-y"]
    share = 1 / np.arange(1, len(names) + 1)
    return [" ".join(rng.choice(names, size=int(rng.integers(1, 90)), p=share / share.sum())) for _ in range(n)]


def ranked(docs, items, k):
    terms = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    n, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    counts = [(d, len(t), Counter(t)) for d, t in terms]
    df = Counter(w for _, _, c in counts for w in c)
    out = []
    for i, text in items:
        rows = []
        for d, size, c in counts:
            m = 50 + (50 * size * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(TERM.findall((text or "").translate(LOWER))) if c[w])
            if score > 0:
                rows.append((-score, d is None, d, score))
        out += [(i, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [3, 50])
def test_search(spark, k):
    docs = list(enumerate([*texts(1, 150), None, "", "...", "W1 w1 w1 rare", "w1 " * 5000]))
    docs += [docs[0], docs[7], (None, docs[7][1])]
    items = [(i, t) for i, t in enumerate(texts(2, 12))] + [(20, None), (21, "!!"), (22, "rare"), (23, "absent"), (24, "É1 RARE the the")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"term": F.lit(1), "item": F.lit("x")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(0))
    assert found(lexical_search.ranked_search(d, q, k)) == ranked(docs, items, k)


def test_search_tiers(spark, monkeypatch):
    """Every list in the last tiers, or all in the first: the same answer."""
    docs, items = list(enumerate(texts(3, 80))), list(enumerate(texts(4, 6)))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for cuts in ((0, 0, 0), (10**15, 10**15, 10**15)):
        monkeypatch.setattr(lexical_search, "CUTS", cuts)
        assert found(lexical_search.ranked_search(d, q, 5)) == ranked(docs, items, 5)
    terms = lexical_search.item_terms(q)
    assert found(lexical_search.search(lexical_search.build(d), terms, 5)) == ranked(docs, items, 5)


def test_search_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.ranked_search(none, items).count() == 0
    assert lexical_search.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.where("false")).count() == 0


def compressed(rows):
    """Codes and errors by plain search, with Python's integers."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    w = len(kept[0][1]) // 4
    cut = [[v[p * w : (p + 1) * w] for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for r in range(5):
        codes = [[near(c[p], books[p]) for p in range(4)] for c in cut]
        for p in range(4) if r < 4 else ():
            for k in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    error = [sum(d for d, _ in code) for code in codes]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] += e
    return [(i, bytes(k for _, k in code).hex(), e, by_label[label]) for (i, _, label), code, e in zip(kept, codes, error, strict=True)], books


@pytest.mark.parametrize("scale", [1.0, 0.004, 20000.0])
def test_codes(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale], int(rng.integers(0, 3)) or None) for i in range(320)]
    rows += [(1000 + i, rows[i][1], 7) for i in range(20)]  # equal vectors
    bad = [(400, None, 1), (401, [1.0] * 7 + [float("nan")], 1), (402, [1.0] * 7 + [None], 1), (403, [float("-inf")] * 8, 1), (404, [], 1), (405, [1.0] * 6, 1), (406, [1.0] * 12, 1)]
    want, books = compressed(rows)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumns({"v": F.lit(1), "code": F.lit("x")}).repartition(3)
    got = code_compression.compress(df).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(want)
    assert {r.codebooks_sha256 for r in got} == {code_compression.codebooks_hash(np.array(books))}


def test_annuli():
    rng = np.random.default_rng(6)
    for width, scale in ((1, 3), (3, 50), (16, 400), (16, 1 << 26)):
        book, x = rng.integers(-scale, scale + 1, (200, width)), rng.integers(-scale, scale + 1, (1500, width))
        book[50:60] = book[3]
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        code, error = code_compression.Annuli(book).nearest(x)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()


def test_few_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert code_compression.compress(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, [1.0] * 4, None), (2, [2.0] * 4, 1), (2, [3.0] * 4, 1), (3, [1e30] * 4, 1)]
    got = sorted((r.vec_id or 0, r.code, r.error) for r in code_compression.compress(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, "03030303", 0), (2, "00000000", 0), (2, "01010101", 0), (3, "02020202", 0)]


def based(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed)


def awkward():
    rng = np.random.default_rng(7)
    pieces = ["a", "bé", "漢字", "#x$", "<|>", "\n", " ", "\t", "\r\n", "\n\n", "\x0b", "\x85", " ", "😀", "a b c ", "same line\n"]
    return [None, "", "\n", " \n a\n a\na", "a b c a b c", "x " * 400, "end\nend", "\nend\nend\n", *("".join(rng.choice(pieces, size=int(rng.integers(1, 150)))) for _ in range(150))]


def scored(docs, trusted):
    """Mean log ratios with buckets kept apart, in floating point."""
    grams = [(d, [*w, *zip(w, w[1:], strict=False)]) for d, w in ((d, WORD.findall(t or "")) for d, t in docs)]
    raw, target = Counter(g for _, x in grams for g in x), Counter(g for d, x in grams if d in trusted for g in x)
    scale = sum(raw.values()) / max(sum(target.values()), 1)
    return {d: sum(math.log((target[g] * scale + 4) / (raw[g] + 4)) for g in x) / max(len(x), 1) for d, x in grams}


def test_rules(spark):
    docs = list(enumerate(awkward())) + [(9, "a b"), (None, "z " * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "trusted": F.lit(1), "kept": F.lit(0)})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df, labels).collect()]
    assert sorted(got, key=str) == sorted(((d, *based(t)) for d, t in docs), key=str)
    assert all(r.kept != r.base_failed for r in quality.judge(df, labels).collect())
    assert quality.judge(df.where("false"), labels).count() == 0


def test_likelihood(spark):
    rng = np.random.default_rng(10)
    good = [f"{t} clean words " + " ".join(f"c{i}" for i in rng.permutation(90)[:60]) for t in texts(8, 120)]
    junk = [" ".join(f"{w}%%%" for w in t.split()) + " %%%" * 40 + " " + " ".join(f"j{i}%%%" for i in range(40)) for t in texts(9, 30)]
    docs = list(enumerate(good + junk))
    labels = [(d, int(d < 120), 0) for d, _ in docs if d % 2 == 0] + [(3, 1, 1), (4, 0, 0), (None, 1, 0)]
    trusted = {d for d in range(0, 120, 2)} - {4}
    df, ls = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.trusted for r in quality.trusted_ids(ls).collect()} == trusted and quality.trusted_ids(ls, 7).count() == 7
    got = {r.doc_id: r for r in quality.judge(df, ls).collect()}
    want = scored(docs, trusted)
    for d, t in docs:
        assert abs(got[d].score - want[d]) < 0.05  # buckets are shared at times
        assert got[d].base_failed == based(t)[-1] and got[d].kept == (not got[d].base_failed and d < 120)
    rest = quality.keep(df.withColumn("gone", F.lit(1)), ls)
    assert {r.doc_id for r in rest.collect()} == {d for d in got if got[d].kept} and rest.columns == ["doc_id", "text", "gone"]
