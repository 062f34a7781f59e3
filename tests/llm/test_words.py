"""Words that a hash linear in places would take for one another, very long words, and items too short for q-grams."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from evidentia.llm import _text, decontaminate, line_dedup, ngram_join, queries, secrets, substring_dedup, token_shards, url_filter


def turned(n, a="a", b="b"):
    """The word of n letters whose letter i is b where i has an odd number of ones."""
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


ODD = [turned(n, *ab) for n in (1024, 2048) for ab in ("ab", "ba")]


def test_hashes_differ():
    words = [*ODD, "a", "b", "abcdefgh", "abcdefghi", "x" * 70_000, "x" * 70_001]
    text = " ".join(words).encode()
    found = _text.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert len(set(found.hash.tolist())) == len(words)


def test_equal_hashes_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(_text, "hashes", lambda raw, start, end: (end - start).astype(np.uint64))
    path = queries.tokenizer_path()
    texts = [" ".join(ODD), "one two six ten", "ten, six. two", ""]
    plain = Tokenizer.from_file(path)
    assert [x.tolist() for x in token_shards.Encoder(path).encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_operators_on_such_words(spark):
    from tokenizers import Tokenizer

    filler = " ".join(f"f{i}" for i in range(60))
    texts = [f"{w} {filler} {w}" for w in ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
    assert removed == {0: 0, 1: 60, 2: 60, 3: 60}
    assert {r.n_shingles for r in ngram_join.jaccard_components(docs).collect()} == {59}
    t = Tokenizer.from_file(queries.tokenizer_path())
    for r in token_shards.token_shards(docs, queries.tokenizer_path()).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4").tobytes())


def entropy_spans(text):
    """The method's spans by plain counting."""
    import math

    base = [m.span() for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6] + [m.span() for m in re.finditer(secrets.ACCESS, text)] + [m.span() for m in re.finditer(secrets.HEX, text)]
    out = []
    for m in re.finditer(secrets.CANDIDATE, text):
        body = m[0]
        if any(a < m.end() and m.start() < b for a, b in base) or all(re.fullmatch(r"[A-Z]?[a-z]*|[A-Z]+", w) for w in re.split(secrets.PARTS, body)) or any(re.search(p, body) for p in secrets.ALLOWED):
            continue
        most = 0.0
        for i in range(max(1, len(body) - secrets.WINDOW + 1)):
            w = body[i : i + secrets.WINDOW]
            most = max(most, -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)))
        if most >= next(bits for p, bits in secrets.CLASSES if re.search(p, body)) - 1e-9:
            out.append(m.span())
    return out


def test_entropy_against_counting(spark):
    import random

    rng = random.Random(3)
    made = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    letters = secrets.ALPHABET
    texts = ["", "plain words only", made(40, "ab"), "a-b" * 3000, f"x {made(30, '0123456789abcdef')} y", f"key {made(20_000, letters)}"]
    texts += [" ".join(made(rng.randint(5, 60), rng.choice((letters, "abcdef0123", "ABCDE0", "aB1"))) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts += [" ".join(f"{made(24, '0123456789abcdef')} {made(25, letters)}" for _ in range(1500))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.secret_report(docs).collect():
        found = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("entropy")]
        assert found == entropy_spans(texts[r.doc_id]), r.doc_id


def test_short_items_are_whole_words(spark):
    docs = spark.createDataFrame([(1, "so  a  Yes, it is"), (2, "yesterday"), (3, None), (4, "A b yes")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "yes"), (2, " A B "), (3, ""), (4, "is")], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1, 7, 10, 0), (1, 4, 15, 17, 0), (4, 2, 0, 3, 0), (4, 1, 4, 7, 0)}


def test_rules_as_listed(spark):
    pages = spark.createDataFrame([(1, "http://a.Example.COM/x"), (2, "http://b.org/P/q"), (3, "http://b.org/p")], "page_id long, url string")
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, [("block", "Example.com"), ("block", "b.org/P")]).collect()}
    assert found == {1: ("Example.com", "block"), 2: ("b.org/P", "block"), 3: (None, "allow")}


def test_single_edits_always_meet(spark):
    """One character or one word within 0.2 of the line: every such pair is found."""
    import random

    rng = random.Random(9)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    pairs = []
    for _ in range(300):
        words = [word(rng.randint(2, 9)) for _ in range(rng.randint(1, 29))]
        line = " ".join(words)
        if len(line) < 10:
            continue
        i = rng.randrange(len(words))
        changed = [*words]
        changed[i] = word(len(words[i])) if len(words[i]) <= 0.2 * len(line) and rng.random() < 0.5 else words[i][:-1] + "z"
        pairs.append((line, " ".join(changed)))
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(x for p in pairs for x in p)], "doc_id long, text string")
    keep = {r.doc_id: r.keep_doc_id for r in line_dedup.fuzzy_lines(rows).collect()}
    assert all(keep[2 * i + 1] == 2 * i for i in range(len(pairs)))
    assert rows.where(F.col("doc_id") < 0).count() == 0
