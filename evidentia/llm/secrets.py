"""Secrets in whole texts, found by expressions of the JVM alone.

Base kinds, each leftmost and non-overlapping (positions are code points, ends exclusive):

- ``assign``: the whole match of ``ASSIGN``, if its second group has 6 characters or more;
- ``access``: ``AKIA`` and following capitals or digits, 20 characters or more;
- ``hex``: a run of ``0-9a-f`` of 24 characters or more.

Positions come from the texts between matches: split() and regexp_extract_all() cut a text at the same
places, so lengths add up to offsets.

The method adds ``entropy``: candidate strings (runs of 20 or more of ``A-Za-z0-9+/_=-``) in which some
window of ``WINDOW`` characters has a Shannon entropy at or above the bound of its character class (the
narrowest of ``CLASSES`` that holds the whole candidate). A window's entropy is log2(W) - S/W with S the sum
of c*log2(c) over the counts c; sliding adds one character and removes one, so S changes by two
differences read from the counts. The allow-list drops words and identifiers (letters in one case per
part), numbers and dates, UUIDs, and samples that say EXAMPLE; a candidate that overlaps a base span is
dropped too. Base spans are never suppressed.

Defined results: null text is empty (no spans); empty tables give no rows; repeated rows are judged alike;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import only

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Matches that are placed together.
CHUNK = 512
#: Pattern of a whole candidate, alphabet, bits that some window must have; the first that fits counts.
CLASSES = (
    (r"^[0-9a-fA-F]+$", 3.0),
    (r"^[0-9a-z]+$", 3.5),
    (r"^[0-9A-Z]+$", 3.5),
    (r"^[A-Za-z0-9+/_=-]+$", 3.7),
)
#: What parts words within a candidate, and words that are no secrets where a candidate has no others.
PARTS, WORD = r"[-_/+=]+", r"^([A-Z]?[a-z]*|[A-Z]+)$"
#: Whole candidates that are no secrets.
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"EXAMPLE",
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NONE = "cast(array() as array<struct<start:int,end:int,body:string>>)"


def bound(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def located(text: str, pattern: str) -> str:
    """SQL: array of (start, end, body) of the pattern's matches in the column ``text``.

    Matches are placed within chunks of ``CHUNK`` and chunks after one another, so that no long array grows by one element at a time.
    """
    p = _quoted(pattern)
    pairs = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (s, m) -> struct(s as s, m as m))"
    one = (
        f"aggregate(ch, named_struct('at', 0, 'found', {_NONE}), (a, x) -> named_struct("
        "'at', a.at + length(x.s) + coalesce(length(x.m), 0), "
        "'found', if(x.m is null, a.found, concat(a.found, array(named_struct('start', a.at + length(x.s), 'end', a.at + length(x.s) + length(x.m), 'body', x.m))))))"
    )
    chunks = bound(pairs, "all_of", f"transform(sequence(0, cast((size(all_of) - 1) div {CHUNK} as int)), j -> slice(all_of, j * {CHUNK} + 1, {CHUNK}))")
    starts = "aggregate(cs, named_struct('at', 0, 'offs', cast(array() as array<int>)), (a, c) -> named_struct('at', a.at + c.at, 'offs', concat(a.offs, array(a.at)))).offs"
    moved = "transform(c.found, f -> named_struct('start', f.start + o, 'end', f.end + o, 'body', f.body))"
    return bound(f"transform({chunks}, ch -> {one})", "cs", f"flatten(zip_with(cs, {starts}, (c, o) -> {moved}))")


def largest_entropy(body: str, window: int = WINDOW) -> str:
    """SQL: the largest Shannon entropy, in bits, of any window of the string ``body`` (all of it, if shorter), by incremental counts.

    Counts are packed, eight of five bits to a number; each step adds the character that enters, takes away the one that leaves, and
    changes the sum of c * log2(c) by the two differences. Characters are cut once, so time grows with the length.
    """
    if window > 31:
        raise ValueError("a window has 31 characters at most")
    f = [c * math.log2(c) if c > 1 else 0.0 for c in range(window + 2)]
    gain = "array(" + ", ".join(f"{f[c + 1] - f[c]!r}D" for c in range(window + 1)) + ")"
    count = lambda x: f"cast(shiftright(a.c[shiftright({x}, 3)], 5 * ({x} & 7)) & 31L as int)"
    change = lambda x: f"if({x} >= 0 and k = shiftright({x}, 3), shiftleft(1L, 5 * ({x} & 7)), 0L)"
    step = (
        f"(a, p) -> named_struct('i', a.i + 1, "
        f"'c', if(p.x = p.y, a.c, transform(a.c, (v, k) -> v + {change('p.x')} - {change('p.y')})), "
        f"'s', if(p.x = p.y, a.s, a.s + {gain}[{count('p.x')}] - if(p.y < 0, 0D, {gain}[{count('p.y')} - 1])), "
        f"'least', if(a.i >= {window}, least(a.least, a.s), a.least))"
    )
    codes = f"transform(split({body}, ''), ch -> instr({_quoted(ALPHABET)}, ch) - 1)"
    pairs = f"zip_with(cs, slice(concat(array_repeat(-1, {window}), cs), 1, size(cs)), (x, y) -> struct(x as x, y as y))"
    start = f"named_struct('i', 0, 'c', array_repeat(0L, {-(-len(ALPHABET) // 8)}), 's', 0D, 'least', double('infinity'))"
    w = f"least({window}, length({body}))"
    return f"if(length({body}) = 0, 0D, log2({w}) - {bound(codes, 'cs', f'aggregate({pairs}, {start}, {step}, a -> least(a.least, a.s))')} / {w})"


def clear_of(candidate: str, known: str) -> str:
    """SQL: the candidates that overlap no known span, both in order of their starts; each is looked at once."""
    of = lambda spans, is_known: f"transform({spans}, x -> struct(x.start as start, x.end as end, x.body as body, {is_known} as known))"
    span = "named_struct('start', x.start, 'end', x.end, 'body', x.body)"
    step = (
        f"(a, x) -> if(x.known, named_struct('reach', greatest(a.reach, x.end), 'held', filter(a.held, h -> h.end <= x.start), 'found', a.found), "
        f"named_struct('reach', a.reach, 'held', if(a.reach > x.start, {_NONE}, array({span})), 'found', concat(a.found, a.held)))"
    )
    merged = f"aggregate(array_sort(concat({of(known, 'true')}, {of(candidate, 'false')})), named_struct('reach', 0, 'held', {_NONE}, 'found', {_NONE}), {step}, a -> concat(a.found, a.held))"
    return f"if(size({known}) = 0 or size({candidate}) = 0, {candidate}, {merged})"


def suspicious(body: str, classes: tuple = CLASSES, allowed: tuple = ALLOWED) -> str:
    """SQL: whether a candidate is allowed by no entry of the list and has a window with enough entropy for its class."""
    bound = "case " + " ".join(f"when {body} rlike {_quoted(p)} then {bits}D" for p, bits in classes) + " else double('infinity') end"
    listed = " or ".join([f"forall(split({body}, {_quoted(PARTS)}), w -> w rlike {_quoted(WORD)})", *(f"{body} rlike {_quoted(p)}" for p in allowed)])
    return f"(not ({listed}) and {largest_entropy(body)} >= {bound})"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans``: array of (start, kind_at, kind, end, body), ordered by start, then kind as listed."""
    rows = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    words = " or ".join(f"contains(lower(t), '{w}')" for w in ("password", "passwd", "secret", "token", "api"))
    base = rows.select(
        "doc_id",
        "t",
        F.expr(f"if({words}, filter({located('t', ASSIGN)}, x -> length(regexp_extract(x.body, {_quoted(ASSIGN)}, 2)) >= 6), {_NONE})").alias("assign"),
        F.expr(f"if(contains(t, 'AKIA'), {located('t', ACCESS)}, {_NONE})").alias("access"),
        F.expr(f"if(t rlike {_quoted(HEX)}, {located('t', HEX)}, {_NONE})").alias("hex"),
        F.expr(f"if(t rlike {_quoted(CANDIDATE)}, {located('t', CANDIDATE)}, {_NONE})").alias("candidate"),
    )
    tagged = lambda k: f"transform({k}, x -> struct(x.start as start, {KINDS.index(k)} as kind_at, '{k}' as kind, x.end as end, x.body as body))"
    known = base.select("doc_id", "candidate", F.expr(f"array_sort(concat({', '.join(tagged(k) for k in KINDS[:3])}))").alias("known"))
    clear = clear_of("candidate", "known")
    added = known.select("doc_id", "known", F.expr(f"filter({clear}, x -> {suspicious('x.body')})").alias("entropy"))
    return added.select("doc_id", F.expr(f"if(size(entropy) = 0, known, array_sort(concat(known, {tagged('entropy')})))").alias("spans"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans (``kind:start:end`` by start, then kind, joined by commas)."""
    joined = lambda a: f"array_join(transform({a}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}")
    return secret_spans(docs, id_col, text_col).select(
        "doc_id", *(count(k) for k in KINDS), F.expr(f"sha2({joined("filter(spans, x -> x.kind != 'entropy')")}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans")
    )
