"""Language identification by hyperdimensional profiles.

Every letter has a random vector of -1 and 1, made from its code point alone. A trigram's vector binds (by
product) its letters' vectors, the first permuted twice, the second once, the third not; the permutation is
a cyclic shift. A text's vector bundles (adds) those of its trigrams, words being lower-cased runs of letters
with one blank on either side; everything that is not a letter is a blank. A language's prototype is the sum
of the unit vectors of its training texts, and a text gets the language whose prototype has the largest
cosine with it.

Training adds up integer vectors (unit vectors times 2^20, rounded), one partial sum per language and batch,
so the prototypes do not depend on how rows are dealt. Only they (languages times ``DIMENSIONS`` numbers,
at most ``MOST_LANGUAGES``) reach the driver.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any training row every
text is ``und`` with score 0; ties go to the first language by code point; rows with null language do not
train; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batches_of, only

DIMENSIONS = 1024
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
SCALE = float(1 << 20)
#: Trigram vectors that a task keeps at hand; others are made anew.
REMEMBERED = 1 << 15


class Profiles:
    """Turns texts into bundled vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.table = np.zeros((1024, dimensions), np.int8)
        self.row: dict[int, int] = {}
        self.letter = np.zeros(0x110000, bool)
        self.letter[[i for i in range(0x110000) if chr(i).isalpha()]] = True

    def vector(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64(code + 7_000_003)).integers(0, 2, self.d, dtype=np.int8)
            self.letters[code] = bits * 2 - 1
        return self.letters[code]

    def bound(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.vector(a), 2) * np.roll(self.vector(b), 1) * self.vector(c)

    def rows(self, codes: list[int]) -> np.ndarray:
        if len(self.row) + len(codes) > REMEMBERED:
            self.row = {}
        if len(codes) > REMEMBERED:
            return np.array([self.bound(c) for c in codes], np.int8)
        out = np.empty(len(codes), np.int64)
        for i, c in enumerate(codes):
            k = self.row.get(c)
            if k is None:
                k = self.row[c] = len(self.row)
                if k >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[k] = self.bound(c)
            out[i] = k
        return self.table[out]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the text's trigram vectors; None without a letter."""
        if not text:
            return None
        u = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        is_letter = self.letter[u]
        if not is_letter.any():
            return None
        u = np.where(is_letter, u, 32)
        u = u[np.append(True, is_letter[1:] | is_letter[:-1])]
        tri = u[:-2] << 42 | u[1:-1] << 21 | u[2:]
        tri = tri[(u[1:-1] != 32)]
        codes, n = np.unique(tri, return_counts=True)
        total = np.zeros(self.d, np.float64)
        for i in range(0, len(codes), 4096):
            total += n[i : i + 4096].astype(np.float32) @ self.rows(codes[i : i + 4096].tolist()).astype(np.float32)
        return np.rint(total)


def _train(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                v = profiles.bundle(text.as_py())
                if v is not None and lang is not None and (size := np.sqrt(v @ v)):
                    sums.setdefault(lang, np.zeros(dimensions, np.int64))
                    sums[lang] += np.rint(v / size * SCALE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"])

    return run


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their unit prototypes."""
    batches_of(rows.sparkSession, 500)
    parts = only(rows, text=text_col, lang=lang_col).where("lang is not null").mapInArrow(_train(dimensions), "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    packed = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    found = sorted((r.lang, [x.x for x in r.v]) for r in packed.limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    proto = np.array([x for _, x in found], np.float64).reshape(len(found), dimensions)
    return [x for x, _ in found], proto / np.maximum(np.sqrt((proto**2).sum(1, keepdims=True)), 1e-12)


def _predict(langs: list[str], proto: np.ndarray, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for batch in batches:
            pred, score = [], []
            for text in batch.column(batch.num_columns - 1):
                v = profiles.bundle(text.as_py()) if langs else None
                if v is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                else:
                    cosine = proto @ v / max(np.sqrt(v @ v), 1e-12)
                    k = int(cosine.argmax())
                    pred.append(langs[k])
                    score.append(round(float(min(1.0, max(0.0, cosine[k]))), 9))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, if None) with lang_pred and score, in place of columns of these names."""
    batches_of(docs.sparkSession, 500)
    langs, proto = model
    kept = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in (text_col, "lang_pred", "score")], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(_predict(langs, proto, proto.shape[1]), f"{schema}{', ' if schema else ''}lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that never train: crc32 of the identifier's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that are not held out."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    return predict(rows, model, "text", ["doc_id", "held_out"])
