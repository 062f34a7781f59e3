"""Material names in texts with their places, and the layers that the words around them describe."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..functions.text import clean_text
from ..sources import dims

#: Characters on either side of a name that may hold its measures, mentions a text may give, and layers kept of a text.
AROUND, MOST, LAYERS = 180, 500, 20


WORD, GAP = re.compile("[a-z0-9]+"), re.compile(r"[\s_-]+")


def by_first_word() -> dict[str, list[tuple[int, tuple[str, ...], str]]]:
    """Names by their first word: rank (the longest name first), words, material."""
    out: dict[str, list[tuple[int, tuple[str, ...], str]]] = {}
    for rank, (alias, material) in enumerate(dims.aliases()):
        words = tuple(alias.split())
        out.setdefault(words[0], []).append((rank, words, material))
    return out


def named_in(text: str, names: dict[str, list[tuple[int, tuple[str, ...], str]]]) -> dict[tuple[int, int, str], int]:
    """(start, stop, material) of every name in a text, with its rank: the text's words are walked once, a name goes on over blanks, underscores and hyphens."""
    # lower-casing that changes a text's length would shift places, so it is done by character
    low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    words = [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
    joined = [GAP.fullmatch(low, a[2], b[1]) is not None for a, b in zip(words, words[1:], strict=False)]
    found: dict[tuple[int, int, str], int] = {}
    for i, (word, start, _) in enumerate(words):
        for rank, want, material in names.get(word, ()):
            last = i + len(want) - 1
            if last < len(words) and all(joined[i:last]) and all(words[i + k][0] == w for k, w in enumerate(want)):
                found.setdefault((start, words[last][2], material), rank)
    return found


def mentions(texts: DataFrame, most: int = MOST) -> DataFrame:
    """id, alias, material, start, stop, context of every name in texts (id, text); a part within a longer name counts too.

    Places are code points of the text, end exclusive. The first ``most`` names found, longest names first, as the feature's bound. Null texts have none.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = by_first_word()
        for batch in batches:
            out = []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                if isinstance(text, str):
                    ranked = sorted((rank, *place) for place, rank in named_in(text, names).items())[:most]
                    out += [(i, text[a:b], m, a, b, text[max(0, a - AROUND) : b + AROUND]) for _, a, b, m in sorted(ranked, key=lambda x: (x[1], -x[2], x[3]))]
            yield pd.DataFrame(out, columns=["id", "alias", "material", "start", "stop", "context"])

    return texts.select("id", "text").mapInPandas(run, f"id {kind}, alias string, material string, start int, stop int, context string")


def layers(texts: DataFrame) -> DataFrame:
    """id, position, marketing_name, material, thickness_mm, density: mentions with measures near by, each triple once, by place, LAYERS at most."""
    context = clean_text("context")
    found = mentions(texts, 300).select("id", "start", "stop", "material", F.initcap(clean_text("alias")).alias("marketing_name"), units.first_thickness_mm(context).alias("thickness_mm"), units.density_kg_m3(context).alias("density"))
    order = [F.col("start"), F.desc("stop"), F.col("material")]
    once = found.withColumn("__n", F.row_number().over(Window.partitionBy("id", "material", "thickness_mm", "density").orderBy(*order))).where("__n = 1")
    placed = once.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("position") <= LAYERS)
    return placed.select("id", "position", "marketing_name", "material", "thickness_mm", "density")
