"""Text normalisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of names too general to be a product's, words that make "mattress" general when they follow it, and general names of one word (fixed values).
GENERIC_STARTS = ("mattresse", "mattress category product", "best mattresse")
GENERIC_SECOND = ("in", "for", "near", "store")
GENERIC_WORDS = ("product", "products", "mattress", "mattresses", "shop")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """White space of any kind, no-break space included, as single blanks; none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?U)\s+", " "))


def normalized_name(c: Column | str) -> Column:
    """Lower case, without the words for bed and mattress, letters a to z and digits only."""
    bare = F.regexp_replace(F.lower(_col(c)), r"\b(mattress|matress|bed)\b", " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def term_key(c: Column | str) -> Column:
    """Key of a trade name: without marks, lower case, letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(_col(c), "[™®©]", "")), r"[^a-z0-9]+", " "))


def is_general_name(c: Column | str) -> Column:
    """A category's, a shop's or a search's name: by how it starts, by the word after "mattress", or as an offer to buy online."""
    t = F.lower(clean_text(c))
    words = F.split(t, " ")
    # a word up to its first mark, so that "in-store" counts as "in"
    word = lambda i: F.regexp_extract(F.coalesce(F.get(words, F.lit(i)), F.lit("")), "^[a-z0-9_]*", 0)
    starts = F.lit(False)
    for g in GENERIC_STARTS:
        starts = starts | t.startswith(g)
    bare = (F.get(words, F.lit(0)) == "mattress") & word(1).isin(*GENERIC_SECOND)
    offer = (F.get(words, F.lit(0)) == "buy") & F.coalesce(F.get(words, F.lit(1)).isin("mattresse", "mattresses"), F.lit(False)) & (word(2) == "online")
    return starts | F.coalesce(bare, F.lit(False)) | F.coalesce(offer, F.lit(False))


def is_specific_name(c: Column | str) -> Column:
    """Not a general name, and of two words or with a digit."""
    t = clean_text(c)
    general = (t == "") | is_general_name(c) | F.lower(t).isin(*GENERIC_WORDS)
    return ~general & ((F.size(F.split(t, " ")) >= 2) | t.rlike("[0-9]"))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """prefix, underscore and 16 hex digits of the SHA-256 of the trimmed lower-case parts joined by bars; null reads ``none``."""
    cleaned = [F.lower(F.trim(F.coalesce(_col(p).cast("string"), F.lit("None")))) for p in parts]
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *cleaned), 256), 1, 16))


def searchable(*parts: Column | str) -> Column:
    """Parts that are not blank, joined by blanks."""
    return F.concat_ws(" ", *(F.when(F.trim(_col(p)) != "", _col(p)) for p in parts))


def slug(c: Column | str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("company"))


def context(c: Column | str, start: Column, stop: Column, radius: int = 150) -> Column:
    """Clean text from ``radius`` characters before a place (from 0, end exclusive) to as many after it."""
    begin = F.greatest(F.lit(0), start - radius)
    return clean_text(F.substring(_col(c), begin + 1, stop + radius - begin))


def chosen(first: Column, second: Column) -> Column:
    """The first unless it is null or an empty text."""
    return F.coalesce(F.when(first.cast("string") != "", first), second)


def spreadsheet_text(c: Column | str) -> Column:
    """Clean text without the escapes that spreadsheets put in place of control characters."""
    return clean_text(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "(?i)_x[0-9a-f]{4}_", " "))


def shortest_number(c: Column) -> Column:
    """A number with six significant digits and no trailing zeros."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-300))))).cast("int")
    fixed = F.round(c * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10f", fixed), "0+$", ""), r"[.]$", "")
